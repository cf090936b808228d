"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A word's symbols start as its characters; an agenda, ordered by the score of the
piece that a pair of neighbours would make and then by place, yields the next
merge until no neighbours make a piece. Characters outside the vocabulary become
byte pieces. Texts fall into segments that no piece can span, so each worker
remembers the ids of words it has met (a bounded number). New words go through
the agenda side by side, one row of a matrix each; long ones and those with
characters outside the vocabulary go through a heap.

Every segment that is encoded for the first time is checked, batch by batch,
against the sentencepiece library, and so is one whole text in `whole_every`; a
difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import lean, pulled, ship, slices
from sheaf.llm.word_ids import WordIds, cut_at

SPACE = "▁"


class Pieces:
    """One vocabulary: encodes and decodes as the library does for identity-normalised BPE models."""

    def __init__(self, model: bytes, remembered: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only merge-type models without normalisation, with a leading space, are supported")
        if any(p.type == 4 for p in spec.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score, self.id, self.byte = {}, {}, [None] * 256
        self.unknown, self.begin, self.end = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        self.out: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            text = b""
            if p.type == 1:
                self.id[p.piece], self.score[p.piece] = i, p.score
                text = p.piece.replace(SPACE, " ").encode()
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                text = train.unk_surface.encode()
            self.out.append(text)
        joined = {c for p in self.id if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or not joined <= self.id.keys():
            raise ValueError("pieces that span words, or whose characters are no pieces, are not supported")
        #: A line feed that no piece holds stands alone; so do the segments around it.
        self.lone_feed = "\n" not in self.id
        self.segment = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.lone_feed else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.feed = np.array(self.merge("\n"), dtype="<u4").tobytes()
        self.words = WordIds(lambda w: self.learn([SPACE + x for x in w]), self.learn, self.feed, True, remembered)
        self.fresh: list[tuple[list[str], list[bytes]]] = []
        # Neighbours (left, right) that make a piece, sorted by left * count + right, and the piece; ranks order pieces by score.
        self.count = len(spec.pieces)
        made = sorted((self.id[p[:k]] * self.count + self.id[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.pairs, self.made = (np.array(x, dtype=np.int64) for x in zip(*made))
        order = sorted(self.id.values(), key=lambda i: (-spec.pieces[i].score, i))
        self.rank = np.zeros(self.count, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order)

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda."""
        symbols, score = list(segment), self.score
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(pair := symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(new := pair + symbols[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, new))
            if (h := before[i]) >= 0:
                s = score.get(new := symbols[h] + pair)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, new))
        ids = []
        for s in symbols:
            if s is not None:
                i = self.id.get(s)
                if i is not None:
                    ids.append(i)
                else:
                    ids.extend(self.byte[b] if self.byte[b] is not None else self.unknown for b in s.encode())
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbours make, or `count` if they make none. Padding is -1."""
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0), self.rank[self.made[at]], self.count)

    def _merge_rows(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda for many segments at once: rows of ids; in each row the best pair merges, until none has any."""
        done, size, live = symbols.copy(), length.copy(), np.arange(len(symbols))
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(live):
            best = ranks.argmin(axis=1)
            r = np.arange(len(live))
            rank = ranks[r, best]
            go = rank < self.count
            if not go.all():
                done[live[~go], : symbols.shape[1]] = symbols[~go]
                live, symbols, ranks, best, rank = live[go], symbols[go], ranks[go], best[go], rank[go]
                r = np.arange(len(live))
                if not len(live):
                    break
            size[live] -= 1
            symbols[r, best] = self.by_rank[rank]
            if symbols.shape[1] == 2:
                done[live, 0] = symbols[:, 0]
                break
            place = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, place + (place > best[:, None]), axis=1)
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place > best[:, None]), axis=1)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._ranks(symbols[left, best[left] - 1], symbols[left, best[left]])
            right = np.flatnonzero(best < symbols.shape[1] - 1)
            ranks[right, best[right]] = self._ranks(symbols[right, best[right]], symbols[right, best[right] + 1])
        return done, size

    def learn(self, segments: list[str]) -> list[bytes]:
        """Ids of new segments."""
        out: list = [None] * len(segments)
        rows, ids = [], self.id.get
        for i, s in enumerate(segments):
            if len(s) <= 32 and None not in (x := list(map(ids, s))):
                rows.append((len(x), i, x))
            else:
                out[i] = np.array(self.merge(s), dtype="<u4").tobytes()
        rows.sort()
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            symbols = np.full((len(part), max(2, part[-1][0])), -1, dtype=np.int64)
            length = np.array([x[0] for x in part])
            symbols[np.arange(symbols.shape[1]) < length[:, None]] = np.concatenate([x[2] for x in part])
            done, size = self._merge_rows(symbols, length)
            flat = done[np.arange(done.shape[1]) < size[:, None]]
            for (_, i, _), got in zip(part, cut_at(flat, np.cumsum(size) - size)):
                out[i] = got
        self.fresh.append((segments, out))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, without begin and end. An empty text has none."""
        lines = [[x.split(" ") for x in t.split("\n")] if t and self.lone_feed and SPACE not in t else [[""]] for t in texts]
        plain = [not any("" in x for x in text) for text in lines]
        known = iter(self.words.encode([x for x, ok in zip(lines, plain) if ok]))
        return [next(known) if ok else self._slow(t) for t, ok in zip(texts, plain)]

    def _slow(self, text: str) -> bytes:
        return b"".join(self.learn(self.segment.findall((" " + text).replace(" ", SPACE)))) if text else b""

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the space that encoding put first goes. Begin and end print nothing."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw

    def check(self) -> None:
        """Compare the segments met since the last call with the library."""
        for segments, got in self.fresh:
            for behind_space in (True, False):
                part = [(s, g) for s, g in zip(segments, got) if (s[0] == SPACE) == behind_space and s not in ("\n", SPACE)]
                # The library puts a space first; a line feed shields segments that have none.
                said = self.library.encode([s[1:] if behind_space else "\n" + s for s, _ in part], num_threads=1)
                skip = 0 if behind_space else 1 + len(self.feed) // 4
                if [g for _, g in part] != cut_at(np.fromiter(chain.from_iterable(x[skip:] for x in said), dtype="<u4"), np.cumsum([0, *(len(x) - skip for x in said)])[:-1]):
                    raise AssertionError("the library encodes a segment of this batch otherwise")
        self.fresh.clear()

    def check_whole(self, text: str, ids: np.ndarray, decoded: bytes) -> None:
        said = self.library.encode(text, add_bos=True, add_eos=True)
        if said != ids.tolist() or self.library.decode(said).encode() != decoded:
            raise AssertionError(f"a text of {len(text)} characters differs from the library's encoding or decoding")


_LOADED: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    name = hashlib.sha256(model).digest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Pieces(model)
    return _LOADED[name]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", whole_every: int = 32) -> DataFrame:
    """One row per row: key, ids binary (little-endian unsigned 32-bit, begin and end id included), n_tokens, decoded.

    Null counts as empty: begin and end id only, decoded to the empty text.
    Repeated rows give repeated rows; other columns are not read. The model file
    (a few MB, fixed) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        p = load(model.value)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (p.begin, p.end))
        for b in slices(batches, "__text", 2 << 20):
            texts = [t or "" for t in pulled(b, "__text").to_pylist()]
            ids, decoded = [begin + x + end for x in p.encode_batch(texts)], []
            for t, got in zip(texts, ids):
                numbers = np.frombuffer(got, dtype="<u4")
                decoded.append(p.decode(numbers))
                if zlib.crc32(t.encode()) % whole_every == 0:
                    p.check_whole(t, numbers, decoded[-1])
            p.check()
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pulled(b, "__key"), pa.array(ids, pa.binary()), n, pa.array(decoded, pa.binary()).cast(pa.string())], names=[key, "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{key}` {kind}, ids binary, n_tokens long, decoded string")
