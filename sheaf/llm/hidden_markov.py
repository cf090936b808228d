"""Language-model scoring with a hidden Markov model.

Tokens are lower-cased words and one end per text. A state emits words: every word
of the training texts has its own expected count in each state, so the model grows
with the vocabulary. All words that training never met are one token. Smoothing
adds one half to each word's count, shared by the states, as in the base, so that
a single state scores as the base does. Transitions and emissions are trained by
Baum-Welch over all training texts, each as a whole.

Neither counts nor expected counts of words fit anywhere in general. They are kept
in shards of the hash space: each chunk of texts asks the shards for its distinct
words, once, and gets their counts back. In each round a chunk sends its expected
counts to the shards and gets the new emission weights back; the texts themselves
lie in buckets and never move. The driver sees the states' own numbers only: starts,
moves, ends and the sums of the emission weights.

Texts are worked on in segments, side by side. What a text's segments know of each
other goes through their transfer matrices (the product of a segment's steps, states
by states), so expected counts and likelihoods are exactly those of the whole text,
however long it is. Words are told apart by 64-bit hashes of their bytes (among
10^9 words two of one hash are expected with probability 0.03).
"""

from __future__ import annotations

import io
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.chunked import GROUP, buckets, joined, numbered, pieces
from sheaf.llm.common import cut, cut_buckets, discard, fold, hashed_words, key_name, lean, lean_group, lean_groups, mix, pulled, ship, slices, tidy, utf8

SYMBOLS = 8  # rows that an emission table has at least; a chunk's has one for each of its words, the end and the unknown
STATES = 4
SEGMENT = 512  # tokens of a text that are worked on one after the other
BLOCK = 1 << 17  # tokens that are worked on side by side
SHARD_WORDS = 1 << 19  # words of chunks that meet in a shard, on average
ASK_WORDS = 1 << 15  # words in a piece of a chunk's question
PAYLOAD, ASK, COUNTS, WEIGHTS, SENT, STATS = range(6)  # what a row holds


@dataclass
class HMM:
    first: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray | None  # symbols x states; a chunk's own
    weight: np.ndarray  # emission weights of the end and the unknown, by state
    mass: np.ndarray  # sums of all emission weights, by state
    train_docs: int
    train_tokens: int
    distinct: int


# --- rows ------------------------------------------------------------------------

LAID = "chunk long, kind int, shard long, piece int, blob binary"
ROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("piece", pa.int32()), ("blob", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(ROW), ROW.types)], schema=ROW)


def _rows(table: pa.Table):
    return zip(*(table.column(c).to_pylist() for c in ROW.names))


def _packed(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(f.getvalue())


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))) as z:
        return {k: z[k] for k in z.files}


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes as the largest needs, behind a byte that tells how many."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(blob: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """n such numbers from place `at`, and the place behind them."""
    width = blob[at]
    return np.frombuffer(blob, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + width * n


def _coded(own: np.ndarray, place: np.ndarray, value: np.ndarray) -> bytes:
    """Words by their ascending numbers in their chunk and in their shard, and for each its count or its weights by state."""
    numbers = b"".join(_narrow(np.diff(x, prepend=0)) for x in (own, place))
    return len(own).to_bytes(4, "little") + numbers + (_narrow(value) if value.ndim == 1 else value.astype("<f4").tobytes())


def _decoded(blob: bytes, states: int = 0, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same back; counts where no states are named."""
    n = int.from_bytes(blob[at : at + 4], "little")
    own, at = _wide(blob, n, at + 4)
    place, at = _wide(blob, n, at)
    value = np.frombuffer(blob, "<f4", n * states, at).reshape(n, states) if states else _wide(blob, n, at)[0]
    return np.cumsum(own), np.cumsum(place), value


# --- chunks and shards -------------------------------------------------------------


def chunks(docs: DataFrame, train, text: str, key: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    """Rows of each chunk, in buckets. Payload: its texts as numbers of its distinct words. Ask: those words' hashes, ascending, and training counts. Stats: training texts, distinct words."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        for name, b in numbered(batches, "__text", chunk_bytes):
            trained = pulled(b, "__train").to_numpy(zero_copy_only=False).astype(bool)
            length, met, index, counts, at = np.zeros(b.num_rows, np.int64), [np.zeros(0, np.uint64)], [], [np.zeros(0)], 0
            for part in slices([b], "__text", 1 << 20):  # distinct words part by part, then of the parts
                h, row = hashed_words(*utf8(pulled(part, "__text")))
                length[at : at + part.num_rows] = np.bincount(row, minlength=part.num_rows)
                u, inverse = np.unique(h, return_inverse=True)
                counts.append(np.bincount(inverse, weights=trained[at + row], minlength=len(u)))
                met.append(u)
                index.append(inverse.astype(np.uint32))
                at += part.num_rows
            u, inverse = np.unique(np.concatenate(met), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
            ends = np.cumsum([len(x) for x in met])
            index = np.concatenate([np.zeros(0, np.uint32), *(inverse[lo:hi].astype(np.uint32)[x] for lo, hi, x in zip(ends, ends[1:], index))])
            keys = b.select(["__key"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as w:
                w.write_batch(keys)
            blob = _packed(keys=np.frombuffer(sink.getvalue(), np.uint8), trained=trained, length=length, index=index, words=np.array([len(u)]))
            rows = [(name, PAYLOAD, 0, i, x) for i, x in enumerate(pieces(blob))]
            for i in range(0, len(u), ASK_WORDS):
                part = slice(i, i + ASK_WORDS)
                rows.append((name, ASK, len(u[part]), i, u[part].astype("<u8").tobytes() + _narrow(count[part])))
            rows.append((name, STATS, 0, 0, np.array([trained.sum(), len(u)], "<f8").tobytes()))
            yield from _table(rows).to_batches()

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), train.alias("__train"))
    return cut_buckets(rows.mapInArrow(lean(run), LAID), "chunk", buckets(spark), "texts", GROUP)


def _dealt(laid: DataFrame, bits: int) -> DataFrame:
    """The chunks' words and training counts dealt to 2^bits shards, which are ranges of the hash."""

    def run(batches):
        for b in batches:
            for name, _, n, first, blob in _rows(pa.Table.from_batches([b])):
                u, count = np.frombuffer(blob, "<u8", n), _wide(blob, n, 8 * n)[0]
                shard = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
                edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
                own, none = np.arange(first, first + n), np.zeros(n, np.int64)
                rows = [(name, ASK, int(shard[x]), first, (y - x).to_bytes(4, "little") + u[x:y].tobytes() + _coded(own[x:y], none[x:y], count[x:y])) for x, y in zip(edges, edges[1:])]
                yield from _table(rows).to_batches()

    return laid.where(F.col("kind") == ASK).mapInArrow(lean(run), LAID)


def _started(u: np.ndarray, total: np.ndarray, states: int, seed: int) -> np.ndarray:
    """First emission weights of words: their smoothed counts, shared by the states, which differ by a factor for each word, from its hash."""
    noise = np.stack([mix(u + np.uint64(0x9E3779B97F4A7C15 * (seed + j + 1) % (1 << 64))) for j in range(states)], axis=1) / 2.0**64 + 0.5
    return ((total[:, None] + 0.5) / states * noise).astype("<f4")


def _answer(states: int, seed: int):
    """One shard: total counts of the words that training texts hold, to every chunk that asked; and the sums of counts, words and first weights."""

    def run(table: pa.Table) -> pa.Table:
        hashes, asks = [], []
        for chunk, _, shard, piece, blob in _rows(table):
            n = int.from_bytes(blob[:4], "little")
            hashes.append(np.frombuffer(blob, "<u8", n, 4))
            own, _, count = _decoded(blob, at=4 + 8 * n)
            asks.append((chunk, shard, piece, own, count))
        u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[4] for a in asks]), minlength=len(u)).astype(np.int64)
        met = total > 0
        place = np.cumsum(met) - 1
        rows, at = [], 0
        for chunk, shard, piece, own, _ in asks:
            k = inverse[at : at + len(own)]
            at += len(own)
            rows.append((chunk, COUNTS, shard, piece, _coded(own[met[k]], place[k][met[k]], total[k][met[k]])))
        sums = np.concatenate([[total.sum(), met.sum()], _started(u[met], total[met], states, seed).sum(axis=0, dtype=float)])
        return _table([*rows, (-1, STATS, asks[0][1], 0, sums.astype("<f8").tobytes())])

    return run


def _renew(states: int):
    """One shard: the sums of its words' expected counts, smoothed, to every chunk that sent some. Statistics are summed."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        if rows[0][1] == STATS:
            return _table([(-1, STATS, rows[0][2], 0, np.sum([np.frombuffer(r[4], "<f8") for r in rows], axis=0).tobytes())])
        sent = [_decoded(r[4], states) for r in rows]
        place = np.concatenate([p for _, p, _ in sent])
        total = np.stack([np.bincount(place, weights=np.concatenate([v[:, j] for _, _, v in sent])) for j in range(states)], axis=1)
        weight = (total + 0.5 / states).astype("<f4")
        return _table([(r[0], WEIGHTS, r[2], r[3], _coded(own, p, weight[p])) for r, (own, p, _) in zip(rows, sent)])

    return run


def _sums(stats: DataFrame, size: int) -> np.ndarray:
    """Element-wise sum of the statistics rows' blobs of `size` numbers each."""

    def unfold(batches):
        for b in batches:
            got = [np.frombuffer(x, "<f8") for x in pulled(b, "blob").to_pylist()]
            if got:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size)), "v": pa.array(np.sum(got, axis=0))})

    out = np.zeros(size)
    for r in stats.where(F.col("kind") == STATS).select("blob").mapInArrow(lean(unfold), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


class _Chunk:
    """One chunk: its texts, and the weights of its words, from the shards' rows or, at first, from counts and hashes."""

    def __init__(self, own: pa.Table, got: pa.Table, hmm: HMM, seed: int):
        kind = own.column("kind").to_numpy()
        self.texts, states = _unpacked(joined(own.filter(pa.array(kind == PAYLOAD)))), len(hmm.first)
        self.words = int(self.texts["words"][0])
        self.count = np.zeros(self.words, np.int64)
        self.rows: list[tuple] = []  # shard, piece, numbers of words here and in the shard
        weight = np.zeros((self.words + 2 + SYMBOLS, states))
        for _, kind_, shard, piece, blob in _rows(got):
            if kind_ == COUNTS:
                here, place, count = _decoded(blob)
                self.count[here] = count
            else:
                here, place, value = _decoded(blob, states)
                weight[here] = value
            if kind_ == WEIGHTS or (kind == ASK).any():
                self.rows.append((shard, piece, here, place))
        for _, _, n, first, blob in _rows(own.filter(pa.array(kind == ASK))):
            u, count = np.frombuffer(blob, "<u8", n), self.count[first : first + n]
            weight[first : first + n] = np.where(count[:, None] > 0, _started(u, count, states, seed), 0)
        self.met = weight[: self.words].any(axis=1)
        weight[self.words : self.words + 2] = hmm.weight
        weight /= hmm.mass
        self.hmm = replace(hmm, emit=weight)

    def sequences(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chosen texts' tokens, ends included, one after the other, and the texts' lengths."""
        length = self.texts["length"]
        symbol = np.where(self.met, np.arange(self.words), self.words + 1).astype(np.int32)
        token = symbol[self.texts["index"][np.repeat(which, length)]]
        n = length[which]
        ends = np.cumsum(n + 1) - 1
        inner = np.ones(len(token) + len(n), dtype=bool)
        inner[ends] = False
        out = np.full(len(inner), self.words, dtype=np.int32)
        out[inner] = token
        return out, n + 1


# --- whole texts, in segments ------------------------------------------------------


@dataclass
class _Segments:
    """Runs of at most SEGMENT tokens, text by text; of each its first token, size, text and number in the text."""

    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, length: np.ndarray) -> _Segments:
        n = -(-length // SEGMENT)
        text = np.repeat(np.arange(len(length)), n)
        number = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        start = (np.cumsum(length) - length)[text] + number * SEGMENT
        return cls(start, np.minimum(length[text] - number * SEGMENT, SEGMENT), text, number)

    def blocks(self, which: np.ndarray):
        """Numbers of segments of falling size, in runs of some BLOCK tokens; with each its live count by step."""
        order = which[np.argsort(-self.size[which], kind="stable")]
        total, lo = np.cumsum(self.size[order]), 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
            some = order[lo:hi]
            z = self.size[some]
            yield some, len(z) - np.searchsorted(z[::-1], np.arange(z[0]), "right")
            lo = hi


def _links(hmm: HMM, token: np.ndarray, length: np.ndarray, seg: _Segments) -> tuple[np.ndarray, np.ndarray]:
    """By segment: the scaled forward vector before it, and the backward vector behind it, over the whole text."""
    k, n = len(hmm.first), -(-length // SEGMENT)
    before, behind = np.zeros((len(seg.start), k)), np.ones((len(seg.start), k))
    long = np.flatnonzero(n > 1)
    if not len(long):
        return before, behind
    step = np.empty((len(seg.start), k, k))
    for some, live in seg.blocks(np.flatnonzero(n[seg.text] > 1)):
        # Rows: the state before the segment. A text's first segment does not depend on it.
        v = np.where((seg.number[some] == 0)[:, None, None], hmm.first[None, None], hmm.move[None]) * hmm.emit[token[seg.start[some]]][:, None, :]
        for t in range(1, len(live)):
            m = live[t]
            w = (v[:m] @ hmm.move) * hmm.emit[token[seg.start[some[:m]] + t]][:, None, :]
            v[:m] = w / w.sum(axis=(1, 2), keepdims=True)
        step[some] = v / v.sum(axis=(1, 2), keepdims=True)
    base = np.cumsum(n) - n
    long = long[np.argsort(-n[long], kind="stable")]
    most = n[long]
    for i in range(1, int(most[0])):
        s = base[long[: np.searchsorted(-most, -i, "left")]] + i  # the texts that have a segment i
        v = step[s - 1][:, 0] if i == 1 else (before[s - 1][:, None, :] @ step[s - 1])[:, 0]
        before[s] = v / v.sum(axis=1, keepdims=True)
    for i in range(int(most[0]) - 1, 0, -1):
        s = base[long[: np.searchsorted(-most, -i, "left")]] + i
        v = (step[s] @ behind[s][:, :, None])[:, :, 0]
        behind[s - 1] = v / v.sum(axis=1, keepdims=True)
    return before, behind


def _alpha(hmm: HMM, token: np.ndarray, seg: _Segments, some: np.ndarray, live: np.ndarray, before: np.ndarray):
    """Scaled forward pass over segments side by side: step and segment of each cell, its symbol, emissions, forward vectors and scales."""
    at = np.concatenate([[0], np.cumsum(live)])
    t_of = np.repeat(np.arange(len(live)), live)
    j_of = np.arange(at[-1]) - at[t_of]
    seq = token[seg.start[some][j_of] + t_of]
    e = hmm.emit[seq]
    a, c = np.empty_like(e), np.empty((len(e), 1))
    edge = at.tolist()
    enter = np.where((seg.number[some] == 0)[:, None], hmm.first, before[some] @ hmm.move)
    for t in range(len(live)):
        x, y = edge[t], edge[t + 1]
        v = (a[edge[t - 1] : edge[t - 1] + y - x] @ hmm.move if t else enter) * e[x:y]
        c[x:y] = v.sum(axis=1, keepdims=True)
        a[x:y] = v / c[x:y]
    return at, t_of, j_of, seq, e, a, c


def expected(hmm: HMM, token: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions of whole texts, by scaled forward and backward passes."""
    k, symbols = len(hmm.first), len(hmm.emit)
    first, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    seg = _Segments.of(length)
    before, behind = _links(hmm, token, length, seg)
    for some, live in seg.blocks(np.arange(len(seg.start))):
        at, t_of, j_of, seq, e, a, c = _alpha(hmm, token, seg, some, live, before)
        b, edge, last = np.empty_like(e), at.tolist(), at[seg.size[some] - 1] + np.arange(len(some))
        b[last] = behind[some] / (a[last] * behind[some]).sum(axis=1, keepdims=True)
        e /= c
        for t in range(len(live) - 1, 0, -1):
            x, y = edge[t], edge[t + 1]
            b[edge[t - 1] : edge[t - 1] + y - x] = (e[x:y] * b[x:y]) @ hmm.move.T
        p = a * b
        p /= p.sum(axis=1, keepdims=True)
        begins = seg.number[some] == 0
        first += p[: edge[1]][begins].sum(axis=0)
        e *= b
        move += hmm.move * (before[some].T @ e[: edge[1]])  # from the segment before; zero where there is none
        later = np.arange(edge[1], edge[-1])
        move += hmm.move * (a[at[t_of[later] - 1] + j_of[later]].T @ e[later])
        for j in range(k):
            emit[:, j] += np.bincount(seq, weights=p[:, j], minlength=symbols)
    return first, move, emit


def forward(hmm: HMM, token: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole text, by the scaled forward recursion."""
    seg, total = _Segments.of(length), np.zeros(len(length))
    before, _ = _links(hmm, token, length, seg)
    for some, live in seg.blocks(np.arange(len(seg.start))):
        _, _, j_of, _, _, _, c = _alpha(hmm, token, seg, some, live, before)
        total += np.bincount(seg.text[some][j_of], weights=np.log(c[:, 0]), minlength=len(total))
    return total


# --- training and scoring -----------------------------------------------------------


def _step(hmm: HMM, seed: int):
    """One chunk: its words' expected counts, to the shards; and the sums of all else."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        c, name = _Chunk(own, got, hmm, seed), own.column("chunk")[0].as_py()
        first, move, emit = expected(c.hmm, *c.sequences(c.texts["trained"]))
        rows = [(name, SENT, shard, piece, _coded(here, place, emit[here])) for shard, piece, here, place in c.rows]
        stats = np.concatenate([first, move.ravel(), emit[c.words], emit[: c.words].sum(axis=0)])
        return _table([*rows, (name, STATS, -1 - name % 64, 0, stats.tobytes())])

    return run


def _grouped(laid: DataFrame, got: DataFrame, at_first: bool):
    """Chunks with the shards' rows for them, which alone move; their words' hashes are read only at first."""
    kinds = [PAYLOAD, ASK] if at_first else [PAYLOAD]
    return laid.where(F.col("kind").isin(kinds)).groupBy("chunk").cogroup(got.groupBy("chunk"))


def fit(laid: DataFrame, rounds: int = 3, states: int = STATES, seed: int = 3) -> tuple[HMM, DataFrame, DataFrame | None]:
    """Baum-Welch over all training texts: the model, the words' counts and, after any round, their weights as rows for the chunks. laid: of `chunks`."""
    n_docs, asked = _sums(laid, 2).astype(int).tolist()
    bits = max(0, (asked // SHARD_WORDS).bit_length())
    counts = cut(_dealt(laid, bits).groupBy("shard").applyInArrow(lean_group(_answer(states, seed)), LAID), "counts", GROUP)
    n_tokens, n_words, *mass = _sums(counts, 2 + states)
    counts = counts.where(F.col("kind") == COUNTS)
    rng = np.random.default_rng(seed)
    weight = (0.5 + np.array([[n_docs], [0]])) / states * rng.uniform(0.5, 1.5, (2, states))
    move = np.eye(states) + rng.uniform(0.5, 1.0, (states, states))
    hmm = HMM(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), None, weight, np.array(mass) + weight.sum(axis=0), n_docs, int(n_tokens) + n_docs, int(n_words) + (n_docs > 0))
    weights = None
    for _ in range(rounds if n_docs else 0):
        old, got = weights, counts if weights is None else weights.where(F.col("kind") == WEIGHTS)
        sent = _grouped(laid, got, old is None).applyInArrow(lean_groups(_step(hmm, seed)), LAID)
        weights = cut(sent.groupBy("shard").applyInArrow(lean_group(_renew(states)), LAID), "weights", GROUP)
        if old is not None:
            discard(old)
        first, move, end, words_ = np.split(_sums(weights, states * (states + 3)), np.cumsum([states, states * states, states]))
        first, move = first + 0.5, move.reshape(states, states) + 0.5
        weight = np.stack([end, np.zeros(states)]) + 0.5 / states
        hmm = HMM(first / first.sum(), move / move.sum(axis=1, keepdims=True), None, weight, words_ + 0.5 * n_words / states + weight.sum(axis=0), n_docs, hmm.train_tokens, hmm.distinct)
    return hmm, counts, None if weights is None else weights.where(F.col("kind") == WEIGHTS)


@tidy
def score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, held: int = 1, rounds: int = 3, states: int = STATES, seed: int = 3) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    Null and empty texts are their end token alone. Rows whose key is null are
    trained on. Without training texts every token has probability 1 in the base,
    and in the model the end and unknown words share it evenly. Repeated rows each
    count; other columns are not read; an empty table gives no rows. A text longer
    than a chunk is one of its own: a task holds some 40 bytes for each of its words,
    and a word longer than a MB is hashed as a whole.
    """
    laid = chunks(docs, fold(key, folds) != held, text, key)
    hmm, counts, weights = fit(laid, rounds, states, seed)
    name = key_name(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def judge(own: pa.Table, got: pa.Table) -> pa.Table:
        c = _Chunk(own, got, hmm, seed)
        z, count = c.texts, c.count
        keys = pa.ipc.open_stream(pa.py_buffer(z["keys"].tobytes())).read_all().column(0)
        n = len(z["length"])
        row, index = np.repeat(np.arange(n), z["length"]), z["index"]
        log_base = np.log10((count + 0.5) / (hmm.train_tokens + 0.5 * (hmm.distinct + 1)))
        end = np.log10((hmm.train_docs + 0.5) / (hmm.train_tokens + 0.5 * (hmm.distinct + 1)))
        add = lambda x: np.bincount(row, weights=x[index], minlength=n)
        known, base = add((count > 0).astype(float)).astype(np.int64) + (hmm.train_docs > 0), add(log_base) + end
        del row
        total = forward(c.hmm, *c.sequences(np.ones(n, dtype=bool))) / np.log(10)
        return pa.Table.from_arrays([keys, pa.array(~z["trained"]), pa.array(z["length"] + 1), pa.array(known), pa.array(np.full(n, hmm.train_tokens)), pa.array(base), pa.array(total)], names=names)

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    got = counts if weights is None else counts.unionByName(weights)
    return _grouped(laid, got, weights is None).applyInArrow(lean_groups(judge), f"`{name}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
