"""Byte-level BPE of a `tokenizers` JSON file, by word with remembered words.

The file's vocabulary is also its merge order, so the ids come from tiktoken's
engine over the same vocabulary and pattern. Where every white-space character
of a text is one space or one line feed between other characters, no token spans
two words. The words of a batch, each behind its space or line feed, are numbered
in Arrow; new ones are encoded side by side, and all ids are gathered by number,
without a Python object a word. Other texts are encoded whole. Both ways give the
ids of the `tokenizers` library; each worker compares them with it on its first
texts and raises an error on a difference.

The file's added tokens are plain text unless `added` is set. With it they are
matched in texts, as the library does by default: a text is split at them, and
each stands for its one id.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space other than one space or line feed between other characters.
LOOSE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLOCK = 1 << 18  # words whose ids are gathered at a time


def _printable() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: those that are one stand for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, spec: bytes, remembered: int = 150_000, checked: int = 16, every: int = 8, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        before = parsed["pre_tokenizer"] or {}
        if (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) != ("ByteLevel", True, False) or parsed["model"]["type"] != "BPE":
            raise ValueError("not a byte-level BPE vocabulary with the usual split of words")
        special = {t["content"] for t in parsed["added_tokens"]}
        byte = _printable()
        vocab = {t: i for t, i in parsed["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.peer = Tokenizer.from_str(spec.decode())
        self.peer.encode_special_tokens = not added
        tokens = parsed["added_tokens"] if added else []
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4") for t in tokens}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        # Tokens that take spaces beside them, or stand only between words, are left to the library.
        self.exact = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens) and not parsed["normalizer"]
        self.size = max(parsed["model"]["vocab"].values()) + 1
        self.feed = self.engine.encode_single_token("\n")
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[[self.feed, *(i for t, i in ranks.items() if t[:1] == b" ")]] = True
        self.remembered = remembered
        self._forget()
        self.to_check, self.every = checked, every

    def _forget(self) -> None:
        """No words: `known` are those met, `ids` theirs one behind the other, `ends` where they end."""
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _check(self, texts: list[str], ids: np.ndarray) -> None:
        """The texts, one behind the other, against the library."""
        want = self.peer.encode("".join(texts), add_special_tokens=False).ids
        if not np.array_equal(np.array(want, dtype="<u4"), ids):
            raise AssertionError(f"one of {len(texts)} texts differs from the tokenizers library")

    def _learn(self, words: pa.Array) -> None:
        """Encode new words as one text, and cut where a token opens with a space or is the line feed. One in `every`, by their hash, goes to the library."""
        raw, at = _bytes(words)
        ids = np.array(self.engine.encode_ordinary(raw.decode()), dtype="<u4")
        ends = np.append(np.flatnonzero(self.opens[ids]), len(ids))
        if len(ends) != len(at) or ends[0]:
            raise AssertionError(f"{len(words)} words are encoded as {len(ends) - 1}")
        chosen = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])), np.uint32, len(words)) % self.every == 0
        if chosen.any():
            self._check([raw[at[i] : at[i + 1]].decode() for i in np.flatnonzero(chosen)], ids[np.repeat(chosen, np.diff(ends))])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that are not empty, and not loose. A line feed before each makes every word stand behind one or a space."""
        if len(self.known) > self.remembered:
            self._forget()
        raw = np.frombuffer("".join(f"\n{t}" for t in texts.to_pylist()).encode(), dtype=np.uint8)
        off = np.append(np.flatnonzero((raw == ord(" ")) | (raw == ord("\n"))), len(raw))
        words = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(raw))
        numbered = pa.chunked_array([self.known, words]).dictionary_encode().chunks[-1]
        new = numbered.dictionary.slice(len(self.known))
        for i in range(0, len(new), BLOCK):
            self._learn(new.slice(i, BLOCK))
        self.known = numbered.dictionary
        number, size = numbered.indices.to_numpy(), np.diff(self.ends)
        ends = np.append(0, np.cumsum(size[number]))
        out = np.empty(ends[-1], dtype="<u4")
        for i in range(0, len(number), BLOCK):
            some, at = number[i : i + BLOCK], ends[i : i + BLOCK + 1]
            out[at[0] : at[-1]] = self.ids[np.repeat(self.ends[some] - at[:-1], size[some]) + np.arange(at[0], at[-1])]
        begins = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1))
        cuts = ends[np.searchsorted(off, begins)].tolist()
        return [out[i + 1 : j] for i, j in zip(cuts, cuts[1:])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; an empty text has none."""
        holds = [any(a in t for a in self.added) for t in texts]
        split = iter(self._split([t for t, h in zip(texts, holds) if h]))
        whole = iter(self._ordinary([t for t, h in zip(texts, holds) if not h]))
        out = [next(split if h else whole) for h in holds]
        for t, ids in zip(texts[: self.to_check], out):
            if self.peer.encode(t, add_special_tokens=False).ids != ids.tolist():
                raise AssertionError(f"a text of {len(t)} characters differs from the tokenizers library")
        self.to_check -= min(self.to_check, len(texts))
        return out

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that hold added tokens: the stretches between them are texts of their own."""
        if not self.exact:
            return [np.array(self.peer.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts]
        parts = [self.split.split(t) for t in texts]  # stretches at even places, tokens at odd ones
        known = iter(self._ordinary([x for p in parts for x in p[::2]]))
        return [np.concatenate([self.added[x] if i % 2 else next(known) for i, x in enumerate(p)]) for p in parts]

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        plain = pc.and_(pc.greater(pc.binary_length(column), 0), pc.invert(pc.match_substring_regex(column, LOOSE)))
        known = iter(self._by_words(column.filter(plain)) if pc.any(plain).as_py() else ())
        out = []
        for t, ok in zip(texts, plain.to_pylist()):
            out.append(next(known) if ok else np.array(self.engine.encode_ordinary(t), dtype="<u4"))
            if t and not ok and zlib.crc32(t.encode()) % self.every == 0:
                self._check([t], out[-1])
        return out


def _bytes(column: pa.Array) -> tuple[bytes, list[int]]:
    """Bytes and offsets of a large string column without nulls."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return data[off[0] : off[-1]].to_pybytes(), (off - off[0]).tolist()


#: Engines of this worker. A task lets go of them at its end: workers outlive their tasks, and stand beside the executor's heap.
_LOADED: dict[tuple[str, bool, int], ByteBPE] = {}


def load(spec: bytes, added: bool = False, every: int = 8) -> ByteBPE:
    name = hashlib.sha256(spec).hexdigest(), added, every
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = ByteBPE(spec, added=added, every=every)
    return _LOADED[name]


def unload() -> None:
    _LOADED.clear()
