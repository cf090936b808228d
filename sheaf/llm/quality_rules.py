"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Viterbi decoding labels the lines of a text as one sequence; the share of word
characters in content lines decides whether the document stays. Weights are
trained here from a bounded sample of labelled documents: lines of good
documents are content, lines of bad ones boilerplate, and lines that several
sampled documents share are boilerplate wherever they stand.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import _IS_SPACE, key_name, lean, mix, pulled, ship, slices, smallest_hashes, utf8, word_hashes, words

SYMBOLS = b"#*$%&|<>"
_KINDS = np.zeros((256, 6), dtype=bool)
_KINDS[65:91, 0] = True
_KINDS[97:123, 1] = True
_KINDS[48:58, 2] = True
_KINDS[list(SYMBOLS), 3] = True
_KINDS[list(b"!?"), 4] = True
_KINDS[:, 5] = (np.arange(256) & 0xC0 != 0x80) & ~_IS_SPACE  # first bytes of characters in words

STATES = ("boilerplate", "content")
FEATURES = 18


@dataclass
class Field:
    """Weights of a fitted field: features x states, and states x states for neighbours."""

    emit: np.ndarray
    move: np.ndarray


def _sums(flags: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[to] - total[at]


def _first_in_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether no earlier element of the row has this hash, and how many elements of the row have it."""
    if not len(h):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    both = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(h), dtype=bool)
    new[1:] = both[order][1:] != both[order][:-1]
    group = np.cumsum(new) - 1
    first = np.zeros(len(h), dtype=bool)
    first[order[new]] = True
    times = np.empty(len(h), dtype=np.int64)
    times[order] = np.bincount(group)[group]
    return first, times


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: counts of the contract. Per line: row, word characters, hash and features. Lines without a word are left out."""
    n, size = len(off) - 1, len(raw)
    starts, ends, row = words(raw, off)
    breaks = np.flatnonzero(raw == 10)
    # A line begins where a text begins and behind each line feed, unless the text ends there.
    behind = np.searchsorted(off, breaks, "right") - 1
    inner = breaks + 1 < off[behind + 1]
    at = np.concatenate([off[:-1], breaks[inner] + 1])
    order = np.argsort(at, kind="stable")
    at, where = at[order], np.concatenate([np.arange(n), behind[inner]])[order]
    to = np.concatenate([at[1:], [size]]) if len(at) else at
    ending = np.zeros(size + 1, dtype=bool)
    ending[breaks + 1] = True
    to = np.maximum(at, to - (ending[to] & (to > at) & (raw[np.maximum(to - 1, 0)] == 10 if size else False)))
    first_word = np.searchsorted(starts, at, "left")
    n_words_line = np.searchsorted(starts, to, "left") - first_word
    full = n_words_line > 0
    at, to, where, n_words_line, first_word = at[full], to[full], where[full], n_words_line[full], first_word[full]

    kind = [_sums(_KINDS[raw, k], at, to) for k in range(6)]
    chars = kind[5]
    line_hash = word_hashes(raw, at, to, lower=False)
    fresh, _ = _first_in_row(where, line_hash)
    hashes = word_hashes(raw, starts, ends, lower=False)

    windows = max(0, len(hashes) - 2)
    same = row[:windows] == row[2 : 2 + windows]
    h3 = mix(hashes[:windows] * np.uint64(3) + hashes[1 : 1 + windows] * np.uint64(5) + hashes[2 : 2 + windows] * np.uint64(7))[same]
    _, times = _first_in_row(row[:windows][same], h3)
    again = np.flatnonzero(same)[times > 1]
    repeated = np.zeros(len(hashes) + 2, dtype=bool)
    for k in range(3):
        repeated[again + k] = True
    repeated = repeated[: len(hashes)]

    per = lambda flags, rows_: np.bincount(rows_, weights=flags, minlength=n).astype(np.int64)
    counts = {
        "word_chars": _sums(_KINDS[raw, 5], off[:-1], off[1:]),
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "n_symbols": _sums(_KINDS[raw, 3], off[:-1], off[1:]),
        "n_dup_lines": per(~fresh, where),
        "n_repeat_words": per(repeated, row),
    }

    letters = np.maximum(kind[0] + kind[1], 1)
    share = lambda x, d=chars: x / np.maximum(d, 1)
    repeat_line = np.add.reduceat(np.append(repeated, False).astype(np.int64), first_word) if len(first_word) else np.zeros(0)
    if len(first_word):
        run = np.zeros(len(repeated) + 1, dtype=np.int64)
        np.cumsum(repeated, out=run[1:])
        repeat_line = run[first_word + n_words_line] - run[first_word]
    last = raw[ends[first_word + n_words_line - 1] - 1] if len(first_word) else np.zeros(0, np.uint8)
    head = raw[starts[first_word]] if len(first_word) else np.zeros(0, np.uint8)
    sym, up = share(kind[3]), kind[0] / letters
    x = np.stack(
        [
            np.ones(len(at)), sym > 0, sym > 0.02, sym > 0.08, sym > 0.2, up > 0.3, up > 0.7, share(kind[2]) > 0.1, share(kind[4]) > 0.05, ~fresh,
            n_words_line < 4, n_words_line > 30, np.isin(last, list(b".!?")), np.isin(head, np.arange(65, 91)) | (head >= 128), repeat_line > 0.3 * n_words_line, repeat_line > 0.8 * n_words_line,
            (to - at) / n_words_line > 9, (to - at) / n_words_line < 4,
        ],
        axis=1,
    ).astype(np.float32) if len(at) else np.zeros((0, FEATURES), np.float32)
    return {"counts": counts, "line_row": where, "line_chars": chars, "line_hash": line_hash, "x": x}


def _grid(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text as steps: distinct rows by falling length, their first line, their length."""
    u, first, count = np.unique(rows, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    return u[order], first[order], count[order], order


def viterbi(emit: np.ndarray, rows: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best state of every line. emit: lines x states; lines of a row are adjacent. Ties go to the lower state."""
    _, first, count, _ = _grid(rows)
    out = np.zeros(len(emit), dtype=np.int64)
    if not len(emit):
        return out
    back = np.zeros(emit.shape, dtype=np.int64)
    score = emit[first].copy()
    live = len(first)
    for t in range(1, count[0]):
        live = int(np.searchsorted(-count, -t, "left"))
        step = score[:live, :, None] + move[None]
        back[first[:live] + t] = step.argmax(axis=1)
        score[:live] = step.max(axis=1) + emit[first[:live] + t]
    state = score.argmax(axis=1)
    for t in range(count[0] - 1, -1, -1):
        live = int(np.searchsorted(-count, -t, "left"))
        here = first[:live] + t
        out[here] = state[:live]
        state[:live] = back[here, state[:live]]
    return out


def _gradient(x, y, rows, f: Field):
    """Log-likelihood gradient: observed less expected counts, by scaled forward and backward passes."""
    _, first, count, _ = _grid(rows)
    psi = np.exp(np.clip(x @ f.emit, -30, 30))
    m = np.exp(f.move)
    a, b = np.zeros_like(psi), np.ones_like(psi)
    a[first] = psi[first] / psi[first].sum(axis=1, keepdims=True)
    for t in range(1, count[0]):
        live = first[: int(np.searchsorted(-count, -t, "left"))] + t
        v = (a[live - 1] @ m) * psi[live]
        a[live] = v / v.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(count[0] - 1, 0, -1):
        live = first[: int(np.searchsorted(-count, -t, "left"))] + t
        v = b[live] * psi[live]
        joint = a[live - 1][:, :, None] * m[None] * v[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        w = v @ m.T
        b[live - 1] = w / w.sum(axis=1, keepdims=True)
    p = a * b
    p /= p.sum(axis=1, keepdims=True)
    seen = np.zeros((2, 2))
    follow = rows[1:] == rows[:-1]
    np.add.at(seen, (y[:-1][follow], y[1:][follow]), 1)
    return x.T @ (np.eye(2)[y] - p) / len(y), (seen - pairs) / len(y)


def train(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rounds: int = 120) -> Field:
    """Adam on the penalised log-likelihood. Without lines the field is even and calls all content."""
    f = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    if not len(x):
        f.emit[0, 1] = 1.0
        return f
    mean, var = [0, 0], [0, 0]
    for i in range(1, rounds + 1):
        for k, (g, v) in enumerate(zip(_gradient(x, y, rows, f), (f.emit, f.move))):
            g = g - 1e-4 * v
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            v += 0.15 * (mean[k] / (1 - 0.9**i)) / (np.sqrt(var[k] / (1 - 0.99**i)) + 1e-8)
    return f


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = 400, lines: int = 400, shared: int = 3) -> Field:
    """Fit on `per_class` documents at most of each quality. Null labels, keys and texts teach nothing.

    Of a document with more than `lines` lines, one run of so many is read; which,
    its key says. Rows of one key count once, with the text that sorts first; the
    lesser of contradictory labels holds.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("__y"))
    picked = smallest_hashes(marks, "__y", "__key", per_class, 11).select("__key", "__y")
    sample = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(F.broadcast(picked), "__key").groupBy("__key", "__y").agg(F.min("__text").alias("__text"))

    def lined(batches):
        for b in slices(batches, "__text"):
            m = measure(*utf8(pulled(b, "__text")))
            for i, (k, y) in enumerate(zip(pulled(b, "__key").to_pylist(), pulled(b, "__y").to_pylist())):
                lo, hi = np.searchsorted(m["line_row"], [i, i + 1])
                lo += zlib.crc32(str(k).encode()) % max(1, -(-(hi - lo) // lines)) * lines
                hi = min(hi, lo + lines)
                yield pa.RecordBatch.from_pydict({"k": [str(k)], "y": [int(y)], "x": [m["x"][lo:hi].tobytes()], "h": [m["line_hash"][lo:hi].tobytes()]}, schema=out)

    out = pa.schema([("k", pa.string()), ("y", pa.int32()), ("x", pa.binary()), ("h", pa.binary())])
    got = sorted(sample.mapInArrow(lean(lined), "k string, y int, x binary, h binary").collect(), key=lambda r: (r.k, r.y, bytes(r.x)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    h = [np.frombuffer(r.h, np.uint64) for r in got]
    if not sum(map(len, h)):
        return train(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int))
    held, docs_with = np.unique(np.concatenate([np.unique(v) for v in h]), return_counts=True)
    common = held[docs_with >= shared]
    y = [np.where(np.isin(v, common), 0, 1 if r.y else 0) for r, v in zip(got, h)]
    rows = np.repeat(np.arange(len(h)), [len(v) for v in h])
    return train(np.concatenate(x).astype(float), np.concatenate(y), rows)


def judge(docs: DataFrame, model: Field, text: str = "text", key: str = "doc_id", least_share: float = 0.5) -> DataFrame:
    """One row per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept.

    Null and empty texts have no words, share 0, and fail. A share equal to
    `least_share` keeps. Repeated rows give repeated rows; other columns are not read;
    a key named like a result's column has `_key` behind it; an empty table gives no
    rows. A text is measured whole: a task holds some 60 bytes a byte of its longest.
    """
    spark = docs.sparkSession
    ship(spark)
    model_ = spark.sparkContext.broadcast(model)
    name = key_name(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        f = model_.value
        for b in slices(batches, "__text"):
            m = measure(*utf8(pulled(b, "__text")))
            c, n = m["counts"], b.num_rows
            state = viterbi(m["x"] @ f.emit, m["line_row"], f.move)
            content = np.bincount(m["line_row"], weights=m["line_chars"] * state, minlength=n)
            share = np.where(c["word_chars"] > 0, content / np.maximum(c["word_chars"], 1), 0.0)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            yield pa.RecordBatch.from_arrays(
                [pulled(b, "__key"), *[pa.array(c[k]) for k in names], pa.array(share), pa.array(failed), pa.array(~failed & (share >= least_share))],
                names=[name, *names, "content_share", "base_failed", "kept"],
            )

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{name}` {kind}, " + ", ".join(f"{k} long" for k in names) + ", content_share double, base_failed boolean, kept boolean")
