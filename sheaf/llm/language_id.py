"""Language identification by error-correcting output codes.

Each language owns a codeword of +1/-1 bits. One binary classifier per bit
(logistic, on hashed byte n-grams of one to three bytes) says which half of the
languages a text belongs to. Decoding is loss-weighted: a codeword's distance is
the weighted logistic loss of its bits against the classifiers' margins, and the
nearest codeword wins. Texts whose two nearest codewords lie close together are
flagged as ambiguous.

Training reads a bounded sample: `per_language` rows of each language, those with
the smallest hashes. Prediction reads every whole text, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import _LOWER, cut, key_name, lean, pulled, ship, slices, smallest_hashes, utf8

DIMS = 1 << 13
UNKNOWN = "und"

#: Bytes that may belong to a letter: A-Z, a-z and every byte above ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Coded:
    """A fitted model: languages, their codewords, bit classifiers and the weight of each bit."""

    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, by its accuracy in training


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """Exhaustive codes up to seven languages; beyond that random dense ones, the widest apart of 64 draws."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        bits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(k)] for b in range(2 ** (k - 1) - 1)]
        return np.array(bits).T
    rng, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(64):
        c = rng.choice([-1, 1], size=(k, int(np.ceil(15 * np.log2(k)))))
        apart = min((c[i] != c[j]).sum() for i, j in combinations(range(k), 2))
        if apart > widest:
            best, widest = c, apart
    return best


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x DIMS: log counts of hashed n-grams, scaled to length 1. Runs of other than letters count as one space."""
    n, size = len(off) - 1, len(raw)
    if not size:
        return np.zeros((n, DIMS), dtype=np.float32)
    x = np.where(_LETTER[raw], _LOWER[raw], np.uint8(32))
    row = np.repeat(np.arange(n), np.diff(off))
    fresh = np.ones(size, dtype=bool)
    fresh[1:] = (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])
    x, row = x[fresh].astype(np.uint32), row[fresh]
    at = row * DIMS
    counts = np.zeros(n * DIMS, dtype=np.int64)
    gram = x
    for order in (1, 2, 3):
        if order > 1:
            same = row[order - 1 :] == row[: len(row) - order + 1]
            gram = (gram[:-1] << np.uint32(8)) | x[order - 1 :]
            hashed = (gram * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(19)
            counts += np.bincount(at[: len(hashed)][same] + hashed[same], minlength=n * DIMS)
        else:
            hashed = (gram * np.uint32(2654435761) + np.uint32(40503)) >> np.uint32(19)
            counts += np.bincount(at + hashed, minlength=n * DIMS)
    out = np.log1p(counts.reshape(n, DIMS).astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a character of Unicode's letter categories."""
    n = len(off) - 1
    low = np.concatenate([[0], np.cumsum(_LETTER[raw] & (raw < 128))])
    found = low[off[1:]] > low[off[:-1]]
    for i in np.flatnonzero(~found):
        if off[i + 1] > off[i]:
            found[i] = any(ch.isalpha() for ch in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found if n else np.zeros(0, dtype=bool)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, seed: int = 7) -> Coded:
    """Fit on `per_language` labelled rows at most of each language. Null languages, null texts and blank texts teach nothing.

    Ties of the hash go by key. Rows of one language and key count once, with the
    text that sorts first. With no labelled row the model has no language and predicts `und` for all.
    """
    ship(docs.sparkSession)
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN)).select(F.col(lang).alias("__lang"), F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    picked = smallest_hashes(named.select("__lang", "__key"), "__lang", "__key", per_language, seed)
    met = named.join(F.broadcast(picked.distinct()), named["__lang"].eqNullSafe(picked["__lang"]) & named["__key"].eqNullSafe(picked["__key"]), "left_semi")
    sample = met.groupBy("__lang", "__key").agg(F.min("__text").alias("__text"))  # rows that repeat a key are one

    def sparse(batches):
        for b in slices(batches, "__text"):
            x = features(*utf8(pulled(b, "__text")))
            cells = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pulled(b, "__lang").cast(pa.string()),
                    "key": pulled(b, "__key").cast(pa.string()),
                    "cells": pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()),
                    "values": pa.array([r[c].astype(np.float16).tobytes() for r, c in zip(x, cells)], pa.binary()),
                }
            )

    rows = sorted(sample.mapInArrow(lean(sparse), "lang string, key string, cells binary, values binary").collect(), key=lambda r: (r.lang, r.key))
    languages = sorted({r.lang for r in rows})
    return _fit(_Rows([(np.frombuffer(r["cells"], np.uint16), np.frombuffer(r["values"], np.float16)) for r in rows]), np.array([languages.index(r.lang) for r in rows], dtype=int), languages)


class _Rows:
    """Sparse rows, dense some thousands at a time; one such block is kept."""

    def __init__(self, cells: list[tuple[np.ndarray, np.ndarray]], most: int = 4096):
        self.cells, self.most, self.kept = cells, most, None

    def blocks(self):
        """(first row, dense rows)."""
        for lo in range(0, len(self.cells), self.most):
            if lo or self.kept is None:
                some = self.cells[lo : lo + self.most]
                x = np.zeros((len(some), DIMS), dtype=np.float32)
                for i, (c, v) in enumerate(some):
                    x[i, c] = v
                self.kept = self.kept if lo else x
            yield lo, x if lo else self.kept


def _fit(rows: _Rows, y: np.ndarray, languages: list[str], rounds: int = 150) -> Coded:
    codes = codebook(len(languages))
    bits = codes.shape[1] if len(languages) else 0
    w, b = np.zeros((DIMS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    if len(languages) < 2:
        return Coded(languages, codes, w, b, np.ones(bits))
    target = codes[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))[y]
    even = (len(y) / (len(languages) * share)).astype(np.float32)[:, None]
    step, speed_w, speed_b = np.float32(20.0), np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        slope_w, slope_b = np.zeros_like(w), np.zeros_like(b)
        for lo, x in rows.blocks():
            some = slice(lo, lo + len(x))
            pull = even[some] * target[some] / (1 + np.exp(np.clip(target[some] * (x @ w + b), -30, 30)))
            slope_w += x.T @ pull
            slope_b += pull.sum(axis=0)
        speed_w = np.float32(0.9) * speed_w + slope_w / len(y) - np.float32(1e-5) * w
        speed_b = np.float32(0.9) * speed_b + slope_b / len(y)
        w, b = w + step * speed_w, b + step * np.float32(0.1) * speed_b
    right = np.sum([(np.sign(x @ w + b) == target[lo : lo + len(x)]).sum(axis=0) for lo, x in rows.blocks()], axis=0) / len(y)
    return Coded(languages, codes, w, b, np.maximum(right - 0.5, 0.01) * 2)


def decode(model: Coded, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of the total weight exp(-distance), and its lead over the second nearest."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.codes[None, :, :])
    far = (loss * model.trust).sum(axis=2)
    best = far.argmin(axis=1)
    part = np.exp(far.min(axis=1, keepdims=True) - far)
    ordered = np.sort(far, axis=1)
    lead = ordered[:, 1] - ordered[:, 0] if far.shape[1] > 1 else np.full(len(far), np.inf)
    return best, 1 / part.sum(axis=1), lead


def _told(model: Coded, texts: pa.Array, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text, 256 at a time: DIMS counters a row are a bounded matrix, however short the texts."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    out = []
    for at in range(0, len(texts), 256):
        raw, off = utf8(texts.slice(at, 256))
        said = has_letter(raw, off)
        if model.languages:
            best, score, lead = decode(model, features(raw, off) @ model.weights + model.bias)
        else:
            best, score, lead, said = np.zeros(len(said), int), np.zeros(len(said)), np.full(len(said), np.inf), said & False
        out.append((names[np.where(said, best, len(names) - 1)], np.where(said, score, 0.0).astype(float), said & (lead < near)))
    return tuple(np.concatenate(x) for x in zip(*out))


def identify(docs: DataFrame, model: Coded, text: str = "text", key: str = "doc_id", near: float = 1.0) -> DataFrame:
    """One row per row: key, lang_pred, score (0 to 1), ambiguous.

    Null texts and texts without a letter are `und` with score 0, not ambiguous.
    Equal distances go to the language that sorts first, and are ambiguous.
    Repeated rows give repeated rows; other columns are not read; an empty table
    gives no rows. A long text is read in pieces; only its bytes are held.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        for b in slices(batches, "__text", 2 << 20):
            said, score, doubt = _told(shared.value, pulled(b, "__text"), near)
            yield pa.RecordBatch.from_arrays([pulled(b, "__key"), pa.array(said, pa.string()), pa.array(score), pa.array(doubt)], names=out.names)

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    out = T.StructType([T.StructField(key_name(key, "lang_pred", "score", "ambiguous"), rows.schema["__key"].dataType), *T._parse_datatype_string("lang_pred string, score double, ambiguous boolean").fields])
    return rows.mapInArrow(lean(predict), out)


def keep(docs: DataFrame, model: Coded, text: str = "text", near: float = 1.0) -> DataFrame:
    """The rows of `docs`, all columns, whose language `identify` tells without ambiguity."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = f"c{docs.columns.index(text)}"  # columns go by their position, so no name clashes

    def choose(batches):
        for b in slices(batches, at, 2 << 20):
            said, _, doubt = _told(shared.value, pulled(b, at), near)
            yield b.filter(pa.array((said != UNKNOWN) & ~doubt))

    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    # Written here, where rows go to Python some MB at a time.
    return cut(rows.mapInArrow(lean(choose), rows.schema), "told").toDF(*docs.columns)
