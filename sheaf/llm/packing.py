"""Packing by non-negative least squares.

Texts are tokenised, closed with an end id, and cut into full windows and one
remainder. Remainders fall into length classes (rounded up to `grain`). All
shallow combinations of classes that fill a window (`depth` classes at most) are
enumerated; non-negative least squares finds how often to use each so that
together they match the histogram; counts are rounded down to what the histogram
holds, and what is left over is packed greedily, largest class first, into the
fullest combination that has room. Only the histogram (window / grain numbers)
and the combinations reach the driver: pieces learn their sequence from their
rank within their class, which is counted in salted parts.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import byte_bpe
from sheaf.llm.common import cut, key_name, lean, pulled, ship, slices, tidy

PART = 1 << 18  # pieces of a class that are ranked in one task, on average
TAKEN = ("start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset")


def pieces(docs: DataFrame, spec_path: str, text: str = "text", key: str = "doc_id", window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens [, ids]: one row per piece. Null and empty texts are the end id alone.

    The file's added tokens are matched in texts and stand for their own ids.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(spec_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = byte_bpe.load(spec.value, added=True)
        try:
            yield from cut_up(bpe, batches)
        finally:
            byte_bpe.unload()

    def cut_up(bpe, batches):
        for b in slices(batches, "__text", 2 << 20):
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, got in enumerate(bpe.encode_batch([t or "" for t in pulled(b, "__text").to_pylist()])):
                raw = got.astype("<u4", copy=False).tobytes() + np.array([end_id], dtype="<u4").tobytes()
                n = len(raw) // 4
                for at in range(0, n, window):
                    piece = raw[4 * at : 4 * (at + window)]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            columns = [pulled(b, "__key").take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=names)

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    name = key_name(key, *TAKEN)
    names = [name, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{name}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of up to `depth` positive classes that sum to `total`, largest class first."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(chosen)
        elif len(chosen) < depth:
            most = min(left, chosen[-1] if chosen else left)
            for c in range(most, -(-left // (depth - len(chosen))) - 1, -1):
                extend((*chosen, c), left - c)

    extend((), total)
    return out


def solve(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson-Hanson active sets on the normal equations: repeat counts >= 0 that match the histogram best."""
    a = np.zeros((len(histogram), len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k, j] += 1
    scale = max(1.0, histogram.max())
    b = histogram / scale
    x, passive = np.zeros(len(combos)), []
    gram, slope = a.T, a.T @ b
    for _ in range(rounds):
        pull = slope - gram @ (a @ x)
        pull[passive] = -np.inf
        j = int(pull.argmax())
        if pull[j] <= 1e-9:
            break
        passive.append(j)
        while passive:
            p = a[:, passive]
            z = np.linalg.solve(p.T @ p + 1e-12 * np.eye(len(passive)), p.T @ b)
            if z.min() > 0:
                break
            now = x[passive]
            bad = z <= 0
            step = np.min(now[bad] / (now[bad] - z[bad] + 1e-300))
            now = now + step * (z - now)
            x[:] = 0
            keep = now > 1e-12
            keep[bad] &= now[bad] > 1e-12
            if keep.all():
                keep[int(np.argmin(np.where(bad, now, np.inf)))] = False
            passive = [k for k, ok in zip(passive, keep) if ok]
            x[passive] = now[keep]
        x[:] = 0
        if passive:
            x[passive] = z
    return x * scale


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to use each; together they hold the histogram exactly. histogram[c]: pieces of class c."""
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = [((full,), int(left[full]))] if left[full] else []
    left[full] = 0
    if left.any():
        held = np.flatnonzero(left)
        usable = [c for c in combinations(full, depth) if len(c) > 1 and left[list(c)].all()]
        if usable:
            want = solve(usable, left.astype(float))
            for j in np.argsort(-want, kind="stable"):
                n = int(want[j] + 1e-6)
                if n <= 0:
                    break
                for c, times in Counter(usable[j]).items():
                    n = min(n, int(left[c]) // times)
                if n > 0:
                    out.append((usable[j], n))
                    np.subtract.at(left, list(usable[j]), n)
        del held
    # The rest, by class and in bulk: open sequences are grouped by what they hold.
    open_: dict[tuple[int, ...], int] = {}
    for c in range(full - 1, 0, -1):
        n = int(left[c])
        while n:
            fits = [(full - sum(k), k) for k in open_ if full - sum(k) >= c]
            if fits:
                _, k = min(fits)
                m = min(n, open_[k])
                open_[k] -= m
                if not open_[k]:
                    del open_[k]
                open_[(*k, c)] = open_.get((*k, c), 0) + m
            else:
                m, each = n, full // c
                groups, odd = divmod(m, each)
                if groups:
                    open_[(c,) * each] = open_.get((c,) * each, 0) + groups
                if odd:
                    open_[(c,) * odd] = open_.get((c,) * odd, 0) + 1
            n -= m
    return out + sorted(open_.items(), reverse=True)


def pack(cut_pieces: DataFrame, key: str = "doc_id", window: int = 1024, grain: int = 4, depth: int = 3) -> DataFrame:
    """The pieces with sequence_id long and offset long.

    `cut_pieces` must be a table read or a cut, whose rows stay the same. Equal
    lengths share a class; which of them comes first goes by a hash of key,
    start and place. Rows repeated in every column are packed each
    on its own. An empty table gives no rows. No sequence is longer than the
    window, and offsets in a sequence run on without gaps.
    """
    spark = cut_pieces.sparkSession
    kind = F.ceil(F.col("length") / F.lit(grain)).cast("int")
    spread = F.xxhash64(F.lit(5), F.col(key), "start", F.monotonically_increasing_id())
    full = window // grain
    rows = cut_pieces.withColumn("__class", kind)
    size = np.zeros(full + 1, dtype=np.int64)
    for r in rows.groupBy("__class").count().collect():  # as many as there are classes
        size[r["__class"]] = r["count"]
    # A class is ranked in parts, more of them the larger it is.
    parts = np.maximum(8, -(-size // PART))
    salt = F.expr(f"pmod(__order, array({', '.join(f'{x}L' for x in parts.tolist())})[__class])")
    rows = rows.withColumn("__order", spread).withColumn("__salt", salt)
    counts = {(r["__class"], r["__salt"]): r["count"] for r in rows.groupBy("__class", "__salt").count().collect()}  # 8 a class, and one for PART pieces
    ends: dict[int, int] = {}
    starts_ = []
    for (c, s), n in sorted(counts.items()):
        starts_.append((int(c), int(s), ends.get(c, 0)))
        ends[c] = ends.get(c, 0) + n
    starts = spark.createDataFrame(starts_, "__class int, __salt long, __before long")

    taken, sequence, spans = np.zeros(full + 1, dtype=np.int64), 0, []
    for combo, n in plan(size, depth):
        for c, times in Counter(combo).items():
            # Ranks [lo, lo + n * times) of the class go to these n sequences, `times` to each.
            spans.append((c, int(taken[c]), int(taken[c] + n * times), times, sequence))
            taken[c] += n * times
        sequence += n
    spans_df = spark.createDataFrame(spans, "__class int, __lo long, __hi long, __times int, __first long")

    ranked = (
        rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__class", "__salt").orderBy("__order")) - 1)
        .join(F.broadcast(starts), ["__class", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__salt", "__order", "__before")
    )
    s = spans_df.alias("s")
    placed = ranked.alias("r").join(F.broadcast(s), (F.col("r.__class") == F.col("s.__class")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    placed = placed.select(*[F.col(f"r.{c}") for c in cut_pieces.columns], F.col("__rank"), (F.col("__first") + F.expr("(__rank - __lo) div __times")).alias("sequence_id"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__rank")
    return placed.withColumn("offset", F.sum("length").over(ahead.rowsBetween(Window.unboundedPreceding, -1))).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long")).drop("__rank")


@tidy
def pack_documents(docs: DataFrame, spec_path: str, text: str = "text", key: str = "doc_id", window: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: key, start, length, ids_crc32, doc_tokens [, ids], sequence_id, offset; one row per piece.

    Null and empty texts are the end id alone. Rows that repeat, and rows without a
    key, are packed each on its own. Other columns are not read; a key named like a
    result's column has `_key` behind it. An empty table gives no rows. A task
    tokenises whole texts: it holds some ten times the bytes of its longest.
    """
    cut_up = cut(pieces(docs, spec_path, text, key, window, with_ids=with_ids), "pieces")
    return pack(cut_up, cut_up.columns[0], window)
