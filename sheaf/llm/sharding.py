"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters whole records into memory-sized buckets by a seeded hash. Pass
two takes one bucket at a time, puts it in a fixed order, and Fisher-Yates
shuffles it (Spark's `shuffle`). Buckets in order are one random permutation of
all rows; it is dealt to shards in runs whose lengths differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_size(text: str):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(16)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, T.MapType) or (isinstance(t, T.ArrayType) and _has_map(t.elementType))


def _entries(c, t: T.DataType, back: bool = False):
    """The column with each map as an array of its entries, which has an order and a hash as maps have not; `back` undoes it. t: the type with maps."""
    if not _has_map(t):
        return c
    if isinstance(t, T.MapType):
        pair = lambda e: F.struct(_entries(e["key"], t.keyType, back).alias("key"), _entries(e["value"], t.valueType, back).alias("value"))
        return F.map_from_entries(F.transform(c, pair)) if back else F.transform(F.map_entries(c), pair)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _entries(x, t.elementType, back))
    return F.when(c.isNotNull(), F.struct(*[_entries(c[f.name], f.dataType, back).alias(f.name) for f in t]))


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 42, text: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """Columns: record (the whole input row as a struct, so no name can clash), shard int, slot long.

    Every input row lands in one shard, repeated rows and rows of nulls too;
    shards' counts differ by one at most; slots run from 0 without gaps. An
    empty table gives no rows. A row's bucket hangs on its content, and on its
    place in the input as well, so that even rows that repeat each other a
    billion times spread evenly. The input must therefore be a table read (or
    a cut), whose order is the same when a task runs again. One text longer
    than `bucket_bytes` makes its bucket larger by that text. Columns may be of any
    type that has an order, and maps.
    """
    n, total = docs.agg(F.count(F.lit(1)), F.sum(record_size(text))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    record = F.struct(*[_entries(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in docs.schema])
    laid = docs.select(record.alias("record"), F.monotonically_increasing_id().alias("at")).select(
        "record", F.xxhash64(F.lit(seed), "record", "at").alias("h")
    ).select("record", "h", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))

    # Counts of buckets, summed in blocks of a thousand: no task reads all of them in order but for the blocks' sums.
    held_ = laid.groupBy("bucket").count().withColumn("block", F.expr("bucket div 1000"))
    blocks = held_.groupBy("block").agg(F.sum("count").alias("c")).select("block", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("before"))
    inside = F.sum("count").over(Window.partitionBy("block").orderBy("bucket")) - F.col("count")
    starts = held_.withColumn("start", inside).join(blocks, "block").select("bucket", (F.col("start") + F.col("before")).alias("start"))
    # One partition holds one bucket, so the generator's seed is the bucket's own, on any cluster.
    held = (
        laid.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "h").alias("order"), "record")).alias("rows"))
    )
    dealt = held.select("bucket", F.shuffle(F.array_sort("rows"), F.lit(seed)).alias("rows"))
    # A few bytes a bucket: up to this many they are sent to every executor, beyond that both sides meet by bucket.
    rows = dealt.join(F.broadcast(starts) if buckets <= 200_000 else starts, "bucket").select("start", F.posexplode("rows").alias("pos", "row"))
    place = "(start + pos)"
    shard = f"({place} * {shards} div {max(n, 1)})"
    first = f"(({shard} * {n} + {shards - 1}) div {shards})"
    return rows.select(_entries(F.col("row.record"), docs.schema, back=True).alias("record"), F.expr(shard).cast("int").alias("shard"), F.expr(f"{place} - {first}").alias("slot"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder per shard. Files hold the records in the order of their slots."""
    dealt.select("record.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")).write.partitionBy("__shard").parquet(path)
