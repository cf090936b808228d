"""A table in chunks: rows side by side, some MB of text each, packed and kept where later steps can reach them.

Chunks lie in a table bucketed by their name. What is found out about a chunk
elsewhere (flags of its rows, answers to its questions) is grouped with it by that
name; only the narrow side is shuffled, whatever the sizes. Blobs are cut into
pieces of half a MB, so that no row of Spark's is large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import cut_buckets, lean, lean_group, lean_groups, pulled, ship, slices

PIECE = 512 << 10
GROUP = 8 << 20  # bytes of a row group of files that hold pieces


def pieces(blob: bytes, most: int = PIECE) -> list[bytes]:
    return [blob[i : i + most] for i in range(0, len(blob), most)] or [b""]


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(batches, text: str, chunk_bytes: int):
    """(name, rows) of each chunk of a task's rows. Names tell the task's number and the chunk's within it."""
    name, held, size = TaskContext.get().partitionId() << 24, [], 0
    for b in slices(batches, text, chunk_bytes):
        own = pc.sum(pc.binary_length(pulled(b, text))).as_py() or 0
        if held and size + own > chunk_bytes:
            yield name, _one(held)
            name, held, size = name + 1, [], 0
        held.append(b)
        size += own
    if held:
        yield name, _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


@dataclass
class Chunks:
    """Rows of a table in chunks. `table`: chunk, piece, blob for packed rows, and chunk, place, key for their names."""

    table: DataFrame
    columns: list[str]
    key: str
    fields: T.StructType

    @property
    def names(self) -> DataFrame:
        """chunk, place, key of every row; no text is read."""
        return self.table.where("place is not null").select("chunk", "place", "key")

    @property
    def packed(self) -> DataFrame:
        return self.table.where("piece is not null").select("chunk", "piece", "blob")

    def each(self, function, schema) -> DataFrame:
        """function(chunk's name, its rows) -> pa.Table of `schema`, for every chunk; nothing moves."""

        def run(rows: pa.Table) -> pa.Table:
            return function(rows.column("chunk")[0].as_py(), unpacked(rows))

        return self.packed.groupBy("chunk").applyInArrow(lean_group(run), schema)

    def gather(self, more: DataFrame, function, schema) -> DataFrame:
        """function(chunk's name, its rows, its rows of `more`) -> pa.Table of `schema`, for every chunk. `more` has a column chunk; it is what moves."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return function(left.column("chunk")[0].as_py(), unpacked(left), right)

        return self.packed.groupBy("chunk").cogroup(more.groupBy("chunk")).applyInArrow(lean_groups(run), schema)


def lay(docs: DataFrame, key: str, text: str, chunk_bytes: int = 4 << 20) -> Chunks:
    """All columns of `docs` in chunks of about so many bytes of `text`; one longer text is a chunk of its own.

    Inside, columns go by their position: c0, c1, ..., so no name clashes.
    """
    spark = docs.sparkSession
    ship(spark)
    columns = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at_text, at_key = f"c{columns.index(text)}", columns.index(key)
    kind = rows.schema[at_key].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (("chunk", T.LongType()), ("piece", T.IntegerType()), ("blob", T.BinaryType()), ("place", T.IntegerType()), ("key", kind))])

    def run(batches):
        for name, b in numbered(batches, at_text, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            blob = pieces(zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))
            n, m = b.num_rows, len(blob)
            names = b.column(at_key)
            yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(blob, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, names.type)], names=schema.names)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), names], names=schema.names)

    table = cut_buckets(rows.mapInArrow(lean(run), schema), "chunk", buckets(spark), "chunks", GROUP)
    return Chunks(table, columns, key, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


def unpacked(rows: pa.Table) -> pa.RecordBatch:
    """The rows of a chunk, from its pieces."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(joined(rows))).read_next_batch()


def joined(rows: pa.Table) -> bytes:
    return b"".join(x for _, x in sorted(zip(rows.column("piece").to_pylist(), rows.column("blob").to_pylist())))


def chosen(chunks: Chunks, which: DataFrame, named: bool = False) -> DataFrame:
    """The rows named by `which` (chunk, place; each once), with their own columns; behind their chunk and place if `named`."""
    at = [T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType())] if named else []

    def run(name, rows: pa.RecordBatch, right: pa.Table) -> pa.Table:
        place = pa.array(np.sort(right.column("place").to_numpy()), pa.int32())
        got = pa.Table.from_batches([rows]).take(place)
        return pa.Table.from_arrays([pa.array([name] * len(place), pa.int64()), place, *got.columns], names=["chunk", "place", *got.column_names]) if named else got

    found = chunks.gather(which.select("chunk", "place"), run, T.StructType([*at, *chunks.fields]))
    return found.select(*[f.name for f in at], *[F.col(f"c{i}").alias(c) for i, c in enumerate(chunks.columns)])
