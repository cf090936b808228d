"""Token counts of flat, unindexed token files by a separator scan.

A flat file holds the ids of text after text, each closed by an end-of-document
id, as little-endian integers and nothing else. Files are read in blocks of fixed
size by many tasks; each block's ends are found with one vectorised comparison.
A text may run over several blocks: a prefix scan over the blocks' last ends
tells each block where its first text began and which number it has.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import byte_bpe
from sheaf.llm.common import cut, key_name, lean, pulled, shared_dir, ship, slices, tidy


def write_flat(docs: DataFrame, spec_path: str, end_id: int, width: int = 2, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Tokenise and write one flat file per task into `folder` (a URI that all executors reach; by default the shared one).

    Returns the list of what the successful attempts wrote: file, tokens (its
    length), ordinal (of a text in it; -1 in the row that stands for the file),
    key. The store must be one that pyarrow.fs opens by its URI (file, hdfs, s3,
    gs), for the driver and executors alike. Files of failed attempts have names of their own and are not listed.
    Null and empty texts are an end id alone.
    """
    spark = docs.sparkSession
    ship(spark)
    home = f"{folder or shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    with open(spec_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind, name = f"<u{width}", key_name(key, "file", "tokens", "ordinal", "start", "n_tokens")

    def run(batches):
        bpe = byte_bpe.load(spec.value, every=2)
        try:
            yield from write(bpe, batches)
        finally:
            byte_bpe.unload()

    def write(bpe, batches):
        task = TaskContext.get()
        assert max(bpe.size - 1, end_id) < 1 << (8 * width), "ids do not fit the width"
        uri = f"{home}/{task.partitionId()}-{task.taskAttemptId()}.bin"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        close, n, tokens = np.array([end_id], dtype=kind).tobytes(), 0, 0
        with fs.open_output_stream(path) as out:
            for b in slices(batches, "__text", 2 << 20):
                for ids in bpe.encode_batch([t or "" for t in pulled(b, "__text").to_pylist()]):
                    out.write(ids.astype(kind).tobytes())
                    out.write(close)
                    tokens += len(ids) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * b.num_rows), pa.nulls(b.num_rows, pa.int64()), pa.array(np.arange(n, n + b.num_rows)), pulled(b, "__key")], names=["file", "tokens", "ordinal", name]
                )
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([tokens]), pa.array([-1]), pa.nulls(1, key_type)], names=["file", "tokens", "ordinal", name])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    key_kind = rows.schema["__key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(key_kind)
    return cut(rows.mapInArrow(lean(run), f"file string, tokens long, ordinal long, `{name}` {key_kind.simpleString()}"), "flat-list")


def scan_flat(files: DataFrame, end_id: int, width: int = 2, block: int = 1 << 20) -> DataFrame:
    """file, ordinal, start, n_tokens of every text in the files (columns file, tokens).

    n_tokens leaves the end id out, so a text may have none. Ids after the last
    end id are a text of their own; an empty file has none. `block` counts ids;
    the result does not hang on it.
    """
    ship(files.sparkSession)
    kind = np.dtype(f"<u{width}")
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block})")).alias("block")).repartition("file", "block")

    def find(batches):
        for batch in batches:
            for file, tokens, k in zip(*(pulled(batch, c).to_pylist() for c in ("file", "tokens", "block"))):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    raw = f.read_at(min(block, tokens - k * block) * width, k * block * width)
                ends = np.flatnonzero(np.frombuffer(raw, dtype=kind) == end_id) + k * block
                if (k + 1) * block >= tokens and (not len(ends) or ends[-1] < tokens - 1):
                    ends = np.append(ends, tokens)  # the file's end closes an open text
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([ends.astype(np.int64)], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    found = cut(blocks.select("file", "tokens", "block").mapInArrow(lean(find), "file string, block long, ends array<long>"), "ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last")).select(
        "file", "block", F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    each = found.where(F.size("ends") > 0).join(carried, ["file", "block"]).select("file", "first", "before", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("before")).otherwise(F.expr("ends[i - 1]")) + 1
    return each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


@tidy
def count_documents(docs: DataFrame, spec_path: str, end_id: int, width: int = 2, text: str = "text", key: str = "doc_id", block: int = 1 << 20) -> DataFrame:
    """key, ordinal, start, n_tokens: written as flat files, counted by scanning them, and named again by file and ordinal.

    Null and empty texts have no token. Rows that repeat, and rows without a key,
    each have a row. A text longer than a block is stitched from several. Other
    columns are not read; a key named like a result's column has `_key` behind it.
    An empty table gives no rows. A task tokenises whole texts of 2 MB and more at a
    time: it holds some ten times the bytes of its longest text. The flat files stay
    in the shared folder; `write_flat` and `scan_flat` are for files of one's own.
    """
    listed = write_flat(docs, spec_path, end_id, width, text, key)
    counted = scan_flat(listed.where("ordinal = -1").select("file", "tokens"), end_id, width, block)
    found = listed.where("ordinal >= 0").drop("tokens").join(counted, ["file", "ordinal"])
    return found.select(key_name(key, "file", "tokens", "ordinal", "start", "n_tokens"), "ordinal", "start", "n_tokens")
