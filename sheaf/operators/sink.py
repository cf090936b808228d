"""Text sinks: lines on their own, one file per sheet in hashed folders, and the log of a run."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.deploy import ship
from sheaf.functions import columns as C
from sheaf.operators import rows as R
from sheaf.sources.reader import read_cells, read_sheets


def lines(rows: DataFrame, types: bool = False) -> DataFrame:
    """Each row as one tab-separated line; with `types`, a line of kinds before each."""
    text = F.concat_ws("\t", F.transform("strings", lambda s: F.coalesce(s, F.lit(""))))
    if not types:
        return rows.select(*R.SHEET, "row", text.alias("line"))
    return rows.select(*R.SHEET, "row", F.posexplode(F.array(F.concat_ws("\t", "types"), text)).alias("part", "line"))


def write_sharded(rows: DataFrame, folder: str) -> DataFrame:
    """One file per sheet at <folder>/<2 hex>/<2 hex>/<base>.<sheet>.tsv; returns path and rows of each.

    A sheet (2^20 rows at most) is written by one task, under a name of the
    attempt's own, and renamed when complete. No quoting, no escaping.
    """
    ship(rows.sparkSession)
    ready = lines(rows).withColumn("path", C.shard_path(F.col("file"), F.col("sheet"))).select("path", "sheet_idx", "row", "line")

    def put(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        body = "".join(x + "\n" for _, _, x in sorted(zip(*(table.column(c).to_pylist() for c in ("sheet_idx", "row", "line")))))
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        target = f"{root}/{path}"
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        own = f"{target}.{TaskContext.get().taskAttemptId()}.part"
        with fs.open_output_stream(own) as f:
            f.write(body.encode())
        fs.move(own, target)
        return pa.table({"path": [path], "rows": pa.array([table.num_rows], pa.int64())})

    return ready.groupBy("path").applyInArrow(put, "path string, rows long")


def run(spark: SparkSession, paths: str | list[str], folder: str | None, log: str | None = None, **options) -> DataFrame:
    """Extract, clean, write and count: the batch job. Without a folder nothing is written (everything else runs). Returns the statistics.

    The log is appended to as tab-separated text: time, file, sheet, rows, columns, error.
    """
    sheets = read_sheets(spark, paths, **options)
    usable = sheets.where("error is null and not is_empty")
    table = R.cleaned(R.to_rows(read_cells(spark, paths, permissive=True, **options).join(usable.select("file", "sheet_idx"), ["file", "sheet_idx"], "left_semi"), usable))
    if folder is None:
        table.write.format("noop").mode("overwrite").save()
    else:
        write_sharded(table, folder).write.format("noop").mode("overwrite").save()
    counted = R.stats(table, sheets)
    if log:
        out = counted.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("file", "sheet", "rows", "columns", "error")])
        out.write.mode("append").option("sep", "\t").option("header", True).csv(log)
    return counted
