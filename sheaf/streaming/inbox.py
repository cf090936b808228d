"""An inbox of files as a stream: each new file's cells, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf import schema as S
from sheaf.sources.reader import _parsed, file_cells


def stream_cells(spark: SparkSession, folder: str, files_per_trigger: int = 100, permissive: bool = True, **options) -> DataFrame:
    """Cells of files as they arrive in a folder. Unreadable files have none if `permissive`."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "content")

    def parse(name, data):
        try:
            yield from file_cells(name, data, None, options)
        except Exception:  # noqa: BLE001
            if not permissive:
                raise

    return _parsed(files, S.CELLS, parse)
