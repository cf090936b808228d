"""Files to tables: sheets and cells.

`read_cells` and `read_sheets` take files with Spark's own binary reader, so any
store that Spark reads will do, and parse one file at a time in Arrow batches.
The data source "tabular" does the same for local and pyarrow paths with
`spark.read.format("tabular")`, and prunes sheets by pushed filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf import schema as S
from sheaf.deploy import ship
from sheaf.registry import open_bytes


def cell_row(file: str, sheet: str, index: int, cell, formatter) -> tuple:
    """One row of CELLS."""
    row, col, seq, v, kind, fmt, url = cell
    slot = {
        "v_bool": v if isinstance(v, bool) else None,
        "v_long": v if isinstance(v, int) and not isinstance(v, bool) else None,
        "v_double": v if isinstance(v, float) else None,
        "v_string": v if isinstance(v, str) else None,
        "v_ts": v if isinstance(v, datetime) else None,
    }
    return (file, sheet, index, row, col, seq, kind or S.BLANK, *slot.values(), fmt, formatter.codes.get(fmt), url)


def file_cells(name: str, data: bytes, sheet: str | None = None, options: dict | None = None) -> Iterator[tuple]:
    book = open_bytes(name, data, **(options or {}))
    for i, (title, _) in enumerate(book.sheets()):
        if sheet is None or sheet == title:
            grid = book.grid(i)
            if grid is not None:
                for cell in grid:
                    yield cell_row(name, title, i, cell, grid.formatter)


def file_sheets(name: str, data: bytes, options: dict | None = None) -> Iterator[tuple]:
    """One row of SHEETS for each; a file that cannot be read has one row with the error."""
    try:
        book = open_bytes(name, data, **(options or {}))
        for i, (title, hidden) in enumerate(book.sheets()):
            g = book.grid(i)
            if g is not None:
                yield (name, book.format, title, i, hidden, book.encrypted, g.n_rows, g.n_cols, not g.cells and g.n_rows <= 1 and g.n_cols <= 1, None)
    except Exception as e:  # noqa: BLE001  any broken file becomes a row
        yield (name, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _parsed(files: DataFrame, kind, parse) -> DataFrame:
    arrow = to_arrow_schema(kind)
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _batches(parse(name, data), arrow)

    return files.mapInArrow(run, kind)


def read_cells(spark: SparkSession, paths: str | list[str], sheet: str | None = None, permissive: bool = False, **options) -> DataFrame:
    """Cells of all sheets of the files. Unreadable files fail the query, or have no cells if `permissive`."""

    def parse(name, data):
        try:
            yield from file_cells(name, data, sheet, options)
        except Exception:  # noqa: BLE001
            if not permissive:
                raise

    return _parsed(_files(spark, paths), S.CELLS, parse)


def read_sheets(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return _parsed(_files(spark, paths), S.SHEETS, lambda n, d: file_sheets(n, d, options))


# --- data source -----------------------------------------------------------------


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, a folder's files, or a pattern's."""
    import fnmatch

    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    if any(c in inner for c in "*?["):
        folder = inner.rpartition("/")[0]
        while any(c in folder for c in "*?["):
            folder = folder.rpartition("/")[0]
        infos = [x for x in fs.get_file_info(pafs.FileSelector(folder or ".", recursive=True)) if fnmatch.fnmatch(x.path, inner)]
    else:
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = fs.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else [info]
    return sorted((prefix + x.path, x.size or 0) for x in infos if x.type == pafs.FileType.File)


def _load(path: str) -> bytes:
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(inner) as f:
        return f.read()


class TabularReader(DataSourceReader):
    """Files in partitions of about `partition_bytes`; filters sheet = ... and file = ... prune before parsing."""

    def __init__(self, options: dict, what: str):
        self.path, self.what = options["path"], what
        self.sheet, self.file = options.get("sheet"), None
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.more = {k: options[k] for k in ("password",) if k in options}
        if "date1904" in options:
            self.more["date1904"] = options["date1904"].lower() in ("1", "true")
        if "strict" in options:
            self.more["strict"] = options["strict"].lower() in ("1", "true")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.sheet is None and self.what == "cells":
                self.sheet = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("file",) and self.file is None:
                self.file = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, part, held = [], [], 0
        for path, size in _listed(self.path):
            if self.file is not None and path != self.file:
                continue
            if part and held + size > self.size:
                out.append(FilePartition(part))
                part, held = [], 0
            part.append(path)
            held += size
        return [*out, FilePartition(part)] if part else out or [FilePartition([])]

    def read(self, partition: FilePartition):
        kind = S.CELLS if self.what == "cells" else S.SHEETS
        for path in partition.paths:
            rows = file_cells(path, _load(path), self.sheet, self.more) if self.what == "cells" else file_sheets(path, _load(path), self.more)
            yield from _batches(rows, to_arrow_schema(kind))


class Tabular(DataSource):
    """spark.read.format("tabular").option("sheet", ...).load(path): the cells."""

    what = "cells"

    @classmethod
    def name(cls) -> str:
        return "tabular"

    def schema(self):
        return S.CELLS

    def reader(self, schema):
        return TabularReader(dict(self.options), self.what)


class TabularSheets(Tabular):
    """spark.read.format("tabular_sheets").load(path): the list of sheets."""

    what = "sheets"

    @classmethod
    def name(cls) -> str:
        return "tabular_sheets"

    def schema(self):
        return S.SHEETS


def install(spark: SparkSession) -> None:
    """Register both data sources with the session and let filters reach them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tabular)
    spark.dataSource.register(TabularSheets)


def listed(sheets: DataFrame) -> DataFrame:
    """The sheets that a listing shows: all, but for hidden ones of legacy workbooks."""
    return sheets.where(~(F.coalesce("hidden", F.lit(False)) & (F.col("format") == "xls")))


def hidden(sheets: DataFrame) -> DataFrame:
    return sheets.where("hidden")
