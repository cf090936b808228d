"""Cells to rows and back: rendering, padding, typed reads, merges, cleaning, statistics."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.deploy import ship
from sheaf.functions import columns as C
from sheaf.functions.formats import CODES, FORMATS, GENERAL, compile_format, render

SHEET = ["file", "sheet", "sheet_idx"]


def value_of(r) -> object:
    """The value of a cell struct, as Python has it."""
    kind = r["kind"]
    if kind == S.BOOLEAN:
        return bool(r["v_bool"])
    if kind == S.INTEGER:
        return int(r["v_long"])
    if kind == S.FLOAT:
        return float(r["v_double"])
    if kind == S.DATE and r["v_ts"] is not None and r["v_ts"] is not pd.NaT:
        return r["v_ts"].to_pydatetime() if isinstance(r["v_ts"], pd.Timestamp) else datetime.fromisoformat(str(r["v_ts"])[:26])
    return r["v_string"]


def rendered(cells: DataFrame) -> DataFrame:
    """Cells with `text`: each value in its format. Blank cells are empty, static ones stand for themselves, unknown formats are General.

    Texts, booleans without a format and whole numbers are shown by Spark's own
    functions, and go to Python as a null only; the rest is shown by one Arrow-batched
    function, which compiles each format code once.
    """
    ship(cells.sparkSession)

    @F.pandas_udf("string")
    def exact(c: pd.DataFrame) -> pd.Series:
        compiled: dict = {}

        def one(r) -> str:
            fmt = r["fmt_id"]
            f = FORMATS.get(fmt)
            if f is None and r["fmt_code"]:
                f = compiled.get(r["fmt_code"]) or compiled.setdefault(r["fmt_code"], compile_format(r["fmt_code"]))
            return render(f or GENERAL, value_of(r))

        rest = c[c["needed"].notna()]
        return pd.Series([one(r) for r in rest.to_dict("records")], index=rest.index, dtype=object).reindex(c.index, fill_value=None)

    plain = F.coalesce("fmt_id", F.lit(0)).isin(0, 49)
    native = (
        F.when(F.col("kind") == S.BLANK, "")
        .when(F.col("kind").isin(S.STATIC, S.HYPERLINK), F.col("v_string"))
        .when(plain & (F.col("kind") == S.STRING), F.col("v_string"))
        .when(plain & (F.col("kind") == S.INTEGER), F.col("v_long").cast("string"))
        .when(plain & (F.col("kind") == S.BOOLEAN), F.when(F.col("v_bool"), "TRUE").otherwise("FALSE"))
    )
    # Whole numbers go as digits: pandas would make them floats beside nulls.
    needs = F.struct(
        F.lit(True).alias("needed"), "kind", "v_bool", F.col("v_long").cast("string").alias("v_long"), "v_double", "v_string", "v_ts", F.coalesce("fmt_id", F.lit(0)).alias("fmt_id"), "fmt_code"
    )
    return cells.withColumn("__native", native).withColumn("text", F.coalesce("__native", exact(F.when(F.col("__native").isNull(), needs)))).drop("__native")


def format_code(fmt_id: Column) -> Column:
    """The code of a built-in format, else the number as text."""
    pairs = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.coalesce(pairs[fmt_id], fmt_id.cast("string"))


def to_rows(cells: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """One row of texts, kinds and format codes for each row of a sheet that has a cell, padded to the sheet's width.

    widths: file, sheet_idx, n_cols (of `read_sheets`); without it a sheet is as
    wide as its last cell. Of several cells in one place the one with the
    highest `seq` counts. Rows of a sheet number at most 2^20, columns 2^14.
    """
    last = rendered(cells).groupBy(*SHEET, "row", "col").agg(
        F.max_by(F.struct("text", "kind", format_code(F.coalesce("fmt_id", F.lit(0))).alias("code")), "seq").alias("c")
    )
    by_row = last.groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "c"))).alias("m"), F.max("col").alias("__last"))
    width = widths.select("file", "sheet_idx", F.col("n_cols").alias("__n")) if widths is not None else last.groupBy("file", "sheet_idx").agg((F.max("col") + 1).alias("__n"))
    padded = by_row.join(width, ["file", "sheet_idx"]).withColumn("__c", F.expr("transform(sequence(0, greatest(__n, __last + 1) - 1), i -> element_at(m, i))"))
    field = lambda name, other: F.transform("__c", lambda c: F.coalesce(c[name], F.lit(other)))
    return padded.select(*SHEET, "row", field("text", "").alias("strings"), field("kind", S.BLANK).alias("types"), field("code", "General").alias("formats"))


def to_cells(rows: DataFrame) -> DataFrame:
    """Texts of rows as string cells, blanks left out: the inverse of `to_rows` for text tables."""
    each = rows.select(*SHEET, "row", F.posexplode("strings").alias("col", "v_string")).where("v_string <> ''")
    have = {"kind": F.lit(S.STRING), "fmt_id": F.lit(0), "seq": F.col("col")}
    return each.select(*[have[f.name].cast(f.dataType).alias(f.name) if f.name in have else F.col(f.name) if f.name in each.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.CELLS.fields])


def unpivot(table: DataFrame, order: list[str], file: str, sheet: str) -> DataFrame:
    """A table of a sheet's size (2^20 rows at most) as its cells: rows in the order of `order`, one column a cell, with kinds by type."""
    kinds = []
    for f in table.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            kinds.append((S.BOOLEAN, "v_bool"))
        elif isinstance(f.dataType, T.IntegralType):
            kinds.append((S.INTEGER, "v_long"))
        elif isinstance(f.dataType, T.FractionalType):
            kinds.append((S.FLOAT, "v_double"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds.append((S.DATE, "v_ts"))
        else:
            kinds.append((S.STRING, "v_string"))
    slots = {f.name: f.dataType for f in S.CELLS.fields if f.name.startswith("v_")}
    cells = []
    for i, (f, (kind, slot)) in enumerate(zip(table.schema.fields, kinds)):
        v = F.col(f.name)
        cells.append(F.struct(F.lit(i).alias("col"), F.when(v.isNull(), S.BLANK).otherwise(kind).alias("kind"), *[(v if s == slot else F.lit(None)).cast(t).alias(s) for s, t in slots.items()]))
    from pyspark.sql import Window

    numbered = table.withColumn("__row", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.select(F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), F.lit(0).alias("sheet_idx"), F.col("__row").alias("row"), F.explode(F.array(*cells)).alias("c")).select(
        "file", "sheet", "sheet_idx", "row", "c.col", F.col("c.col").alias("seq"), "c.kind", *[f"c.{s}" for s in slots], F.lit(0).alias("fmt_id"), F.lit(None).cast("string").alias("fmt_code"), F.lit(None).cast("string").alias("url")
    )


# --- typed reads -----------------------------------------------------------------

_SLOTS = {"boolean": ("v_bool", S.BOOLEAN), "long": ("v_long", S.INTEGER), "double": ("v_double", S.FLOAT), "string": ("v_string", S.STRING), "timestamp": ("v_ts", S.DATE)}


def scan(cells: DataFrame, names_types: list[tuple[str, str]], first_row: int = 0) -> DataFrame:
    """A typed table from a sheet's cells, without coercion: a cell of another kind fails the query, a blank is null.

    names_types: column names and one of boolean, long, double, string,
    timestamp, for the leading columns of the sheet.
    """
    picked = []
    for i, (name, kind) in enumerate(names_types):
        slot, want = _SLOTS[kind]
        kinds = [want, S.BLANK, S.HYPERLINK, S.STATIC] if want == S.STRING else [want, S.BLANK]
        here = F.col("col") == i
        bad = F.max(F.when(here & ~F.col("kind").isin(*kinds), F.col("kind")))
        message = F.concat(F.lit(f"invalid scan type: column {i} holds "), bad)
        picked.append(F.when(bad.isNull(), F.max(F.when(here, F.col(slot)))).otherwise(F.raise_error(message)).alias(name))
    return cells.where(F.col("row") >= first_row).groupBy(*SHEET, "row").agg(*picked)


def scan_text(rows: DataFrame, names_types: list[tuple[str, str]]) -> DataFrame:
    """Typed fields of text rows, which must have as many fields as names; numbers must parse, any other text is false."""
    n = len(names_types)
    fields = []
    for i, (name, kind) in enumerate(names_types):
        s = F.col("strings")[i]
        fields.append((C.scan_bool(s) if kind == "boolean" else s if kind == "string" else s.cast(kind)).alias(name))
    checked = rows.withColumn("strings", F.when(F.size("strings") == n, F.col("strings")).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields, found "), F.size("strings").cast("string")))))
    return checked.select(*SHEET, "row", *fields)


# --- merges ----------------------------------------------------------------------


def covered(merges: DataFrame) -> DataFrame:
    """Merged areas (file, sheet, sheet_idx, row0, row1, col0, col1) to one row per cell with the mark it holds; the first cell has none."""
    cells = merges.withColumn("row", F.explode(F.sequence("row0", "row1"))).withColumn("col", F.explode(F.sequence("col0", "col1")))
    down = F.when(F.col("row") == F.col("row1"), S.END_ROW).otherwise(S.CONTINUE_ROW)
    across = F.when(F.col("col") == F.col("col1"), S.END_COLUMN).otherwise(S.CONTINUE_COLUMN)
    first = (F.col("row") == F.col("row0")) & (F.col("col") == F.col("col0"))
    return cells.withColumn("mark", F.when(first, F.lit(None)).when(F.col("col") == F.col("col0"), down).otherwise(across))


def filled(cells: DataFrame) -> DataFrame:
    """Marks replaced by the value of the area's first cell: down the first column, then across."""
    from pyspark.sql import Window

    down, across = Window.partitionBy(*SHEET, "col").orderBy("row"), Window.partitionBy(*SHEET, "row").orderBy("col")
    mark = F.col("v_string").isin(S.CONTINUE_ROW, S.END_ROW) & (F.col("kind") == S.STATIC)
    step = cells.withColumn("v_string", F.when(mark, F.last(F.when(~mark, F.col("v_string")), True).over(down.rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.col("v_string")))
    side = F.col("v_string").isin(S.CONTINUE_COLUMN, S.END_COLUMN) & (F.col("kind") == S.STATIC)
    return step.withColumn("v_string", F.when(side, F.last(F.when(~side, F.col("v_string")), True).over(across.rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.col("v_string")))


# --- cleaning and statistics -------------------------------------------------------


def cleaned(rows: DataFrame, condense: bool = True, trim: bool = True, skip_blank: bool = True) -> DataFrame:
    """White space condensed and trimmed in every field; rows without any text left out."""

    def field(s: Column) -> Column:
        s = C.condense(s) if condense else s
        return C.trim(s) if trim else s

    out = rows.withColumn("strings", F.transform("strings", field)) if condense or trim else rows
    return out.where(F.exists("strings", lambda s: s != "")) if skip_blank else out


def stats(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """file, hash, sheet, rows, columns, n_columns, error of every sheet, and of every file that could not be read.

    columns is the largest index of a column with text, n_columns their number;
    sheets without rows have zeros.
    """
    widest = F.array_max(F.expr("transform(strings, (s, i) -> if(s <> '', i, 0))"))
    per = rows.groupBy("file", "sheet_idx").agg(F.count(F.lit(1)).alias("rows"), F.max(widest).cast("int").alias("columns"))
    joined = sheets.join(per, ["file", "sheet_idx"], "left")
    n, c = F.coalesce("rows", F.lit(0)), F.coalesce("columns", F.lit(0))
    return joined.select("file", F.md5(C.base_name(F.col("file")).cast("binary")).alias("hash"), "sheet", n.alias("rows"), c.alias("columns"), F.when(n > 0, c + 1).otherwise(0).alias("n_columns"), "error")


def is_tabular(lines: DataFrame, line: str, separator: str = "\t") -> DataFrame:
    """The width test of text files as one aggregate over lines: total, widest share and the verdict (null: it says nothing)."""
    widths = lines.groupBy(F.size(F.split(F.col(line), separator, -1)).alias("width")).count()
    wide = F.col("width") > 1
    return widths.agg(F.sum("count").alias("total"), F.max(F.when(wide, F.col("count"))).alias("most")).select(
        "total", "most", F.when((F.col("most") > 10) & (F.col("most") / F.col("total") > 0.8), True).when(F.col("most") > 25, False).alias("tabular")
    )
