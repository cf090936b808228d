"""Schemas of the extracted tables, cell kinds, and the marks that stand in merged cells."""

from __future__ import annotations

from pyspark.sql import types as T

#: Cell kinds, as they are named in `types` arrays.
BLANK, INTEGER, FLOAT, STRING, BOOLEAN, DATE, HYPERLINK, STATIC = "blank", "integer", "float", "string", "boolean", "date", "hyperlink", "static"

#: Marks in cells that a merge covers.
CONTINUE_COLUMN, END_COLUMN, CONTINUE_ROW, END_ROW = "→", "⇥", "↓", "⤓"
MARKS = (CONTINUE_COLUMN, END_COLUMN, CONTINUE_ROW, END_ROW)

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType())}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in fields.split())])


CELLS = _struct(
    "file:string sheet:string sheet_idx:int row:int col:int seq:int kind:string v_bool:boolean v_long:long v_double:double v_string:string v_ts:time fmt_id:int fmt_code:string url:string"
)
SHEETS = _struct("file:string format:string sheet:string sheet_idx:int hidden:boolean encrypted:boolean n_rows:int n_cols:int is_empty:boolean error:string")
ROWS = _struct("file:string sheet:string sheet_idx:int row:int strings:strings types:strings formats:strings")
