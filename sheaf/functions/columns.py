"""Number, date and text functions as Spark column expressions.

Most are built from Spark's own functions and stay in generated code. General of
floats, exponents and fractions need shortest digits, exact rounding or a loop
with an early end, and run as Arrow-batched functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import values as V
from sheaf.functions.formats import Format

SPACES = r"\s\x0B\u0085   -     　"


def whole(x: Column) -> Column:
    """Toward zero, as a long; what does not fit is the smallest long, null stays null."""
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("long"), F.lit(-(2**63))))


def fixed(x: Column, places: int) -> Column:
    """Exact binary value rounded half to even, as printf does in Go and C; format_string rounds half up.

    format_number rounds the shortest digits, which end before the last place where doubles lie further apart than
    that; there the whole part is split off. Exact below 2^63 for 15 places at most.
    """
    show = lambda c: F.call_function("format_number", c, F.lit("0" + ("." + "0" * places if places else "")))
    size = F.abs(x.cast("double"))
    part = show(F.abs(x - whole(x)))
    carry = F.when(part.startswith("1"), F.signum(x).try_cast("long")).otherwise(F.lit(0))
    split = F.concat((whole(x) + carry).cast("string"), F.substring(part, 2, 1 << 30))
    return F.when((size >= max(2.0**52 / 10**places, 1.0)) & (size < 2.0**63), split).otherwise(show(x))


def scientific(x: Column, places: int) -> Column:
    """Exact binary value rounded half to even; Spark's exponent patterns round some ties up."""
    return _each(lambda v: f"{v:.{places}E}", x)


def commas(s: Column) -> Column:
    """Thousands commas in the whole part of a number's text."""
    end = F.regexp_extract(s, r"^-?([^.eE]*)", 1)
    sign = F.regexp_extract(s, r"^(-?)", 1)
    tail = F.regexp_extract(s, r"^-?[^.eE]*(.*)$", 1)
    return F.concat(sign, F.regexp_replace(end, r"(?<=.)(?=(.{3})+$)", ","), tail)


def parens(s: Column) -> Column:
    return F.when(s.startswith("-"), F.concat(F.lit("("), F.substring(s, 2, 1 << 30), F.lit(")"))).otherwise(s)


def _each(text, x: Column) -> Column:
    """A function of one double, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: text(float(v)), na_action="ignore").astype(object)

    return run(x.cast("double"))


def general(x: Column) -> Column:
    """The General format of doubles."""
    return _each(V.general, x)


def shortest(x: Column) -> Column:
    """Default printing of doubles."""
    return _each(V.shortest, x)


def fraction(x: Column, digits: int) -> Column:
    return _each(lambda v: V.fraction(v, digits), x)


def serial_to_timestamp(serial: Column, date1904: bool = False) -> Column:
    """Serial day number to a timestamp without zone; fractions of a microsecond are cut off."""
    x = serial.cast("double")
    offset = 2416481.0 if date1904 else 2415019.0
    base = "1904-01-01" if date1904 else "1899-12-30"
    julian = x + F.lit(0.5) + F.lit(offset - 0.5)
    late = whole(x) >= 61
    day = F.when(late, whole(x)).otherwise(whole(julian) - F.lit(int(offset)))
    part = F.when(late, x - whole(x)).otherwise(julian - whole(julian))
    micros = F.expr("0L") + F.floor(whole(part * F.lit(86400e9)) / F.lit(1000)).cast("long")
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(days=day.try_cast("int"), secs=(micros.cast("decimal(20,6)") / F.lit(1000000)).cast("decimal(18,6)"))


_PATTERN = {
    "month_name": "MMMM", "month_abbr": "MMM", "day_name": "EEEE", "day_abbr": "EEE", "year": "yyyy", "month02": "MM", "day02": "dd", "hour12_02": "hh", "minute02": "mm", "second02": "ss",
    "year2": "yy", "hour": "HH", "month": "M", "day": "d", "hour12": "h", "minute": "m", "second": "s", "AM": "a",
}


def time_text(t: Column, layout: str) -> Column:
    """A timestamp in a layout: one date_format for each field, literals between."""

    def part(name: str, text: str) -> Column:
        if not name:
            return F.lit(text)
        if name in _PATTERN:
            return F.date_format(t, _PATTERN[name])
        if name == "zone":
            return F.lit("UTC")
        if name == "am":
            return F.lower(F.date_format(t, "a"))
        if name == "day_pad":
            return F.lpad(F.date_format(t, "d"), 2, " ")
        digit, places, mark = name[8], int(name[9:-1]), name[-1]
        digits = F.substring(F.concat(F.date_format(t, "SSSSSS"), F.lit("000")), 1, places)
        if digit == "0":
            return F.concat(F.lit(mark), digits)
        short = F.regexp_replace(digits, "0+$", "")
        return F.when(short == "", "").otherwise(F.concat(F.lit(mark), short))

    return F.concat(*[part(n, s) for n, s in V.layout_tokens(layout)])


def chinese_noon(s: Column) -> Column:
    once = lambda c, a, b: F.regexp_replace(c, f"^(.*?){a}", f"$1{b}")
    return once(once(s, "AM", "上午"), "PM", "下午")


def render(f: Format, x: Column, date1904: bool = False) -> Column:
    """Text of a double (or, for times, a serial or a timestamp) column in a format."""
    if f.op == "switch":
        at = lambda i: render(f.sections[i] if i < len(f.sections) else f.sections[0], x, date1904)
        return F.when(x.isNull(), "").when(x == 0, at(2)).when(x < 0, at(1)).otherwise(at(0))
    if f.op == "static":
        return F.lit(f.text)
    if f.op == "general":
        return general(x)
    if f.op == "time":
        s = time_text(x, f.text)
        return chinese_noon(s) if f.chinese else s
    if f.op == "fraction":
        s = fraction(x, f.digits)
    else:
        scaled = x * F.lit(float(f.scale)) if f.scale != 1 else x
        s = whole(scaled).cast("string") if f.verb == "d" else fixed(scaled, f.places) if f.verb == "f" else scientific(scaled, f.places)
        if f.width > 1:
            s = F.when(F.length(s) < f.width, F.lpad(s, f.width, " ")).otherwise(s)
        if f.percent:
            s = F.concat(s, F.lit("%"))
    if f.commas:
        s = commas(s)
    if f.parens:
        s = parens(s)
    if f.before or f.after:
        s = F.concat(F.lit(f.before), s, F.lit(f.after))
    return F.when(x == 0, "-").otherwise(s) if f.zero_dash else s


# --- coercion, comparison, text ---------------------------------------------------


def truth(s: Column) -> Column:
    """Texts that count as true; null and all others are false."""
    return F.coalesce(s.isin(*V.TRUE_TEXTS), F.lit(False))


def scan_bool(s: Column) -> Column:
    """Typed read of a text field as a boolean: case does not matter here."""
    return F.lower(s).isin("1", "t", "true", "y", "yes")


def scanned_long(s: Column) -> Column:
    """The whole number that a text begins with, or null."""
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def scanned_double(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def text_to_long(s: Column) -> Column:
    """Strict coercion of text: what is no whole number is 0, what is too large is the extreme."""
    good = s.rlike(r"^[+-]?\d+$")
    clamped = F.when(s.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(good, F.coalesce(s.try_cast("long"), clamped)).otherwise(F.lit(0).cast("long"))


def text_to_double(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")).otherwise(F.lit(0.0))


def cell_less(a: Column, b: Column) -> Column:
    """a < b of cells (structs of kind, v_bool, v_long, v_double, v_string)."""
    ka, kb = a["kind"], b["kind"]

    def is_(k: Column, *names: str) -> Column:
        return k.isin(*names)

    text = lambda c: F.when(c["kind"] == "integer", c["v_long"].cast("string")).otherwise(c["v_string"])
    num = lambda c: F.when(c["kind"] == "integer", c["v_long"].cast("double")).otherwise(c["v_double"])
    true_b = F.when(kb == "boolean", b["v_bool"]).when(kb == "integer", b["v_long"] != 0).when(kb == "float", b["v_double"] != 0).otherwise(truth(b["v_string"]))
    int_text = F.coalesce(a["v_long"] < scanned_long(b["v_string"]), text(a) < b["v_string"])
    text_int = F.coalesce(scanned_long(a["v_string"]) < b["v_long"], a["v_string"] < text(b))
    # Floats print shortest only in Python; text that scans as no number is compared with that print.
    float_text = F.coalesce(a["v_double"] < scanned_double(b["v_string"]), shortest(a["v_double"]) < b["v_string"])
    text_float = F.coalesce(scanned_double(a["v_string"]) < b["v_double"], a["v_string"] < shortest(b["v_double"]))
    return (
        F.when(is_(ka, "blank") | is_(kb, "blank"), False)
        .when(is_(ka, "date") & is_(kb, "date"), a["v_ts"] < b["v_ts"])
        .when(ka == "boolean", ~a["v_bool"] & true_b)
        .when((ka == "string") & (kb == "boolean"), b["v_bool"] & ~truth(a["v_string"]))
        .when(kb == "boolean", num(a) < b["v_bool"].cast("int"))
        .when((ka == "integer") & (kb == "integer"), a["v_long"] < b["v_long"])
        .when(ka.isin("integer", "float") & kb.isin("integer", "float"), num(a) < num(b))
        .when((ka == "integer") & (kb == "string"), int_text)
        .when((ka == "float") & (kb == "string"), float_text)
        .when((ka == "string") & (kb == "integer"), text_int)
        .when((ka == "string") & (kb == "float"), text_float)
        .otherwise(a["v_string"] < b["v_string"])
    )


def cell_equal(a: Column, b: Column) -> Column:
    """By value if either is a number (text scanned, else 0); else if neither is less. Blanks equal only blanks."""
    value = lambda c: (
        F.when(c["kind"] == "integer", c["v_long"].cast("double")).when(c["kind"] == "float", c["v_double"]).when(c["kind"] == "string", F.coalesce(scanned_double(c["v_string"]), F.lit(0.0))).otherwise(F.lit(0.0))
    )
    numeric = a["kind"].isin("integer", "float") | b["kind"].isin("integer", "float")
    return F.when((a["kind"] == "blank") | (b["kind"] == "blank"), a["kind"] == b["kind"]).when(numeric, value(a) == value(b)).otherwise(cell_less(a, b) == cell_less(b, a))


def condense(s: Column) -> Column:
    """Runs of blanks, tabs and line ends as one space."""
    return F.regexp_replace(s, "[ \n\r\t]+", " ")


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+$", "")


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z0-9]+", "_")


def base_name(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"\.[^.]*$", "")


def shard_path(file: Column, sheet: Column) -> Column:
    """Relative path of a sheet's text file: two levels of the name's md5, base name and sheet."""
    base = base_name(file)
    h = F.md5(base.cast("binary"))
    name = F.when(sheet == file, "main").otherwise(safe_name(sheet))
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(base, F.lit("."), name, F.lit(".tsv")))


def column_index(letters: Column) -> Column:
    """A -> 0, Z -> 25, AA -> 26."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def cell_reference(ref: Column) -> tuple[Column, Column]:
    """Row and column, from 0, of a reference like $B$12."""
    bare = F.regexp_replace(F.upper(ref), r"\$", "")
    return F.regexp_extract(bare, r"([0-9]+)$", 1).try_cast("int") - 1, column_index(F.regexp_extract(bare, r"^([A-Z]+)", 1))
