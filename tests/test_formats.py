"""Number formats, dates, coercion and comparison of single values, and the same as Spark columns."""

import math
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import columns as C
from sheaf.functions import values as V
from sheaf.functions.formats import CODES, FORMATS, GENERAL, TYPES, Formatter, coerce, compile_format, infer, render

#: Format id, value, text.
BUILT_IN = [
    (1, 2.7, "2"), (1, -2.7, "-2"), (2, 0.125, "0.12"), (2, 1.005, "1.00"), (2, 5.0, "5.00"), (3, 1234567.9, "1,234,567"), (4, -1234.567, "-1,234.57"), (9, 0.29, "28%"), (10, 0.256, "25.60%"),
    (11, 12345.678, "1.23E+04"), (48, 0.00012, "1.2E-04"), (12, 42.333333, "42 1/3"), (12, -4.2, "-4 1/5"), (13, 0.47, "8/17"), (12, 3.0, "3"), (12, -0.5, "-1/2"), (37, -1234.0, "(1,234)"),
    (39, -0.5, "(0.50)"), (40, 7.0, "7.00"), (41, 0.0, "-"), (43, -12.5, "-12.50"), (42, -5.0, "$(-5)"), (42, 0.0, "$-"), (44, 1234.5, "$1,234.50"), (0, 2.4e-8, "0.000000024"),
    (0, 123456789.1234, "1.23457e+08"), (0, -123456789.1234, "-1.234567891234e+08"), (0, 0.1 + 0.2, "0.3"), (0, 100000.12345, "100000"), (0, True, "TRUE"), (0, "text", "text"), (49, 7, "7"),
    (0, 12345678901234, "12345678901234"), (0, 1e21, "1e+21"), (0, 2e23, "2e+23"),
]


@pytest.mark.parametrize("fmt_id,value,text", BUILT_IN)
def test_built_in(fmt_id, value, text):
    assert render(FORMATS[fmt_id], value) == text


#: Serial, format id, text.
DATES = [
    (38179.0, 15, "11-Jul-04"), (38179.75, 22, "7/11/04 18:00"), (0.0, 14, "12-30-99"), (1.0, 14, "12-31-99"), (60.0, 14, "02-28-00"), (61.0, 14, "03-01-00"), (0.5, 18, "12:00 PM"), (0.0, 18, "12:00 AM"),
    (45000.25, 46, "6:00:00"), (45000.0, 27, '2023"年"3"月"'), (45000.0, 36, '2023"年"15"月"'), (0.7, 34, '下午 4"时"48"分"'), (0.2, 56, '上午 4"时"48"分"00"秒'), (45000.000005787, 80, "00:00.4"),
    (45000.0, 47, "0000"), (45000.0, 81, "15/3/23"), (45000.5, 79, "12:00:00"),
]


@pytest.mark.parametrize("serial,fmt_id,text", DATES)
def test_dates(serial, fmt_id, text):
    assert render(FORMATS[fmt_id], serial) == text


def test_serials_agree_with_day_arithmetic():
    assert V.serial_to_datetime(0, True) == datetime(1904, 1, 1) and V.serial_to_datetime(100.5, True) == datetime(1904, 4, 10, 12)
    for serial in (0, 5.25, 59.999, 60.5, 61, 1000.125, 45000.75):
        want = V.BASE_1900.timestamp() + serial * 86400
        assert abs(V.serial_to_datetime(serial).timestamp() - want) < 5e-5


#: Custom code, value, text. The last lines hold the oddities that are kept.
CUSTOM = [
    ("0.000", 3.14159, "3.142"), ("#,##0.0", 1234.56, "1,234.6"), ('0.0" kg"', 2.0, "2.0 kg"), ("0%", 0.5, "50%"), ("0.0%", 0.256, "25.6%"), ("[Red]0;[Blue](0)", -5.0, "(-5)"),
    ('0;-0;"zero";@', 0.0, "zero"), ('0;-0;"zero";@', "text", "text"), ('"yes";"yes";"no"', 0.0, "no"), ('"yes";"yes";"no"', 1.0, "yes"), ("yyyy-mm-dd", 45000.0, "2023-03-15"),
    ("d mmmm yyyy", 45000.0, "15 March 2023"), ("hh:mm:ss", 45000.5, "12:00:00"), ("0.00E+00", 12345.0, "1.23E+04"), ("@", 5.0, "5"), ('"only text"', 5.0, "only text"), ("General", 1.5, "1.5"),
    (r"\$0.00", 3.0, "$3.00"), ("_(0.0_)", 3.0, "3.0"), ("00000", 123.0, " 123"), ("h:mm", 45000.5, "12:03"), ("dddd", 45000.0, "Wed15ay"), ("h:mm:ss AM/PM", 45000.75, "6:00:00 AM/PM"),
    ('"pieces" 0', 5.0, "pieces 5.0000000000E+00"),
]


@pytest.mark.parametrize("code,value,text", CUSTOM)
def test_custom(code, value, text):
    assert render(compile_format(code), value) == text


def test_formatter():
    f = Formatter()
    f.add(164, "0.0")
    assert f.kind(164) == "float" and f.apply(164, 2.0) == "2.0" and f.code(164) == "164" and f.code(14) == "mm-dd-yy"
    for bad in (14, 164):
        with pytest.raises(ValueError):
            f.add(bad, "0.00")
    f.add(5, "GENERAL")
    assert f.get(5) == (GENERAL, True) and f.get(999) == (GENERAL, False) and f.apply(999, 1.25) == "1.25" and f.kind(5) is None
    assert set(CODES) == set(FORMATS) and TYPES[14] == "date" and 0 not in TYPES


def test_every_built_in_format_takes_every_value():
    for f in FORMATS.values():
        for v in (None, True, False, 0, -7, 12.5, -0.25, 1e300, math.inf, "", "text", "12.5", datetime(2020, 2, 29, 13, 5, 9, 120000)):
            assert isinstance(render(f, v), str)


#: Value, digits, text.
FRACTIONS = [
    (0.0, 1, "0"), (0.5, 1, "1/2"), (-0.5, 1, "-1/2"), (0.125, 1, "1/8"), (10.0, 1, "10"), (-10.0, 1, "-10"), (10.5, 1, "10 1/2"), (-10.5, 1, "-10 1/2"), (10.25, 1, "10 1/4"), (10.75, 1, "10 3/4"),
    (10.667, 1, "10 2/3"), (-10.25, 1, "-10 1/4"), (-10.75, 1, "-10 3/4"), (-10.667, 1, "-10 2/3"), (3.14159, 1, "3 1/7"), (3.14159, 2, "3 1/7"), (3.14159, 3, "3 16/113"), (3.14159, 4, "3 431/3044"),
    (3.14159, 5, "3 3432/24239"), (3.14159, 6, "3 14159/100000"), (math.pi, 1, "3 1/7"), (math.pi, 2, "3 1/7"), (math.pi, 3, "3 16/113"), (math.pi, 4, "3 16/113"), (math.pi, 5, "3 14093/99532"),
    (-math.pi, 1, "-3 1/7"), (-math.pi, 3, "-3 16/113"), (-math.pi, 5, "-3 14093/99532"),
]


@pytest.mark.parametrize("x,digits,text", FRACTIONS)
def test_fractions(x, digits, text):
    assert V.fraction(x, digits) == text


@settings(max_examples=300, deadline=None)
@given(st.floats(0.001, 0.999), st.integers(1, 3))
def test_fractions_keep_to_their_digits(x, digits):
    n, d = V.fraction_of(x, digits, digits)
    assert 0 <= n < 10**digits and 0 < d < 10**digits


@settings(max_examples=500, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_text_of_floats_reads_back(x):
    assert float(V.plain(x)) == x and float(V.shortest(x)) == x and "e" not in V.plain(x)


def test_commas():
    for n in (0, 1, 12, 123, 1234, 12345, 123456, 1234567, 10**12):
        assert V.commas(str(n)) == f"{n:,}" and V.commas(f"-{n}.125") == f"-{n:,}.125" and V.commas(f"{n}e+10") == f"{n:,}e+10"


COERCED = [
    (True, "integer", 1), (False, "float", 0.0), (True, "string", "TRUE"), (2.9, "integer", 2), (-2.9, "integer", -2), (0.0, "boolean", False), (1.5, "string", "1.5"), (7, "float", 7.0), (7, "boolean", True),
    (7, "string", "7"), (36526, "date", datetime(2000, 1, 1)), (36526.5, "date", datetime(2000, 1, 1, 12)), ("yes", "boolean", True), ("Yes", "boolean", False), ("x", "string", "x"), (None, "integer", None),
]


@pytest.mark.parametrize("value,kind,want", COERCED)
def test_coerce(value, kind, want):
    assert coerce(value, kind) == (want, None if want is None else kind)


def test_coerce_text_under_number_formats():
    assert coerce("Total", "float") == ("Total", "string") and coerce("Total", "integer") == ("Total", "string")
    assert coerce("Total", "float", strict=True) == (0.0, "float") and coerce("12", "integer", strict=True) == (12, "integer")
    assert coerce("9" * 30, "integer", strict=True) == (2**63 - 1, "integer") and coerce(None, "string", strict=True) == ("<nil>", "string")
    assert infer("") == (None, None) and infer(2**64) == (float(2**64), "float") and infer(b"ab") == ("ab", "string")


LESS = [
    (None, 1, False), (1, None, False), (False, True, True), (True, True, False), (False, 3, True), (False, "yes", True), (False, "Yes", False), (1, 2, True), (2, True, False), (0, True, True), (1, 1.5, True),
    (1, 1e300, True), (5, "12abc", True), (13, "12abc", False), (5, "abc", True), (1.5, "2.5x", True), ("12abc", 13, True), ("abc", 5, False), ("a", "b", True), ("no", True, True), ("yes", True, False), ("0.5", 0.75, True),
]


@pytest.mark.parametrize("a,b,want", LESS)
def test_less(a, b, want):
    assert V.less(a, b) is want


def test_equal():
    assert V.equal(1, 1.0) and V.equal("12abc", 12) and not V.equal("13", 12) and V.equal(None, "x") and not V.equal("a", "b") and V.equal(datetime(2020, 1, 1), datetime(2020, 1, 1))


# --- columns -----------------------------------------------------------------------


def test_columns_render_as_values_do(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 0.125, 2.675, 1e15, -1e15, 0.005, 6765.0, 1e-7, 123456789.125] + [round(rng.uniform(-1e6, 1e6), rng.randrange(6)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    ids = [i for i, f in FORMATS.items() if f.op != "time"]
    codes = ["0.000", "#,##0.0", '0.0" kg"', "0%;(0%)", '0.0;-0.0;"zero"', "00000", r"\$#,##0", "0.0E+00"]
    got = df.select("x", *[C.render(FORMATS[i], F.col("x")).alias(f"f{i}") for i in ids], *[C.render(compile_format(c), F.col("x")).alias(f"c{k}") for k, c in enumerate(codes)]).collect()
    for r in got:
        for i in ids:
            assert r[f"f{i}"] == render(FORMATS[i], r.x), (i, r.x)
        for k, c in enumerate(codes):
            assert r[f"c{k}"] == render(compile_format(c), r.x), (c, r.x)


def test_columns_fix_digits_of_large_numbers_as_values_do(spark):
    rng = random.Random(3)
    numbers = [s * rng.uniform(1, 2) * 2.0**e for e in range(-4, 62) for s in (1, -1) for _ in range(5)] + [2.0**45 + 1 - 2.0**-7, -(2.0**45) - 1 + 2.0**-7, math.inf, math.nan]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double")
    for r in df.select("x", C.whole(F.col("x")).alias("w"), *[C.fixed(F.col("x"), p).alias(f"f{p}") for p in (0, 2, 6, 15)]).collect():
        if r.x is None:
            assert set(r[1:]) == {None}
        elif math.isfinite(r.x):
            assert r.w == V.truncated(r.x) and [r[f"f{p}"] for p in (0, 2, 6, 15)] == [f"{r.x:.{p}f}" for p in (0, 2, 6, 15)], r.x


def test_columns_render_times_as_values_do(spark):
    rng = random.Random(2)
    serials = [0.0, 0.999999, 59.5, 60.25, 61.0, 61.00001] + [rng.uniform(0, 80000) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in serials], "x double")
    ids = [i for i, f in FORMATS.items() if f.op == "time"]
    t = df.select("x", C.serial_to_timestamp(F.col("x")).alias("t"), C.serial_to_timestamp(F.col("x"), True).alias("u"))
    for r in t.select("*", *[C.render(FORMATS[i], F.col("t")).alias(f"f{i}") for i in ids]).collect():
        assert r.t == V.serial_to_datetime(r.x) and r.u == V.serial_to_datetime(r.x, True)
        for i in ids:
            assert r[f"f{i}"] == render(FORMATS[i], r.x), (i, r.x)


def test_columns_compare_as_values_do(spark):
    values = [None, True, False, 0, 5, -3, 12, 0.5, 12.0, 1e300, "12abc", "abc", "yes", "Yes", "0.5", " 7 ", "", datetime(2020, 1, 1), datetime(2021, 1, 1)]

    def cell(v):
        v, kind = infer(v)
        slot = {bool: 1, int: 2, float: 3, str: 4, datetime: 5}
        out = [kind or "blank", None, None, None, None, None]
        if v is not None:
            out[slot[type(v)]] = v
        return tuple(out)

    pairs = [(i, j) for i in range(len(values)) for j in range(len(values))]
    kind = "struct<kind:string,v_bool:boolean,v_long:long,v_double:double,v_string:string,v_ts:timestamp_ntz>"
    df = spark.createDataFrame([(i, j, cell(values[i]), cell(values[j])) for i, j in pairs], f"i int, j int, a {kind}, b {kind}")
    for r in df.select("i", "j", C.cell_less(F.col("a"), F.col("b")).alias("l"), C.cell_equal(F.col("a"), F.col("b")).alias("e")).collect():
        a, b = infer(values[r.i])[0], infer(values[r.j])[0]
        mixed_date = isinstance(a, datetime) != isinstance(b, datetime) and None not in (a, b)
        if not mixed_date:
            assert r.l == V.less(a, b), (a, b)
            assert r.e == ((a is b) if None in (a, b) else V.equal(a, b)), (a, b)


def test_text_columns(spark):
    df = spark.createDataFrame([(" 　a \n\t b  ", "/x/My report.v2.xlsx", "My Sheet #1", "$BB$12")], "s string, f string, n string, r string")
    r = df.select(
        C.trim(C.condense(F.col("s"))).alias("s"), C.shard_path(F.col("f"), F.col("n")).alias("p"), C.shard_path(F.col("f"), F.col("f")).alias("q"), *[c.alias(n) for c, n in zip(C.cell_reference(F.col("r")), ("row", "col"))]
    ).first()
    import hashlib

    h = hashlib.md5(b"My report.v2").hexdigest()
    assert (r.s, r.p, r.q, r.row, r.col) == ("a b", f"{h[:2]}/{h[2:4]}/My report.v2.My_Sheet_1.tsv", f"{h[:2]}/{h[2:4]}/My report.v2.main.tsv", 11, 53)
