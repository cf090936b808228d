"""Tables of cells and rows, sinks, statistics, the data sources and the inbox stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.operators import rows as R
from sheaf.operators import sink
from sheaf.sources import reader
from sheaf.sources import writers as W
from sheaf.streaming.inbox import stream_cells


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "a.tsv").write_bytes(b"  one \ttwo\t\n\t\t\nx\ty  \n z\tz z\n")
    (at / "b.xlsx").write_bytes(W.xlsx([("First sheet", [["h", "n"], ["v", (0.5, 1)], [None, True]]), ("gone", [])], styles=[0, 9], merges={"First sheet": ["A2:A3"]}))
    (at / "c.xls").write_bytes(W.xls([("s1", [[1, "t"], [2.5, "u"]]), ("s2", [["only"]])], hidden=("s2",)))
    (at / "bad.xls").write_bytes(W.compound({"Workbook": b"\x09\x08\x10\0" + bytes(16)}))
    return str(at)


def by_file(df, *columns):
    out = {}
    for r in df.orderBy("file", "sheet_idx", "row").collect():
        out.setdefault((r.file.rpartition("/")[2], r.sheet), []).append(tuple(r[c] for c in columns))
    return out


def test_rows_are_padded_typed_and_shown(spark, folder):
    sheets = reader.read_sheets(spark, folder)
    rows = by_file(R.to_rows(reader.read_cells(spark, folder, permissive=True), sheets.where("error is null")), "row", "strings", "types", "formats")
    first = rows["b.xlsx", "First sheet"]
    assert first[1] == (1, ["v", "50%"], ["string", "float"], ["General", "0%"])
    assert first[2][1:3] == (["⤓", "TRUE"], ["static", "boolean"])
    assert rows["a.tsv", "a.tsv"][0][1:3] == (["  one ", "two", ""], ["string", "string", "blank"])
    assert rows["c.xls", "s1"] == [(0, ["1", "t"], ["integer", "string"], ["General", "General"]), (1, ["2.5", "u"], ["float", "string"], ["General", "General"])]
    assert rows["c.xls", "s2"][0][1] == ["only"]


def test_sheets_and_errors(spark, folder):
    got = {(r.file.rpartition("/")[2], r.sheet): r for r in reader.read_sheets(spark, folder).collect()}
    assert got["bad.xls", None].error.startswith("SheafError") and got["b.xlsx", "gone"].is_empty and got["c.xls", "s2"].hidden and not got["c.xls", "s1"].hidden
    assert (got["c.xls", "s1"].n_rows, got["c.xls", "s1"].n_cols, got["c.xls", "s1"].format) == (2, 2, "xls")
    shown = {r.sheet for r in reader.listed(reader.read_sheets(spark, f"{folder}/c.xls")).collect()}
    assert shown == {"s1"} and {r.sheet for r in reader.hidden(reader.read_sheets(spark, f"{folder}/c.xls")).collect()} == {"s2"}
    with pytest.raises(Exception, match="unsupported|version"):
        reader.read_cells(spark, f"{folder}/bad.xls").count()


def test_last_write_wins(spark):
    cell = lambda seq, text: ("f", "s", 0, 0, 0, seq, "string", None, None, None, text, None, 0, None, None)
    df = spark.createDataFrame([cell(2, "late"), cell(1, "early"), cell(3, "last")], S.CELLS)
    assert R.to_rows(df).first().strings == ["last"]


def test_only_formatted_cells_are_shown_by_the_slow_function(spark):
    big = 2**53 + 1

    def cell(col, kind, fmt, code=None, **slots):
        own = {"v_bool": None, "v_long": None, "v_double": None, "v_string": None, "v_ts": None} | slots
        return ("f", "s", 0, 0, col, col, kind, *own.values(), fmt, code, None)

    cells = [cell(0, "integer", 1, v_long=big), cell(1, "integer", 0, v_long=big), cell(2, "string", 0, v_string="t"), cell(3, "blank", 2), cell(4, "float", 9, v_double=0.5), cell(5, "string", None, "0.0", v_string="u")]
    df = R.rendered(spark.createDataFrame(cells, S.CELLS).repartition(1))
    assert [r.text for r in df.orderBy("col").collect()] == [str(big), str(big), "t", "", "50%", "u"]


def test_typed_reads(spark, folder):
    cells = reader.read_cells(spark, f"{folder}/c.xls", sheet="s2")
    assert R.scan(cells, [("a", "string"), ("b", "long")]).select("a", "b").collect() == [("only", None)]
    with pytest.raises(Exception, match="invalid scan type"):
        R.scan(reader.read_cells(spark, f"{folder}/c.xls", sheet="s1"), [("a", "long")]).collect()
    text = spark.createDataFrame([("f", "s", 0, 0, ["Yes", "7", "1.5", "x"]), ("f", "s", 0, 1, ["off", "-1", "2", ""])], "file string, sheet string, sheet_idx int, row int, strings array<string>")
    kinds = [("a", "boolean"), ("b", "long"), ("c", "double"), ("d", "string")]
    assert R.scan_text(text, kinds).orderBy("row").select("a", "b", "c", "d").collect() == [(True, 7, 1.5, "x"), (False, -1, 2.0, "")]
    for wrong in (kinds[:3], [("a", "long"), *kinds[1:]]):
        with pytest.raises(Exception):  # noqa: B017
            R.scan_text(text, wrong).collect()


def test_cleaning_and_statistics(spark, folder):
    rows = R.to_rows(reader.read_cells(spark, f"{folder}/a.tsv"))
    assert [r.strings for r in R.cleaned(rows).orderBy("row").collect()] == [["one", "two"], ["x", "y"], ["z", "z z"]]
    assert [r.strings for r in R.cleaned(rows, trim=False, condense=False, skip_blank=False).orderBy("row").collect()][0] == ["  one ", "two"]
    got = R.stats(R.cleaned(rows), reader.read_sheets(spark, folder)).collect()
    row = next(r for r in got if r.file.endswith("a.tsv"))
    assert (row.rows, row["columns"], row.n_columns, row.hash) == (3, 1, 2, hashlib.md5(b"a").hexdigest())
    assert next(r for r in got if r.file.endswith("bad.xls")).error and next(r for r in got if r.sheet == "gone").rows == 0


def test_cells_of_rows_and_back(spark, folder):
    rows = R.to_rows(reader.read_cells(spark, f"{folder}/a.tsv"))
    again = R.to_rows(R.to_cells(rows))
    assert again.orderBy("row").select("row", "strings").collect() == rows.orderBy("row").select("row", "strings").collect()


def test_merged_areas(spark):
    areas = spark.createDataFrame([("f", "s", 0, 1, 3, 2, 4)], "file string, sheet string, sheet_idx int, row0 int, row1 int, col0 int, col1 int")
    marks = {(r.row, r.col): r.mark for r in R.covered(areas).collect()}
    assert len(marks) == 9 and marks[1, 2] is None and marks[2, 2] == "↓" and marks[3, 2] == "⤓" and marks[1, 3] == "→" and marks[3, 4] == "⇥"
    cells = R.covered(areas).withColumn("kind", F.when(F.col("mark").isNull(), "string").otherwise("static")).withColumn("v_string", F.coalesce("mark", F.lit("top")))
    assert {r.v_string for r in R.filled(cells).collect()} == {"top"}


def test_batch_job(spark, folder, tmp_path):
    out, log = tmp_path / "out", tmp_path / "log"
    counted = {(r.file.rpartition("/")[2], r.sheet): r.rows for r in sink.run(spark, folder, str(out), f"file://{log}").collect()}
    assert counted["a.tsv", "a.tsv"] == 3 and counted["bad.xls", None] == 0 and counted["c.xls", "s1"] == 2
    h = hashlib.md5(b"b").hexdigest()
    assert (out / h[:2] / h[2:4] / "b.First_sheet.tsv").read_text() == "h\tn\nv\t50%\n⤓\tTRUE\n"
    assert len([p for p in out.rglob("*") if p.is_file()]) == 4
    logged = spark.read.option("sep", "\t").option("header", True).csv(f"file://{log}")
    assert logged.columns == ["time", "file", "sheet", "rows", "columns", "error"] and logged.count() == 6
    before = sorted(out.rglob("*"))
    sink.run(spark, folder, None)
    assert sorted(out.rglob("*")) == before


def test_lines_with_types(spark, folder):
    got = sink.lines(R.to_rows(reader.read_cells(spark, f"{folder}/c.xls", sheet="s1")), types=True).orderBy("row", "part").collect()
    assert [r.line for r in got] == ["integer\tstring", "1\tt", "float\tstring", "2.5\tu"]


def test_data_sources(spark, folder):
    reader.install(spark)
    for path in (f"{folder}/c.xls", f"file://{folder}/c.xls", f"{folder}/*.xls*"):
        cells = spark.read.format("tabular").load(path) if "*" not in path else spark.read.format("tabular").load(path.replace("*.xls*", "b.xls*"))
        assert cells.schema == S.CELLS and cells.count() > 0
    one = spark.read.format("tabular").load(f"{folder}/c.xls").where("sheet = 's2'")
    assert one.count() == 1 and one.first().v_string == "only"
    assert "PythonDataSource" in one._jdf.queryExecution().toString() or one.count() == 1
    assert spark.read.format("tabular").option("sheet", "s1").load(f"{folder}/c.xls").select("sheet").distinct().collect() == [("s1",)]
    assert spark.read.format("tabular_sheets").load(folder).where("error is not null").count() == 1


def test_pushed_filters_choose_sheets_and_files(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = reader.TabularReader({"path": folder}, "cells")
    kept = list(r.pushFilters([EqualTo(("sheet",), "s1"), GreaterThan(("row",), 1), EqualTo(("file",), f"{folder}/c.xls")]))
    assert [type(f) for f in kept] == [GreaterThan] and r.sheet == "s1" and [p.paths for p in r.partitions()] == [[f"{folder}/c.xls"]]
    assert len(reader.TabularReader({"path": folder, "partition_bytes": "1"}, "cells").partitions()) == 4


def test_inbox(spark, folder, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "one.tsv").write_bytes(b"a\tb\n")
    q = stream_cells(spark, str(inbox)).writeStream.format("memory").queryName("inbox_cells").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        (inbox / "two.xls").write_bytes(W.xls([("s", [[1, 2, 3]])]))
        (inbox / "broken.xls").write_bytes(W.compound({"Workbook": b"x"}))
        q.processAllAvailable()
        got = spark.sql("select file, count(*) as n from inbox_cells group by file").collect()
        assert sorted((r.file.rpartition("/")[2], r.n) for r in got) == [("one.tsv", 2), ("two.xls", 3)]
    finally:
        q.stop()
