"""Readers of text, Office Open XML and legacy workbooks, on files made by the writers."""

import struct
from collections import Counter
from datetime import datetime

import pytest

from sheaf.errors import NotInFormat, SheafError, UnknownFormat
from sheaf.registry import open_bytes, register
from sheaf.schema import CONTINUE_COLUMN, CONTINUE_ROW, END_COLUMN, END_ROW
from sheaf.sources import rc4, text, xls, xlsx
from sheaf.sources import writers as W
from sheaf.sources.compound import CompoundFile

ROWS = [["a", "b", None, "é日"], [1, 2.5, True, ""], [-3, 1e10, False, "x" * 9000], [(45000.5, 1), (0.256, 2), None, "→"]]


def values(book, sheet=0):
    return {(r, c): (v, kind) for r, c, _, v, kind, _, _ in book.grid(sheet)}


@pytest.mark.parametrize("ending", ["xlsx", "xls", "locked"])
def test_workbooks(ending):
    data = W.xlsx([("S 1", ROWS), ("two", [])], styles=[0, 14, 10]) if ending == "xlsx" else W.xls([("S 1", ROWS), ("two", [])], password="VelvetSweatshop" if ending == "locked" else None, styles=[0, 14, 10])
    book = open_bytes("file", data)
    assert book.format == ("xlsx" if ending == "xlsx" else "xls") and book.encrypted == (ending == "locked")
    assert book.sheets() == [("S 1", False), ("two", False)] and not book.grid(1).cells
    got = values(book)
    whole = "float" if ending == "xlsx" else "integer"
    assert got[0, 0] == ("a", "string") and got[0, 3] == ("é日", "string") and got[1, 0] == (1, whole) and got[1, 1] == (2.5, "float") and got[1, 2] == (True, "boolean")
    assert got[2, 0] == (-3, whole) and got[2, 1] == (1e10, "float") and got[2, 3] == ("x" * 9000, "string") and got[3, 0] == (datetime(2023, 3, 15, 12), "date")
    assert got[3, 1] == (0.256, "float") and got[3, 3] == ("→", "static") and (0, 2) not in got


def test_wrong_password():
    data = W.xls([("s", [[1]])], password="secret")
    with pytest.raises(SheafError, match="password"):
        open_bytes("f", data)
    assert values(open_bytes("f", data, password="secret")) == {(0, 0): (1, "integer")}


def test_unsupported_protection_is_fatal():
    stream = W.workbook_stream([("s", [[1]])])
    first = 4 + struct.unpack_from("<H", stream, 2)[0]
    data = W.compound({"Workbook": stream[:first] + W._rec(xls.FILEPASS, struct.pack("<H", 2)) + stream[first:]})
    with pytest.raises(SheafError, match="unsupported"):
        open_bytes("f", data)


@pytest.mark.parametrize("limit", [40, 100, 8224])
def test_shared_strings_run_over_records(limit):
    rows = [[f"text {i} " + "äé日"[i % 3] * (i % 37) for i in range(4)] + ["", "plain" * 30] for _ in range(60)]
    book = open_bytes("f", W.xls([("s", rows)], sst_limit=limit))
    got = values(book)
    assert all(got[r, c] == (v, "string") for r, row in enumerate(rows) for c, v in enumerate(row) if v)


def test_string_with_runs_and_phonetics_and_a_change_of_width():
    first = struct.pack("<2I", 2, 2) + struct.pack("<HBHI", 6, 0x0C, 1, 3) + b"abc"
    second = b"\x01" + "日本語".encode("utf-16-le") + b"RUNS" + b"EXT" + struct.pack("<HB", 2, 0) + b"ok"
    assert xls.shared_strings([first, second]) == ["abc日本語", "ok"]


#: Packed number, value.
PACKED = [(0x3FF00000, 1.0), (0x3FF00001, 0.01), ((1234 << 2) | 2, 1234), ((1234 << 2) | 3, 12.34), ((-5 << 2 | 2) & 0xFFFFFFFF, -5)]


@pytest.mark.parametrize("raw,value", PACKED)
def test_packed_numbers(raw, value):
    assert xls.rk_number(raw) == value


def cell(r, c, xf=0):
    return struct.pack("<3H", r, c, xf)


def test_formulas_errors_and_embedded_parts():
    chart = W._rec(xls.BOF, struct.pack("<4HQ", 0x0600, 0x20, 0, 0x07CC, 0)) + W._rec(xls.NUMBER, cell(9, 9) + struct.pack("<d", 1)) + W._rec(xls.EOF)
    extra = (
        W._rec(xls.BOOLERR, cell(1, 0) + bytes([0x07, 1])) + W._rec(xls.BOOLERR, cell(1, 1) + bytes([0x99, 1]))
        + W._rec(xls.FORMULA, cell(2, 0) + struct.pack("<d", 2.5) + bytes(8)) + W._rec(xls.FORMULA, cell(2, 1) + bytes([1, 0, 1, 0, 0, 0, 255, 255]) + bytes(8))
        + W._rec(xls.FORMULA, cell(2, 2) + bytes([2, 0, 0x2A, 0, 0, 0, 255, 255]) + bytes(8)) + W._rec(xls.FORMULA, cell(2, 3) + bytes([3, 0, 0, 0, 0, 0, 255, 255]) + bytes(8))
        + W._rec(xls.FORMULA, cell(2, 4) + bytes([0, 0, 0, 0, 0, 0, 255, 255]) + bytes(8)) + W._rec(xls.STRING, struct.pack("<HB", 5, 0) + b"ab\xe9") + W._rec(xls.CONTINUE, b"\x01" + "日本".encode("utf-16-le"))
        + W._rec(xls.MULRK, struct.pack("<2H", 3, 1) + struct.pack("<HI", 0, (7 << 2) | 2) + struct.pack("<HI", 0, 0x3FF00000) + struct.pack("<H", 2)) + chart
    )
    got = values(open_bytes("f", W.xls([("s", [["x"]])], extra={"s": extra})))
    assert got == {
        (0, 0): ("x", "string"), (1, 0): ("#DIV/0!", "string"), (1, 1): ("<unknown error>", "string"), (2, 0): (2.5, "float"), (2, 1): (True, "boolean"), (2, 2): ("#N/A", "string"),
        (2, 4): ("abé日本", "string"), (3, 1): (7, "integer"), (3, 2): (1.0, "float"),
    }


def test_dialogs_are_skipped():
    assert open_bytes("f", W.xls([("s", [[1]])], extra={"s": W._rec(xls.WSBOOL, b"\0\x10")})).grid(0) is None


def wide(s):
    return struct.pack("<I", len(s) + 1) + s.encode("utf-16-le") + b"\0\0"


def test_links_of_legacy_workbooks():
    url = "http://x.y/z\0".encode("utf-16-le")
    head = lambda flags: bytes(16) + struct.pack("<2I", 2, flags)
    assert xls.hyperlink(head(0x11) + wide("Text ") + xls.URL_MONIKER + struct.pack("<I", len(url)) + url) == ("Text", "http://x.y/z")
    assert xls.hyperlink(head(0x101) + wide("plain")) == ("", "plain") and xls.hyperlink(head(0x98) + wide("t") + wide("frame") + wide("Sheet2!A1")) == ("t", "Sheet2!A1")
    file = struct.pack("<HI", 0, 4) + b"a.x\0" + bytes(24)
    assert xls.hyperlink(head(0x01) + xls.FILE_MONIKER + file + struct.pack("<I", 0)) == ("", "a.x")
    assert xls.hyperlink(head(0x01) + xls.FILE_MONIKER + file + struct.pack("<IIH", 6 + 6, 6, 3) + "日.x".encode("utf-16-le")) == ("", "日.x")
    record = struct.pack("<4H", 0, 1, 0, 0xFF) + head(0x11) + wide("T") + xls.URL_MONIKER + struct.pack("<I", len(url)) + url
    got = values(open_bytes("f", W.xls([("s", [[1, 2, 3], [4, 5, 6]])], extra={"s": W._rec(xls.HLINK, record)})))
    assert got[0, 0] == ("T <http://x.y/z>", "string") and [got[0, 1][0], got[0, 2][0], got[1, 0][0], got[1, 2][0]] == [CONTINUE_COLUMN, END_COLUMN, END_ROW, END_COLUMN]


@pytest.mark.parametrize("kind", ["xlsx", "xls"])
def test_merges(kind):
    rows = [[f"{r}{c}" for c in range(4)] for r in range(5)]
    data = W.xlsx([("s", rows)], merges={"s": ["B2:D4", "A1:A3"]}) if kind == "xlsx" else W.xls([("s", rows)], merges={"s": [(1, 3, 1, 3), (0, 2, 0, 0)]})
    got = {k: v[0] for k, v in values(open_bytes("f", data)).items()}
    assert [got[r, 1] for r in (1, 2, 3)] == ["11", CONTINUE_ROW, END_ROW] and [got[r, 0] for r in (0, 1, 2)] == ["00", CONTINUE_ROW, END_ROW]
    assert [got[2, c] for c in (2, 3)] == [CONTINUE_COLUMN, END_COLUMN] and got[4, 3] == "43"


def test_merges_to_the_last_row_and_without_a_dimension():
    got = values(open_bytes("f", W.xls([("s", [["a"], ["b"], ["c"]])], merges={"s": [(0, 0xFFFF, 0, 0xFF)]})))
    assert [got[r, 0][0] for r in range(3)] == ["a", CONTINUE_ROW, END_ROW]
    got = values(open_bytes("f", W.xlsx([("s", [["a", "b"], ["c", "d"]])], merges={"s": ["A1:B2"]}, dimension=False)))
    assert got[1, 1][0] == END_COLUMN


def test_links_dates_and_hidden_sheets_of_xlsx():
    book = open_bytes("f", W.xlsx([("s", [["x", (100, 1)], ["y", "z"]]), ("h", [[1]])], styles=[0, 14], links={"s": {"A1": "http://a/b", "A2:B2": "http://c/"}}, hidden=("h",), date1904=True))
    assert book.sheets() == [("s", False), ("h", True)]
    cells = {(r, c): (v, kind, url) for r, c, _, v, kind, _, url in book.grid(0)}
    assert cells[0, 0] == ("http://a/b", "hyperlink", "http://a/b") and cells[0, 1][:2] == (datetime(1904, 4, 10), "date") and cells[1, 1][0] == END_COLUMN
    assert values(open_bytes("f", W.xls([("s", [[(100, 1)]])], styles=[0, 14], date1904=True)))[0, 0] == (datetime(1904, 4, 10), "date")
    assert values(open_bytes("f", W.xls([("s", [[(100, 1)]])], styles=[0, 14], date1904=True), date1904=False))[0, 0] == (datetime(1900, 4, 9), "date")


def test_custom_formats_type_and_show_cells():
    for data in (W.xlsx([("s", [[(0.5, 1), ("text", 1)]])], formats={164: "0.0%"}, styles=[0, 164]), W.xls([("s", [[(0.5, 1), ("text", 1)]])], formats={164: "0.0%"}, styles=[0, 164])):
        g = open_bytes("f", data).grid(0)
        assert g.formatter.apply(164, 0.5) == "50.0%" and g.cells[0, 1][1:3] == ("text", "string")
        strict = open_bytes("f", data, strict=True).grid(0)
        assert strict.cells[0, 1][1:3] == (0.0, "float")


def test_references():
    assert xlsx.reference("A1") == (0, 0) and xlsx.reference("$XFD$1048576") == (1048575, 16383) and xlsx.reference("R3C2") == (2, 1) and xlsx.reference("?") == (-1, -1)
    assert xlsx.area("B2:C3") == (1, 2, 1, 2) and [W.letters(c) for c in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_compound_files():
    streams = {"Workbook": b"w" * 5000, "small": b"s" * 100, "empty": b"", "more": b"m" * 4095, "fifth": bytes(range(256)) * 40}
    box = CompoundFile(W.compound(streams))
    assert set(box.names()) == set(streams) and all(box.stream(n) == raw for n, raw in streams.items())
    with pytest.raises(KeyError):
        box.stream("none")
    with pytest.raises(NotInFormat):
        CompoundFile(b"x" * 600)
    with pytest.raises(SheafError):
        CompoundFile(W.compound(streams)[:1500])


def test_rc4():
    #: Published test vector.
    assert rc4.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key = rc4.base_key("pass", bytes(16))
    assert rc4.crypt(key, rc4.crypt(key, b"x" * 3000)) == b"x" * 3000


def test_text_files():
    assert open_bytes("a.tsv", b'a\t"q"\r\n\r\n1\t\n').rows == [["a", '"q"'], [""], ["1", ""]]
    assert open_bytes("a.csv", b'a,"b,""c"""\r\n\r\n1\n').rows == [["a", 'b,"c"'], ["1"]]
    assert open_bytes("a.txt", b"just\none column").format == "tsv" and open_bytes("a.csv", b"").rows == []
    with pytest.raises(UnknownFormat):
        open_bytes("a.csv", b'a,"never closed\n')
    book = open_bytes("dir/a.tsv", b"a\t\tb\n")
    assert book.sheets() == [("a.tsv", False)] and values(book) == {(0, 0): ("a", "string"), (0, 2): ("b", "string")}


#: Lines by width, verdict.
WIDTHS = [({1: 500}, None), ({3: 11}, True), ({3: 10}, None), ({3: 26, 4: 30}, False), ({3: 81, 4: 19}, True), ({3: 80, 1: 20}, False), ({2: 20, 3: 20}, None), ({}, None)]


@pytest.mark.parametrize("counts,verdict", WIDTHS)
def test_width_test(counts, verdict):
    assert text.looks_tabular(Counter(counts)) is verdict


def test_formats_are_tried_in_order():
    for bad in (b"PK\x03\x04 no zip", W.compound({"Other": b"x" * 10})):
        assert open_bytes("a", bad).format == "tsv"
    with pytest.raises(SheafError):
        open_bytes("a.tsv", "\n".join("\t" * (i % 2 + 1) for i in range(60)).encode())

    class Mine(list):
        format = "mine"

    def opener(name, data, **_):
        if not data.startswith(b"MINE"):
            raise NotInFormat("not mine")
        return Mine()

    register("mine", 0, opener)
    assert open_bytes("a", b"MINE...").format == "mine" and open_bytes("a.tsv", b"x").format == "tsv"
