"""Small writers of workbooks and text: fixtures of tests, and the far end of round trips."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape, quoteattr

from sheaf.sources import rc4
from sheaf.sources import xls as B

Sheet = tuple[str, list[list[object]]]


def letters(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def tsv(rows: list[list[object]]) -> bytes:
    return "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows).encode()


def comma_separated(rows: list[list[object]]) -> bytes:
    def field(v) -> str:
        s = "" if v is None else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s

    return "".join(",".join(map(field, r)) + "\n" for r in rows).encode()


def xlsx(sheets: list[Sheet], formats: dict[int, str] | None = None, styles: list[int] | None = None, merges: dict[str, list[str]] | None = None, links: dict[str, dict[str, str]] | None = None,
         hidden: tuple[str, ...] = (), date1904: bool = False, dimension: bool = True) -> bytes:
    """A workbook. A cell is a value, or (value, style); a style is a place in `styles`, the list of format ids."""
    strings: list[str] = []
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office, package = ("http://schemas.openxmlformats.org/" + x for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006/relationships"))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        rels, tabs = "", ""
        for i, (name, rows) in enumerate(sheets):
            rels += f'<Relationship Id="rId{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
            state = ' state="hidden"' if name in hidden else ""
            tabs += f'<sheet name={quoteattr(name)} sheetId="{i + 1}"{state} r:id="rId{i + 1}"/>'
            body, width = "", max(map(len, rows), default=0)
            for r, row in enumerate(rows):
                cells = ""
                for c, v in enumerate(row):
                    v, style = v if isinstance(v, tuple) else (v, 0)
                    at = f'r="{letters(c)}{r + 1}"' + (f' s="{style}"' if style else "")
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells += f'<c {at} t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f"<c {at}><v>{v!r}</v></c>"
                    else:
                        strings.append(str(v))
                        cells += f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
                body += f'<row r="{r + 1}">{cells}</row>'
            if rows and width and dimension:
                body = f'<dimension ref="A1:{letters(width - 1)}{len(rows)}"/><sheetData>{body}</sheetData>'
            else:
                body = f"<sheetData>{body}</sheetData>"
            if merges and name in merges:
                body += "<mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merges[name]) + "</mergeCells>"
            if links and name in links:
                body += "<hyperlinks>" + "".join(f'<hyperlink ref="{ref}" r:id="L{k}"/>' for k, ref in enumerate(links[name])) + "</hyperlinks>"
                z.writestr(
                    f"xl/worksheets/_rels/sheet{i + 1}.xml.rels",
                    f'{head}<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="L{k}" Type="{office}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for k, u in enumerate(links[name].values())) + "</Relationships>",
                )
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{head}<worksheet xmlns="{main}" xmlns:r="{office}">{body}</worksheet>')
        n = len(sheets)
        rels += f'<Relationship Id="rId{n + 1}" Type="{office}/styles" Target="styles.xml"/><Relationship Id="rId{n + 2}" Type="{office}/sharedStrings" Target="/xl/sharedStrings.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">{rels}</Relationships>')
        flag = '<workbookPr date1904="1"/>' if date1904 else ""
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}">{flag}<sheets>{tabs}</sheets></workbook>')
        own = "".join(f'<numFmt numFmtId="{k}" formatCode={quoteattr(v)}/>' for k, v in (formats or {}).items())
        xfs = "".join(f'<xf numFmtId="{k}" xfId="0" applyNumberFormat="1"/>' for k in styles or [0])
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><numFmts>{own}</numFmts><cellStyleXfs><xf numFmtId="0"/></cellStyleXfs><cellXfs>{xfs}</cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>")
    return out.getvalue()


# --- legacy workbooks -------------------------------------------------------------


def _rec(kind: int, data: bytes = b"") -> bytes:
    return struct.pack("<2H", kind, len(data)) + data


def _sst(strings: list[str], limit: int = 8224) -> bytes:
    """The shared strings; records are cut wherever they are full, with a new width flag inside a string."""
    out, part, kind = b"", struct.pack("<2I", len(strings), len(strings)), B.SST
    for s in strings:
        wide = int(any(ord(c) > 255 for c in s))
        raw = s.encode("utf-16-le") if wide else s.encode("latin-1")
        if len(part) + 4 > limit:
            out, part, kind = out + _rec(kind, part), b"", B.CONTINUE
        part += struct.pack("<HB", len(raw) // (1 + wide), wide)
        while raw:
            room = (limit - len(part)) // (1 + wide) * (1 + wide)
            part, raw = part + raw[:room], raw[room:]
            if raw:
                out, part, kind = out + _rec(kind, part), bytes([wide]), B.CONTINUE
    return out + _rec(kind, part)


def workbook_stream(sheets: list[Sheet], formats: dict[int, str] | None = None, styles: list[int] | None = None, merges: dict[str, list[tuple[int, int, int, int]]] | None = None,
                    hidden: tuple[str, ...] = (), date1904: bool = False, extra: dict[str, bytes] | None = None, sst_limit: int = 8224) -> bytes:
    """The records of a legacy workbook. Cells are as in `xlsx`; extra: more records of a sheet, ready made."""
    strings, bodies = [], []
    bof = lambda kind: _rec(B.BOF, struct.pack("<4HQ", 0x0600, kind, 0, 0x07CC, 0))
    for name, rows in sheets:
        body = bof(0x10) + _rec(B.DIMENSIONS, struct.pack("<2I3H", 0, len(rows), 0, max(map(len, rows), default=0), 0))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                v, style = v if isinstance(v, tuple) else (v, 0)
                head = struct.pack("<3H", r, c, style)
                if isinstance(v, bool):
                    body += _rec(B.BOOLERR, head + bytes([v, 0]))
                elif isinstance(v, int) and -(1 << 29) <= v < 1 << 29:
                    body += _rec(B.RK, head + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
                elif isinstance(v, (int, float)):
                    body += _rec(B.NUMBER, head + struct.pack("<d", v))
                elif v is not None:
                    strings.append(str(v))
                    body += _rec(B.LABELSST, head + struct.pack("<I", len(strings) - 1))
        if merges and name in merges:
            body += _rec(B.MERGECELLS, struct.pack("<H", len(merges[name])) + b"".join(struct.pack("<4H", *m) for m in merges[name]))
        bodies.append(body + (extra or {}).get(name, b"") + _rec(B.EOF))
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    before = bof(0x05) + _rec(B.DATE1904, struct.pack("<H", int(date1904))) + b"".join(_rec(B.FORMAT, struct.pack("<H", k) + text(v)) for k, v in (formats or {}).items())
    before += b"".join(_rec(B.XF, struct.pack("<2H", 0, k) + bytes(16)) for k in styles or [0])
    after = _sst(strings, sst_limit) + _rec(B.EOF)
    names = [bytes([len(n)]) + (b"\0" + n.encode("latin-1") if n.isascii() else b"\1" + n.encode("utf-16-le")) for n, _ in sheets]
    at = len(before) + sum(4 + 6 + len(n) for n in names) + len(after)
    tabs = b""
    for (name, _), n, body in zip(sheets, names, bodies):
        tabs += _rec(B.BOUNDSHEET, struct.pack("<I2B", at, int(name in hidden), 0) + n)
        at += len(body)
    return before + tabs + after + b"".join(bodies)


def locked(stream: bytes, password: str = rc4.DEFAULT_PASSWORD, salt: bytes = bytes(range(16))) -> bytes:
    """The same records encrypted, with a protection record behind the first."""
    key, verifier = rc4.base_key(password, salt), bytes(range(100, 116))
    proof = rc4.rc4(rc4.block_key(key, 0), verifier + rc4.md5(verifier).digest())
    first = 4 + struct.unpack_from("<H", stream, 2)[0]
    note = _rec(B.FILEPASS, struct.pack("<H", 1) + struct.pack("<2H", 1, 1) + salt + proof)
    grown, out = stream[:first] + note + stream[first:], bytearray()
    for at, kind, data in B.records(grown):
        if kind == B.BOUNDSHEET:
            data = struct.pack("<I", struct.unpack_from("<I", data)[0] + len(note)) + data[4:]
        out += _rec(kind, data)
    return B.decrypt(bytes(out), key)  # the cipher is its own inverse, and clear parts stay


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams below 4096 bytes go to the mini stream."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def chain(raw: bytes) -> int:
        if not raw:
            return 0xFFFFFFFE
        first = len(sectors)
        parts = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, len(raw), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), 0xFFFFFFFE])
        return first

    mini, mini_fat, entries = b"", [], []
    for name, raw in streams.items():
        if len(raw) < 4096:
            at, n = len(mini) // 64, -(-len(raw) // 64)
            mini += raw.ljust(n * 64, b"\0")
            mini_fat += [*range(at + 1, at + n), 0xFFFFFFFE] if n else []
            entries.append((name, 2, at if n else 0xFFFFFFFE, len(raw)))
        else:
            entries.append((name, 2, chain(raw), len(raw)))
    entries.insert(0, ("Root Entry", 5, chain(mini), len(mini)))

    def entry(name: str, kind: int, start: int, size: int, child: int) -> bytes:
        n = name.encode("utf-16-le") + b"\0\0"
        return n.ljust(64, b"\0") + struct.pack("<HBB3I", len(n), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", start, size)

    dir_at = chain(b"".join(entry(*e, 1 if i == 0 and len(entries) > 1 else 0xFFFFFFFF) for i, e in enumerate(entries)))
    ints = lambda x: struct.pack(f"<{len(x)}I", *x)
    pad = lambda x: x + [0xFFFFFFFF] * (-len(x) % 128)
    n_mini = len(pad(mini_fat)) // 128
    mini_at = chain(ints(pad(mini_fat)))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    assert n_fat <= 109, "too large for this writer"
    places = list(range(len(sectors), len(sectors) + n_fat))
    table = pad(fat + [0xFFFFFFFD] * n_fat)
    head = struct.pack("<Q", 0xE11AB1A1E011CFD0) + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, n_fat, dir_at, 0, 4096, mini_at, n_mini, 0xFFFFFFFE, 0) + ints(places + [0xFFFFFFFF] * (109 - n_fat))
    return head + b"".join(sectors) + ints(table)


def xls(sheets: list[Sheet], password: str | None = None, **more) -> bytes:
    stream = workbook_stream(sheets, **more)
    return compound({"Workbook": stream if password is None else locked(stream, password)})
