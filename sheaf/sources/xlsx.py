"""Office Open XML workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from sheaf.errors import NotInFormat, SheafError
from sheaf.functions.formats import Formatter
from sheaf.functions.values import parse_float
from sheaf.sources.grid import Grid

_REF = re.compile(r"\$?([A-Za-z]+)\$?(\d+)$")
_R1C1 = re.compile(r"R(\d+)C(\d+)$")


def reference(ref: str) -> tuple[int, int]:
    """Row and column from 0; (-1, -1) if it is no reference."""
    if m := _REF.match(ref):
        col = 0
        for c in m[1].upper():
            col = col * 26 + ord(c) - 64
        return int(m[2]) - 1, col - 1
    if m := _R1C1.match(ref):
        return int(m[1]) - 1, int(m[2]) - 1
    return -1, -1


def area(ref: str) -> tuple[int, int, int, int]:
    """First row, last row, first column, last column."""
    first, _, last = ref.partition(":")
    r0, c0 = reference(first)
    r1, c1 = reference(last) if last else (r0, c0)
    return r0, r1, c0, c1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if _local(k) == name), "")


class Workbook:
    format = "xlsx"
    encrypted = False

    def __init__(self, data: bytes, password: str = "", date1904: bool | None = None, strict: bool = False):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError) as e:
            raise NotInFormat("no zip archive") from e
        self.names, self.strict = set(self.zip.namelist()), strict
        if "_rels/.rels" not in self.names:
            raise NotInFormat("an archive without relationships")
        main = [target for kind, _, target, _ in self._relations("_rels/.rels", "") if kind == "officeDocument"]
        if not main:
            raise SheafError("xlsx: invalid document")
        self.formatter, self.xfs, self.found = Formatter(bool(date1904)), [], []
        folder, name = posixpath.split(main[0])
        rels = self._relations(f"{folder}/_rels/{name}.rels".lstrip("/"), folder)
        self.rels = {i: target for _, i, target, _ in rels}
        for e in self._all(main[0], "sheet", "workbookPr"):
            if _local(e.tag) == "workbookPr" and date1904 is None:
                self.formatter.date1904 = _attr(e, "date1904") in ("1", "true")
            elif _local(e.tag) == "sheet" and _attr(e, "name") and _attr(e, "id"):
                self.found.append((_attr(e, "name"), self.rels.get(_attr(e, "id"), ""), _attr(e, "state") not in ("", "visible")))
        self.strings: list[str] = []
        by_kind = {kind: target for kind, _, target, _ in rels}
        if by_kind.get("styles") in self.names:
            self._styles(by_kind["styles"])
        if by_kind.get("sharedStrings") in self.names:
            self.strings = ["".join(x.text or "" for x in si.iter() if _local(x.tag) == "t") for si in self._all(by_kind["sharedStrings"], "si")]

    def _relations(self, path: str, folder: str) -> list[tuple[str, str, str, bool]]:
        if path not in self.names:
            return []
        out = []
        for e in self._all(path, "Relationship"):
            target, external = _attr(e, "Target"), _attr(e, "TargetMode") == "External"
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out.append((_attr(e, "Type").rpartition("/")[2], _attr(e, "Id"), target, external))
        return out

    def _all(self, path: str, *names: str):
        """Elements of these names as they end; what was read is dropped."""
        try:
            with self.zip.open(path) as f:
                for _, e in ET.iterparse(f, ("end",)):
                    if _local(e.tag) in names:
                        yield e
                        e.clear()
        except KeyError as e:
            raise SheafError(f"xlsx: {path} is missing") from e
        except ET.ParseError as e:
            raise SheafError(f"xlsx: {path} is no valid XML") from e

    def _styles(self, path: str) -> None:
        base: list[int] = []
        for e in self._all(path, "numFmt", "cellStyleXfs", "cellXfs"):
            name = _local(e.tag)
            if name == "numFmt" and _attr(e, "numFmtId"):
                try:
                    self.formatter.add(int(_attr(e, "numFmtId")), _attr(e, "formatCode"))
                except ValueError:
                    pass  # built-in formats stay as they are
            elif name == "cellStyleXfs":
                base = [int(_attr(x, "numFmtId") or 0) for x in e]
            elif name == "cellXfs":
                for x in e:
                    parent = int(_attr(x, "xfId") or 0)
                    fmt = int(_attr(x, "numFmtId") or (base[parent] if parent < len(base) else 0))
                    self.xfs.append(0 if _attr(x, "applyNumberFormat") in ("0", "false") else fmt)

    def sheets(self) -> list[tuple[str, bool]]:
        return [(name, hidden) for name, _, hidden in self.found]

    def _value(self, kind: str, text: str):
        if kind == "b":
            return text.startswith("1")
        if kind in ("", "n"):
            x = parse_float(text.strip())
            return text if x is None else x
        if kind == "s":
            k = int(text) if text.strip().isdigit() else -1
            if not 0 <= k < len(self.strings):
                raise SheafError("xlsx: a shared string is missing")
            return self.strings[k]
        return text

    def grid(self, index: int) -> Grid:
        _, path, _ = self.found[index]
        folder, name = posixpath.split(path)
        links = {i: target for _, i, target, _ in self._relations(f"{folder}/_rels/{name}.rels", folder)}
        g, merges, hyper = Grid(self.formatter, self.strict), [], []
        for e in self._all(path, "dimension", "c", "mergeCell", "hyperlink"):
            tag = _local(e.tag)
            if tag == "dimension":
                _, r1, _, c1 = area(_attr(e, "ref"))
                g.resize(r1 + 1, c1 + 1)
            elif tag == "mergeCell":
                merges.append(area(_attr(e, "ref")))
            elif tag == "hyperlink":
                hyper.append((area(_attr(e, "ref")), links.get(_attr(e, "id"), "")))
            else:
                r, c = reference(_attr(e, "r"))
                style = _attr(e, "s")
                fmt = self.xfs[int(style)] if style.isdigit() and int(style) < len(self.xfs) else 0
                kind, v, inline = _attr(e, "t"), None, None
                for x in e:
                    if _local(x.tag) == "v":
                        v = x.text or ""
                    elif _local(x.tag) == "is":
                        inline = "".join(t.text or "" for t in x.iter() if _local(t.tag) == "t")
                if kind == "inlineStr":
                    v = inline if inline is not None else v
                if v:
                    g.put(r, c, self._value(kind, v), fmt)
        for r0, r1, c0, c1 in merges:
            if min(r0, c0) >= 0:
                g.cover(r0, min(r1, g.n_rows - 1), c0, min(c1, g.n_cols - 1))
        for (r0, r1, c0, c1), url in hyper:
            if url and min(r0, c0) >= 0:
                g.put(r0, c0, url)
                g.set_url(r0, c0, url)
                g.cover(r0, r1, c0, c1)
        return g
