"""Formats and the order in which they are tried."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable

from sheaf.errors import NotInFormat, UnknownFormat
from sheaf.sources import text, xls, xlsx
from sheaf.sources.grid import Grid


class TextFile:
    """One table of texts; rows keep their own widths."""

    encrypted = False

    def __init__(self, name: str, rows: list[list[str]], kind: str):
        self.name, self.rows, self.format = name, rows, kind

    def sheets(self) -> list[tuple[str, bool]]:
        return [(posixpath.basename(self.name), False)]

    def grid(self, index: int) -> Grid:
        g = Grid()
        for r, row in enumerate(self.rows):
            for c, v in enumerate(row):
                g.resize(r + 1, c + 1)
                if v:
                    g.put(r, c, v)
        g.widths = [len(r) for r in self.rows]
        return g


Opener = Callable[..., object]
_OPENERS: list[tuple[int, str, Opener]] = []


def register(name: str, priority: int, opener: Opener) -> None:
    """Add a format. opener(name, data, **options) raises NotInFormat if the bytes are of another kind; lower priorities come first."""
    _OPENERS[:] = sorted([x for x in _OPENERS if x[1] != name] + [(priority, name, opener)], key=lambda x: x[0])


def _workbook(cls):
    return lambda name, data, **o: cls(data, **{k: v for k, v in o.items() if v is not None})


def _text(kind: str, parse):
    def opener(name: str, data: bytes, **_):
        # Most comma-separated files also read as one tab-separated column, so a telling name decides.
        ending = os.path.splitext(name)[1].lower()
        if ending in (".csv", ".tsv", ".tab") and (ending == ".csv") != (kind == "csv"):
            raise NotInFormat(f"the name says {ending}")
        return TextFile(name, parse(data), kind)

    return opener


register("xls", 1, _workbook(xls.Workbook))
register("xlsx", 5, _workbook(xlsx.Workbook))
register("tsv", 10, _text("tsv", text.open_tsv))
register("csv", 15, _text("csv", text.open_csv))


def open_bytes(name: str, data: bytes, **options):
    """Try the formats in order; any error but NotInFormat ends the search."""
    for _, _, opener in _OPENERS:
        try:
            return opener(name, data, **options)
        except NotInFormat:
            continue
    raise UnknownFormat(f"{name}: no known format")
