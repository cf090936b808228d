"""A sheet while it is read: cells by place, the last write wins, typed by their formats."""

from __future__ import annotations

from collections.abc import Iterator

from sheaf.functions.formats import Formatter, coerce, infer
from sheaf.schema import CONTINUE_COLUMN, CONTINUE_ROW, END_COLUMN, END_ROW, HYPERLINK, MARKS, STATIC


class Grid:
    def __init__(self, formatter: Formatter | None = None, strict: bool = False):
        self.formatter, self.strict = formatter or Formatter(), strict
        self.cells: dict[tuple[int, int], tuple[int, object, str | None, int, str | None]] = {}
        self.n_rows = self.n_cols = self._seq = 0

    def resize(self, rows: int, cols: int) -> None:
        self.n_rows, self.n_cols = max(self.n_rows, rows), max(self.n_cols, cols)

    def put(self, row: int, col: int, value, fmt_id: int = 0) -> None:
        """Place a value. The four marks become static cells; a known format decides the kind."""
        if row < 0 or col < 0:
            return
        self.resize(row + 1, col + 1)
        if isinstance(value, str) and value in MARKS:
            held, kind = value, STATIC
        elif fmt_id and (target := self.formatter.kind(fmt_id)):
            held, kind = coerce(value, target, self.formatter.date1904, self.strict)
        else:
            held, kind = infer(value)
        self._seq += 1
        self.cells[row, col] = (self._seq, held, kind, fmt_id, None)

    def set_value(self, row: int, col: int, value) -> None:
        """Replace the value and keep the format."""
        fmt_id = self.cells[row, col][3] if (row, col) in self.cells else 0
        self.put(row, col, value, fmt_id)

    def set_url(self, row: int, col: int, url: str) -> None:
        if (row, col) in self.cells:
            seq, held, _, fmt_id, _ = self.cells[row, col]
            self.cells[row, col] = (seq, held, HYPERLINK, fmt_id, url)

    def cover(self, row0: int, row1: int, col0: int, col1: int) -> None:
        """Mark the cells that a merge covers; the first keeps its value."""
        for r in range(row0, row1 + 1):
            for c in range(col0, col1 + 1):
                if (r, c) != (row0, col0):
                    self.put(r, c, (END_ROW if r == row1 else CONTINUE_ROW) if c == col0 else END_COLUMN if c == col1 else CONTINUE_COLUMN)

    def __iter__(self) -> Iterator[tuple[int, int, int, object, str | None, int, str | None]]:
        for (r, c), cell in sorted(self.cells.items()):
            yield r, c, *cell
