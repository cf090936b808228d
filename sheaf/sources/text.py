"""Tab- and comma-separated text: parsing and the test whether bytes look like it."""

from __future__ import annotations

import csv
import io
from collections import Counter

from sheaf.errors import NotInFormat


def looks_tabular(counts: Counter) -> bool | None:
    """By the histogram of fields per line: True if some width beyond 1 holds more than 10 lines and 80 % of them,
    False if some width beyond 1 holds more than 25 lines but none is that regular, None if it says nothing."""
    total = sum(counts.values())
    wide = [n for width, n in counts.items() if width > 1]
    if any(n > 10 and n / total > 0.8 for n in wide):
        return True
    return False if any(n > 25 for n in wide) else None


def lines(text: str) -> list[str]:
    """Lines without their ends; a last empty line is none."""
    out = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return out[:-1] if out and out[-1] == "" else out


def parse_tsv(text: str) -> list[list[str]]:
    return [x.split("\t") for x in lines(text)]


def parse_csv(text: str) -> list[list[str]]:
    """Ragged rows are fine; a quote that is never closed, or stands inside a bare field, is not. Blank lines are skipped."""
    try:
        return [row for row in csv.reader(io.StringIO(text, newline=""), strict=True) if row]
    except csv.Error as e:
        raise NotInFormat(f"not comma-separated: {e}") from e


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def open_tsv(data: bytes) -> list[list[str]]:
    rows = parse_tsv(decoded(data))
    if looks_tabular(Counter(map(len, rows))) is False:
        raise NotInFormat("lines have too many widths for tab-separated text")
    return rows


def open_csv(data: bytes) -> list[list[str]]:
    rows = parse_csv(decoded(data))
    if looks_tabular(Counter(map(len, rows))) is False:
        raise NotInFormat("lines have too many widths for comma-separated text")
    return rows
