"""Number and date text of single values, as Go's fmt, strconv and time packages write them.

These are the plain definitions; `columns` has the same as Spark expressions.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta

MICRO = timedelta(microseconds=1)
BASE_1900, BASE_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def _digits(x: float) -> tuple[str, int]:
    """Shortest digits that read back as x > 0, and the place of the decimal point before them."""
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    if part == "0":
        part = ""
    digits, point = whole + part, len(whole) + int(exponent or 0)
    lead = len(digits) - len(digits.lstrip("0"))
    digits = digits.lstrip("0").rstrip("0")
    return digits or "0", point - lead if digits else 1


def _special(x: float) -> str | None:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return None


def plain(x: float) -> str:
    """Shortest decimal without exponent."""
    if (s := _special(x)) is not None:
        return s
    sign = "-" if math.copysign(1, x) < 0 else ""
    if x == 0:
        return sign + "0"
    d, p = _digits(abs(x))
    if p <= 0:
        return f"{sign}0.{'0' * -p}{d}"
    return sign + (d.ljust(p, "0") if len(d) <= p else f"{d[:p]}.{d[p:]}")


def shortest(x: float) -> str:
    """Shortest digits; with an exponent below -4 and from 6 on."""
    if (s := _special(x)) is not None:
        return s
    if x == 0:
        return plain(x)
    d, p = _digits(abs(x))
    if -4 <= p - 1 < 6:
        return plain(x)
    e = p - 1
    return f"{'-' if x < 0 else ''}{d[0]}{'.' + d[1:] if len(d) > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"


def shown(v) -> str:
    """Default printing of any value."""
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return shortest(v)
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S") + (f".{v.microsecond:06d}".rstrip("0") if v.microsecond else "") + " +0000 UTC"
    return str(v)


def general(v) -> str:
    """The General format: plain if it fits eleven places, else six digits if that fits, else all."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        s = plain(v)
        if len(s) <= 11 or (len(s) == 12 and v < 0):
            return s
        s = f"{v:.6g}"
        if len(s) <= 11:
            return s
    return shown(v)


def number(v) -> float | None:
    """The value as a number, if it is one or reads as one."""
    if isinstance(v, (bool, int, float)):
        return float(v)
    if isinstance(v, str):
        return parse_float(v)
    return None


_FLOAT = re.compile(r"[+-]?(\d+(_?\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$|[+-]?(inf|infinity|nan)$", re.I)


def parse_float(s: str) -> float | None:
    if not _FLOAT.match(s) or "_" in s:
        return None
    try:
        return float(s)
    except ValueError:
        return None


def truncated(x: float) -> int:
    """Toward zero; what does not fit 64 bits becomes the smallest integer."""
    if math.isnan(x) or math.isinf(x) or not -(2.0**63) <= x < 2.0**63:
        return -(2**63)
    return int(x)


def commas(s: str) -> str:
    """A comma wherever a multiple of three characters lies between a spot and the end of the whole part."""
    sign, whole, rest = re.match(r"(-?)([^.eE]*)(.*)", s, re.S).groups()
    return sign + re.sub(r"(?s)(?<=.)(?=(?:...)+\Z)", ",", whole) + rest


def parens(s: str) -> str:
    return f"({s[1:]})" if s.startswith("-") else s


#: A fractional part below the first shows as one part in 10^9; a convergent within the second is exact.
NEAR, CLOSE = 1e-9, 1e-10


def _convergents(x: float):
    """(h, k) for the convergents h/k of the continued fraction of x > 0 behind its whole part: h(i) = a(i) h(i-1) + h(i-2), and k likewise."""
    whole = math.floor(x)
    (h0, h), (k0, k), rest = (1, whole), (0, 1), x - whole
    while rest:
        a, rest = divmod(1 / rest, 1)
        h0, h = h, int(a) * h + h0
        k0, k = k, int(a) * k + k0
        yield h, k


def fraction_of(x: float, numerator_digits: int, denominator_digits: int) -> tuple[int, int]:
    """The first convergent close to x, or the last whose terms fit their digits (two where none are given); 0/1 if none does.

    Whole numbers stand over one. Negative ones have a fractional part below NEAR.
    """
    whole = math.trunc(x)
    if x == whole:
        return whole, 1
    if x - whole < NEAR:
        return (1 if x > 0 else -1), 10**9
    found = 0, 1
    for h, k in _convergents(x):
        if h >= 10 ** (numerator_digits or 2) or k >= 10 ** (denominator_digits or 2):
            break
        found = h, k
        if abs(x - h / k) <= CLOSE:
            break
    return found


def whole_and_fraction(x: float, numerator_digits: int, denominator_digits: int) -> tuple[int, int, int]:
    if not math.isfinite(x) or x == math.trunc(x):
        return truncated(x), 0, 1
    return truncated(x), *fraction_of(abs(x - math.trunc(x)), numerator_digits, denominator_digits)


NOT_NUMERIC = "MUST BE numeric TO FORMAT CORRECTLY"
NOT_TIME = "MUST BE time.Time OR numeric TO FORMAT CORRECTLY"


def fraction(v, digits: int) -> str:
    x = number(v)
    if x is None:
        return NOT_NUMERIC
    w, n, d = whole_and_fraction(x, digits, digits)
    if n == 0:
        return str(w)
    if w == 0:
        return f"{-n if x < 0 and n > 0 else n}/{d}"
    return f"{w} {n}/{d}"


# --- dates ---------------------------------------------------------------------


def serial_to_datetime(x: float, date1904: bool = False) -> datetime:
    """Serial day number to a time without zone; fractions of a microsecond are cut off."""
    day = int(x)
    base = BASE_1904 if date1904 else BASE_1900
    if day < 61:  # these go through a Julian day, which costs some low bits
        offset = 2416481.0 if date1904 else 2415019.0
        julian = x + 0.5 + (offset - 0.5)
        day, part = int(julian) - int(offset), julian - int(julian)
    else:
        part = x - day
    nanos = int(86400e9 * part)
    return base + timedelta(days=day) + timedelta(microseconds=nanos // 1000)


#: Layout tokens, longest first where one begins another, and the field of a time that each shows.
LAYOUT = {
    "January": "month_name", "Jan": "month_abbr", "Monday": "day_name", "Mon": "day_abbr", "MST": "zone", "2006": "year", "01": "month02", "02": "day02", "03": "hour12_02",
    "04": "minute02", "05": "second02", "06": "year2", "15": "hour", "1": "month", "2": "day", "3": "hour12", "4": "minute", "5": "second", "PM": "AM", "pm": "am", "_2": "day_pad",
}


def layout_tokens(layout: str) -> list[tuple[str, str]]:
    """A layout as (field, "") and ("", literal) pairs. A point with nines or noughts behind it shows part of a second."""
    out: list[tuple[str, str]] = []
    i, text = 0, ""
    while i < len(layout):
        found = None
        for token, name in LAYOUT.items():
            if layout.startswith(token, i):
                if token in ("Jan", "Mon") and layout[i + 3 : i + 4].islower():
                    continue
                if token == "_2" and layout.startswith("_2006", i):
                    continue
                found = token, name
                break
        if found is None and (m := re.compile(r"[.,](0+|9+)(?!\d)").match(layout, i)):
            found = m[0], f"fraction{m[1][0]}{len(m[1])}{m[0][0]}"
        if found is None:
            text += layout[i]
            i += 1
            continue
        if text:
            out.append(("", text))
            text = ""
        out.append((found[1], ""))
        i += len(found[0])
    return out + ([("", text)] if text else [])


_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def _field(t: datetime, name: str) -> str:
    h12 = t.hour % 12 or 12
    simple = {
        "month_name": _MONTHS[t.month - 1], "month_abbr": _MONTHS[t.month - 1][:3], "day_name": _DAYS[t.weekday()], "day_abbr": _DAYS[t.weekday()][:3], "zone": "UTC", "year": f"{t.year:04d}",
        "month02": f"{t.month:02d}", "day02": f"{t.day:02d}", "hour12_02": f"{h12:02d}", "minute02": f"{t.minute:02d}", "second02": f"{t.second:02d}", "year2": f"{t.year % 100:02d}",
        "hour": f"{t.hour:02d}", "month": str(t.month), "day": str(t.day), "hour12": str(h12), "minute": str(t.minute), "second": str(t.second), "AM": "PM" if t.hour >= 12 else "AM",
        "am": "pm" if t.hour >= 12 else "am", "day_pad": f"{t.day:2d}",
    }
    if name in simple:
        return simple[name]
    digit, places, mark = name[8], int(name[9:-1]), name[-1]
    part = f"{t.microsecond:06d}000"[:places]
    if digit == "9":
        part = part.rstrip("0")
        return mark + part if part else ""
    return mark + part


def time_text(v, layout: str, date1904: bool = False) -> str:
    """A time, or a serial number, in a layout. Serials beyond the calendar stay numbers."""
    if not isinstance(v, datetime):
        x = number(v)
        if x is None:
            return NOT_TIME
        try:
            v = serial_to_datetime(x, date1904)
        except (OverflowError, ValueError):
            return general(v)
    return "".join(_field(v, name) if name else text for name, text in layout_tokens(layout))


def chinese_noon(s: str) -> str:
    return s.replace("AM", "上午", 1).replace("PM", "下午", 1)


# --- booleans and comparison ----------------------------------------------------

#: Texts that count as true. Case matters; everything else is false.
TRUE_TEXTS = ("yes", "true", "t", "y", "1", "on", "YES", "TRUE", "T", "Y", "1.0", "ON")
_INT_HEAD, _FLOAT_HEAD = re.compile(r"\s*([+-]?\d+)"), re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def scanned_int(s: str) -> int | None:
    m = _INT_HEAD.match(s)
    return int(m[1]) if m and -(2**63) <= int(m[1]) < 2**63 else None


def scanned_float(s: str) -> float | None:
    m = _FLOAT_HEAD.match(s)
    return float(m[1]) if m else None


def less(a, b) -> bool:
    """a < b across types: nothing is less than or below a blank; times compare with times only."""
    if a is None or b is None:
        return False
    if isinstance(a, datetime) or isinstance(b, datetime):
        return isinstance(a, datetime) and isinstance(b, datetime) and a < b
    if isinstance(a, bool):
        truth = b in TRUE_TEXTS if isinstance(b, str) else bool(b)
        return not a and truth
    if isinstance(a, str):
        if isinstance(b, bool):
            return b and a not in TRUE_TEXTS
        if isinstance(b, str):
            return a.encode() < b.encode()
        x = scanned_int(a) if isinstance(b, int) else scanned_float(a)
        return x < b if x is not None else a.encode() < shown(b).encode()
    if isinstance(b, str):
        x = scanned_int(b) if isinstance(a, int) else scanned_float(b)
        return a < x if x is not None else shown(a).encode() < b.encode()
    if isinstance(b, bool):
        return a < int(b)
    if isinstance(a, int) and isinstance(b, int):
        return a < b
    return float(a) < float(b)


def equal(a, b) -> bool:
    """Numbers against anything by value, text scanned; else neither is less."""
    numeric = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if numeric(a) or numeric(b):
        value = lambda v: float(v) if numeric(v) else (scanned_float(shown(v)) or 0.0)
        return value(a) == value(b)
    return less(a, b) == less(b, a)
