"""Legacy workbooks (BIFF8 in a compound file)."""

from __future__ import annotations

import struct

from sheaf.errors import NotInFormat, SheafError
from sheaf.functions.formats import Formatter
from sheaf.sources import rc4
from sheaf.sources.compound import CompoundFile
from sheaf.sources.grid import Grid

#: Record ids.
BOF, EOF, CONTINUE, DATE1904, FILEPASS, FORMAT, XF, SST, BOUNDSHEET = 2057, 10, 60, 34, 47, 1054, 224, 252, 133
DIMENSIONS, WSBOOL, BOOLERR, MULRK, RK, NUMBER, FORMULA, STRING, LABELSST, HLINK, MERGECELLS = 512, 129, 517, 189, 638, 515, 6, 519, 253, 440, 229
#: Records whose data are never encrypted (the first sheet offset of BOUNDSHEET neither).
CLEAR = (BOF, FILEPASS, 401, 405, 225, 406, 312)
#: Error codes.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}
#: Class ids of link monikers.
URL_MONIKER = bytes.fromhex("e0c9ea79f9bace118c8200aa004ba90b")
FILE_MONIKER = bytes.fromhex("0303000000000000c000000000000046")


def records(stream: bytes):
    """(offset, id, data) of each record; a truncated last one is dropped."""
    at = 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<2H", stream, at)
        if at + 4 + size > len(stream):
            return
        yield at, kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


def decrypt(stream: bytes, key: bytes) -> bytes:
    """Decrypt everything and put back what was clear: record heads, some records, sheet offsets."""
    out = bytearray(rc4.crypt(key, stream))
    for at, kind, data in records(stream):
        keep = 4 + (len(data) if kind in CLEAR else 4 if kind == BOUNDSHEET else 0)
        out[at : at + keep] = stream[at : at + keep]
    return bytes(out)


def _string(data: bytes, at: int, long: bool) -> str:
    """A string with its length in one byte or two, and a flag for 16-bit characters."""
    n = struct.unpack_from("<H" if long else "<B", data, at)[0]
    at += 2 if long else 1
    wide = data[at] & 1
    return data[at + 1 : at + 1 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


class _Parts:
    """Bytes that run over several records; characters switch width at each new one."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def more(self) -> bool:
        while self.i < len(self.parts) and self.at >= len(self.parts[self.i]):
            self.i, self.at = self.i + 1, 0
        return self.i < len(self.parts)

    def raw(self, n: int) -> bytes:
        out = b""
        while n and self.more():
            got = self.parts[self.i][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
        return out

    def chars(self, n: int, wide: int) -> str:
        out: list[bytes] = []
        while n:
            if self.at >= len(self.parts[self.i]):
                if self.i + 1 >= len(self.parts):
                    break
                self.i, self.at = self.i + 1, 1
                wide = self.parts[self.i][0] & 1
            room = (len(self.parts[self.i]) - self.at) // (1 + wide)
            if room == 0:
                raise SheafError("xls: a character is cut in two")
            take = min(n, room)
            got = self.parts[self.i][self.at : self.at + take * (1 + wide)]
            out.append(got if wide else got.decode("latin-1").encode("utf-16-le"))
            n, self.at = n - take, self.at + len(got)
        return b"".join(out).decode("utf-16-le", "replace")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The shared string table; formatting runs and phonetic data are skipped."""
    p = _Parts([parts[0][8:], *parts[1:]])
    total, out = struct.unpack_from("<I", parts[0], 4)[0], []
    while len(out) < total and p.more():
        n, flags = struct.unpack("<HB", p.raw(3))
        runs = struct.unpack("<H", p.raw(2))[0] * 4 if flags & 8 else 0
        extra = struct.unpack("<I", p.raw(4))[0] if flags & 4 else 0
        out.append(p.chars(n, flags & 1))
        p.raw(runs + extra)
    return out


def rk_number(x: int) -> int | float:
    """A packed number: 30 bits of an integer or the top of a double, perhaps in hundredths."""
    signed = struct.unpack("<i", struct.pack("<I", x))[0]
    value = signed >> 2 if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    if x & 1:
        return value / 100
    return value


def hyperlink(data: bytes) -> tuple[str, str]:
    """Display text and target of a link."""
    version, flags = struct.unpack_from("<2I", data, 16)
    if version != 2:
        raise SheafError("xls: unknown link version")
    at, text, target = 24, "", ""

    def wide() -> str:
        nonlocal at
        n = struct.unpack_from("<I", data, at)[0]
        at += 4 + 2 * n
        return data[at - 2 * n : at].decode("utf-16-le", "replace")

    if flags & 0x10:
        text = wide()
    if flags & 0x80:
        wide()
    if flags & 0x01:
        if flags & 0x100:
            target = wide()
        else:
            target, at = _moniker(data, at)
    if flags & 0x08:
        target = wide()
    strip = " \v\f\t\r\n\0"
    return text.strip(strip), target.strip(strip)


def _moniker(data: bytes, at: int) -> tuple[str, int]:
    kind, at = data[at : at + 16], at + 16
    if kind == URL_MONIKER:
        n = struct.unpack_from("<I", data, at)[0]
        url = data[at + 4 : at + 4 + n].decode("utf-16-le", "replace")
        return url.split("\0")[0], at + 4 + n
    if kind == FILE_MONIKER:
        n = struct.unpack_from("<I", data, at + 2)[0]
        short = data[at + 6 : at + 6 + n].decode("latin-1")
        at += 6 + n + 24
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        return (data[at + 6 : at + n].decode("utf-16-le", "replace") if n else short), at + n
    raise SheafError("xls: unknown link moniker")


class Workbook:
    """Sheets of a legacy workbook."""

    format = "xls"

    def __init__(self, data: bytes, password: str = rc4.DEFAULT_PASSWORD, date1904: bool | None = None, strict: bool = False):
        box = CompoundFile(data)
        if "Workbook" not in box.entries:
            raise NotInFormat("no workbook in the compound file")
        stream, self.encrypted, self.strict = box.stream("Workbook"), False, strict
        for _, kind, body in records(stream):
            if kind == FILEPASS:
                how = struct.unpack_from("<H", body)[0]
                if how != 1:
                    raise SheafError("xls: unsupported encryption")
                stream, self.encrypted = decrypt(stream, rc4.unlock(body[2:], password)), True
                break
        self.substreams: dict[int, list[tuple[int, bytes]]] = {}
        depth, current = 0, None
        for at, kind, body in records(stream):
            if kind == BOF:
                if depth == 0:
                    current = self.substreams.setdefault(at, [])
                    version, _, _, year = struct.unpack_from("<4H", body)
                    if version != 0x0600 or year not in (0x07CC, 0x07CD):
                        raise SheafError("xls: unsupported version")
                depth += 1
            elif kind == EOF:
                depth -= 1
            if current is not None:
                current.append((kind, body))
        if not self.substreams:
            raise SheafError("xls: the workbook stream is empty")
        self.formatter, self.xfs, self.strings, self.found = Formatter(), [], [], []
        self._globals(next(iter(self.substreams.values())), date1904)

    def _globals(self, recs: list[tuple[int, bytes]], date1904: bool | None) -> None:
        for i, (kind, body) in enumerate(recs):
            if kind == SST and len(body) >= 8:
                parts = [body]
                for k, more in recs[i + 1 :]:
                    if k != CONTINUE:
                        break
                    parts.append(more)
                self.strings = shared_strings(parts)
            elif kind == DATE1904 and date1904 is None:
                self.formatter.date1904 = struct.unpack_from("<H", body)[0] == 1
            elif kind == FORMAT:
                try:
                    self.formatter.add(struct.unpack_from("<H", body)[0], _string(body, 2, True))
                except ValueError:
                    pass  # built-in formats stay as they are
            elif kind == XF:
                self.xfs.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == BOUNDSHEET:
                at, state = struct.unpack_from("<IB", body)
                self.found.append((_string(body, 6, False), at, bool(state & 3)))
        if date1904 is not None:
            self.formatter.date1904 = date1904

    def sheets(self) -> list[tuple[str, bool]]:
        return [(name, hidden) for name, _, hidden in self.found]

    def grid(self, index: int) -> Grid | None:
        """The cells of a sheet; None for a dialog."""
        name, at, _ = self.found[index]
        if at not in self.substreams:
            raise SheafError(f"xls: sheet {name!r} is not in the stream")
        recs, depth = [], 0
        for i, (kind, body) in enumerate(self.substreams[at]):
            if kind == BOF and i:
                depth += 1  # a chart or other embedded part
            if depth == 0:
                recs.append((kind, body))
            elif kind == EOF:
                depth -= 1
        g = Grid(self.formatter, self.strict)
        for kind, body in recs:
            if kind == WSBOOL and len(body) > 1 and body[1] & 0x10:
                return None
            if kind == DIMENSIONS:
                _, rows, _, cols = struct.unpack_from("<2I2H", body)
                g.resize(rows, cols)
        rows, cols = g.n_rows, g.n_cols
        formula = (0, 0)
        for i, (kind, body) in enumerate(recs):
            if kind in (BOOLERR, MULRK, RK, NUMBER, FORMULA, LABELSST):
                r, c, xf = struct.unpack_from("<3H", body)
                fmt = self.xfs[xf] if xf < len(self.xfs) else 0
            if kind == BOOLERR:
                g.put(r, c, *((body[6] == 1, fmt) if body[7] == 0 else (ERRORS.get(body[6], "<unknown error>"), 0)))
            elif kind == MULRK:
                for k in range((len(body) - 6) // 6):
                    xf, x = struct.unpack_from("<HI", body, 4 + 6 * k)
                    g.put(r, c + k, rk_number(x), self.xfs[xf] if xf < len(self.xfs) else 0)
            elif kind == RK:
                g.put(r, c, rk_number(struct.unpack_from("<I", body, 6)[0]), fmt)
            elif kind == NUMBER:
                g.put(r, c, struct.unpack_from("<d", body, 6)[0], fmt)
            elif kind == FORMULA:
                formula, value = (r, c), body[6:14]
                if value[6:8] != b"\xff\xff":
                    g.put(r, c, struct.unpack("<d", value)[0], fmt)
                elif value[0] == 0:
                    g.put(r, c, "", fmt)  # the text follows
                elif value[0] == 1:
                    g.put(r, c, value[2] != 0, fmt)
                elif value[0] == 2:
                    g.put(r, c, ERRORS.get(value[2], "<unknown error>"))
            elif kind == STRING:
                parts = [body[3:]]
                for k, more in recs[i + 1 :]:
                    if k != CONTINUE:
                        break
                    parts.append(more)
                g.set_value(*formula, _Parts(parts).chars(struct.unpack_from("<H", body)[0], body[2] & 1))
            elif kind == LABELSST:
                k = struct.unpack_from("<I", body, 6)[0]
                if k >= len(self.strings):
                    raise SheafError("xls: a shared string is missing")
                if self.strings[k]:
                    g.put(r, c, self.strings[k], fmt)
            elif kind == HLINK:
                r0, r1, c0, c1 = struct.unpack_from("<4H", body)
                if r0 > rows or c0 > cols:
                    continue
                text, target = hyperlink(body[8:])
                g.put(r0, c0, f"{text} <{target}>")
                g.cover(r0, rows - 1 if r1 == 0xFFFF else r1, c0, cols - 1 if c1 == 0xFF else c1)
            elif kind == MERGECELLS:
                for k in range(struct.unpack_from("<H", body)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<4H", body, 2 + 8 * k)
                    g.cover(r0, rows - 1 if r1 == 0xFFFF else r1, c0, cols - 1 if c1 == 0xFF else c1)
        return g
