"""OLE2 compound files: streams by name."""

from __future__ import annotations

import struct

from sheaf.errors import NotInFormat, SheafError

#: Fixed values of the file format.
SIGNATURE, BYTE_ORDER = 0xE11AB1A1E011CFD0, 0xFFFE
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MINI_CUTOFF = 4096


class CompoundFile:
    def __init__(self, data: bytes):
        if len(data) < 512 or struct.unpack_from("<Q", data)[0] != SIGNATURE:
            raise NotInFormat("no compound file")
        self.data = data
        _, major, order, shift, mini_shift = struct.unpack_from("<5H", data, 24)
        n_dirs, _, dir_at, _, cutoff, mini_at, _, difat_at, n_difat = struct.unpack_from("<9I", data, 40)
        if order != BYTE_ORDER:
            raise NotInFormat("no compound file")
        if (major, shift) not in ((3, 9), (4, 12)) or mini_shift != 6 or cutoff != MINI_CUTOFF or (major == 3 and n_dirs):
            raise SheafError("compound file: header out of range")
        self.size = 1 << shift
        self._fat(difat_at, n_difat)
        self.mini_fat = self._ints(self._chain(mini_at))
        self.entries: dict[str, tuple[int, int]] = {}
        root = b""
        directory = self._chain(dir_at)
        for at in range(0, len(directory) - 127, 128):
            n_name, kind = struct.unpack_from("<HB", directory, at + 64)
            start, length = struct.unpack_from("<IQ", directory, at + 116)
            length = length & 0xFFFFFFFF if major == 3 else length
            if kind == 5:
                root = self._chain(start)[:length]
            elif kind == 2:
                self.entries.setdefault(directory[at : at + max(0, n_name - 2)].decode("utf-16-le", "replace"), (start, length))
        self.mini = root

    def _ints(self, raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _sector(self, sid: int) -> bytes:
        at = (sid + 1) * self.size
        if at >= len(self.data):
            raise SheafError("compound file: sector beyond the end")
        return self.data[at : at + self.size]

    def _fat(self, at: int, n_more: int) -> None:
        ids = [s for s in struct.unpack_from("<109I", self.data, 76) if s < END]
        for _ in range(n_more):
            if at >= END:
                break
            *more, at = self._ints(self._sector(at))
            ids += [s for s in more if s < END]
        self.fat = [x for s in ids for x in self._ints(self._sector(s))]

    def _chain(self, sid: int) -> bytes:
        out, seen = [], 0
        while sid < END - 2 and sid < len(self.fat):
            out.append(self._sector(sid))
            sid, seen = self.fat[sid], seen + 1
            if seen > len(self.fat):
                raise SheafError("compound file: a chain runs in a circle")
        return b"".join(out)

    def names(self) -> list[str]:
        return list(self.entries)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise KeyError(name)
        start, length = self.entries[name]
        if length >= MINI_CUTOFF:
            out = self._chain(start)
        else:
            parts, seen = [], 0
            while start < END - 2 and start < len(self.mini_fat) and seen * 64 < length:
                parts.append(self.mini[start * 64 : start * 64 + 64])
                start, seen = self.mini_fat[start], seen + 1
            out = b"".join(parts)
        if len(out) < length:
            raise SheafError("compound file: a stream ends early")
        return out[:length]
