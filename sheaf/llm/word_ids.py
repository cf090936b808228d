"""Ids of words, remembered: texts whose white space is single spaces and line feeds split into words that tokens never span."""

from __future__ import annotations

from itertools import chain

import numpy as np


class WordIds:
    """Remembers ids (as bytes) of words behind a space and of words that begin a line; forgets all when full."""

    def __init__(self, many_spaced, many_plain, feed: bytes, first_spaced: bool, most: int = 400_000):
        self.many_spaced, self.many_plain, self.feed, self.first_spaced, self.most = many_spaced, many_plain, feed, first_spaced, most
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def clear(self) -> None:
        self.spaced.clear()
        self.plain.clear()

    def encode(self, texts: list[list[list[str]]]) -> list[bytes]:
        """texts: of each text its lines, of each line its words, none of them empty."""
        if len(self.spaced) + len(self.plain) > self.most:
            self.clear()
        lines = list(chain.from_iterable(texts))
        for known, many, met in ((self.spaced, self.many_spaced, set(chain.from_iterable(lines))), (self.plain, self.many_plain, {x[0] for x in lines})):
            new = list(met.difference(known))
            if new:
                known.update(zip(new, many(new)))
        spaced, plain, out = self.spaced.__getitem__, self.plain.__getitem__, []
        for text in texts:
            parts = []
            for line in text:
                at = len(parts)
                parts += map(spaced, line)
                parts[at] = plain(line[0]) if at or not self.first_spaced else parts[at]
                parts.append(self.feed)
            parts.pop()
            out.append(b"".join(parts))
        return out


def cut_at(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Runs of ids from each start to the next, as little-endian unsigned 32-bit integers."""
    raw = ids.astype("<u4").tobytes()
    at = (starts * 4).tolist()
    return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]
