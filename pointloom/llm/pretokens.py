"""The pre-token split of byte-level BPE, of one text or of a block of texts at once."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import regex

from pointloom.llm.words import _Powers, _sums, mixed

#: Fixed value: the split that byte-level BPE applies before merging, as published with the tokenizers libraries.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same classes within Latin-1, spelt out for the standard library's faster engine.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


def splitter(pattern: str = BYTE_LEVEL):
    """A function from text to its pre-tokens."""
    wide = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return wide

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return _NARROW(text)

    return split


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a number, 3 for white space, 0 for others."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, sys.maxunicode + 1)]).astype(np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for number, kind in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(kind, every):
            out[points[m.start() : m.end()]] = number
    return out


def spans(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in no order, of the pre-tokens of BYTE_LEVEL in texts given as code points; ``at``: where each text begins, and the end.

    Texts are cut into runs of one class. Of white space before another run the last character stands apart, and a blank there belongs to that run.
    A lone apostrophe that no blank belongs to takes the ending after it away from the letters.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    first = at[:-1][at[:-1] < n]
    new[first] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    kind = kind[begin]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    last = opens[end]  # whether the run ends its text
    space = kind == 3
    apart = space & ~last
    blank = apart & (points[end - 1] == 0x20)
    joined = np.concatenate([[False], blank[:-1]])
    start, stop = begin - joined, end.copy()
    # endings after an apostrophe
    lone = np.flatnonzero((points[begin] == 0x27) & (end - begin == 1) & ~joined & ~last)
    lone = lone[kind[lone + 1] == 1]
    a = points[begin[lone + 1]]
    long = end[lone + 1] - begin[lone + 1] > 1
    b = np.where(long, points[np.minimum(begin[lone + 1] + 1, n - 1)], 0)
    c = lambda x: ord(x)
    takes = np.where((a == c("s")) | (a == c("t")), 1, 0)
    takes = np.where(((a == c("r")) | (a == c("v"))) & (b == c("e")) | (a == c("l")) & (b == c("l")), 2, takes)
    takes = np.where((a == c("m")) | (a == c("d")), 1, takes)
    stop[lone] += takes
    start[lone + 1] += takes
    # white space
    stop[apart] -= 1
    alone = apart & ~blank
    start, stop = np.concatenate([start, end[alone] - 1]), np.concatenate([stop, end[alone]])
    real = start < stop
    return start[real], stop[real]


def span_hashes(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums = _sums(mixed(points.astype(np.uint64) + np.uint64(0xD1342543DE82EF95)))
    _, down = _Powers.of(len(points) + 1)
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


class Recent(dict):
    """A cache in two generations: when the newer one is full it becomes the older, and what is used again moves over."""

    def __init__(self, room: int, make, longest: int = 64):
        super().__init__()
        self.room, self.make, self.longest, self.old = max(1, room // 2), make, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
