"""Hashed words and word sequences of a block of texts, as numpy arrays.

A word is hashed without being cut out: the bytes of all texts are mapped to fixed 64-bit values, weighted with the powers of an odd base and
summed up once, so that a word's hash is a difference of two sums, shifted to a common power. The same is done with the hashes of words for
sequences of words. Words of over LONG bytes, for which such sums are weak, are hashed by xxh3 instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words of more bytes are hashed one by one.
LONG = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_FOLDED = _BYTE[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and its inverse modulo 2**64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, each weighted with the power of its place."""
    up, _ = _Powers.of(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def flat(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the places where each begins, with the end of the last. Null counts as empty."""
    if isinstance(texts, list):
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.cast(pa.large_binary() if big else pa.binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of several texts end to end: hashes, bytes from ``begin`` to ``end``, how many each text has and where it starts."""

    def __init__(self, texts: pa.Array | list[bytes], lower: bool = False, table: np.ndarray | None = None):
        """``table``: what each byte is taken for."""
        raw, at = flat(texts)
        raw = raw if table is None else table[raw]
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[raw], out=inside[1:-1])
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        border = at[1:-1]  # where one text ends and the next begins
        border = border[(border > 0) & (border < n)]
        first[border] = inside[1 + border]
        last[border - 1] = inside[border]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.n = len(self.begin)
        cut = np.searchsorted(self.begin, at)
        self.counts = np.diff(cut)
        self.starts = cut[:-1]
        sums = _sums((_FOLDED if lower else _BYTE)[raw])
        self.raw, self.byte_sums = raw, sums
        self.hashes = self.hashed(self.begin, self.end)
        for i in np.flatnonzero(self.end - self.begin > LONG).tolist():
            word = raw[self.begin[i] : self.end[i]].tobytes()
            self.hashes[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
        self.sums = _sums(self.hashes)

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, as of words of at most LONG bytes."""
        _, down = _Powers.of(len(self.raw) + 1)
        return mixed((self.byte_sums[end] - self.byte_sums[begin]) * down[begin])

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each position on; those that run into the next text mean nothing. Shorter by k - 1."""
        n = max(0, self.n - k + 1)
        _, down = _Powers.of(self.n + 1)
        return mixed((self.sums[k : k + n] - self.sums[:n]) * down[:n] + np.uint64(k))

    def whole(self, i: int) -> int:
        """A hash of all words of text i."""
        a, n = int(self.starts[i]), int(self.counts[i])
        _, down = _Powers.of(self.n + 1)
        return int(mixed((self.sums[a + n : a + n + 1] - self.sums[a : a + 1]) * down[a : a + 1] + np.uint64(n))[0])

    def left(self) -> np.ndarray:
        """For each position, the words from it to the end of its text."""
        return np.repeat(self.starts + self.counts, self.counts) - np.arange(self.n)


def word_hash(word: bytes, lower: bool = False) -> int:
    """The hash of one word."""
    return int(Words([word], lower).hashes[0])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of n neighbours, shorter by n - 1."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
