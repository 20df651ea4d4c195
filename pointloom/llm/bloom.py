"""Bloom filters in segments, whose entries have levels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pointloom.llm.words import mixed

#: Bits for each entry, and probes for each level, which lie in one block of as many bits as a line of the processor's cache has.
BITS, PROBES, BLOCK = 11, 4, 512
#: Keys that are looked up together.
RUN = 1 << 14


def segments_of(words: np.ndarray, bits: int) -> np.ndarray:
    """The segment, of 2**bits, of what is kept by these words."""
    return (mixed(words ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)


def short_of(keys: np.ndarray) -> np.ndarray:
    """The part of a key that tells it from others of its segment."""
    return (keys >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Filter:
    """Segments of bits end to end: 2**bits of them, where each begins and how many bits it has."""

    bits: int
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @staticmethod
    def hashes(short: np.ndarray, level: int) -> np.ndarray:
        """Of each entry 28 bits for its block, above PROBES times 9 bits for the places in it."""
        return mixed(short.astype(np.uint64) + np.uint64(0xA0761D6478BD642F * level % (1 << 64)))

    @staticmethod
    def block(hashes: np.ndarray, blocks: np.ndarray | np.uint64) -> np.ndarray:
        """Where the block of each entry begins, in a segment of so many."""
        return ((hashes >> np.uint64(36)) * blocks >> np.uint64(28)) << np.uint64(9)

    @staticmethod
    def built(short: np.ndarray, levels: np.ndarray, most: int | None = None) -> bytes:
        """One segment that holds each key at the levels 1 to its own, of at most ``most`` bytes."""
        blocks = max(1, -(-int(levels.sum()) * BITS // BLOCK))
        blocks = blocks if most is None else max(1, min(blocks, 8 * most // BLOCK))
        on = np.zeros(blocks * BLOCK, bool)
        now = 1
        while len(short):
            x = Filter.hashes(short, now)
            begin = Filter.block(x, np.uint64(blocks))
            for i in range(PROBES):
                on[begin + (x >> np.uint64(9 * i) & np.uint64(BLOCK - 1))] = True
            now += 1
            keep = levels >= now
            short, levels = short[keep], levels[keep]
        return np.packbits(on, bitorder="little").tobytes()

    @classmethod
    def joined(cls, bits: int, parts: dict[int, bytes]) -> Filter:
        """The filter of the segments by number; one that is missing holds nothing."""
        size = np.array([len(parts.get(i, b"")) for i in range(1 << bits)], np.uint64)
        return cls(bits, (np.cumsum(size) - size) * np.uint64(8), size * np.uint64(8), np.frombuffer(b"".join(parts[i] for i in sorted(parts)), np.uint8))

    def segments(self, words: np.ndarray) -> np.ndarray:
        """The segments of what is kept by these words."""
        return segments_of(words, self.bits)

    def holds(self, segments: np.ndarray) -> np.ndarray:
        """Whether this shard has these segments."""
        return self.size[segments] > 0

    def levels(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The highest level that each key, of its segment, holds without a gap, by probing one after the other."""
        out = np.zeros(len(keys), np.int64)
        # a segment after the other, so that its bits stay at hand
        index = np.argsort(segments.astype(np.uint16) if self.bits <= 16 else segments, kind="stable")
        segments = segments[index]
        here = self.holds(segments)
        if not here.all():
            index, segments = index[here], segments[here]
        start, blocks, short = self.start[segments], self.size[segments] // np.uint64(BLOCK), short_of(keys)[index]
        found = self._climbed(start, blocks, short, 1, 2)
        # what goes further occurs often, so each key is followed once
        more = np.flatnonzero(found == 2)
        _, first, place = np.unique(segments[more].astype(np.uint64) << np.uint64(32) | short[more], return_index=True, return_inverse=True)
        first = more[first]
        found[more] = self._climbed(start[first], blocks[first], short[first], 3)[place]
        out[index] = found
        return out

    def _climbed(self, start: np.ndarray, blocks: np.ndarray, short: np.ndarray, now: int, last: int | None = None) -> np.ndarray:
        """The highest level up to ``last`` of keys that are known to hold the one below ``now``; RUN keys at a time, so that what is computed stays at hand."""
        out = np.full(len(short), now - 1)
        for a in range(0, len(short), RUN):
            self._climb(out[a : a + RUN], start[a : a + RUN], blocks[a : a + RUN], short[a : a + RUN], now, last)
        return out

    def _climb(self, out: np.ndarray, start: np.ndarray, blocks: np.ndarray, short: np.ndarray, now: int, last: int | None) -> None:
        index = None
        while len(short) and (last is None or now <= last):
            x = self.hashes(short, now)
            begin = (self.block(x, blocks) + start >> np.uint64(3)).view(np.int64)
            alive, found = None, None
            for i in range(PROBES):
                # few keys have more than one level: most are gone after some probes
                if now > 1 and i == PROBES // 2:
                    alive = np.flatnonzero(found & np.uint8(1))
                    x, begin, found = x[alive], begin[alive], None
                at = x >> np.uint64(9 * i) & np.uint64(BLOCK - 1)
                bit = self.data.take(begin + (at >> np.uint64(3)).view(np.int64)) >> (at.astype(np.uint8) & np.uint8(7))
                found = bit if found is None else found & bit
            kept = np.flatnonzero(found & np.uint8(1))
            alive = kept if alive is None else alive[kept]
            start, blocks, short = start[alive], blocks[alive], short[alive]
            index = alive if index is None else index[alive]
            out[index] = now
            now += 1
