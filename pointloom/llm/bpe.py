"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

Token bytes are mapped to Latin-1, so that an Aho-Corasick automaton over str finds every vocabulary entry
in a piece of text in one pass. The encoder takes the longest entry at each position, keeps it if BPE could
leave it beside the entry before it, else tries shorter ones, else takes back the last entry; positions that
were given up are never tried again, so the work is linear in the piece. Whether two entries may stand side by
side follows from undoing their merges in reverse order of rank and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, blocks, bounded, column, live
from pointloom.llm.pretokens import Recent, splitter

#: Entries kept by a worker: encoded pieces (of at most 64 characters and 256 bytes of ids, 500 bytes in all), and pairs of adjacent tokens (100 bytes).
PIECE_CACHE, PAIR_CACHE = 200_000, 400_000


class ByteBpe:
    """A vocabulary of ranks by token bytes, as tiktoken takes it, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, splitter(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.size = list(map(len, self.token))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.found = ahocorasick.Automaton()
        for rank, token in sorted((r, t) for t, r in ranks.items()):
            self._learn(rank, token)
        if ranks:
            self.found.make_automaton()
        self.ids_of = Recent(PIECE_CACHE, lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())

    @classmethod
    def from_file(cls, data: bytes, pattern: str) -> ByteBpe:
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}, pattern)

    def _learn(self, rank: int, token: bytes) -> None:
        """Finds which two lower-ranked entries merge into this one; an entry that no merge reaches is never matched."""
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
        else:
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
                if left < rank and right < rank and left in self.halves and right in self.halves and self._compatible(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
            else:
                return
        self.found.add_word(token.decode("latin-1"), (rank, len(token)))

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two side by side: no merge across their border comes before the merges that made them."""
        before, merged, halves = len(self.token), self.merged, self.halves
        while True:
            if merged.get((left, right), before) < before:
                return False
            inner, outer = halves[left][1], halves[right][0]
            if inner != left and (left > right or outer == right):
                before, left = left, inner
            elif outer != right:
                before, right = right + 1, outer
            else:
                return True

    def _beside(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _next_shorter(self, rank: int) -> int:
        """The longest entry that is a proper prefix of this one, or -1."""
        known = self.shorter.get(rank)
        if known is None:
            token, known = self.token[rank], -1
            for n in range(len(token) - 1, 0, -1):
                r = self.ranks.get(token[:n])
                if r is not None and r in self.halves:
                    known = r
                    break
            self.shorter[rank] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, size) in self.found.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last one written is the longest
        open_at, out, at, last = bytearray(b"\1") * (n + 1), [], 0, -1
        size, pairs = self.size, self.pairs
        now = longest[0] if n else -1
        while at < n:
            while now >= 0:
                end = at + size[now]
                if open_at[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | now)
                    if fits or fits is None and self._beside(last, now):
                        break
                now = self._next_shorter(now)
            if now >= 0:
                out.append(now)
                at, last = end, now
                now = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError("a byte is missing from the vocabulary")
            else:
                open_at[at] = 0
                now = out.pop()
                at -= size[now]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids_of.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def engine(data: bytes, pattern: str) -> ByteBpe:
    """The engine of a vocabulary, one at a time in a worker process."""
    return live(("bpe", hashlib.sha256(data).digest(), pattern), lambda: ByteBpe.from_file(data, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = (), ids: bool = True, digests: bool = False) -> DataFrame:
    """Every whole text as token ids.

    ``vocabulary`` is a path to a file of ranks, read by the driver and broadcast (its size is that of the file,
    whatever the input). ``keep``: further columns of ``docs`` to carry along. Returns doc_id, the kept columns, n_tokens
    and, as asked for, ids (array<int>), ids_sha256, decoded_sha256 and round_trip, the last three of the ids decoded again.
    A null text counts as empty and has no tokens; null ids, repeated rows and empty tables pass through row by row.
    A text's length is bounded by memory for that text alone.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    want = [f"{column('doc_id', docs)}", *(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_tokens bigint"]
    want += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string", "round_trip boolean"] * digests

    def work(batches):
        bpe = engine(shared.value, pattern)
        for batch in blocks(batches):
            raw = as_bytes(batch.column("text"))
            coded = [bpe.encode(b.decode("utf-8", "replace")) for b in raw]
            out = [batch.column("doc_id"), *(batch.column(k) for k in keep), pa.array([len(c) >> 2 for c in coded], pa.int64())]
            if ids:
                ends = pc.cumulative_sum(pa.array([0, *(len(c) >> 2 for c in coded)], pa.int32()))
                flat = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(coded))])
                out.append(pa.ListArray.from_arrays(ends, flat))
            if digests:
                back = [bpe.decode(c) for c in coded]
                out += [pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([a == b for a, b in zip(back, raw)])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", *keep, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256", "round_trip"] * digests]
    picked = bounded(docs).select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    return picked.mapInArrow(work, ", ".join(want))


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (array<int>); null ids give a null text."""
    with open(vocabulary, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        bpe = engine(shared.value, r".+")
        for batch in batches:
            back = [None if x is None else b"".join(map(bpe.token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(work, f"{column('doc_id', coded)}, text string")
