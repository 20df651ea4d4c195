"""Fill-in-middle: texts cut into prefix, middle and suffix at units chosen by a hash of the id, and put in another order between markers.

A text is a big integer for each class of bytes, one bit a byte, made by ``bytes.translate``. Shifts and boolean operations of these mark where units
begin and where a marker stands; ``bit_count`` gives the number of units, and halving the integer finds the byte at which the k-th of them begins.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, blocks, column, texts_of

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred: texts that are cut at all, and those of them with the suffix first.
CUT, SUFFIX_FIRST, SEED = 90, 20, 1
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACE = bytes([0x20, *range(0x09, 0x0E)])


@lru_cache(64)
def _table(members: bytes) -> bytes:
    return bytes(0x31 if b in members else 0x30 for b in range(256))


def mask(raw: bytes, members: bytes) -> int:
    """Bit i says whether byte i is one of ``members``."""
    return int(raw.translate(_table(members))[::-1], 2) if raw else 0


def starts(raw: bytes, unit: str = "char") -> int:
    """The bytes at which units begin: code points, or words of which each takes the white space after it (and the first what stands before it)."""
    every = (1 << len(raw)) - 1
    if unit == "char":
        return every if raw.isascii() else every ^ mask(raw, _CONTINUES)
    if unit != "word":
        raise ValueError(f"unit {unit!r}")
    space = mask(raw, _SPACE)
    first = (every ^ space) & ((space << 1) | 1)
    return first & (first - 1) | (1 if raw else 0)  # the first unit begins with the text


def holds(raw: bytes, marker: bytes) -> bool:
    """Whether the marker stands anywhere: the masks of its bytes, each shifted by its place, have a bit in common."""
    found = -1
    for i, byte in enumerate(marker):
        found &= mask(raw, bytes([byte])) >> i
        if not found:
            return False
    return True


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, from 0. Each step keeps the half that has it."""
    at, size = 0, bits.bit_length()
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, size = low, half
        else:
            bits, at, size, k = bits >> half, at + half, size - half, k - n
    return at


def cut(raw: bytes, hashes: tuple[int, int, int, int], unit: str = "char", cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[bytes, ...] = tuple(m.encode() for m in MARKERS)):
    """(n, form, units of the prefix and of the middle or None, output) of one text. ``hashes``: two for the places, one for whether, one for the order."""
    bits = starts(raw, unit)
    n = bits.bit_count()
    if not n or hashes[2] % 100 >= cut_share or any(holds(raw, m) for m in markers):
        return n, "plain", None, None, raw
    low, high = sorted((hashes[0] % (n + 1), hashes[1] % (n + 1)))
    a, b = (len(raw) if k == n else select(bits, k) for k in (low, high))
    p, s, m = markers
    if hashes[3] % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return n, "psm", low, high - low, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def transform(docs: DataFrame, unit: str = "char", cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units and output of every whole text.

    form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``: the text as it is, with null units, as for an empty or null text, one
    that holds a marker, and those that the hash of seed and id leaves whole. A null id is hashed as an empty one. Repeated rows are cut alike;
    an empty table gives no rows.
    """
    if len(set(markers)) < 3 or any(not m or any(x[0] in m[1:] or x != m and x.startswith(m) for x in markers) for m in markers):
        raise ValueError("three markers are needed, none of which begins another or with a character that stands further on in one")
    encoded = tuple(m.encode() for m in markers)

    def work(batches):
        for batch in blocks(batches):
            made = [cut(raw, tuple(int(key[i : i + 8], 16) for i in (0, 8, 16, 24)), unit, cut_share, suffix_first, encoded) for raw, key in zip(as_bytes(batch.column("text")), batch.column("key").to_pylist())]
            n, form, low, mid, out = zip(*made)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    made = texts_of(docs).withColumn("key", F.substring(key, 1, 32)).mapInArrow(work, f"{column('doc_id', docs)}, n bigint, form string, prefix_units bigint, middle_units bigint, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``made`` with text, rebuilt from form and output alone: each marker stands once in an output that was cut. Null form or output: null."""
    parts = F.split("output", "|".join(f"\\Q{m}\\E" for m in markers), -1)
    text = F.when(F.col("form") == "plain", F.col("output"))
    for form, order in (("psm", (1, 3, 2)), ("spm", (2, 3, 1))):
        text = text.when(F.col("form") == form, F.concat(*(parts[i] for i in order)))
    return made.withColumn("text", text)


def digest(made: DataFrame) -> DataFrame:
    """What op11 reports of rows of transform()."""
    return restore(made).select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))
