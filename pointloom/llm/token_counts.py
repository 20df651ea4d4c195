"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

The first tier is a compact hash table of the most frequent pre-tokens and their lengths in tokens: ascending 64-bit hashes beside bytes, TABLE entries
at most, broadcast. Which are frequent is counted in a bounded sample, the first documents of some partitions; that changes no result, only how often the
second tier is asked.
There a worker encodes a pre-token by the library's model and keeps its length in a bounded cache.

Texts are cut into pre-tokens a block at a time, as arrays, and looked up as hashes; only pre-tokens that the table lacks are cut out as strings.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter as Tally

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ARRAY_BYTES, blocks, column, live, texts_of
from pointloom.llm.pretokens import Recent, span_hashes, spans, splitter

#: Entries of the table (9 bytes each), and the documents, partitions and bytes that are sampled for it, at most and about.
TABLE, SAMPLE, PARTS, SAMPLED = 1 << 18, 8_000, 256, 64 << 20
#: Pre-tokens that a task of the sample counts before it passes them on.
PASSED = 1 << 17
#: Misses that a worker keeps (some 150 bytes each); long ones are encoded each time.
MISS_CACHE = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_LETTERS = byte_letters()


def _spelt(piece: str) -> str:
    return "".join(map(_LETTERS.__getitem__, piece.encode()))


def _model(tokenizer_json: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json).model


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, where each begins, and the end."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


def frequent(docs: DataFrame, sample: int = SAMPLE, most: int = TABLE) -> Tally:
    """The ``most`` frequent pre-tokens, with their counts, of about ``sample`` documents: the first of evenly chosen partitions. What lies behind them
    isn't read, so the cost doesn't grow with the table."""
    texts = texts_of(docs).select("text")
    parts = max(1, texts.rdd.getNumPartitions())
    stride = -(-parts // PARTS)
    chosen = -(-parts // stride)
    rows, size = -(-sample // chosen), SAMPLED // chosen

    def counted(seen: Tally) -> pa.RecordBatch:
        best = [(t, n) for t, n in seen.items() if len(t) <= 64]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    def work(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % stride:
            return
        seen, split, docs_left, bytes_left = Tally(), splitter(), rows, size
        for batch in blocks(batches):
            part = batch.slice(0, docs_left)
            for text in part.column("text").to_pylist():
                seen.update(split(text))
            docs_left -= part.num_rows
            bytes_left -= part.nbytes
            if len(seen) > PASSED:
                yield counted(seen)
                seen = Tally()
            if docs_left <= 0 or bytes_left <= 0:
                break
        yield counted(seen)

    pieces = texts.mapInArrow(work, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    table = pieces.orderBy(F.desc("n"), "piece").limit(most).toArrow()
    return Tally(dict(zip(table.column("piece").to_pylist(), table.column("n").to_pylist())))


def table_of(tokenizer_json: str, pieces: Tally, most: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and lengths in tokens of the most frequent pieces."""
    tokenize = _model(tokenizer_json).tokenize
    best = [(t, n) for t, _ in pieces.most_common(most) if (n := len(tokenize(_spelt(t)))) < 256]
    points, at = _points([t for t, _ in best])
    keys = span_hashes(points, at[:-1], at[1:])
    by = np.argsort(keys)
    return keys[by], np.array([n for _, n in best], np.uint8)[by]


class Counter:
    def __init__(self, tokenizer_json: str, table: tuple[np.ndarray, np.ndarray]):
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        added = spec.get("added_tokens", [])
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that strip or stand alone aren't supported")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.marks = [t["content"] for t in added]
        tokenize = _model(tokenizer_json).tokenize
        self.keys, self.sizes = table
        self.missed = Recent(MISS_CACHE, lambda piece: len(tokenize(_spelt(piece))))

    def counts(self, texts: list[str]) -> np.ndarray:
        """As the library counts: a special string in a text is one token, and the parts around it stand alone."""
        specials = np.zeros(len(texts), np.int64)
        owner, parts = np.arange(len(texts)), texts
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        if marked:
            parts, whose = [], []
            for i, t in enumerate(texts):
                cut = self.special.split(t)
                specials[i] = len(cut) - 1
                parts += cut
                whose += [i] * len(cut)
            owner = np.array(whose, np.int64)
        points, at = _points(parts)
        start, stop = spans(points, at)
        keys, first, place = np.unique(span_hashes(points, start, stop), return_index=True, return_inverse=True)
        size = np.zeros(len(keys), np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            size = np.where(self.keys[i] == keys, self.sizes[i], 0).astype(np.int64)
        whole = points.tobytes()
        for k in np.flatnonzero(size == 0).tolist():
            a, b = int(start[first[k]]), int(stop[first[k]])
            size[k] = self.missed[whole[4 * a : 4 * b].decode("utf-32-le", "surrogatepass")]
        text = owner[np.searchsorted(at, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
        return specials + np.bincount(text, size[place], len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, read by the driver and broadcast with the
    table of frequent pre-tokens. A null text counts as empty (0 tokens); null ids, repeated rows and empty tables pass row by row.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, table_of(spec, frequent(docs))))
    mark = hashlib.sha256(spec.encode()).digest()

    def work(batches):
        table = shared.value[1]
        counter = live(("tokens", mark, hashlib.sha256(table[0].tobytes()).digest()), lambda: Counter(*shared.value))
        for batch in blocks(batches, limit=ARRAY_BYTES // 2):
            text = batch.column("text")
            n = counter.counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(work, f"{column('doc_id', docs)}, n_bytes bigint, n_tokens bigint, over_limit boolean")
