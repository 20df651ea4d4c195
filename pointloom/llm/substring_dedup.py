"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A window is WINDOW consecutive words. Its anchor is the smallest hash among the sequences of ANCHOR words in it, so equal windows have equal anchors,
wherever they stand. The windows of one anchor that follow each other in a document span a stretch of words, its passage. The different passages of an
anchor, from all documents, are its reference block, a text of words in which every window is indexed by where the document with the smallest id has it.

Each passage is parsed greedily against the block: from its first word on where a window stands in an earlier document, the factor is extended there, word
by word, to the longest match, (position, length) in the block; parsing goes on at the factor's border, WINDOW - 1 words before its end, so that no window
across the border is missed. Factors have WINDOW words or more. A passage that an earlier document has as a whole is one factor. Those of one document,
from all blocks, are joined where they meet.

Only anchors that several rows have make blocks. They are found first, from hashes alone, and go to the workers as a Bloom filter of bounded size: what it
lets through beside them makes blocks of one row, which hold no factor. Texts aren't shuffled for that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.bloom import Filter, segments_of, short_of
from pointloom.llm.common import ARRAY_BYTES, as_bytes, blocks, bounded, column, give_back, released, written
from pointloom.llm.words import Words, _Powers, _sums, mixed, sliding_min

WINDOW, ANCHOR = 50, 25
#: Bytes of the filter of anchors at most, anchors in a bucket and bytes of passages in a bucket, about, and anchors that a task holds before it sends.
FILTER, BUCKET, PASSAGES, HELD = 64 << 20, 1 << 20, 8 << 20, 1 << 18
LAST = np.iinfo(np.int64).max


def _ids(column_: pa.Array) -> np.ndarray:
    """Ids for comparison; a null id comes after all others."""
    return pc.fill_null(column_.cast(pa.int64()), LAST).to_numpy(zero_copy_only=False)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def passages(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each run of windows of one anchor in a text: the anchor, the text, the first word and the words of the passage."""
    mins = sliding_min(w.grams(anchor), window - anchor + 1)
    at = np.flatnonzero(w.left()[: len(mins)] >= window)
    text = np.repeat(np.arange(len(w.counts)), w.counts)[at]
    mins = mins[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0) | (mins[1:] != mins[:-1])])) if len(at) else at
    windows = np.diff(np.append(first, len(at)))
    return mins[first], text[first], at[first], windows + window - 1


def _dealt(rows: list[tuple], bucket: np.ndarray) -> tuple[list, list[int], list[int]]:
    """The arrays by ascending bucket, where each begins, and the numbers of the buckets."""
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [x[by] for x in rows], cuts, bucket[cuts[:-1]].tolist() if len(bucket) else []


def _repeated(keyed: DataFrame, window: int, anchor: int, bits: int) -> Filter:
    """The anchors that rows of different keys have, and few others."""

    def sent(held):
        found, key = (np.concatenate(x) for x in zip(*held))
        (short, key), cuts, numbers = _dealt([short_of(found), key], segments_of(found, bits))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] if numbers else [], pa.binary()) for x in (short, key))], names=["bucket", "anchors", "keys"])

    def work(batches):
        held, size = [], 0
        for batch in blocks(batches, limit=ARRAY_BYTES):
            found, text, _, _ = passages(Words(batch.column("text")), window, anchor)
            held.append((found, batch.column("key").to_numpy()[text]))
            size += len(found)
            if size >= HELD:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    most = max(64, FILTER >> bits)

    def build(table: pa.Table) -> pa.Table:
        short, key = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("anchors", np.uint32), ("keys", np.int64)))
        by = np.argsort(short, kind="stable")
        short, key = short[by], key[by]
        at = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
        several = short[at][np.minimum.reduceat(key, at) < np.maximum.reduceat(key, at)] if len(at) else short
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([Filter.built(several, np.ones(len(several), np.int64), most) if len(several) else None], pa.binary())})

    found = keyed.select("key", "text").mapInArrow(work, "bucket int, anchors binary, keys binary").groupBy("bucket").applyInArrow(build, "bucket int, bits binary")
    return Filter.joined(bits, {r["bucket"]: bytes(r["bits"]) for r in found.where("bits IS NOT NULL").toLocalIterator()})


#: Of each passage that a pack tells apart its name, length and words; of each row that has one its number in the pack, the row's key and id and the first word.
_PACK = {"names": np.uint64, "sizes": np.uint32, "words": np.uint32, "of": np.uint32, "keys": np.int64, "ids": np.int64, "starts": np.int32}


def _sent(known, window: int, anchor: int, bits: int):
    def pack(held):
        name, size, words, found, key, doc, start = (np.concatenate(x) for x in zip(*held))
        names, first, place = np.unique(name, return_index=True, return_inverse=True)
        begin = np.cumsum(size) - size
        # passages by bucket, then the rows that have them
        (number,), cuts, buckets = _dealt([np.arange(len(names))], segments_of(found[first], bits))
        rank = np.empty(len(names), np.int64)
        rank[number] = np.arange(len(names))
        by = np.argsort(rank[place], kind="stable")
        of = rank[place][by]
        edges = np.searchsorted(of, cuts)
        rows = []
        for a, b, c, d in zip(cuts, cuts[1:], edges, edges[1:]):
            own = first[number[a:b]]
            rows.append([x.astype(k).tobytes() for x, k in zip((names[number[a:b]], size[own], words[_ranges(begin[own], size[own])], of[c:d] - a, key[by[c:d]], doc[by[c:d]], start[by[c:d]]), _PACK.values())])
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(len(_PACK)))], names=["bucket", *_PACK])

    def work(batches):
        held, size = [], 0
        for batch in blocks(batches, limit=ARRAY_BYTES):
            w = Words(batch.column("text"))
            found, text, at, n = passages(w, window, anchor)
            some = np.flatnonzero(known.value.levels(found, known.value.segments(found)))
            if not len(some):
                continue
            found, text, at, n = (x[some] for x in (found, text, at, n))
            _, down = _Powers.of(w.n + 1)
            name = mixed((w.sums[at + n] - w.sums[at]) * down[at] + n.astype(np.uint64))
            # a passage's words go once from a block
            name, first, place = np.unique(name, return_index=True, return_inverse=True)
            words = short_of(w.hashes)[_ranges(at[first], n[first])]
            lengths = np.zeros(len(place), np.int64)
            lengths[first] = n[first]
            order = np.argsort(first)
            held.append((name[place], lengths, short_of(w.hashes)[_ranges(at[first[order]], n[first[order]])], found, batch.column("key").to_numpy()[text], _ids(batch.column("doc_id"))[text], at - w.starts[text]))
            size += len(found)
            if size >= HELD // 4:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return work


def parsed(words: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of passages against the block that they make together: the passage, where the factor begins in it, its position in the block, its length.

    ``words`` of all passages end to end, with their sizes and the smallest id that has each. A factor stands in a passage of a smaller id.
    """
    begin = np.cumsum(size) - size
    sums = _sums(words.astype(np.uint64))
    _, down = _Powers.of(len(words) + 1)
    of = lambda at, n: (sums[at + n] - sums[at]) * down[at]
    at = _ranges(begin, size - window + 1)
    passage = np.repeat(np.arange(len(size)), size - window + 1)
    # the index: for each window the place where the smallest id has it
    key = mixed(of(at, window))
    by = np.lexsort((doc[passage], key))
    new = np.concatenate([[True], key[by][1:] != key[by][:-1]]) if len(by) else np.zeros(0, bool)
    first = np.empty(len(at), np.int64)
    first[by] = by[new][np.cumsum(new) - 1] if len(by) else by
    late = np.flatnonzero(doc[passage[first]] < doc[passage])
    out = []
    end = begin + size
    # the first place of each passage where a factor begins; places ascend with passages
    now = late[np.concatenate([[True], passage[late][1:] != passage[late][:-1]])] if len(late) else late
    while len(now):
        p, q = at[now], at[first[now]]
        # the longest match, by halving: no shorter than a window, no longer than what is left of either passage
        low, high = np.full(len(now), window), np.minimum(end[passage[now]] - p, end[passage[first[now]]] - q)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = of(p, middle) == of(q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out.append((passage[now], p - begin[passage[now]], q, low))
        # on at the border: the first window that the factor doesn't hold
        i = np.searchsorted(late, now + low - window + 1)
        there = i < len(late)
        there[there] = passage[late[i[there]]] == passage[now[there]]
        now = late[i[there]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (late, late, late, late)


def _factors(window: int):
    def work(table: pa.Table) -> pa.Table:
        packs = {c: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in _PACK.items()}
        before = np.cumsum([0, *map(len, packs["names"])])
        name, size, words, key, doc, start = (np.concatenate(packs[c]) for c in ("names", "sizes", "words", "keys", "ids", "starts"))
        of = np.concatenate([x.astype(np.int64) + n for x, n in zip(packs["of"], before)])
        size = size.astype(np.int64)
        _, own, place = np.unique(name, return_index=True, return_inverse=True)
        begin, of = np.cumsum(size) - size, place[of]
        words, size = words[_ranges(begin[own], size[own])], size[own]
        least = np.full(len(size), LAST)
        np.minimum.at(least, of, doc)
        passage, offset, _, length = parsed(words, size, least, window)
        # rows of a larger id have the whole passage from the smallest, which itself is parsed
        later = np.flatnonzero(doc > least[of])
        mine = np.flatnonzero(doc == least[of])
        mine = mine[np.argsort(of[mine], kind="stable")]
        low, high = np.searchsorted(of[mine], passage, "left"), np.searchsorted(of[mine], passage, "right")
        row, factor = mine[_ranges(low, high - low)], np.repeat(np.arange(len(passage)), high - low)
        begins = np.concatenate([start[later], start[row] + offset[factor]]).astype(np.int32)
        ends = begins + np.concatenate([size[of[later]], length[factor]]).astype(np.int32)
        out = pa.table({"key": pa.array(np.concatenate([key[later], key[row]])), "start": pa.array(begins), "stop": pa.array(ends)})
        give_back()
        return out

    return work


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by a hash of id and text: rows equal in both have equal results."""
    return bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, start, stop: stretches of words, each a factor in a document of smaller id. ``key`` is xxhash64 of id and text, null as empty."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    power = lambda n, each: min(20, int(np.ceil(np.log2(max(1, partitions, n // each)))))
    # a passage begins every 13 words, some 80 bytes; one in a few is repeated, with four bytes for each of its words
    known = spark.sparkContext.broadcast(_repeated(keyed, window, anchor, power(size // 80, BUCKET)))
    bits = power(size, PASSAGES)
    packs = keyed.mapInArrow(_sent(known, window, anchor, bits), "bucket int, " + ", ".join(f"{c} binary" for c in _PACK))
    return packs.groupBy("bucket").applyInArrow(_factors(window), "key bigint, start int, stop int")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space) and spans (start, stop in words, joined) of every row.

    ``docs`` needs doc_id (an integer) and text. A null or empty text has no words. A null id counts as larger than all others, and rows of
    the same id, repeated rows among them, never count against each other. Texts shorter than a window are kept whole; empty tables give no rows.
    Other columns aren't read.
    """
    spans = factors(docs, window, anchor).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("key", "_key")
    keyed = _keyed(docs)
    met = keyed.join(spans, F.col("key") == F.col("_key"), "left").select("doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop"))

    def work(batches):
        for batch in blocks(batches):
            out = []
            for raw, start, stop in zip(as_bytes(batch.column("text")), batch.column("start").to_pylist(), batch.column("stop").to_pylist()):
                words, joined, kept, at = raw.split(), [], [], 0
                for a, b in sorted(zip(start or (), stop or ())):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                for a, b in joined:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [{"start": a, "stop": b} for a, b in joined]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "text", "spans"])

    return met.mapInArrow(work, f"{column('doc_id', docs)}, n_words bigint, n_removed bigint, text string, spans array<struct<start:int,stop:int>>")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
