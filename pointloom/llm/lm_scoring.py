"""Language-model scoring with log-frequency Bloom filters (after Talbot and Osborne, 2007).

A filter holds no counts: an n-gram whose quantised count is q is entered q times, as (n-gram, 1) to (n-gram, q), and its count is read back by
probing level after level until one is missing. A false positive raises a count by few levels. One filter holds words, another word pairs and how
often each word begins one. Every n-gram is entered from a count of 1. From these,

    P(w | v) = (c(v,w) + m P(w)) / (c(v) + m),   P(w) = (c(w) + 1/2) / (N + (V + 1)/2).

Every word is followed by one token, END by the first of a text.

A filter is made of segments, each built by one task to the size that its entries need and written to the shared folder: those of words by a hash of the
word, those of pairs by a hash of the first word. Filters of at most ``capacity`` bytes are broadcast whole. Words beyond that are put in shards of about
that size, each broadcast for a pass over the documents. Pairs beyond that aren't broadcast: tokens, with the levels of their words, are sent packed to the
segments of the words before them, a bundle of segments at a time, and what each bundle adds to a document's score is sent back packed and summed up. The
levels read are the same either way, and no n-gram is left out for room.

Words are known by 64-bit hashes. The base score needs exact counts: those of frequent words are broadcast (at most HOT of them), a document's other words
are joined with the counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.bloom import BITS, Filter, segments_of, short_of
from pointloom.llm.common import ARRAY_BYTES, blocks, bounded, column, written
from pointloom.llm.words import Words, mixed

#: The token that ends each document, which is also what its first word follows. It is no word's hash.
END = np.uint64(0x94D049BB133111EB)
HOT, CAPACITY = 1 << 20, 160 << 20
#: Entries in a segment, about, and segments that tokens are sent to together: the more, the fewer sums come back for each document.
SEGMENT, BUNDLE = 1 << 20, 8
#: A level covers counts up to so many times its smallest: finer for words than for pairs.
WORD_STEP, PAIR_STEP = 1.2, 1.5
PRIOR = 20.0
#: Tokens that a task counts before it passes them on.
HELD = 1 << 20


def hashed(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each token of all texts, of the one before it, and how many tokens each text has."""
    w = Words(texts, lower=True)
    n = w.counts + 1
    ends = np.cumsum(n) - 1
    token = np.empty(w.n + len(n), np.uint64)
    word = np.ones(len(token), bool)
    word[ends] = False
    token[word] = w.hashes
    token[ends] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(n) - n] = END
    return token, before, n


# ---- Keys and levels


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * np.uint64(0x9E3779B97F4A7C15) + second)


def first_keys(first: np.ndarray) -> np.ndarray:
    """The keys of how often words begin a pair."""
    return mixed(first + np.uint64(0x2545F4914F6CDD1D))


def levels_of(count: np.ndarray, step: float) -> np.ndarray:
    """1 for a count of 1, and so on: the number of powers of ``step`` up to the count."""
    return (1 + np.floor(np.log(count) / float(np.log(step)) + 1e-9)).astype(np.int64)


def counts_of_levels(step: float, n: int = 512) -> np.ndarray:
    """The count that each level stands for: the middle of the integers in it, 0 for level 0."""
    low = np.ceil(step ** np.arange(n) - 1e-6)
    high = np.maximum(low, np.ceil(step ** np.arange(1, n + 1) - 1e-6) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


# ---- The filter


@dataclass(frozen=True)
class Shards:
    """The written (segment, bits) of a filter of 2**bits segments, their bytes, and the first segment of each shard with the end of the last."""

    parts: DataFrame
    bits: int
    size: np.ndarray
    bounds: tuple[int, ...]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def filter(self, i: int) -> Filter:
        """Shard ``i``: segments of other shards have no bits in it."""
        a, b = self.bounds[i], self.bounds[i + 1]
        size = np.where((np.arange(1 << self.bits) >= a) & (np.arange(1 << self.bits) < b), self.size, 0)
        start = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        for r in self.parts.where((F.col("segment") >= a) & (F.col("segment") < b)).toLocalIterator():
            at = start[r["segment"]]
            data[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        return Filter(self.bits, start.astype(np.uint64) * np.uint64(8), size.astype(np.uint64) * np.uint64(8), data)


@dataclass(frozen=True)
class Terms:
    """The numbers that turn levels into probabilities."""

    total: int
    distinct: int
    prior: float

    def log10(self, pairs: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """log10 P by the levels of a pair, of its second word, and of how often the first one begins a pair."""
        alone = (counts_of_levels(WORD_STEP)[words] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        v = counts_of_levels(WORD_STEP)[firsts]
        return np.log10((np.minimum(counts_of_levels(PAIR_STEP)[pairs], v) + self.prior * alone) / (v + self.prior))


def _follows(own: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the token before each stands among the distinct ones: it is one of the block's, END for the first of a text."""
    out = np.empty_like(place)
    out[1:] = place[:-1]
    out[before == END] = np.searchsorted(own, END)
    return out


class Known:
    """Levels of words that a task has looked up, of those with FEW or more, at most MOST words: frequent ones have many levels and are in most blocks."""

    FEW, MOST = 3, 1 << 17

    def __init__(self):
        self.words, self.levels = np.zeros(0, np.uint64), None

    def of(self, own: np.ndarray, find) -> list[np.ndarray]:
        """What ``find`` gives for distinct words: arrays of levels."""
        at = np.searchsorted(self.words, own)
        new = np.ones(len(own), bool) if not len(self.words) else self.words[np.minimum(at, len(self.words) - 1)] != own
        found = find(own[new])
        out = [np.zeros(len(own), np.int64) for _ in found]
        for i, x in enumerate(out):
            x[new] = found[i]
            if len(self.words):
                x[~new] = self.levels[i][at[~new]]
        keep = np.flatnonzero(np.max(found, axis=0) >= self.FEW)[: self.MOST - len(self.words)]
        if len(keep):
            words = np.concatenate([self.words, own[new][keep]])
            by = np.argsort(words)
            self.levels = [np.concatenate([*([self.levels[i]] if self.levels else []), x[keep]])[by] for i, x in enumerate(found)]
            self.words = words[by]
        return out


@dataclass(frozen=True)
class Scorer:
    """What is sent to the workers where both filters are broadcast."""

    words: Filter
    pairs: Filter
    terms: Terms

    def log10(self, token: np.ndarray, before: np.ndarray, own: np.ndarray, place: np.ndarray, known: Known) -> np.ndarray:
        """log10 P of each token after the one before it. ``own``: the distinct tokens, at ``place``."""
        segments, follows = self.pairs.segments(own), _follows(own, place, before)
        words, firsts = known.of(own, lambda w: (self.words.levels(mixed(w), self.words.segments(w)), self.pairs.levels(first_keys(w), self.pairs.segments(w))))
        return self.terms.log10(self.pairs.levels(pair_keys(before, token), segments[follows]), words[place], firsts[follows])


@dataclass(frozen=True)
class Model:
    words: Shards
    pairs: Shards
    terms: Terms
    #: Of each bundle of segments of pairs, into how many lanes what is sent to it is dealt.
    lanes: np.ndarray

    @property
    def whole(self) -> bool:
        """Whether both filters are small enough to be broadcast."""
        return len(self.words) == len(self.pairs) == 1

    def scorer(self) -> Scorer:
        return Scorer(self.words.filter(0), self.pairs.filter(0), self.terms)


# ---- Learning


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


_PACKED = "segment int, keys binary, times binary, first boolean"


def _packed(segment: np.ndarray, keys: np.ndarray, times: np.ndarray, first: bool) -> pa.RecordBatch:
    """A row for each segment, which ascend."""
    cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
    rows = [(int(segment[a]), keys[a:b].tobytes(), times[a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts, cuts[1:]) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2)), pa.array([first] * len(rows))], names=["segment", "keys", "times", "first"])


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """Rows of _PACKED: keys counted in the tasks. ``keys_of``: (segment, key) arrays of (token, before)."""

    def work(batches):
        held, size = [], 0

        def sent():
            segment, key = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((key, segment))
            segment, key = segment[by], key[by]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])]))
            return _packed(segment[at], key[at], np.diff(np.append(at, len(key))), False)

        for batch in blocks(batches, limit=ARRAY_BYTES):
            token, before, _ = hashed(batch.column("text"))
            held.append(keys_of(token, before))
            size += len(token)
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return texts.select("text").mapInArrow(work, _PACKED)


def _summed(keys: list[bytes], times: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.frombuffer(b"".join(keys), kind), np.frombuffer(b"".join(times), np.uint32).astype(np.int64)
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens, by hash, counted in the tasks first."""

    def work(batches):
        held, size = [], 0

        def sent():
            word, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])

        for batch in blocks(batches, limit=ARRAY_BYTES):
            held.append(hashed(batch.column("text"))[0])
            size += len(held[-1])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return texts.select("text").mapInArrow(work, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _entered(words: DataFrame, keys, bits: int, first: bool) -> DataFrame:
    """Rows of _PACKED of (word, c), by the word."""

    def work(batches):
        for batch in batches:
            word = batch.column("word").to_numpy(zero_copy_only=False).view(np.uint64)
            segment = segments_of(word, bits)
            by = np.argsort(segment, kind="stable")
            if len(by):
                yield _packed(segment[by], short_of(keys(word))[by], batch.column("c").to_numpy(zero_copy_only=False)[by], first)

    return words.mapInArrow(work, _PACKED)


def _built(entries: DataFrame, bits: int, capacity: int) -> Shards:
    """The filter of rows of _PACKED. ``first`` tells counts of words from those of pairs."""

    def build(table: pa.Table) -> pa.Table:
        short, levels = [], []
        for first, step in ((False, PAIR_STEP), (True, WORD_STEP)):
            part = table.filter(pc.equal(table.column("first"), first))
            k, n = _summed(part.column("keys").to_pylist(), part.column("times").to_pylist(), np.uint32)
            short.append(k)
            levels.append(levels_of(n, step))
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([Filter.built(np.concatenate(short), np.concatenate(levels))], pa.binary())})

    parts = written(entries.groupBy("segment").applyInArrow(build, "segment int, bits binary"))
    size = np.zeros(1 << bits, np.int64)
    for r in parts.select("segment", F.octet_length("bits").alias("n")).toLocalIterator():
        size[r["segment"]] = r["n"]
    # what is kept by a word of another segment than any in the filter must still be told to lie in a shard
    size = np.maximum(size, 64)
    shards = max(1, -(-int(size.sum()) // capacity))
    which = np.minimum((np.cumsum(size) - size) * shards // max(1, int(size.sum())), shards - 1)
    return Shards(parts, bits, size, (0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), 1 << bits))


def _lanes(words: DataFrame, bits: int) -> np.ndarray:
    """For each bundle of segments as many lanes as its words, by their counts, begin pairs over the mean of all bundles."""

    def work(batches):
        for batch in batches:
            bundle = segments_of(batch.column("word").to_numpy().view(np.uint64), bits) // BUNDLE
            own, place = np.unique(bundle, return_inverse=True)
            load = np.zeros(len(own), np.int64)
            np.add.at(load, place, batch.column("c").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(load)], names=["bundle", "load"])

    load = np.zeros(-(-(1 << bits) // BUNDLE), np.int64)
    for r in words.select("word", "c").mapInArrow(work, "bundle bigint, load bigint").groupBy("bundle").agg(F.sum("load").alias("load")).toLocalIterator():
        load[r["bundle"]] = r["load"]
    return np.maximum(1, -(-load // max(1, int(load.mean())))).astype(np.int64)


def learn(texts: DataFrame, capacity: int = CAPACITY, prior: float = PRIOR) -> tuple[Model, DataFrame]:
    """The model and the exact (word, c), by hash, of the rows of ``texts``. ``capacity``: bytes of a shard, about."""
    words = written(word_counts(texts))
    row = words.agg(F.sum("c"), F.count("*")).first()
    total, distinct = row[0] or 0, row[1] or 0
    # a shard has several segments, so that shards come out even
    each = min(SEGMENT, max(1, capacity * 8 // BITS // 4))
    bits = lambda n: int(np.ceil(np.log2(max(1, -(-n // each)))))
    many, few = bits(total), bits(4 * distinct)
    singles = _built(_entered(words, mixed, few, True), few, capacity)
    pairs = _counted(texts, lambda token, before: (segments_of(before, many), short_of(pair_keys(before, token))))
    doubles = _built(pairs.union(_entered(words, first_keys, many, True)), many, capacity)
    return Model(singles, doubles, Terms(total, distinct, prior), _lanes(words, many)), words


# ---- Scoring


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words, ascending, and their counts, of as many of the most frequent as have a count above that of the first one left out."""
    by_count = counts.groupBy(F.least(F.col("c"), F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    seen, least = 0, None
    for r in by_count.toLocalIterator():
        seen += r["n"]
        if seen > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    word, c = table.column("word").to_numpy().view(np.uint64), table.column("c").to_numpy()
    by = np.argsort(word)
    return word[by], c[by]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    return np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))


def score(docs: DataFrame, model: Model, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. ``counts``: the exact (word, c)."""
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(_frequent(counts, hot))
    total = model.terms.total
    scale = total + 0.5 * (model.terms.distinct + 1)
    whole = model.whole
    shared = sc.broadcast(model.scorer() if whole else None)

    def work(batches):
        (word, times), known_levels = frequent.value, Known()
        for batch in blocks(batches, limit=ARRAY_BYTES):
            token, before, n = hashed(batch.column("text"))
            own, place = np.unique(token, return_inverse=True)
            i = np.minimum(np.searchsorted(word, own), max(0, len(word) - 1))
            c = np.where(word[i] == own, times[i], 0) if len(word) else np.zeros(len(own), np.int64)
            known = c > 0
            base = np.where(known, np.log10((c + 0.5) / scale), 0.0)[place]
            there = known[place]
            cut = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[~there], minlength=len(n)))])
            rare = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(token[~there].view(np.int64)))
            value = _sums(shared.value.log10(token, before, own, place, known_levels), n) if whole else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "held_out")), pa.array(n), pa.array(_sums(there, n).astype(np.int64)), pa.array(_sums(base, n)), pa.array(value), rare], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    if not whole:  # every pass has to meet the same rows under the same numbers
        texts = written(texts)
    part = written(texts.mapInArrow(work, f"row bigint, {column('doc_id', docs)}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>"))
    shared.destroy()
    frequent.destroy()
    rare = part.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    met = rare.join(counts, F.col("w") == F.col("word"), "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(scale))).alias("more_base"))
    rows = part.drop("rare").join(met, "row", "left")
    if not whole:
        rows = rows.drop("score").join(_routed(texts, model), "row")
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")


#: Of each token sent to a lane: the pair's key, the level of its word, and its document, counted from the pack's first row. Tokens are sorted by the word
#: before them, so of each such word once: its key, its segment in the bundle, and how many tokens follow it.
_SENT = {"keys": np.uint32, "levels": np.uint8, "docs": np.uint16, "firsts": np.uint32, "parts": np.uint8, "times": np.uint32}
#: Rows that a pack reaches over.
REACH = 1 << 16


def _packs(held: list[list[np.ndarray]], base: int) -> pa.RecordBatch:
    """A row for each lane, of the (lane, segment, key, key of the word before, level, document) of tokens."""
    lane, segment, key, first, level, doc = (np.concatenate(x) for x in zip(*held))
    whose = (lane * BUNDLE + segment % BUNDLE).astype(np.uint64) << np.uint64(32) | first
    by = np.argsort(whose, kind="stable")
    whose, key, level, doc = whose[by], key[by], level[by].astype(np.uint8), doc[by].astype(np.uint16)
    run = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
    times = np.diff(np.append(run, len(whose))).astype(np.uint32)
    firsts, at = whose[run].astype(np.uint32), (whose[run] >> np.uint64(32)).astype(np.int64)
    lanes, parts = at // BUNDLE, (at % BUNDLE).astype(np.uint8)
    cuts = np.flatnonzero(np.concatenate([[True], lanes[1:] != lanes[:-1]]))
    ends = np.append(cuts[1:], len(lanes))
    token = np.append(run, len(whose))
    cells = [[x[a:b].tobytes() for a, b in zip(token[cuts], token[ends])] for x in (key, level, doc)] + [[x[a:b].tobytes() for a, b in zip(cuts, ends)] for x in (firsts, parts, times)]
    return pa.RecordBatch.from_arrays([pa.array(lanes[cuts], pa.int32()), pa.array(np.full(len(cuts), base, np.int64)), *(pa.array(x, pa.binary()) for x in cells)], names=["lane", "base", *_SENT])


def _within_reach(batches):
    """(first row of the pack, whether it begins here, batch) of batches whose rows lie within REACH of that one."""
    base = None
    for batch in blocks(batches, limit=ARRAY_BYTES):
        row, a = batch.column("row").to_numpy(), 0
        while a < len(row):
            new = base is None or not base <= row[a] < base + REACH
            base = int(row[a]) if new else base
            out = np.flatnonzero((row[a:] < base) | (row[a:] >= base + REACH))
            b = a + int(out[0]) if len(out) else len(row)
            again = yield base, new, batch.slice(a, b - a)
            base, a = None if again else base, b


def _routed(texts: DataFrame, model: Model) -> DataFrame:
    """(row, score) by filters that aren't broadcast whole.

    A document's tokens go to one lane of each bundle of segments. Frequent words make heavy bundles, which have more lanes, so no lane gets much more than the
    mean. What a lane adds to the documents of a pack comes back as one row of arrays, so rows are few both ways.
    """
    sc, bits, terms = texts.sparkSession.sparkContext, model.pairs.bits, model.terms
    first_lane = np.cumsum(model.lanes) - model.lanes
    lanes = sc.broadcast((first_lane, model.lanes))
    bundle = np.repeat(np.arange(len(model.lanes)), model.lanes)
    segment = (bundle[:, None] * BUNDLE + np.arange(BUNDLE)).ravel()
    segment_of = texts.sparkSession.createDataFrame(pa.table({"lane": pa.array(np.repeat(np.arange(len(bundle)), BUNDLE), pa.int32()), "segment": pa.array(segment, pa.int32())}))

    def tokens_of(shard):
        def work(batches):
            held, size, base, known = [], 0, None, Known()
            each = _within_reach(batches)
            item = next(each, None)
            while item is not None:
                now, new, batch = item
                if new and size:
                    yield _packs(held, base)
                    held, size = [], 0
                base = now
                token, before, n = hashed(batch.column("text"))
                own, place = np.unique(token, return_inverse=True)
                words = shard.value.segments(own)
                here = np.flatnonzero(shard.value.holds(words)[place])
                (found,) = known.of(own, lambda w: (shard.value.levels(mixed(w), shard.value.segments(w)),))
                level = np.minimum(found, 255)[place[here]]
                row = np.repeat(batch.column("row").to_numpy(), n)[here]
                of, first = (x[_follows(own, place, before)[here]] for x in (segments_of(own, bits), short_of(first_keys(own))))
                begin, many = lanes.value
                lane = begin[of // BUNDLE] + mixed(row.astype(np.uint64)).astype(np.int64) % many[of // BUNDLE]
                held.append([lane, of, short_of(pair_keys(before[here], token[here])), first, level, row - base])
                size += len(here)
                full = size >= HELD
                if full:
                    yield _packs(held, base)
                    held, size = [], 0
                try:
                    item = each.send(full)
                except StopIteration:
                    break
            if size:
                yield _packs(held, base)

        return work

    def scored(packs: pa.Table, part: pa.Table) -> pa.Table:
        segments = {s % BUNDLE: bits for s, bits in zip(part.column("segment").to_pylist(), part.column("bits").to_pylist())}
        filter_ = Filter.joined(BUNDLE.bit_length() - 1, segments)
        read = lambda short, at: filter_.levels(short.astype(np.uint64) << np.uint64(32), at)
        docs, sums = [], []
        for i in range(packs.num_rows):
            key, level, doc, first, at, times = (np.frombuffer(packs.column(c)[i].as_py(), k) for c, k in _SENT.items())
            at = at.astype(np.int64)
            value = terms.log10(read(key, np.repeat(at, times)), level, np.repeat(read(first, at), times))
            there = np.flatnonzero(np.bincount(doc))
            docs.append(there.astype(np.uint16).tobytes())
            sums.append(np.bincount(doc, value)[there].tobytes())
        return pa.table({"base": packs.column("base"), "lane": packs.column("lane"), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def total(answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("lane")  # in one order, so that equal texts have equal sums
        score, there = np.zeros(REACH), np.zeros(REACH, bool)
        for docs, sums in zip(answers.column("docs").to_pylist(), answers.column("sums").to_pylist()):
            docs = np.frombuffer(docs, np.uint16)
            score[docs] += np.frombuffer(sums)
            there[docs] = True
        docs = np.flatnonzero(there)
        return pa.table({"row": pa.array(docs + answers.column("base")[0].as_py()), "score": pa.array(score[docs])})

    parts = []
    for i in range(len(model.words)):
        shard = sc.broadcast(model.words.filter(i))
        packs = texts.select("row", "text").mapInArrow(tokens_of(shard), "lane int, base bigint, " + ", ".join(f"{c} binary" for c in _SENT))
        parts_of = segment_of.join(model.pairs.parts, "segment").select("lane", "segment", "bits")
        answers = packs.groupBy("lane").cogroup(parts_of.groupBy("lane")).applyInArrow(scored, "base bigint, lane int, docs binary, sums binary")
        parts.append(written(answers.groupBy("base").applyInArrow(total, "row bigint, score double")))
        shard.destroy()
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).groupBy("row").agg(F.sum("score").alias("score"))


def score_corpus(docs: DataFrame, capacity: int = CAPACITY, hot: int = HOT) -> DataFrame:
    """score() of all of ``docs`` by a model of those that aren't held out.

    A null or empty text is one end token. Rows are told apart inside, so repeated rows and null ids get a row each; equal texts get equal scores. Of an
    empty table, or one that is all held out, the model knows nothing and gives every token the same probability. Other columns aren't read.
    """
    texts = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model, counts = learn(texts.where(~held_out(F.col("doc_id"))), capacity)
    return score(docs, model, counts, hot)
