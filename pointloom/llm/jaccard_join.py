"""Jaccard self-join of word shingle sets by adaptive multi-match prefixes, and the classes it links.

Each set is ordered by a global order, frequent shingles last. If two sets reach the threshold, the first |s| - ceil(t|s|) + l shingles of
both have l in common at least, for every l. A set's l is chosen by the estimated cost of its candidates: the more documents share its prefix,
the longer the prefix and the more matches a candidate needs before it is verified.

Equal sets become one first. Prefix shingles are dealt to buckets by their hash, packed by task. A bucket makes the posting lists and sends on what
stands in a list with another set of about its size; lists of very frequent shingles need no gathering. A set that is in fewer of the lists than any partner asks for can't link and is taken out, which
shortens the lists and is repeated. Then

* lists of at most SHORT sets send their pairs, equal lists once with their number, and a pair with the matches that both its sets ask for is verified;
* sets that meet in longer lists, as in a family of near copies, form blocks, which are never turned into pairs of rows: a task holds a block, or two
  parts of a large one, counts the matches of all its sets at once, and compares whole sets where there are enough.

Both count the same links, none twice. Classes are connected components over the names of sets; ids come in at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ARRAY_BYTES, as_bytes, blocks, bounded, column, free, released, written
from pointloom.llm.words import Words, mixed
from pointloom.operators.components import components

SHINGLE, PERCENT = 5, 80
#: Shingles whose frequency is broadcast, the most frequent (12 bytes each), and the occurrences that one has at least.
FREQUENT, LEAST = 1 << 20, 3
#: A prefix asks for one more match for each so many shingles of the set, as the cost of verifying a candidate grows with the set;
#: twice or four times as many where its shingles occur in COSTLY documents, or four times that, on average.
PER_MATCH, COSTLY = 32, 8.0
#: Shingles of documents that frequent are not gathered in a bucket: each is a long list, known by its hash.
HOT = 1000
#: Times that sets with too few matches are taken out, and sets in a list that sends pairs.
THINNED, SHORT = 2, 32
#: Partners of one set that are verified in one go.
FAN = 256
#: Packed bytes and sets in a part of a block, at most about so many; and the rows of overlaps that are held at once.
PART_BYTES, PART_SETS, STRIP = 1 << 20, 512, 512
#: Shingles in a bucket, about, and in what a task holds before it sends; sets that are broadcast to fetch their texts.
BUCKET, HELD, FEW_SETS = 1 << 19, 1 << 20, 1 << 19
#: Shares into which the rows of one class or set are dealt to be joined.
SALTS = 8
#: Sizes are compared by bands, each 2 % above the one before.
_BAND = float(np.log(1.02))


def need(n: int, percent: int) -> int:
    """The smallest overlap that a set of n needs."""
    return (n * percent + 99) // 100


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: pa.Array | list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text of fewer words is one shingle, and one without words has none."""
    w = Words(texts, lower=True)
    grams = w.grams(k)
    out = []
    for i, (a, n) in enumerate(zip(w.starts.tolist(), w.counts.tolist())):
        out.append(_distinct(grams[a : a + n - k + 1]) if n >= k else np.array([w.whole(i)] if n else [], np.uint64))
    return out


def _name(s: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _signed(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, tie, n and sid of every row: the size and name of its set."""

    def work(batches):
        for batch in blocks(batches, limit=ARRAY_BYTES):
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(list(map(len, sets)), pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "tie", "n", "sid"])

    return texts.mapInArrow(work, f"{column('doc_id', texts)}, tie bigint, n bigint, sid bigint")


# ---- The order


def _bits(items: int, each: int, least: int) -> int:
    """Bits of the number of a bucket, so that a bucket has about ``each`` of the items and there are ``least`` buckets."""
    return int(np.ceil(np.log2(max(1, least, -(-items // each)))))


def _bucket_cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where each of 2**bits buckets begins in ascending keys, and the end."""
    if not bits:
        return [0, len(keys)]
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the number of the bucket."""
    return (keys >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _frequencies(texts: DataFrame, k: int, bits: int) -> DataFrame:
    """(bucket, keys, times): of each bucket the most frequent shingles, FREQUENT in all at most. Shingles are counted by ``bits`` + 32 bits of their hash."""

    def count(batches):
        held, size = [], 0

        def sent():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            short, cuts = _short(u, bits), _bucket_cuts(u, bits)
            rows = [(b, short[i:j].tobytes(), np.minimum(n[i:j], 255).astype(np.uint8).tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2))], names=["bucket", "keys", "times"])

        for batch in blocks(batches, limit=ARRAY_BYTES):
            sets = {s.tobytes(): s for s in shingle_sets(batch.column("text"), k) if len(s)}
            if sets:
                held.append(np.concatenate(list(sets.values())))
                size += len(held[-1])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    most = max(1, FREQUENT >> bits)

    def reduce(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, times = keys[at], np.add.reduceat(times, at)
        often = np.flatnonzero(times >= LEAST)
        if len(often) > most:
            often = np.sort(often[np.lexsort((often, -times[often]))[:most]])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([keys[often].tobytes()], pa.binary()), "times": pa.array([times[often].astype(np.uint32).tobytes()], pa.binary())})

    kind = "bucket int, keys binary, times binary"
    return texts.select("text").mapInArrow(count, kind).groupBy("bucket").applyInArrow(reduce, kind)


@dataclass(frozen=True)
class Order:
    """Frequent shingles by the upper bits of their hash, ascending, and about how many documents have each."""

    bits: int
    keys: np.ndarray
    times: np.ndarray
    #: The settings of this name, which go to the workers with the order.
    per_match: int = PER_MATCH
    costly: float = COSTLY
    hot: int = HOT

    @staticmethod
    def of(frequencies: DataFrame, bits: int) -> Order:
        rows = sorted(frequencies.collect(), key=lambda r: r["bucket"])
        keys = [np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in rows]
        return Order(bits, np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["times"], np.uint32) for r in rows)]), PER_MATCH, COSTLY, HOT)

    def times_of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), np.uint32)
        if len(self.keys):
            short = tokens >> np.uint64(32 - self.bits)
            i = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
            same = self.keys[i] == short
            out[same] = self.times[i[same]]
        return out

    def prefixes(self, sets: list[np.ndarray], percent: int) -> list[tuple[np.ndarray, int, int]]:
        """For each set its prefix in order, how many matches it asks for, and the factor that this has by its cost."""
        times = np.split(self.times_of(np.concatenate(sets)), np.cumsum(list(map(len, sets)))[:-1]) if sets else []
        out = []
        for s, t in zip(sets, times):
            n = len(s)
            base = n - need(n, percent) + 1
            if int(t.max()) > 1:
                order = np.argsort(t, kind="stable")  # hashes ascend already
                s, t = s[order], t[order]
            cost = float(t[:base].mean())
            factor = 1 if cost < self.costly else 2 if cost < 4 * self.costly else 4
            matches = asked(n, factor, percent, self.per_match)
            out.append((s[: base + matches - 1], matches, factor))
        return out


def asked(n: int, factor: int, percent: int, per_match: int) -> int:
    """The matches that a set of n asks for."""
    return min(need(n, percent), 1 + n // per_match * factor)


# ---- Posting lists


def _bands(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / _BAND + 1e-9).astype(np.int64)


def _entries(texts: DataFrame, order, k: int, percent: int, bits: int) -> DataFrame:
    """(bucket, hot, keys, sids, codes): prefix shingles of sets, packed by bucket. A code is the size's band, times 4, and the factor's power of 2.

    Shingles of HOT documents or more are dealt by the set instead and keep their whole hash.
    """

    def work(batches):
        known = order.value
        held, size = [], 0

        def sent():
            token, sid, code = (np.concatenate(x) for x in zip(*held))
            often = known.times_of(token) >= known.hot
            rows = []
            for hot in (False, True):
                t, s, c = (x[often == hot] for x in (token, sid, code))
                by = t if not hot else mixed(s.view(np.uint64))
                at = np.argsort(by, kind="stable")
                t, s, c = t[at], s[at], c[at]
                keys, cuts = t if hot else _short(t, bits), _bucket_cuts(by[at], bits)
                rows += [(b, hot, keys[i:j].tobytes(), s[i:j].tobytes(), c[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (2, 3, 4))], names=["bucket", "hot", "keys", "sids", "codes"])

        for batch in blocks(batches, limit=ARRAY_BYTES):
            sets = {_name(s): s for s in shingle_sets(batch.column("text"), k) if len(s)}
            if sets:
                found = known.prefixes(list(sets.values()), percent)
                times = [len(p) for p, _, _ in found]
                n = np.array(list(map(len, sets.values())), np.int64)
                code = (_bands(n) * 4 + np.array([f.bit_length() - 1 for _, _, f in found])).astype(np.int16)
                held.append((np.concatenate([p for p, _, _ in found]), np.repeat(np.array(list(sets), np.int64), times), np.repeat(code, times)))
                size += len(held[-1][0])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return texts.select("text").mapInArrow(work, "bucket int, hot boolean, keys binary, sids binary, codes binary")


_SHARED = "token bigint, sid bigint, code smallint"


def _lists(percent: int):
    """The entries, told once, of those lists of a bucket where another set is near enough in size for a link, and all of frequent shingles."""
    reach = int(np.ceil(np.log(100 / percent) / _BAND)) + 1

    def once(key, sid, code):
        """By key, size and set."""
        by = np.lexsort((sid, code >> 2, key))
        key, sid, code = key[by], sid[by], code[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        return key[fresh], sid[fresh], code[fresh]

    def read(table, kind):
        return (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("keys", kind), ("sids", np.int64), ("codes", np.int16)))

    def work(table: pa.Table) -> pa.Table:
        hot = table.column("hot")
        key, sid, code = read(table.filter(pc.invert(hot)), np.uint32)
        by = np.argsort(key, kind="stable")
        key, sid, code = key[by], sid[by], code[by]
        # most shingles stand alone
        same = key[1:] == key[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)
        key, sid, code = once(key[some], sid[some], code[some])
        band = (code >> 2).astype(np.int64)
        near = (key[1:] == key[:-1]) & (band[1:] - band[:-1] <= reach)
        out = np.concatenate([[False], near]) | np.concatenate([near, [False]]) if len(key) else np.zeros(0, bool)
        token = key[out].astype(np.int64) | table.column("bucket")[0].as_py() << 32
        # a whole hash is made negative, so that it is no other token's
        often = once(*read(table.filter(hot), np.uint64))
        return pa.table({"token": pa.array(np.concatenate([token, (often[0] | np.uint64(1 << 63)).view(np.int64)])), "sid": pa.array(np.concatenate([sid[out], often[1]])), "code": pa.array(np.concatenate([code[out], often[2]]))})

    return work


def _few(percent: int) -> Column:
    """The least matches that any partner of a set asks for, by the set's code."""
    size = F.exp(F.floor(F.col("code") / 4) * _BAND) * (percent / 100)
    return 1 + F.floor(F.ceil(size * 0.999) / PER_MATCH)


def _thinned(shared: DataFrame, percent: int) -> DataFrame:
    """Without the sets that are in too few lists to link, and the lists that keep only one set; repeated."""
    for _ in range(THINNED):
        enough = shared.groupBy("sid").agg(F.count("*").alias("c"), F.first("code").alias("code")).where(F.col("c") >= _few(percent)).select("sid")
        left = shared.join(enough, "sid", "left_semi")
        lists = left.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        before, shared = shared, written(left.join(lists, "token", "left_semi"))
        released(before)
    return shared


# ---- Overlaps


class Overlaps:
    """How many elements each set of ``one`` has in common with each of ``two`` (or of ``one``), a strip of rows at a time."""

    def __init__(self, one: list[np.ndarray], two: list[np.ndarray] | None):
        two = one if two is None else two
        self.n, self.m = np.array([len(s) for s in one], np.int64), np.array([len(s) for s in two], np.int64)
        alone = two is one
        token, number = np.unique(np.concatenate(one if alone else [*one, *two]), return_inverse=True)
        self.a = number[: self.n.sum()]
        b = self.a if alone else number[self.n.sum() :]
        self.owner_a, owner_b = np.repeat(np.arange(len(self.n)), self.n), np.repeat(np.arange(len(self.m)), self.m)
        by_token = np.argsort(b, kind="stable")
        self.posted, self.in_b = owner_b[by_token], np.bincount(b, minlength=len(token))
        self.start = np.cumsum(self.in_b) - self.in_b
        # what many sets have is multiplied as a matrix, the rest by posting lists
        self.dense = np.bincount(self.a, minlength=len(token)) * self.in_b * 50 > len(self.n) * len(self.m)
        self.columns, self.place = int(self.dense.sum()), np.cumsum(self.dense) - 1
        v = self.dense[b]
        self.b, self.owner_b = self.place[b[v]], owner_b[v]
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def strip(self, low: int, high: int) -> np.ndarray:
        m = len(self.m)
        t, row = self.a[self.starts[low] : self.starts[high]], self.owner_a[self.starts[low] : self.starts[high]] - low
        thin = ~self.dense[t]
        x, times = t[thin], self.in_b[t[thin]]
        at = np.repeat(self.start[x] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        both = np.bincount(np.repeat(row[thin], times) * m + self.posted[at], minlength=(high - low) * m).reshape(high - low, m)
        place, row = self.place[t[~thin]], row[~thin]
        for c in range(0, self.columns, STRIP):
            width = min(STRIP, self.columns - c)
            mine, theirs = np.zeros((high - low, width), np.float32), np.zeros((m, width), np.float32)
            u, v = (place >= c) & (place < c + width), (self.b >= c) & (self.b < c + width)
            mine[row[u], place[u] - c] = 1
            theirs[self.owner_b[v], self.b[v] - c] = 1
            both += (mine @ theirs.T).astype(np.int64)
        return both


def links_of(one: list[np.ndarray], two: list[np.ndarray] | None, order: Order, percent: int) -> np.ndarray:
    """Which sets of ``one`` link with which of ``two`` (or of ``one``): those whose prefixes have the matches that both ask for, by their exact overlap."""
    alone = two is None
    first = order.prefixes(one, percent)
    second = first if alone else order.prefixes(two, percent)
    n, m = (np.array([len(s) for s in x], np.int64) for x in (one, one if alone else two))
    la, lb = (np.array([l for _, l, _ in x], np.int64) for x in (first, second))
    matches = Overlaps([p for p, _, _ in first], None if alone else [p for p, _, _ in second])
    out = np.zeros((len(n), len(m)), bool)
    for low in range(0, len(n), STRIP):
        high = min(low + STRIP, len(n))
        fits = np.minimum(n[low:high, None], m[None]) * 100 >= np.maximum(n[low:high, None], m[None]) * percent
        out[low:high] = fits & (matches.strip(low, high) >= np.minimum(la[low:high, None], lb[None]))
    if alone:
        np.fill_diagonal(out, False)
    rows, columns = np.flatnonzero(out.any(1)), np.flatnonzero(out.any(0))
    if not len(rows):
        return out
    whole = Overlaps([one[i] for i in rows], [(one if alone else two)[j] for j in columns])
    for low in range(0, len(rows), STRIP):
        at = rows[low : low + STRIP]
        both = whole.strip(low, low + len(at))
        hit = 100 * both >= percent * (n[at][:, None] + m[columns][None] - both)
        out[np.ix_(at, columns)] &= hit
    return out


def heads(hit: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column (one and the same if ``alone``) of a matrix of links the number of the component it is in; columns count on from the rows."""
    n, m = hit.shape
    row, col = np.full(n, -1), np.full(m, -1)
    for i in range(n):
        if row[i] >= 0:
            continue
        row[i], open_ = i, np.array([i])
        while len(open_):
            if alone:
                open_ = np.flatnonzero(hit[open_].any(0) & (row < 0))
                row[open_] = i
            else:
                there = np.flatnonzero(hit[open_].any(0) & (col < 0))
                col[there] = i
                open_ = np.flatnonzero(hit[:, there].any(1) & (row < 0))
                row[open_] = i
    return row, row if alone else np.where(col < 0, n + np.arange(m), col)


def _block_links(members: DataFrame, order, k: int, percent: int) -> DataFrame:
    """(sid, linked, head) of rows of sid, block, copies, packed: how many rows of other sets link with each set, and a set that links lead to.

    Blocks of more than PART_BYTES or PART_SETS are compared as all pairs of parts, in a row for each; small ones go together in a task.
    """
    size = members.groupBy("block").agg(F.greatest(F.ceil(F.sum(F.octet_length("packed")) / PART_BYTES), F.ceil(F.count("*") / PART_SETS)).cast("int").alias("n_parts"))
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = max(partitions, (members.agg(F.sum(F.octet_length("packed"))).first()[0] or 0) // PART_BYTES)
    dealt = members.join(size, "block").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("n_parts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    small = F.col("n_parts") == 1
    dealt = dealt.select("sid", "block", "copies", "packed", "part", F.when(small, F.pmod(F.xxhash64("block"), F.lit(bundles))).otherwise(F.col("block")).alias("bundle"), small.alias("small"), F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"))
    # few bytes but much work: as many tasks as a shuffle has, which aren't coalesced
    dealt = dealt.repartition(partitions, "small", "bundle", "i", "j")

    def work(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = table.sort_by([("block", "ascending"), ("part", "ascending"), ("sid", "ascending")])
        block, part, copies, sid = (rows.column(c).to_numpy() for c in ("block", "part", "copies", "sid"))
        two = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        total, head = np.zeros(len(block), np.int64), sid.copy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            sets = shingle_sets([unpack(x) for x in rows.column("packed").slice(a, b - a).to_pylist()], k)
            c = int(np.searchsorted(part[a:b], part[a], "right")) if two else b - a
            if two and c < b - a:
                hit = links_of(sets[:c], sets[c:], order.value, percent)
                total[a : a + c], total[a + c : b] = hit @ copies[a + c : b], copies[a : a + c] @ hit
                head[a:b] = sid[a:b][np.concatenate(heads(hit, False))]
            elif not two and c > 1:
                hit = links_of(sets, None, order.value, percent)
                total[a:b] = hit @ copies[a:b]
                head[a:b] = sid[a:b][heads(hit, True)[0]]
        some = pa.array(np.flatnonzero(total))
        return pa.table({"sid": pa.array(sid).take(some), "linked": pa.array(total).take(some), "head": pa.array(head).take(some)})

    return dealt.groupBy("small", "bundle", "i", "j").applyInArrow(work, "sid bigint, linked bigint, head bigint")


# ---- Pairs of short lists


def _pairs(short: DataFrame) -> DataFrame:
    """(sid, other, times) of the pairs within lists, sid below other. Equal lists become one first."""
    lists = short.groupBy("token").agg(F.sort_array(F.collect_set("sid")).alias("sids")).groupBy("sids").agg(F.count("*").alias("times"))
    each = lists.select("times", "sids", F.posexplode("sids").alias("i", "sid")).select("times", "sid", F.explode(F.slice("sids", F.col("i") + 2, F.size("sids"))).alias("other"))
    return each.groupBy("sid", "other").agg(F.sum("times").alias("times"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (sid, other) of ``pairs`` that reach the threshold. The partners of one set come in groups of about FAN, its own text with each."""
    fan = pairs.groupBy("sid").agg(F.ceil(F.count("*") / FAN).cast("int").alias("groups"))
    own = fan.join(texts, "sid").select("sid", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("bigint").alias("other"), "packed")
    met = pairs.join(fan, "sid").select("sid", "other", F.pmod(F.xxhash64("other"), F.col("groups")).cast("int").alias("part"))
    met = met.join(texts.withColumnRenamed("sid", "t"), F.col("other") == F.col("t")).select("sid", "part", "other", "packed")

    def work(batches):
        name, mine = None, None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in blocks(batches, "packed", ARRAY_BYTES // 4):
            sid, other = batch.column("sid").to_pylist(), batch.column("other").to_pylist()
            sets = shingle_sets([unpack(x) if x else b"" for x in as_bytes(batch.column("packed"))], k)
            out = []
            for a, b, s in zip(sid, other, sets):
                if b is None:
                    name, mine = a, s
                    continue
                if a != name:
                    raise RuntimeError("a set is missing beside its partners")
                both = np.sort(np.concatenate([mine, s]))
                if linked(len(mine), len(s), int((both[1:] == both[:-1]).sum()), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["sid", "other"])

    both = own.unionByName(met).repartition("sid", "part").sortWithinPartitions("sid", "part", F.col("other").asc_nulls_first())
    return both.mapInArrow(work, "sid bigint, other bigint")


# ---- The join


def _keyed(docs: DataFrame) -> DataFrame:
    return bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))


def _fetched(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, packed): the compressed text of each wanted (sid, tie)."""
    few = wanted.count() <= FEW_SETS
    wanted = wanted.select(F.col("sid").alias("want"), F.col("tie").alias("_tie"))
    near = texts.join(F.broadcast(wanted) if few else wanted, F.col("tie") == F.col("_tie")).select("want", "text")

    def own(batches):
        pack = zstandard.ZstdCompressor().compress
        for batch in blocks(batches, limit=ARRAY_BYTES):
            raw, want = as_bytes(batch.column("text")), batch.column("want").to_pylist()
            keep = {want[i]: i for i, s in enumerate(shingle_sets(batch.column("text"), k)) if len(s) and _name(s) == want[i]}
            yield pa.RecordBatch.from_arrays([pa.array(list(keep), pa.int64()), pa.array([pack(raw[i]) for i in keep.values()], pa.binary())], names=["sid", "packed"])

    return near.mapInArrow(own, "sid bigint, packed binary").groupBy("sid").agg(F.min("packed").alias("packed"))


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, found): rows of doc_id, n, sid; the distinct sets as sid, n, doc (smallest id), copies; and for each set that links with another
    sid, label (of its class) and linked (rows of other sets that it links with)."""
    spark = docs.sparkSession
    texts = _keyed(docs)
    rows = written(_signed(texts, shingle))
    sets = written(rows.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.col("doc_id").cast("bigint")).alias("doc"), F.min("tie").alias("tie"), F.count("*").alias("copies")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, _bits(total, 2 * BUCKET, min(partitions, 1 << 10)))
    order = spark.sparkContext.broadcast(Order.of(_frequencies(texts, shingle, bits), bits))

    bits = min(31, _bits(total // 4, BUCKET, partitions))
    entries = _entries(texts, order, shingle, percent, bits)
    shared = _thinned(written(entries.groupBy("bucket").applyInArrow(_lists(percent), _SHARED)), percent)

    length = shared.groupBy("token").agg(F.count("*").alias("c"), F.min("sid").alias("head"))
    longer = written(length.where(F.col("c") > SHORT).select("token", "head"))
    block = components(shared.join(longer, "token").select(F.col("sid").alias("u"), F.col("head").alias("v")).distinct()).withColumnsRenamed({"v": "sid", "label": "block"})
    block = written(block.distinct())
    known = written(shared.groupBy("sid").agg(F.first("code").alias("code")).join(sets, "sid").join(block, "sid", "left").select("sid", "n", "tie", "copies", "block", F.pow(F.lit(2), F.pmod("code", F.lit(4))).cast("int").alias("factor")))
    full = written(_fetched(texts, known.select("sid", "tie"), shingle))

    small = (F.col("n") * percent + 99) / 100
    matches = F.least(F.floor(small), 1 + F.floor(F.col("n") / PER_MATCH) * F.col("factor"))
    side = lambda a, name: known.select(F.col("sid").alias(name), F.col("n").alias(f"n{a}"), matches.alias(f"l{a}"), F.col("block").alias(f"b{a}"), F.col("copies").alias(f"copies{a}"))
    met = _pairs(shared.join(longer, "token", "left_anti")).join(side(1, "sid"), "sid").join(side(2, "other"), "other")
    met = met.where("times >= least(l1, l2)").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent).where("b1 IS NULL OR b2 IS NULL OR b1 <> b2")
    candidates = written(met.select("sid", "other", "copies1", "copies2"))
    pairs = written(_verified(candidates.select("sid", "other"), full, shingle, percent).join(candidates, ["sid", "other"]))
    blocks_ = written(_block_links(known.where("block IS NOT NULL").join(full, "sid").select("sid", "block", "copies", "packed"), order, shingle, percent))
    edges = pairs.select(F.col("sid").alias("u"), F.col("other").alias("v")).union(blocks_.select(F.col("sid").alias("u"), F.col("head").alias("v")))
    label = components(edges)
    counted = pairs.select("sid", F.col("copies2").alias("linked")).union(pairs.select("other", "copies1")).union(blocks_.select("sid", "linked"))
    found = written(label.join(counted.groupBy("sid").agg(F.sum("linked").alias("linked")), F.col("v") == F.col("sid")).select("sid", "label", "linked"))
    released(shared, longer, block, known, full, candidates, pairs, blocks_)
    order.destroy()
    return rows, sets, found


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie, n_shingles, copy_of (the smallest doc_id with the same set), component_id (the smallest doc_id that links lead to) and n_links (how
    many other rows the row links with, those of the same set among them) of every row. ``tie`` is a hash of the text, which tells rows of one id apart.

    Sets are of distinct ``shingle``-word sequences, A-Z folded; two rows link at a Jaccard similarity of ``percent`` or more. Rows without words, null
    texts among them, have no shingles and are linked with nothing. Every row is judged by its own text, so rows that share a doc_id get a row each;
    ids are integers, and a row with a null id takes the class of its set, which is null if all ids of the class are. Empty tables give no rows.
    Columns other than doc_id and text aren't read. Long texts are taken whole.
    """
    rows, sets, found = joined(docs, shingle, percent)
    met = sets.select("sid", "doc", "copies").join(found, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = found.join(sets.select("sid", "doc"), "sid").groupBy("label").agg(F.min("doc").alias("least"))
    final = met.join(least, "label", "left").select(F.col("sid").alias("s"), F.col("doc").alias("copy_of"), F.when(F.col("linked").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    # a group of equal sets may hold much of the table: its row is spread over salts
    final = final.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int"))
    kind = docs.schema["doc_id"].dataType
    out = rows.join(final, (rows["sid"] == final["s"]) & (rows["salt"] == final["part"]), "left")
    own = lambda c: F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col(c)).cast(kind).alias
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), own("copy_of")("copy_of"), own("component")("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs``, all its columns, with one row of each class: that of the smallest doc_id (null last), then the smallest hash of the text, and one of
    several rows that are equal in both. Rows without words all stay."""
    rows, _, found = joined(docs, shingle, percent)
    classed = rows.where("n > 0").join(found.select("sid", "label"), "sid", "left").select(F.coalesce("label", "sid").alias("label"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie").alias("row"))
    # a class may hold much of the table: rows equal in id and text become one first, with their number
    times = classed.groupBy("label", "row").agg(F.count("*").alias("times"))
    first = times.groupBy("label").agg(F.min("row").alias("first")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    times = times.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    gone, more, own, tie = (free(c, docs) for c in ("_goes", "_again", "_id", "_tie"))
    named = [F.col("row.doc_id").alias(own), F.col("row.tie").alias(tie), (F.col("row") != F.col("first")).alias(gone), (F.col("times") > 1).alias(more)]
    times = written(times.join(first, ["label", "salt"]).select(*named).where(F.col(gone) | F.col(more)))
    # texts go through one shuffle, by the same plan whatever the number of rows that go
    met = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(tie)), "left")
    out = met.where(F.col(gone).isNull()).select(*docs.columns)
    again = F.col(more) & ~F.col(gone)
    if times.where(again).isEmpty():
        return out
    whole = F.struct(*docs.columns)
    one = met.where(again).groupBy(own, tie).agg(F.min_by(whole, F.to_json(whole)).alias("row"))  # the same one on every run
    return out.unionByName(one.select("row.*"))
