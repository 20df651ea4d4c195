"""Spelling variants: words at one insertion, deletion or replacement of a code point, and the commoner form that each leads to.

The pairs come from a trie joined with itself: going down, each node has the set of active nodes whose prefixes are at distance one of its own, made
from its parent's set, and two ends at distance one are a pair. The vocabulary's trie is partitioned by prefix. So that no partition needs
another's words, a word is cut into stretches: two words at distance one differ within one stretch, and are equal before it and behind it. So words
are dealt by what stands around each of their stretches, and a partition's trie holds that stretch alone. A partition of more than FULL words is
cut further by halving its stretch, down to one code point, where no more words are left than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, blocks, bounded, give_back, released, texts_of, written

#: Fixed value: the letters of words, A-Z being lower-cased.
LETTERS = "a-zÀ-ÿ"
SHORTEST, RAREST = 5, 3
#: Words of a partition before it is cut further.
FULL = 1 << 13
#: Words of up to so many code points have two stretches, longer ones as many as the square root of their length.
TWO = 24
#: Bytes of text whose words a task counts before it passes them on.
COUNTED = 16 << 20


def word_counts(docs: DataFrame, shortest: int = SHORTEST, spoilt: int = 0) -> DataFrame:
    """(word, n): how often each word of at least ``shortest`` code points occurs in all whole texts.

    ``spoilt``: the words of a document whose crc32 with its id is divisible by that lose a code point, as a test of what the grouping finds; 0 for none.
    """
    words = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def work(batches):
        seen, size = Counter(), 0
        for batch in blocks(batches):
            for key, raw in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text"))):
                size += len(raw)
                found = words(raw.lower().decode("utf-8", "replace"))
                if not spoilt:
                    seen.update(found)
                    continue
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % spoilt == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < shortest:
                            continue
                    seen[word] += n
            if size >= COUNTED:
                yield rows(seen)
                seen, size = Counter(), 0
        if seen:
            yield rows(seen)

    keyed = texts_of(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return keyed.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, size, m, start, stop) with the hash of what stands around the stretch. m is the length of the shorter word of a pair; one
    that is longer by one has a stretch that is longer by one."""
    before = F.substring("word", F.lit(1), F.col("start"))
    after = F.substring(F.col("word"), F.col("stop") + F.col("size") - F.col("m") + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("m", "start", "stop", before, after))


def stretches(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(key, m, start, stop, size, word, n): every word by each of its stretches, as the shorter word of a pair and as the longer one."""
    sized = words.withColumn("size", F.char_length("word")).withColumn("m", F.explode(F.array(F.col("size"), F.col("size") - 1))).where(F.col("m") >= shortest)
    many = F.when(F.col("m") <= TWO, F.lit(2)).otherwise(F.ceil(F.sqrt("m")).cast("int"))
    cut = sized.withColumn("each", F.ceil(F.col("m") / many).cast("int"))
    starts = F.sequence(F.lit(0), F.col("m") - 1, F.col("each"))
    cut = cut.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + F.col("each"), F.col("m")))
    return _keyed(cut.drop("each"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("stop"))))
    return _keyed(rows.withColumn("_h", both).withColumn("start", F.col("_h.start")).withColumn("stop", F.col("_h.stop")).drop("_h"))


def trie_pairs(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) of all pieces at distance one, either way round."""
    kids: list[dict[str, int]] = [{}]
    ends: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        at = 0
        for c in piece:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
            at = to
        ends.setdefault(at, []).append(i)
    stack = [(0, set(kids[0].values()))]
    while stack:
        node, active = stack.pop()
        if node in ends:
            for other in active:
                if other in ends:
                    for i in ends[node]:
                        for j in ends[other]:
                            yield i, j
        own = kids[node]
        for c, child in own.items():
            near = {to for q in active if (to := kids[q].get(c)) is not None}  # at distance one already
            near.update(own.values())  # a replaced code point
            near.add(node)  # one that is deleted
            near.update(kids[child].values())  # one that is inserted
            near.discard(child)
            stack.append((child, near))


def _linked(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """(word, near, n of near) of one partition's rows (m, start, stop, word, n)."""
    m, start, stop = rows[0][:3]
    words, counts = [r[3] for r in rows], [r[4] for r in rows]
    pieces = [w[start : stop + len(w) - m] for w in words]
    for i, j in trie_pairs(pieces):
        a, b = words[i], words[j]
        short, long = sorted((pieces[i], pieces[j]), key=len)
        if len(short) == len(long) and len(a) > m or len(short) < len(long) and stop < m and long.startswith(short):
            continue  # that pair belongs to another stretch
        if a[:start] == b[:start] and a[stop + len(a) - m :] == b[stop + len(b) - m :]:
            yield a, b, counts[j]


def near_words(words: DataFrame, shortest: int = SHORTEST, full: int = FULL) -> DataFrame:
    """(word, near, near_n): every pair of ``words`` (word, n; each once) at distance one, both ways."""
    todo, ready = stretches(words, shortest), []
    while True:
        hot = written(todo.groupBy("key").count().where(F.col("count") > full).select("key"))
        if hot.isEmpty():
            ready.append(todo)
            break
        ready.append(todo.join(hot, "key", "left_anti"))
        over = todo.join(hot, "key", "left_semi")
        ready.append(over.where("stop - start <= 1"))
        todo = written(_halved(over.where("stop - start > 1")))
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    columns = ("m", "start", "stop", "word", "n")

    def work(batches):
        held, key = [], None

        def found(groups):
            made = [x for g in groups if len(g) > 1 for x in _linked(g)]
            a, b, n = zip(*made) if made else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        for batch in blocks(batches, "word"):
            groups = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *columns))):
                if k != key:
                    groups.append(held)
                    held, key = [], k
                held.append(row)
            yield found(groups)
        yield found([held])
        give_back()

    dealt = bounded(rows.select("key", *columns)).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows of word and form: what following the forms ends at. Each round doubles the steps; a form is at least twice as frequent as its
    word, so no path has more than 62 steps."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("to"))
        then = written(now.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        released(now)
        now = then
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = 2, spoilt: int = 0) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that occurs ``rarest`` times or more in all texts.

    form: the near word of largest n, the smallest in code-point order among equals, if it is at least ``ratio`` times as frequent; else null, and form_n
    too. root: the word that following the forms ends at, the word itself if it has none. A null or empty text has no words; repeated
    rows count again; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = written(word_counts(docs, shortest, spoilt).where(F.col("n") >= rarest))
    near = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    taken = F.col("best.near_n") >= ratio * F.col("n")
    formed = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("best.near_n")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
