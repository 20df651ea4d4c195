"""Document fingerprints with DataFrame functions only: bottom-k sketches of hashed word shingles.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a document's shingles of five words (a document of fewer
words is one shingle, one without words has none). The sketch of a union is the bottom k of the sketches' union, so parts merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import texts_of

K, SHINGLE = 128, 5
#: Bytes of text in a range of ids, about, and ranges at most.
RANGE_BYTES, RANGES = 4 << 20, 50_000


# ---- Sketches as expressions


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, n: int) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n))))
    return F.when(F.size(words) >= n, each).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketched(df: DataFrame, text: str, name: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text column. Words and shingles are columns of their own on the way, computed once a row."""
    w, s = f"__w_{name}", f"__s_{name}"
    return df.withColumn(w, _word_hashes(F.col(text))).withColumn(s, _shingles(F.col(w), n)).withColumn(name, bottom(F.col(s), k)).drop(w, s)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the merged sketch that both have; 1 for two empty sketches."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct(a: Column, k: int = K) -> Column:
    """About how many distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """About which share of a's shingles b has; 1 where a is empty."""
    size = distinct(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct(merge(a, b, k), k) / F.greatest(size, F.lit(1.0))))


def merged(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch a group, of any number of sketches: only the k smallest hashes of a group leave each task."""
    each = df.select(*by, F.explode(sketch).alias("__h")).distinct()
    best = each.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars and the sketch (fingerprint) of every whole text; a null text counts as empty."""
    return sketched(texts_of(docs), "text", "fingerprint", k).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


# ---- Each document beside the one after it


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie below; two short searches instead of one long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values, x: F.size(F.filter(values, lambda b: b < x))
    first = F.greatest(below(F.array(*(F.lit(r[0]) for r in rows)), doc_id) - 1, F.lit(0))
    row = F.get(F.array(*(F.array(*map(F.lit, r)) for r in rows)), first)
    return first * step + below(row, doc_id)


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, next_text, fingerprint, next_fingerprint: the next document by ascending doc_id, after the last the first.

    ``docs`` has doc_id (an integer or null; nulls come last) and text (not null). Rows of one id follow each other by a hash of the text.
    Ranges of ids of about equal bytes are sorted apart. The first row of each range is also sent to the range before, so no task needs all rows
    and each text is shuffled once.
    """
    order = (F.col("doc_id").asc_nulls_last(), F.col("__tie"), F.col("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(RANGES, max(1, total // RANGE_BYTES)))
    bounds: list[int] = []
    if n > 1:
        bounds = sorted({int(b) for b in docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] or []})
    last = len(bounds) + 1  # null ids come after it, in 128 ranges by hash
    dealt = docs.withColumn("__tie", F.xxhash64("text")).withColumn("__range", F.when(F.col("doc_id").isNull(), F.shiftright("__tie", 57) + last + 64).otherwise(_range_of(F.col("doc_id"), bounds)).cast("int"))
    # One row for each range at most, RANGES + 130 in all.
    heads = dealt.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__tie")).alias("h")).select("__range", F.col("h.doc_id").alias("__id"), F.col("h.__tie").alias("__t"))
    around = Window.orderBy("__range")
    ahead = heads.withColumn("__to", F.coalesce(F.lag("__range").over(around), F.max("__range").over(Window.partitionBy())))
    ahead = ahead.select("__id", "__t", "__to")
    first = dealt.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__t")))
    first = first.groupBy("__to").agg(F.min("text").alias("text")).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(None).cast("bigint").alias("__tie"), F.col("__to").alias("__range"), F.lit(True).alias("__after"))
    rows = dealt.withColumn("__after", F.lit(False)).unionByName(first).repartition(max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "__range")
    rows = sketched(rows, "text", "fingerprint", k)
    w = Window.partitionBy("__range").orderBy("__after", *order)
    both = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w))
    return both.where(~F.col("__after")).select("doc_id", "text", "next_text", "fingerprint", "next_fingerprint")


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text beside its edited text, whose last half of the code points is replaced by as many first ones of the next document.

    Returns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint (array<bigint>), near_edited and near_next. A null text counts as
    empty; a single document is its own next; empty tables give no rows; very long texts are sketched whole.
    """
    rows = with_next(texts_of(docs), k).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = sketched(rows, "edited", "edited_fingerprint", k)
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", resemblance(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"), resemblance(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"))


def digest(compared: DataFrame) -> DataFrame:
    said = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), said("fingerprint"), said("edited_fingerprint"), "near_edited", "near_next")
