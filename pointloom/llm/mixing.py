"""Mixing sources to target weights with DataFrame functions only.

Words are counted once per document into a narrow table. Per-source totals, a table as long as there are sources, give the targets;
a document is then emitted floor(rate) times, and once more if a hash of it, seeded, is among the smallest of its source and size, with the rate's
fraction as probability.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, free, written

#: Copies of a document, at most, as a multiple of its source.
MOST = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17
#: Bands of sizes go up by a tenth.
STEP = math.log(1.1)


def words(text: Column | str) -> Column:
    """How many words; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df``, written, with ``_rank`` from 1 in that order, without one task that sees all rows.

    Rows are dealt out by range, numbered within each range, and shifted by the sizes of the ranges before; only those sizes, one for each
    partition, meet in a window.
    """
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = part.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return part.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target of rows of source and source_size.

    Sources by code point, null last, take ``weights`` in turn and share the sum of sizes by them. No target exceeds ``most`` times its
    source; what is over goes to the others by weight. That ends where every source below its bound has the same target for each unit of
    weight, a level that rises with each round and bounds one more source at least, until none is above.
    """
    bound = F.col("source_size") * most
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = written(ranked(totals, F.col("source").asc_nulls_last()).withColumn("_weight", turn))
    level = 0.0  # of target for each unit of weight
    while True:
        over = bound <= F.col("_weight") * level
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, bound)).alias("held"), F.sum(F.when(~over, F.col("_weight"))).alias("rest")).first()
        if not row["rest"]:
            break
        new = max(0.0, (row["all"] - (row["held"] or 0.0)) / row["rest"])
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(bound, F.col("_weight") * level).cast("double").alias("target"))


def _drawn(*parts: Column) -> Column:
    """52 bits of a hash of the parts; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def _key(seed: int, text_col: str) -> Column:
    return _drawn(F.lit(str(seed)), F.col("doc_id").cast("string"), F.col(text_col))


def _band(size: Column) -> Column:
    """Sizes of a band differ by a tenth; -1 holds texts without words."""
    return F.when(size > 0, F.floor(F.log(F.greatest(size, F.lit(1))) / STEP + 1e-9)).otherwise(-1).cast("int")


def _rate(most: float) -> Column:
    return F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0.0))


def shares(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """source, source_size, target, band, whole and edge of rows of source, size and key: what decides the copies of each document.

    A document gets ``whole`` copies, and one more if its key is not above ``edge``. A source's rate is its target by its size. Of each band of sizes
    of a source that many documents get the further copy as the rate's fraction asks for, those with the smallest keys; numbers are rounded along the
    bands of a source from a start that depends on seed and source, so that a document's probability is the fraction and a source misses its target
    by little more than a document. The key at the edge is found by counting keys by their upper bits first; only those about the edge are numbered.
    """
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    top = F.shiftright("key", 40)
    counts = written(sized.groupBy("source", _band(F.col("size")).alias("band"), top.alias("top")).agg(F.count("*").alias("n")))
    many = counts.groupBy("source", "band").agg(F.sum("n").alias("n"))
    goal = goal.withColumnRenamed("source", "s")
    many = many.join(goal, many["source"].eqNullSafe(goal["s"])).drop("s").withColumn("rate", _rate(most)).withColumn("whole", F.floor("rate"))
    along = Window.partitionBy("source").orderBy("band")
    start = _drawn(F.lit(str(seed)), F.lit("start"), F.col("source").cast("string")) / F.lit(float(1 << 52))
    # texts without words change nothing: they get the further copy or not as a band of its own
    asked = F.sum((F.col("rate") - F.col("whole")) * F.col("n")).over(along) + start
    many = many.withColumn("upto", F.floor(asked + 1e-9)).withColumn("more", F.least(F.col("n"), F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0))))
    many = written(many.select("source", "band", "source_size", "target", "whole", "more"))
    wanted = many.where("more > 0").select(F.col("source").alias("s"), F.col("band").alias("b"), "more")
    below = F.sum("n").over(Window.partitionBy("source", "band").orderBy("top")) - F.col("n")
    about = counts.withColumn("below", below).join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    about = written(about.where("below < more AND more <= below + n").select("s", "b", F.col("top").alias("t"), (F.col("more") - F.col("below")).alias("rest")))
    near = sized.select("source", _band(F.col("size")).alias("band"), "key").join(about, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (top == F.col("t")))
    edge = near.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("key"))).where("r = rest").select("s", "b", F.col("key").alias("edge"))
    out = many.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")), "left")
    return written(out.select("source", "source_size", "target", "band", "whole", F.coalesce("edge", F.lit(-1)).alias("edge")))


#: Bands of sources that are broadcast; beyond, a salted shuffle join takes over.
BROADCAST, SALTS = 200_000, 16


def _decided(near: DataFrame, share: DataFrame, source: Column, size: Column, key: Column) -> tuple[DataFrame, Column, DataFrame]:
    """``near`` beside the columns of ``share`` for its source and size, the copies, and ``share`` as joined; one source may hold much of it."""
    same = source.eqNullSafe(share["source"]) & (_band(size) == share["band"])
    if share.limit(BROADCAST + 1).count() <= BROADCAST:
        met = near.join(F.broadcast(share), same)
    else:
        share = share.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = near.join(share, source.eqNullSafe(share["source"]) & (_band(size) == share["band"]) & (F.pmod(key, F.lit(SALTS)).cast("int") == share["slot"]))
    return met, (share["whole"] + F.when(key <= share["edge"], 1).otherwise(0)).cast("long"), share


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, copies.

    A null text has size 0 and a null source is a source of its own. Rows are decided by shares() and a hash of seed, doc_id and text, so that reruns
    agree and repeated rows share their fate. A source without words has target 0, and its rows are not taken. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", _key(seed, text_col).alias("key"), F.col(source_col).alias("source"), words(text_col).alias("size")))
    met, copies, share = _decided(sized, shares(sized, weights, most, seed), sized["source"], sized["size"], sized["key"])
    return met.select("doc_id", sized["source"], "size", share["source_size"], share["target"], copies.alias("copies"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, whatever their names, each as often as plan() takes it. Texts aren't shuffled."""
    sized = written(docs.select(_key(seed, text_col).alias("key"), F.col(source_col).alias("source"), words(text_col).alias("size")))
    met, copies, _ = _decided(docs, shares(sized, weights, most, seed), docs[source_col], words(docs[text_col]), _drawn(F.lit(str(seed)), docs["doc_id"].cast("string"), docs[text_col]))
    times = free("copies", docs)
    taken = met.select(*(docs[c] for c in docs.columns), copies.alias(times)).where(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(free("copy", docs))).select(*docs.columns)
