"""Aggregates of groups of points, as the segmentation needs them. ``by`` names the group's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.voxels import AXES
from pointloom.plans.storage import released, written


def centroids(points: DataFrame, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    return points.groupBy(*by).agg(*(F.avg(a).alias(f"c{a}") for a in axes))


def first_label(points: DataFrame, by: list[str], label: str, order: str = "point_id") -> DataFrame:
    """The label of the group's first point."""
    return points.groupBy(*by).agg(F.min_by(label, order).alias(label))


def sizes(points: DataFrame, by: list[str]) -> DataFrame:
    """(n): how many rows each group has."""
    return points.groupBy(*by).agg(F.count("*").alias("n"))


def extents(points: DataFrame, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """(n, min_x, max_x, ...) of each group; without columns to group by, of all rows."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``others``."""
    return df.join(others.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't among ``others``."""
    return df.join(others.select(key).distinct(), key, "left_anti")


def mode_label(points: DataFrame, by: list[str], label: str) -> DataFrame:
    """The commonest label, the smallest among equals; counted first, so a large group meets as one row a label."""
    counts = points.groupBy(*by, label).count()
    return counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias(label))


def elevation_length(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.min("z").alias("elev"), (F.max("z") - F.min("z")).alias("len"))


#: Distinct values of a group that are ranked in one task, and stretches that more of them are counted in.
RANKED, STRETCHES = 1 << 16, 1 << 10


def _beside(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row for each key; null keys meet too."""
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]).drop(*(f"_k{i}" for i in range(len(key))))


def _narrowed(values: DataFrame, todo: DataFrame, key: list[str]) -> DataFrame:
    """``todo`` with each group's band cut to the stretch that has the wanted ranks; with their values where two stretches have them, or one value alone."""
    band = _beside(values, todo.select(*key, "lo", "hi"), key).where("value BETWEEN lo AND hi")
    share = F.try_divide(F.col("value") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)  # halved, lest the difference overflows
    stretch = F.least(F.floor(F.coalesce(share, (F.col("value") > F.col("lo")).cast("double")) * STRETCHES), F.lit(STRETCHES - 1))
    counts = band.groupBy(*key, stretch.alias("_s")).agg(F.sum("m").alias("c"), F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*key).orderBy("_s")))
    both = _beside(upto, todo.select(*key, "place", "k1", "k2", "below"), key).withColumn("from", F.col("below") + F.col("upto") - F.col("c"))
    of = lambda k, c: F.max(F.when((F.col("from") <= F.col(k)) & (F.col(k) < F.col("from") + F.col("c")), F.col(c)))
    each = both.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("place", "k1", "k2")), of("k1", "from").alias("below"), of("k1", "lo").alias("lo"), of("k1", "hi").alias("hi"), of("k1", "d").alias("distinct"), of("k2", "lo").alias("_lo2"))
    apart, alone = F.col("lo") < F.col("_lo2"), F.col("distinct") == 1
    return each.withColumn("v1", F.when(apart | alone, F.col("hi"))).withColumn("v2", F.when(apart, F.col("_lo2")).when(alone, F.col("hi"))).drop("_lo2")


def quantiles(points: DataFrame, by: list[str], share: float, axes: tuple[str, ...] = AXES, name: str = "q") -> DataFrame:
    """Exact interpolated quantiles (name_axis) of each group, by selection: count, narrow, repeat.

    Equal values are one row with a count. While a group has more than RANKED distinct values between its bounds, they are counted in STRETCHES equal
    stretches, and the one that has the wanted ranks is the next band. Nulls and numbers that aren't finite don't count; a group of nothing else has no row.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    key = [*by, "axis"]
    long = points.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes))).alias("_a")).select(*by, "_a.axis", "_a.value")
    values = written(long.where("abs(value) < double('infinity')").groupBy(*key, "value").agg(F.count("*").alias("m")))
    place, none = F.lit(share) * (F.sum("m") - 1), F.lit(None).cast("double")
    todo = values.groupBy(*key).agg(place.alias("place"), F.floor(place).alias("k1"), F.ceil(place).alias("k2"), F.lit(0).cast("bigint").alias("below"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("distinct"))
    todo = written(todo.withColumn("v1", none).withColumn("v2", none))
    large = F.col("v1").isNull() & (F.col("distinct") > RANKED)
    while not todo.where(large).isEmpty():
        last, todo = todo, written(_narrowed(values, todo.where(large), key).unionByName(todo.where(~large)))
        released(last)
    band = _beside(values, todo.where("v1 IS NULL").drop("v1", "v2", "distinct"), key).where("value BETWEEN lo AND hi")
    ranked = band.withColumn("upto", F.col("below") + F.sum("m").over(Window.partitionBy(*key).orderBy("value")))
    first = lambda k: F.min(F.when(F.col("upto") > F.col(k), F.col("value")))
    found = ranked.groupBy(*key).agg(F.first("place").alias("place"), first("k1").alias("v1"), first("k2").alias("v2"))
    found = found.unionByName(todo.where("v1 IS NOT NULL").select(*key, "place", "v1", "v2"))
    part = F.col("place") - F.floor("place")
    each = found.withColumn("q", (1 - part) * F.col("v1") + part * F.col("v2"))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("axis") == a, F.col("q"))).alias(f"{name}_{a}") for a in axes))


def medians(points: DataFrame, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Exact interpolated medians (med_axis) of each group."""
    return quantiles(points, by, 0.5, axes, "med")


def widest_axis(points: DataFrame, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """(axis): the number of the axis of the largest population variance, the first among equals."""
    spread = points.groupBy(*by).agg(*(F.var_pop(a).alias(f"_v{i}") for i, a in enumerate(axes)))
    best = F.greatest(*(F.col(f"_v{i}") for i in range(len(axes)))) if len(axes) > 1 else F.col("_v0")
    pick: Column = F.lit(len(axes) - 1)
    for i in reversed(range(len(axes) - 1)):
        pick = F.when(F.col(f"_v{i}") == best, i).otherwise(pick)
    return spread.select(*by, pick.alias("axis"))


def trimmed_means(points: DataFrame, by: list[str], percent: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Means without the k smallest and k largest values of each axis, k the share percent / 200 of the group, rounded half to even.

    Only values beyond approximate quantiles well inside of the trimmed ones are ranked, so of a large group few rows meet in a task.
    """
    if not 0 <= percent < 100:
        raise ValueError("percent must be from 0 to below 100")
    share = percent / 200
    inner = min(0.5, 2 * share + 0.005)
    long = points.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes))).alias("_a")).select(*by, "_a.axis", "_a.value")
    key = [*by, "axis"]
    stats = long.groupBy(*key).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.percentile_approx("value", [inner, 1 - inner], 10_000).alias("q"))
    stats = stats.withColumn("k", F.bround(F.col("n") * share, 0).cast("long"))
    # groups of up to a thousand rows are ranked whole
    tails = long.join(stats.where("k > 0").select(*key, "k", "q", "n"), key)
    below = tails.where("n <= 1000 OR value <= q[0]").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("value"))).where("r <= k").groupBy(*key).agg(F.sum("value").alias("low"))
    above = tails.where("n <= 1000 OR value >= q[1]").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value")))).where("r <= k").groupBy(*key).agg(F.sum("value").alias("high"))
    mean = (F.col("total") - F.coalesce("low", F.lit(0.0)) - F.coalesce("high", F.lit(0.0))) / (F.col("n") - 2 * F.col("k"))
    each = stats.join(below, key, "left").join(above, key, "left").withColumn("mean", mean)
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("axis") == a, F.col("mean"))).alias(f"trim_{a}") for a in axes))


def dense_labels(df: DataFrame, label: str, by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """``df`` with labels renumbered 0, 1, ... by value in each cloud. Rows with a null label or cloud are left out.

    Distinct labels are sorted by ranges over all tasks, and written, so that the ranges hold. A label's number is its place in its range, after as many as its
    cloud has in the ranges before: no task sees more of a cloud than a range, and one row for each of its ranges.
    """
    by, name = by or ["cloud_id"], name or label
    keys = [f"_b{i}" for i in range(len(by))]
    distinct = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(label).alias("_l")).dropna().distinct()
    ranges = distinct.repartitionByRange(*keys, "_l").sortWithinPartitions(*keys, "_l")
    # the upper bits of such an id are the range's number
    rows = written(ranges.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    counts = rows.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    start = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")
    ranks = rows.join(start, [*keys, "_range"]).select(*keys, "_l", (F.col("_id") - F.col("_first") + F.col("_before")).cast("int").alias("_dense"))
    met = [*(F.col(b) == F.col(k) for b, k in zip(by, keys)), F.col(label) == F.col("_l")]
    return df.join(ranks, met).withColumn(name, F.col("_dense")).drop("_l", "_dense", *keys)


# ---- Of weighted vertices: (comp, o1..oD, w)


def weighted_means(vertices: DataFrame, by: list[str], obs: list[str], w: str = "w") -> DataFrame:
    """Weighted means; zero where the weights sum to 0."""
    total = F.sum(w)
    return vertices.groupBy(*by).agg(*(F.when(total == 0, 0.0).otherwise(F.sum(F.col(w) * F.col(o)) / F.when(total == 0, 1).otherwise(total)).alias(f"m_{o}") for o in obs))


def two_centers(vertices: DataFrame, obs: list[str], by: str = "comp", side: str = "side", w: str = "w") -> DataFrame:
    """For each component the weighted means of its vertices on either side; saturated if a side is empty."""
    on = lambda s: F.when(F.col(side) == s, F.col(w))
    cols = []
    for s, tag in ((False, "a"), (True, "b")):
        total = F.sum(on(s))
        cols += [F.when(total > 0, F.sum(F.when(F.col(side) == s, F.col(w) * F.col(o))) / F.when(total > 0, total)).alias(f"{tag}_{o}") for o in obs]
    empty = (F.coalesce(F.sum(on(False)), F.lit(0.0)) == 0) | (F.coalesce(F.sum(on(True)), F.lit(0.0)) == 0)
    return vertices.groupBy(by).agg(*cols, empty.alias("saturated"))


def fidelity(vertices: DataFrame, obs: list[str], values: list[str], w: str = "w") -> DataFrame:
    """One row: half the weighted squared distance of observations from values."""
    square = sum((F.col(o) - F.col(v)) * (F.col(o) - F.col(v)) for o, v in zip(obs, values))
    return vertices.agg((F.lit(0.5) * F.sum(F.col(w) * square)).alias("fidelity"))


def penalty(edges: DataFrame, labels: DataFrame, reg: float, label: str = "comp") -> DataFrame:
    """One row: reg times the weight of edges (u, v, w) between components."""
    return crossing(edges, labels, label).agg((F.lit(float(reg)) * F.coalesce(F.sum("w"), F.lit(0.0))).alias("penalty"))


def crossing(edges: DataFrame, labels: DataFrame, label: str = "comp") -> DataFrame:
    """Edges whose ends have different labels, with both: lu, lv."""
    a = labels.select(F.col("v").alias("_u"), F.col(label).alias("lu"))
    b = labels.select(F.col("v").alias("_v"), F.col(label).alias("lv"))
    return edges.join(a, F.col("u") == F.col("_u")).join(b, F.col("v") == F.col("_v")).where("lu <> lv").drop("_u", "_v")


def border_weights(edges: DataFrame, labels: DataFrame, label: str = "comp") -> DataFrame:
    """(ca, cb, weight): half the weight of the edges between two components, listed in both directions or not."""
    return crossing(edges, labels, label).groupBy(F.least("lu", "lv").alias("ca"), F.greatest("lu", "lv").alias("cb")).agg((F.sum("w") * 0.5).alias("weight"))


def symmetrized(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *(c for c in edges.columns if c not in ("u", "v"))))
