"""Merging segments that are parts of one object, by scores of pairs, in passes over whole tables.

A pass takes a snapshot: features of all groups, which of them look like hanging parts, and for each of those the best of the nearest
other groups. Targets don't move within a pass, so it is one set-based update whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.groups import centroids, dense_labels, elevation_length, first_label, members, trimmed_means, without
from pointloom.operators.hulls import hull_overlap, hulls
from pointloom.operators.knn import distance, knn_join
from pointloom.params import SegmentationParams
from pointloom.plans.storage import written


def vertical_overlap(elev_a: Column, len_a: Column, elev_b: Column, len_b: Column) -> Column:
    """The smaller over the larger of the two distances from one's top to the other's foot; 0 if apart or both are flat on one level."""
    one, two = elev_b + len_b - elev_a, elev_a + len_a - elev_b
    low, high = F.least(one, two), F.greatest(one, two)
    return F.when((high == 0) | (low <= 0), F.lit(0.0)).otherwise(low / F.when(high != 0, high))


def merge_score(h: Column, v: Column, d3: Column, d2: Column, sigma: Column, weight: float) -> Column:
    """exp of minus the squared lacks of overlap and the squared relative distance; without a scale, only distance 0 is near."""
    near = F.least(d3, d2)
    far = F.when(sigma > 0, (near / F.when(sigma > 0, sigma)) ** 2).otherwise(F.when(near == 0, 0.0).otherwise(F.lit(1e9)))
    return F.exp(-((1 - h) ** 2) - F.lit(weight) * (1 - v) ** 2 - far)


def group_features(points: DataFrame, p: SegmentationParams) -> DataFrame:
    """(g, fx, fy, fz, elev, len, hx, hy) of rows of g, x, y, z."""
    trimmed = trimmed_means(points, ["g"], p.trim_percent).withColumnsRenamed({"trim_x": "fx", "trim_y": "fy", "trim_z": "fz"})
    return trimmed.join(elevation_length(points, ["g"]), "g").join(hulls(points, "g"), "g")


def nearest_scale(near: DataFrame) -> DataFrame:
    """(sigma): the mean distance of groups from the nearest other one, of rows of u, v, dist."""
    return near.where("u <> v").groupBy("u").agg(F.min("dist").alias("d")).agg(F.avg("d").alias("sigma"))


def stem_flags(features: DataFrame, near: DataFrame, p: SegmentationParams) -> DataFrame:
    """``features`` with flagged (its foot is high over its neighbours' for its length) and long (it is much longer than they are, by the median).

    ``near``: (u, v) of each group and its neighbours, itself among them. A flat group over others is flagged and short.
    """
    other = features.select(F.col("g").alias("v"), F.col("elev").alias("e"), F.col("len").alias("l"))
    around = near.select("u", "v").join(other, "v").groupBy("u").agg(F.min("e").alias("low"), F.percentile("l", 0.5).alias("mid"))
    rise = F.abs(F.col("elev") - F.col("low"))
    flagged = F.when(F.col("len") > 0, rise / F.when(F.col("len") > 0, F.col("len")) > p.rel_height_length_ratio).otherwise(rise > 0)
    long = F.when(F.col("mid") > 0, F.col("len") / F.when(F.col("mid") > 0, F.col("mid")) > p.long_stem_ratio).otherwise(F.col("len") > 0)
    return features.join(around, F.col("g") == F.col("u")).withColumn("flagged", flagged).withColumn("long", F.col("flagged") & long).drop("u", "low", "mid")


def best_candidates(pairs: DataFrame, ratio: float) -> DataFrame:
    """Of each a's scored pairs (a, b, d3, score) the nearest by d3 among those that score above ``ratio`` of the best; none if the best is 0."""
    best = pairs.groupBy("a").agg(F.max("score").alias("top"))
    good = pairs.join(best, "a").where((F.col("top") > 0) & (F.col("score") > F.col("top") * ratio))
    return good.groupBy("a").agg(F.min_by("b", F.struct(F.col("d3"), -F.col("score"), F.col("b"))).alias("b"))


def centroid_gaps(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, d3): the smallest distance between centroids of the clusters of two groups."""
    one = clusters.select(F.col("g").alias("a"), *(F.col(f"c{x}").alias(f"_a{x}") for x in "xyz"))
    two = clusters.select(F.col("g").alias("b"), *(F.col(f"c{x}").alias(f"_b{x}") for x in "xyz"))
    d = distance([F.col(f"_a{x}") for x in "xyz"], [F.col(f"_b{x}") for x in "xyz"])
    return pairs.select("a", "b").join(one, "a").join(two, "b").groupBy("a", "b").agg(F.min(d).alias("d3"))


def merge_pass(points: DataFrame, clusters: DataFrame, p: SegmentationParams, first: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One pass over points (cloud, init, x, y, z) and clusters (cloud, init, cx, cy, cz, g) of any number of clouds; init and g are of one cloud each.

    Returns the clusters with new g, how many groups were to merge in each cloud (cloud, n), the groups that stayed as targets (g) and the features.
    """
    whose = clusters.select("g", "cloud").distinct()
    grouped = points.join(clusters.select("init", "g"), "init").select("g", "x", "y", "z")
    features = written(group_features(grouped, p).join(whose, "g"))
    flat = ("fx", "fy")
    near = written(knn_join(features, features, p.min_nn3, flat, "g", "g", by="cloud"))
    apart = near.where("u <> v").groupBy(F.col("u").alias("g")).agg(F.min("dist").alias("d"))
    scale = apart.join(whose, "g").groupBy("cloud").agg(F.avg("d").alias("sigma"))
    flags = written(stem_flags(features, near, p))
    count = lambda c: F.sum(F.col(c).cast("long"))
    counts = flags.groupBy("cloud").agg(F.max("long").alias("any_long"), count("long").alias("n_long"), count("flagged").alias("n_flagged"), F.sum((~F.col("flagged")).cast("long")).alias("n_stay"))
    only_long = F.col("any_long") if first else F.lit(False)
    counts = written(counts.select("cloud", only_long.alias("only_long"), F.when(F.col("n_stay") == 0, 0).when(only_long, F.col("n_long")).otherwise(F.col("n_flagged")).alias("n")).join(scale, "cloud", "left"))
    staying = flags.where("NOT flagged")
    going = flags.join(counts.where("n > 0").select("cloud", "only_long"), "cloud").where(F.when(F.col("only_long"), F.col("long")).otherwise(F.col("flagged")))
    if counts.where("n > 0").isEmpty():
        return clusters, counts.select("cloud", "n"), staying.select("g"), features
    pairs = written(knn_join(going, staying, p.min_nn3, flat, "g", "g", by="cloud").select(F.col("u").alias("a"), F.col("v").alias("b")))
    mean = centroids(clusters.withColumnsRenamed({f"c{x}": x for x in "xyz"}), ["g"])
    a = features.join(mean, "g").select(*(F.col(c).alias(f"{c}_a") for c in ("g", "cloud", "elev", "len", "hx", "hy", "cx", "cy")))
    b = features.join(mean, "g").select(*(F.col(c).alias(f"{c}_b") for c in ("g", "elev", "len", "hx", "hy", "cx", "cy")))
    both = centroid_gaps(pairs, clusters).join(a, F.col("a") == F.col("g_a")).join(b, F.col("b") == F.col("g_b")).join(counts.select(F.col("cloud").alias("cloud_a"), "sigma"), "cloud_a")
    both = both.withColumn("h", hull_overlap("hx_a", "hy_a", "hx_b", "hy_b", "lattice", p.raster_scale))
    both = both.withColumn("v", vertical_overlap(*(F.col(c) for c in ("elev_a", "len_a", "elev_b", "len_b"))))
    both = both.withColumn("d2", distance([F.col("cx_a"), F.col("cy_a")], [F.col("cx_b"), F.col("cy_b")]))
    scored = both.withColumn("score", merge_score(F.col("h"), F.col("v"), F.col("d3"), F.col("d2"), F.coalesce("sigma", F.lit(0.0)), p.vertical_weight))
    chosen = best_candidates(scored.select("a", "b", "d3", "score"), p.score_candidate_ratio)
    moved = clusters.join(chosen, F.col("g") == F.col("a"), "left").withColumn("g", F.coalesce("b", "g")).select(*clusters.columns)
    return written(moved), counts.select("cloud", "n"), staying.select("g"), features


def final_segments(points: DataFrame, params: SegmentationParams | None = None, max_passes: int = 100, by: str | None = None) -> DataFrame:
    """(init, final): the final label of each first-stage cluster, from 0, of rows of point_id, x, y, z, init and inter.

    With ``by``, an integer column of points, its values are clouds of their own, whose labels init and inter differ; passes are shared by all clouds, and each
    cloud ends by itself. Passes go on while groups are to merge and their number changes; that this doesn't end is an error. Groups of the last
    pass that never were targets then join the nearest of those that were.
    """
    p = params or SegmentationParams()
    cloud = (F.col(by) if by else F.lit(0)).cast("bigint").alias("cloud")
    points = written(points.select("point_id", cloud, "x", "y", "z", "init", "inter"))
    labels = first_label(points, ["init"], "inter").withColumnRenamed("inter", "g").join(points.groupBy("init").agg(F.min("cloud").alias("cloud")), "init")
    clusters = written(centroids(points, ["init"]).join(labels, "init"))
    open_ = points.select("cloud").distinct().withColumn("before", F.lit(-1).cast("bigint"))
    targets, ended, last = None, [], []
    for number in range(max_passes):
        # clouds of one group, or none, are done
        many = written(clusters.groupBy("cloud").agg(F.countDistinct("g").alias("groups")).join(open_, "cloud"))
        ended.append(members(clusters, many.where("groups < 2"), "cloud"))
        open_ = many.where("groups > 1").select("cloud", "before")
        if open_.isEmpty():
            break
        clusters = members(clusters, open_, "cloud")
        clusters, counts, staying, features = merge_pass(members(points, open_, "cloud"), clusters, p, number == 0)
        targets = written(staying if targets is None else targets.union(staying).distinct())
        now = written(counts.join(open_, "cloud").withColumn("over", (F.col("n") == 0) | (F.col("n") == F.col("before"))))
        ended.append(members(clusters, now.where("over"), "cloud"))
        last.append(members(features, now.where("over"), "cloud"))
        open_ = now.where("NOT over").select("cloud", F.col("n").alias("before"))
        clusters = members(clusters, open_, "cloud")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("merging didn't settle")
    every = _united(ended)
    if last:
        every, now = written(every), every.select("g").distinct()
        left = without(now, targets, "g")
        if not left.isEmpty():
            features = members(_united(last), now, "g")
            pairs = knn_join(members(features, left, "g"), members(features, targets, "g"), p.min_nn3, ("fx", "fy"), "g", "g", by="cloud")
            near = centroid_gaps(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")), every)
            to = near.groupBy("a").agg(F.min_by("b", F.struct("d3", "b")).alias("b"))
            every = every.join(to, F.col("g") == F.col("a"), "left").withColumn("g", F.coalesce("b", "g")).select(*every.columns)
    return dense_labels(every, "g", ["cloud"], "final").select("init", "final")


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
