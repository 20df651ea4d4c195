"""The segmentation of clouds in three stages, from points to points with three labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.cutpursuit import cut_pursuits
from pointloom.operators.groups import centroids, dense_labels, mode_label
from pointloom.operators.knn import knn_join, located, nearest_gaps
from pointloom.operators.merge import final_segments
from pointloom.operators.outliers import isolate_gaps
from pointloom.operators.voxels import VOXEL, centered, decimate, label_back, voxelize
from pointloom.params import SegmentationParams
from pointloom.plans.storage import written

LABELS = ("init_segs", "intermediate_segs", "final_segs")


def init_segments(points: DataFrame, params: SegmentationParams | None = None, by: str | None = None) -> DataFrame:
    """(point_id, init): components of the cloud's neighbour graph by position. With ``by``, an integer column, each of its values is a cloud."""
    p = params or SegmentationParams()
    own = written(centered(points.select("cloud_id", "point_id", "x", "y", "z")))
    edges = knn_join(own, own, p.min_nn1, exclude_self=True, by=by).select("u", "v", F.lit(1.0).alias("w"))
    vertices = own.select(F.col("point_id").alias("v"), *([by] if by else []), "x", "y", "z", F.lit(1.0).alias("w"))
    labels, _ = cut_pursuits(vertices, edges, ["x", "y", "z"], p.reg_strength1, p.solver, by)
    return labels.select(F.col("v").alias("point_id"), F.col("comp").alias("init"))


def gap_edges(points: DataFrame, p: SegmentationParams, by: str | None = None) -> DataFrame:
    """(u, v, gap): neighbours whose clusters (init) have a known gap below max_gap; within a cluster it is 0."""
    clusters = centroids(points, ["init", *([by] if by else [])])
    around = knn_join(clusters, clusters, p.min_nn2, ("cx", "cy", "cz"), "init", "init", exclude_self=True, by=by)
    pairs = around.select(F.col("u").alias("ci"), F.col("v").alias("cj")).union(clusters.select(F.col("init").alias("ci"), F.col("init").alias("cj")))
    gaps = written(nearest_gaps(points, pairs, p.max_gap, "init"))
    near = knn_join(points, points, p.min_nn2, exclude_self=True, by=by).select("u", "v")
    label = points.select("point_id", "init")
    one = near.join(label.withColumnsRenamed({"point_id": "u", "init": "ci"}), "u")
    return one.join(label.withColumnsRenamed({"point_id": "v", "init": "cj"}), "v").join(gaps, ["ci", "cj"]).select("u", "v", "gap")


def gap_weight(gap):
    """Ten for touching clusters, falling with the gap in centimetres."""
    return 10.0 / ((gap + 0.01) / 0.01)


def intermediate_segments(points: DataFrame, params: SegmentationParams | None = None, by: str | None = None) -> DataFrame:
    """(point_id, inter): components in the plane, of rows with init. With ``by``, an integer column, each of its values is a cloud."""
    p = params or SegmentationParams()
    own = written(centered(points.select("cloud_id", "point_id", "x", "y", "z", "init")))
    edges = gap_edges(own, p, by).select("u", "v", gap_weight(F.col("gap")).alias("w"))
    vertices = own.select(F.col("point_id").alias("v"), *([by] if by else []), "x", "y", F.lit(1.0).alias("w"))
    labels, _ = cut_pursuits(vertices, edges, ["x", "y"], p.reg_strength2, p.solver, by)
    return labels.select(F.col("v").alias("point_id"), F.col("comp").alias("inter"))


def numbered(points: DataFrame, min_points: int = 0) -> DataFrame:
    """(cloud_id, point_id, x, y, z, and as _cloud and _point the ids that they came with) of points that have a place and an id,
    in clouds of at least ``min_points`` of them.

    The new ids are integers, unique over all clouds, in the order of cloud and id; a cloud's is its smallest point's. Written, so that they hold.
    """
    plain = points.where(located(list("xyz")) & F.col("point_id").isNotNull()).select(F.col("cloud_id").alias("_cloud"), F.col("point_id").alias("_point"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    order = plain.repartitionByRange("_cloud", "_point").sortWithinPartitions("_cloud", "_point")
    own = written(order.withColumn("point_id", F.monotonically_increasing_id()))
    first = own.groupBy(F.col("_cloud").alias("_c")).agg(F.min("point_id").alias("cloud_id"), F.count("*").alias("_n")).where(F.col("_n") >= min_points).drop("_n")
    return written(own.join(first, F.col("_cloud").eqNullSafe(F.col("_c"))).drop("_c"))


def segment(points: DataFrame, params: SegmentationParams | None = None) -> DataFrame:
    """``points`` of any number of clouds (cloud_id, point_id, x, y, z and any others) with init_segs, intermediate_segs and final_segs, int, from 0 in each cloud.

    All clouds go through the same jobs, whose number doesn't depend on theirs. Every input row comes back once, point_id being unique in a cloud; a row with a
    null, NaN or infinite coordinate, or without an id, has null labels and counts for nothing. An empty table gives no rows; fewer points than neighbours
    are asked for, or all at one place, are one segment, unless ``min_points`` skips such clouds, whose labels are null then. Labels are computed on decimated points and carried back through voxels; other columns
    pass unchanged.
    """
    p, by = params or SegmentationParams(), "cloud_id"
    own = numbered(points, p.min_points)
    plain = own.select("cloud_id", "point_id", "x", "y", "z")
    fine = written(voxelize(plain, p.decimate_res1, p.origin))
    coarse = written(voxelize(plain, p.decimate_res2, p.origin))
    small = written(decimate(fine))
    init = written(init_segments(small, p, by))
    labelled = label_back(fine.select("cloud_id", "point_id", *VOXEL), small.join(init, "point_id"), "init").select("cloud_id", "point_id", "init")
    labelled = written(labelled)
    large = written(decimate(coarse).join(labelled.drop("cloud_id"), "point_id"))
    inter = written(intermediate_segments(large, p, by))
    by_point = label_back(coarse.select("cloud_id", "point_id", *VOXEL), large.join(inter, "point_id"), "inter").select("point_id", "inter")
    by_point = written(by_point)
    both = small.select("cloud_id", "point_id", "x", "y", "z").join(init, "point_id").join(by_point, "point_id")
    if p.cluster_label == "mode":
        both = both.drop("inter").join(mode_label(both, ["init"], "inter"), "init")
    final = written(final_segments(both, p, by=by))
    out = labelled.join(by_point, "point_id").join(final, "init")
    if p.isolate_outliers:
        apart = label_back(fine.select("cloud_id", "point_id", *VOXEL), small.join(isolate_gaps(small, p.outlier_gap, by=by), "point_id").withColumnRenamed("label", "_part"), "_part").select("point_id", "_part")
        out = dense_labels(out.join(apart, "point_id").withColumn("_both", F.struct("final", "_part")), "_both", name="final").drop("_both", "_part")
    out = dense_labels(dense_labels(out, "init", name=LABELS[0]), "inter", name=LABELS[1])
    labels = out.select("point_id", LABELS[0], LABELS[1], F.col("final").cast("int").alias(LABELS[2])).join(own.select("point_id", "_cloud", "_point"), "point_id").drop("point_id")
    return points.join(labels, points["cloud_id"].eqNullSafe(F.col("_cloud")) & (points["point_id"] == F.col("_point")), "left").drop("_cloud", "_point")
