"""Statistical outlier removal and isolation of far points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.components import label_vertices
from pointloom.operators.knn import knn_join, radius_edges


def sor_filter(points: DataFrame, k: int = 10, deviations: float = 1.0) -> DataFrame:
    """``points`` whose mean distance to their k nearest others is within so many standard deviations above the mean of those means."""
    mean = knn_join(points, points, k, exclude_self=True).groupBy(F.col("u").alias("_u")).agg(F.avg("dist").alias("_d"))
    limit = mean.agg((F.avg("_d") + F.lit(float(deviations)) * F.stddev_pop("_d")).alias("limit")).first()["limit"]
    if limit is None:
        return points
    return points.join(mean.where(F.col("_d") <= limit), F.col("point_id") == F.col("_u"), "left_semi")


def isolate_gaps(points: DataFrame, max_gap: float = 3.0, k: int = 20, by: str | None = None) -> DataFrame:
    """(point_id, label): parts of the cloud, or of each of ``by``, that no chain of near neighbours closer than ``max_gap`` joins, by their smallest point."""
    edges = radius_edges(knn_join(points, points, k, by=by), max_gap).where("u <> v").select("u", "v")
    return label_vertices(points.select(F.col("point_id").alias("v")), edges).select(F.col("v").alias("point_id"), "label")
