"""Centring, voxel decimation and carrying voxel labels back to points.

Points are rows of cloud_id, point_id (unique in the cloud), x, y, z and any other columns. Every cloud is worked on apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
VOXEL = ("_vx", "_vy", "_vz")


def _with_stats(df: DataFrame, *aggs: Column, by: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    """``df`` with aggregates of each cloud. Partial sums meet, one row a cloud, and are joined back; no cloud's points do."""
    stats = df.groupBy(*by).agg(*aggs)
    return df.join(stats, list(by))


def centered(df: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Each axis less its mean in the cloud."""
    out = _with_stats(df, *(F.avg(a).alias(f"_m_{a}") for a in axes))
    return out.withColumns({a: F.col(a) - F.col(f"_m_{a}") for a in axes}).drop(*(f"_m_{a}" for a in axes)).select(*df.columns)


def min_shifted(df: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Each axis less its minimum in the cloud."""
    out = _with_stats(df, *(F.min(a).alias(f"_m_{a}") for a in axes))
    return out.withColumns({a: F.col(a) - F.col(f"_m_{a}") for a in axes}).select(*df.columns)


def voxelize(df: DataFrame, res: float, origin: str = "mean") -> DataFrame:
    """``df`` with its voxel. ``origin``: mean, min or zero of the cloud."""
    if origin == "zero":
        return df.withColumns({v: F.floor(F.col(a) / res) for v, a in zip(VOXEL, AXES)})
    f = F.avg if origin == "mean" else F.min
    out = _with_stats(df, *(f(a).alias(f"_o_{a}") for a in AXES))
    return out.withColumns({v: F.floor((F.col(a) - F.col(f"_o_{a}")) / res) for v, a in zip(VOXEL, AXES)}).drop(*(f"_o_{a}" for a in AXES))


def decimate(voxels: DataFrame) -> DataFrame:
    """Of each voxel the row with the smallest point_id, of rows of voxelize()."""
    rest = [c for c in voxels.columns if c not in ("cloud_id", *VOXEL)]
    best = voxels.groupBy("cloud_id", *VOXEL).agg(F.min_by(F.struct(*rest), "point_id").alias("_r"))
    return best.select("cloud_id", *VOXEL, "_r.*")


def label_back(voxels: DataFrame, labels: DataFrame, *names: str) -> DataFrame:
    """``voxels`` with label columns of their voxel, of rows of cloud_id, the voxel and the labels."""
    return voxels.join(labels.select("cloud_id", *VOXEL, *names), ["cloud_id", *VOXEL])
