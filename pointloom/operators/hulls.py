"""Convex hulls of groups and their overlap, as DataFrame operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import convex_hull, overlap_ratio


def hulls(points: DataFrame, by: str, box: bool = True) -> DataFrame:
    """(by, hx, hy): the corners of each group's convex hull in the x, y plane, counter-clockwise.

    A hull of hulls is the hull, so each batch sends on the corners of its groups only, whatever their size. ``box``: groups on one line get the
    corners of their bounding box instead, once all their corners are known.
    """
    kind = points.schema[by].dataType.simpleString()

    def corners(batches):
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(by, sort=False, dropna=False):
                p = g[["x", "y"]].to_numpy(float)
                h = convex_hull(p)
                q = np.unique(p, axis=0)
                # corners of a line's box need not be points of the group; its ends are
                keep = h if len(h) > 2 and _cornered(h, q) else q[[0, -1]] if len(q) > 1 else q
                out.append(pd.DataFrame({by: key, "x": keep[:, 0], "y": keep[:, 1]}))
            if out:
                yield pd.concat(out)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        h = convex_hull(p)
        if not box and not _cornered(h, np.unique(p, axis=0)):
            h = np.unique(p, axis=0)[[0, -1]]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "hx": [h[:, 0].tolist()], "hy": [h[:, 1].tolist()]})

    part = points.select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(corners, f"{by} {kind}, x double, y double")
    return part.groupBy(by).applyInPandas(whole, f"{by} {kind}, hx array<double>, hy array<double>")


def _cornered(hull: np.ndarray, points: np.ndarray) -> bool:
    """Whether all corners are points, which isn't so for the box of a line."""
    have = {tuple(p) for p in points.tolist()}
    return len(points) > 2 and all(tuple(c) in have for c in hull.tolist())


def _edges(x: Column, y: Column, low_x: Column, low_y: Column, scale: float) -> Column:
    """The sides of a polygon that aren't level, moved and scaled: where each begins, and how x changes with y."""
    place = lambda i: F.struct(((F.element_at(x, i) - low_x) * scale).alias("x"), ((F.element_at(y, i) - low_y) * scale).alias("y"))
    n = F.size(x)
    sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(place(i).alias("a"), place(i % n + 1).alias("b")))
    return F.filter(sides, lambda e: e["a"]["y"] != e["b"]["y"])


def _interval(edges: Column, row: Column) -> Column:
    """The lattice points of one row within a convex polygon: from ``a`` to before ``b``; null if the row passes it by."""
    met = F.filter(edges, lambda e: (e["a"]["y"] > row) != (e["b"]["y"] > row))
    at = F.transform(met, lambda e: e["a"]["x"] + (row - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))
    return F.struct(F.ceil(F.array_min(at)).alias("a"), F.ceil(F.array_max(at)).alias("b"))


def _lattice(ax: Column, ay: Column, bx: Column, by: Column, scale: float) -> Column:
    """Lattice points of both polygons, counted row by row: a convex polygon is one interval of each row, and what two have in common is theirs."""
    low_x, low_y = F.least(F.array_min(ax), F.array_min(bx)), F.least(F.array_min(ay), F.array_min(by))
    one, two = _edges(ax, ay, low_x, low_y, scale), _edges(bx, by, low_x, low_y, scale)
    top = F.ceil((F.greatest(F.array_max(ay), F.array_max(by)) - low_y) * scale)
    rows = F.transform(F.sequence(F.lit(0).cast("bigint"), top), lambda y: F.struct(_interval(one, y).alias("a"), _interval(two, y).alias("b")))
    size = lambda i: F.coalesce(i["b"] - i["a"], F.lit(0).cast("bigint"))
    common = lambda r: F.when(r["a"]["a"].isNotNull() & r["b"]["a"].isNotNull(), F.greatest(F.least(r["a"]["b"], r["b"]["b"]) - F.greatest(r["a"]["a"], r["b"]["a"]), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("both"))
    add = lambda t, r: F.struct((t["a"] + size(r["a"])).alias("a"), (t["b"] + size(r["b"])).alias("b"), (t["both"] + common(r)).alias("both"))
    share = lambda t: F.coalesce(F.greatest(F.try_divide(t["both"], t["a"]), F.try_divide(t["both"], t["b"])), F.lit(0.0))
    return F.when((F.size(ax) > 0) & (F.size(bx) > 0), F.aggregate(rows, start, add, share)).otherwise(0.0)


def hull_overlap(ax: str | Column, ay: str | Column, bx: str | Column, by: str | Column, mode: str = "lattice", scale: float = 10.0) -> Column:
    """The overlap ratio of two hulls given as columns of corner coordinates: the larger of the two shares that what they have in common has of either.

    ``lattice`` counts points of a lattice of ``scale`` to the unit, laid from the joint minimum; ``exact`` clips one polygon by the other. Without
    corners it is 0.
    """
    if mode == "lattice":
        return _lattice(*(F.col(c) if isinstance(c, str) else c for c in (ax, ay, bx, by)), float(scale))

    @F.pandas_udf("double")
    def ratio(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([overlap_ratio(np.column_stack([a, b]), np.column_stack([c, d]), mode, scale) for a, b, c, d in zip(ax, ay, bx, by)])

    return ratio(ax, ay, bx, by)
