"""Positions along the Z-order curve: near ones are mostly near in space, and a prefix of the bits is a cell of an octree or quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a position in all dimensions together.
BITS = 60


def interleaved(cells: list[Column], bits: int) -> Column:
    """One number of the bits of several, the lowest bit of each first."""
    out: Column = F.lit(0).cast("bigint")
    for i in range(bits):
        for d, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), i).bitwiseAND(F.lit(1).cast("bigint")), i * len(cells) + d))
    return out


def box(df: DataFrame, dims: list[str]) -> tuple[int, list[float], float]:
    """How many rows there are, and the smallest place and the longest side of the cube that holds them."""
    got = df.agg(F.count("*"), *(f(d) for d in dims for f in (F.min, F.max))).first()
    low = [float(got[1 + 2 * i] or 0.0) for i in range(len(dims))]
    return got[0], low, max([float(got[2 + 2 * i] or 0.0) - a for i, a in enumerate(low)])


def position(dims: list[str], low: list[float] | list[Column], side: float | Column, bits: int | None = None) -> Column:
    """The place of a row on the curve through a cube, in ``bits`` for each dimension."""
    bits = bits or BITS // len(dims)
    side = side if isinstance(side, Column) else F.lit(side)
    step = F.when(side > 0, side / float(1 << bits)).otherwise(1.0)
    cell = lambda d, a: F.least(F.greatest(F.floor((F.col(d) - (a if isinstance(a, Column) else F.lit(a))) / step), F.lit(0)), F.lit((1 << bits) - 1))
    return interleaved([cell(d, a) for d, a in zip(dims, low)], bits)
