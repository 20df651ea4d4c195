"""Connected components of an undirected graph by alternating large-star and small-star steps (Kiveris et al. 2014).

First every task replaces the edges that it reads by stars of the parts they make, CHUNK edges at a time. A graph of at most SMALL edges, as counted
after that, is solved in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.maxflow import parts
from pointloom.plans.storage import released, written


#: Edges that are gathered in one task, and that a task contracts together (16 bytes each).
SMALL, CHUNK = 1 << 19, 1 << 20


def _labels(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of all edges and the smallest that each reaches."""
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = (table.column(c).to_numpy() for c in ("u", "v"))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[parts(len(ids), place[: len(u)], place[len(u) :])]


def _at_once(batches):
    """(v, label) of all vertices of all edges."""
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _labels(list(batches))], names=["v", "label"])


def _contracted(batches):
    """The edges as stars: (u, v) of every vertex and the smallest that it reaches by edges of the same chunk."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield _stars(held)
            held, size = [], 0
    yield _stars(held)


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids, label = _labels(held)
    other = ids != label
    return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(label[other])], names=["u", "v"])


def _nearest(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and its neighbours. A hub's rows stay apart: only its minimum is joined back."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u above v."""
    near = _nearest(edges)
    out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v, label) of every vertex that has an edge (u, v) to another: label is the smallest vertex it reaches.

    Vertices are integers. Self-loops, nulls and repeated edges count for nothing. Every round is written to the shared folder; the only values that
    come to the driver are a count and a checksum, which show when a round changed nothing.
    """
    as_long = lambda c: c.cast("bigint")
    real = edges.where("u <> v").select(as_long(F.greatest("u", "v")).alias("u"), as_long(F.least("u", "v")).alias("v"))
    now = written(real.mapInArrow(_contracted, "u bigint, v bigint").distinct())
    before = None
    if now.count() <= SMALL:
        return written(now.coalesce(1).mapInArrow(_at_once, "v bigint, label bigint"))
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        last, now = now, written(_small_star(_large_star(now)))
        released(last)
    else:
        raise RuntimeError("components didn't settle")
    labels = now.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("v"), "label").distinct())


def label_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, label) of all of ``vertices`` (column v); a vertex without edges is its own component."""
    found = components(edges)
    return vertices.select("v").distinct().join(found, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
