"""Minimum cuts by regions and components by rounds, against plain versions of their own."""

from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions.maxflow import sink_side
from pointloom.operators import components as comps
from pointloom.operators import cutpursuit, regions
from pointloom.params import CutPursuitParams


def plain_sink_side(n, s, t, edges):
    """Augments shortest paths one at a time; what then still reaches the sink."""
    room = {}
    for a, b, c in [*((n, i, int(x)) for i, x in enumerate(s)), *((i, n + 1, int(x)) for i, x in enumerate(t))]:
        room.setdefault(a, {})[b] = c
        room.setdefault(b, {}).setdefault(a, 0)
    for a, b, c in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                room.setdefault(x, {})[y] = room[x].get(y, 0) + int(c)
    while True:
        came, queue = {n: None}, deque([n])
        while queue and n + 1 not in came:
            x = queue.popleft()
            for y, c in room.get(x, {}).items():
                if c > 0 and y not in came:
                    came[y] = x
                    queue.append(y)
        if n + 1 not in came:
            break
        path, y = [], n + 1
        while came[y] is not None:
            path.append((came[y], y))
            y = came[y]
        f = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= f
            room[b][a] += f
    reach, queue = {n + 1}, deque([n + 1])
    while queue:
        y = queue.popleft()
        for x in room.get(y, {}):
            if x not in reach and room[x][y] > 0:
                reach.add(x)
                queue.append(x)
    return np.array([i in reach for i in range(n)], bool)


def network(rng, n, k=5):
    xy = rng.random((n, 2)) * np.sqrt(n)
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    u, v = np.repeat(np.arange(n), k), near.ravel()
    left = xy[:, 0] < np.sqrt(n) / 2
    s, t = np.where(left, rng.integers(0, 60, n), rng.integers(0, 4, n)), np.where(left, rng.integers(0, 4, n), rng.integers(0, 60, n))
    return xy, u, v, rng.integers(0, 40, n * k), s, t


def test_sink_side_of_random_networks():
    rng = np.random.default_rng(5)
    for n in [*range(1, 30), 80, 120]:
        xy, u, v, c, s, t = network(rng, n, min(5, max(1, n - 1)))
        assert (sink_side(n, s, t, u, v, c) == plain_sink_side(n, s, t, zip(u.tolist(), v.tolist(), c.tolist()))).all()


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("seed", [0, 1])
def test_cut_by_regions(spark, parts, seed):
    n = 240
    xy, u, v, c, s, t = network(np.random.default_rng(seed), n)
    vertices = spark.createDataFrame(pd.DataFrame({"v": np.arange(n) * 7, "x": xy[:, 0], "y": xy[:, 1], "to_source": s, "to_sink": t}))
    edges = spark.createDataFrame(pd.DataFrame({"u": u * 7, "v": v * 7, "cap": c}))
    placed = regions.by_region(vertices, ["x", "y"], 2 * n // parts)
    sizes = [r["count"] for r in placed.groupBy("region").count().collect()]
    assert parts <= len(sizes) <= parts + 2 and (parts == 1 or max(sizes) < 2.5 * n / parts)
    got = {r["v"]: r["side"] for r in regions.cut(placed, regions.lines(placed, edges)).collect()}
    want = plain_sink_side(n, s, t, zip(u.tolist(), v.tolist(), c.tolist()))
    assert [got[7 * i] for i in range(n)] == want.tolist() and 0 < want.sum() < n


@pytest.mark.parametrize("sink", [60, 4])
def test_cut_by_regions_without_sweeps(spark, monkeypatch, sink):
    """What the regions leave open is solved at once; with weak terminals nearly all is."""
    n = 240
    xy, u, v, c, s, t = network(np.random.default_rng(3), n)
    t = np.minimum(t, sink)
    vertices = spark.createDataFrame(pd.DataFrame({"v": np.arange(n) * 7, "x": xy[:, 0], "y": xy[:, 1], "to_source": s, "to_sink": t}))
    placed = regions.by_region(vertices, ["x", "y"], n // 2)
    near = regions.lines(placed, spark.createDataFrame(pd.DataFrame({"u": u * 7, "v": v * 7, "cap": c})))
    monkeypatch.setattr(regions, "_begin", None)  # no sweep can begin
    got = {r["v"]: r["side"] for r in regions.cut(placed, near, most=n).collect()}
    assert [got[7 * i] for i in range(n)] == plain_sink_side(n, s, t, zip(u.tolist(), v.tolist(), c.tolist())).tolist()
    assert regions._cut_of_few(placed, near, 1) is None


def test_many_components_flow_together():
    """Networks side by side give the sides that each has alone, in few searches for all."""
    rng = np.random.default_rng(9)
    made = [network(rng, 40) for _ in range(60)]
    alone = np.concatenate([sink_side(40, s, t, u, v, c) for _, u, v, c, s, t in made])
    u, v = (np.concatenate([m[i] + 40 * k for k, m in enumerate(made)]) for i in (1, 2))
    c, s, t = (np.concatenate([m[i] for m in made]) for i in (3, 4, 5))
    assert (sink_side(2400, s, t, u, v, c) == alone).all() and 0 < alone.sum() < 2400
    obs, w = np.concatenate([m[0] for m in made]), np.ones(2400)
    label, saturated = cutpursuit.split_components(obs, w, u, v, c / 40, np.arange(0, 2401, 40), 0.5, CutPursuitParams())
    for k, (xy, a, b, cap, _, _) in enumerate(made):
        one, full = cutpursuit.split_components(xy, w[:40], a, b, cap / 40, np.array([0, 40]), 0.5, CutPursuitParams())
        assert (label[40 * k : 40 * k + 40] == one + 40 * k).all() and saturated[k] == full[0]


def test_vertices_at_one_place_are_cut_into_regions(spark):
    """A path whose vertices share their place: regions go by id, and the cheapest edge is cut."""
    n = 60
    vertices = spark.createDataFrame([(i, 1.0, 100 if i == 0 else 0, 100 if i == n - 1 else 0) for i in range(n)], "v bigint, x double, to_source bigint, to_sink bigint")
    edges = spark.createDataFrame([(i, i + 1, 3 if i == 40 else 10) for i in range(n - 1)], "u bigint, v bigint, cap bigint")
    placed = regions.by_region(vertices, ["x"], 20)
    assert placed.select("region").distinct().count() >= 5
    got = {r["v"]: r["side"] for r in regions.cut(placed, regions.lines(placed, edges)).collect()}
    assert [got[i] for i in range(n)] == [i > 40 for i in range(n)]


def plain_labels(n, edges):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("chunk", [1 << 20, 64])
@pytest.mark.parametrize("small", [1 << 19, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(comps, "SMALL", small)
    monkeypatch.setattr(comps, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    for n, m in ((200, 150), (3000, 2400)):
        e = rng.integers(0, n, (m, 2)).tolist()
        e += [(n - 1 - i, n - 2 - i) for i in range(100)]  # a path from the largest vertex down
        df = spark.createDataFrame(e, "u bigint, v bigint").repartition(7)
        got = dict(comps.components(df).collect())
        want = plain_labels(n, e)
        assert got == {x: want[x] for a, b in e if a != b for x in (a, b)}
    assert comps.components(spark.createDataFrame([(1, 1), (None, 2)], "u bigint, v bigint")).count() == 0


def test_a_component_by_regions_is_split_as_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (2, 0), (2, 2))])
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :6]
    vertices = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(xyz)], "v bigint, x double, y double, w double")
    edges = spark.createDataFrame([(i, int(j), 1.0) for i in range(len(xyz)) for j in near[i]], "u bigint, v bigint, w double")
    want, rounds = cutpursuit.cut_pursuit(vertices, edges, ["x", "y"], 0.3)
    want = dict(want.collect())
    monkeypatch.setattr(cutpursuit, "REGION", 30)
    got, by_regions = cutpursuit.cut_pursuit(vertices, edges, ["x", "y"], 0.3)
    assert dict(got.collect()) == want and len(set(want.values())) > 2
    assert [(r.number, r.components, r.saturated) for r in by_regions] == [(r.number, r.components, r.saturated) for r in rounds]
    assert [r.energy for r in by_regions] == pytest.approx([r.energy for r in rounds])


def test_graphs_without_edges_or_vertices(spark, monkeypatch):
    monkeypatch.setattr(cutpursuit, "REGION", 2)
    vertices = spark.range(9).select(F.col("id").alias("v"), (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("w"))
    edges = spark.createDataFrame([], "u bigint, v bigint, w double")
    labels, rounds = cutpursuit.cut_pursuit(vertices, edges, ["x"], 1.0)
    assert dict(labels.collect()) == {i: i for i in range(9)} and len(rounds) >= 1
    assert cutpursuit.cut_pursuit(vertices.limit(0), edges, ["x"], 1.0)[0].count() == 0
