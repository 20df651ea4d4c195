"""Nearest neighbours and gaps over boxes, in one region and in many, against brute force."""

import itertools

import numpy as np
import pytest

from pointloom.functions.boxes import Places, Pyramid, closest, leaves
from pointloom.operators import knn
from pointloom.operators.knn import knn_join, nearest_gaps


def clouds():
    rng = np.random.default_rng(0)
    dense = rng.normal(0, 0.001, (300, 3))
    return {
        "uniform": rng.random((250, 3)),
        "clustered": np.concatenate([rng.normal(0, 0.01, (150, 3)), rng.normal(5, 2, (60, 3))]),
        "far points": np.concatenate([dense, rng.normal(0, 300, (12, 3)), [[1e6, 0, 0]]]),
        "lattice": np.array(list(itertools.product(range(6), range(6), range(5))), float),
        "same": np.zeros((40, 3)),
        "one place and others": np.concatenate([np.ones((120, 3)), rng.random((40, 3)) * 3]),
        "flat": np.column_stack([rng.random(90), rng.random(90), np.zeros(90)]),
        "few": rng.random((3, 3)),
    }


def rows(spark, p, start=0):
    return spark.createDataFrame([(start + i, *map(float, x)) for i, x in enumerate(p)], "point_id bigint, x double, y double, z double")


def plain(q, d, k, ids, own=None):
    """(id, distance) of the k nearest of d to each of q."""
    out = []
    for i, x in enumerate(q):
        gap = np.sqrt((x[0] - d[:, 0]) * (x[0] - d[:, 0]) + (x[1] - d[:, 1]) * (x[1] - d[:, 1]) + (x[2] - d[:, 2]) * (x[2] - d[:, 2]))
        out.append([(int(ids[j]), gap[j]) for j in np.lexsort((ids, gap)) if own is None or ids[j] != own[i]][:k])
    return out


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["u"], []).append((r["rk"], r["v"], r["dist"]))
    return {u: [(v, d) for _, v, d in sorted(x)] for u, x in got.items()}


@pytest.mark.parametrize("region", [1 << 16, 25])
@pytest.mark.parametrize("kind", list(clouds()))
def test_nearest_in_any_number_of_regions(spark, monkeypatch, kind, region):
    monkeypatch.setattr(knn, "REGION", region)
    p = clouds()[kind]
    c, ids = rows(spark, p), np.arange(len(p))
    got = collected(knn_join(c, c, 5, exclude_self=True))
    assert [got.get(i, []) for i in ids] == plain(p, p, 5, ids, ids)


@pytest.mark.parametrize("region", [1 << 16, 25])
def test_nearest_of_another_cloud(spark, monkeypatch, region):
    """Places far from all data, data all in one corner, fewer places than are asked for."""
    monkeypatch.setattr(knn, "REGION", region)
    rng = np.random.default_rng(3)
    q, d = np.concatenate([rng.random((150, 3)) * 10, rng.random((20, 3)) * 1e-3]), rng.random((60, 3)) * 0.1
    ids = np.arange(60) + 500
    for n, k in ((60, 7), (4, 7)):
        got = collected(knn_join(rows(spark, q), rows(spark, d[:n], 500), k))
        assert [got[i] for i in range(len(q))] == plain(q, d[:n], k, ids[:n])
    assert knn_join(rows(spark, q), rows(spark, d[:0]), 3).count() == 0 and knn_join(rows(spark, q[:0]), rows(spark, d), 3).count() == 0


@pytest.mark.parametrize("region", [1 << 16, 10])
def test_rows_without_a_place_are_nobodys_neighbours(spark, monkeypatch, region):
    monkeypatch.setattr(knn, "REGION", region)
    p = np.random.default_rng(1).random((30, 3))
    odd = [(100, None, 0.0, 0.0), (101, 0.0, float("nan"), 0.0), (102, 0.0, 0.0, float("inf")), (103, None, None, None)]
    c = rows(spark, p).union(spark.createDataFrame(odd, "point_id bigint, x double, y double, z double"))
    got = collected(knn_join(c, c, 4, exclude_self=True))
    assert sorted(got) == list(range(30)) and [got[i] for i in range(30)] == plain(p, p, 4, np.arange(30), np.arange(30))


def test_far_points_ask_few_regions():
    """Boxes that can't hold a neighbour are passed over, whatever their number: a far place comes to some boxes of a dense part, not to all."""
    rng = np.random.default_rng(0)
    dense = np.sort(rng.normal(0, 0.01, (20_000, 3)), axis=0)
    pyramid = Pyramid(*leaves(dense))
    far = np.array([50.0, 0, 0])
    boxes, _ = pyramid.near(far, far, 5)
    assert 0 < len(boxes) < len(pyramid.levels[0][2]) / 50
    places = Places(dense, np.arange(len(dense)))
    _, ids, dist = places.nearest(far[None], 5)
    assert dist.tolist() == sorted(np.sqrt(((dense - far) ** 2).sum(axis=1)).tolist())[:5]


def test_closest_pairs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.random((int(rng.integers(1, 90)), 3)), rng.random((int(rng.integers(1, 90)), 3)) + rng.random(3) * rng.integers(0, 4)
        want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min()
        assert closest(a, b) == pytest.approx(want, rel=1e-12)
        assert closest(a, b, want * 1.01) == pytest.approx(want, rel=1e-12) and closest(a, b, want * 0.9) == want * 0.9
    assert closest(np.empty((0, 3)), a, 7.0) == 7.0


@pytest.mark.parametrize(("region", "chunk"), [(1 << 16, 1 << 10), (40, 6)])
def test_gaps_of_labels(spark, monkeypatch, region, chunk):
    """Labels of one point, large labels over many partitions, touching labels, null places and labels, pairs both ways round."""
    monkeypatch.setattr(knn, "REGION", region)
    monkeypatch.setattr(knn, "CHUNK", chunk)
    monkeypatch.setattr(knn, "FAN", 3 if chunk == 6 else 64)
    rng = np.random.default_rng(5)
    sets = {0: rng.random((300, 3)), 1: rng.random((50, 3)) + [1.05, 0, 0], 2: rng.random((1, 3)) + [3, 0, 0], 3: rng.random((40, 3)) * 0.1 + [0.2, 0.2, 1.3], 4: rng.random((30, 3)) + 50}
    sets[5] = sets[0][:4]
    data = [(g, *map(float, x)) for g, p in sets.items() for x in p] + [(None, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(data, "g bigint, x double, y double, z double").repartition(5)
    pairs = spark.createDataFrame([(a, b) for a in [*sets, 9] for b in [*sets, 9]], "ci bigint, cj bigint")
    got = {(r["ci"], r["cj"]): r["gap"] for r in nearest_gaps(points, pairs, 1.5, "g").collect()}
    want = {(9, 9): 0.0}
    for a in sets:
        for b in sets:
            gap = 0.0 if a == b else np.sqrt(((sets[a][:, None] - sets[b][None]) ** 2).sum(axis=2)).min()
            if gap < 1.5:
                want[a, b] = gap
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert nearest_gaps(points.limit(0), pairs, 1.5, "g").where("ci <> cj").count() == 0


@pytest.mark.parametrize("region", [1 << 16, 60, 9])
def test_nearest_within_each_of_many_clouds(spark, monkeypatch, region):
    """Clouds of any size and place beside each other, each with its own neighbours, in one region and across many."""
    monkeypatch.setattr(knn, "REGION", region)
    rng = np.random.default_rng(8)
    sets = [rng.random((int(n), 3)) * s + o for n, s, o in ((70, 1, 0), (1, 1, 0), (40, 1e-3, 1e6), (3, 5, -4), (90, 100, 0), (6, 0, 2))]
    data, start = [], 0
    for c, p in enumerate(sets):
        data += [(c * 10, start + i, *map(float, x)) for i, x in enumerate(p)]
        start += len(p)
    df = spark.createDataFrame(data, "cloud bigint, point_id bigint, x double, y double, z double").repartition(3)
    got = collected(knn_join(df, df, 4, exclude_self=True, by="cloud"))
    start = 0
    for p in sets:
        ids = np.arange(len(p)) + start
        assert [got.get(int(i), []) for i in ids] == plain(p, p, 4, ids, ids)
        start += len(p)


def test_overlapping_labels_meet_within_a_bound(spark, monkeypatch):
    """chunks of labels that lie in one another met without a bound, one after the other in one task. Now they come with the distance of two near points."""
    rng = np.random.default_rng(3)
    p, label = rng.normal(0, 1, (6000, 3)), rng.integers(0, 3, 6000)
    monkeypatch.setattr(knn, "REGION", 1000)
    monkeypatch.setattr(knn, "CHUNK", 64)
    monkeypatch.setattr(knn, "TOGETHER", 100)
    met, real = [], knn.written
    monkeypatch.setattr(knn, "written", lambda df: met.append(real(df)) or met[-1])
    points = spark.createDataFrame([(i, int(g), *map(float, x)) for i, (g, x) in enumerate(zip(label, p))], "point_id bigint, label int, x double, y double, z double")
    pairs = spark.createDataFrame([(0, 1), (2, 1), (2, 0)], "ci int, cj int")
    out = nearest_gaps(points, pairs, 2.0)
    got = {(r["ci"], r["cj"]): r["gap"] for r in out.collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    want = {(i, j): d[np.ix_(label == i, label == j)].min() for i, j in ((0, 1), (2, 1), (2, 0))}
    assert got == pytest.approx(want)
    rows = [r for df in met if "b_chunk" in df.columns for r in df.collect()]
    assert 0 < len(rows) < 3 * 32 * 32 and all(want[max((r["ci"], r["cj"]), (r["cj"], r["ci"]), key=lambda k: k in want)] <= r["bound"] < 0.2 for r in rows)


def test_closest_of_large_sets_equals_brute_force():
    rng = np.random.default_rng(4)
    for n, m, apart in ((300, 700, 0.0), (1000, 1024, 0.5), (3000, 5000, 0.0), (2000, 17, 9.0)):
        a, b = (x[np.lexsort((x * 4 // 1).T)] for x in (rng.normal(0, 1, (n, 3)), rng.normal(apart, 1, (m, 3))))
        want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min()
        assert closest(a, b) == pytest.approx(want, rel=1e-12) and closest(a, b, want * 2) == closest(a, b) and closest(a, b, want / 2) == want / 2


def test_queries_that_lie_apart_meet_few_boxes():
    """a block of queries met all places of every box near any part of the block. Boxes that no query can need are left out, with the same neighbours."""
    rng = np.random.default_rng(5)
    p = rng.random((20_000, 3))
    cell = (p * 16).astype(int)
    p = p[np.lexsort((cell[:, 0], cell[:, 1], cell[:, 2]))]
    places, ids = Places(p, np.arange(len(p))), np.arange(len(p))
    q = p[:: len(p) // 32][:32]
    boxes, _ = places.pyramid.near(q.min(axis=0), q.max(axis=0), 5)
    assert len(places.narrowed(boxes, q, 5)) < len(boxes) / 2
    row, near, dist = places.nearest(q, 5)
    want = plain(q, p, 5, ids)
    assert [(int(v), d) for v, d in zip(near, dist)] == [x for w in want for x in w] and (np.bincount(row) == 5).all()
