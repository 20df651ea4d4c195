"""The k-means++ start of cut pursuit: by groups in Spark as on arrays, seeded, and never worse than the median's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cutpursuit as C
from pointloom.params import CutPursuitParams

P = CutPursuitParams(start="kmeans", seed=7)


def invented(rng, comp):
    n = int(rng.integers(1, 40))
    obs = rng.normal(0, 1, (n, 2)) + np.where(rng.random((n, 1)) < 0.4, rng.normal(0, 6, 2), 0)
    if comp % 10 == 3:
        obs[:] = obs[0]
    w = rng.random(n) if comp % 3 else np.ones(n)
    if comp % 10 == 7:
        w[: n // 2] = 0
    return obs, w


def energy(obs, w, side):
    total = 0.0
    for s in (side, ~side):
        if w[s].sum() > 0:
            m = (w[s, None] * obs[s]).sum(axis=0) / w[s].sum()
            total += (w[s] * ((obs[s] - m) ** 2).sum(axis=1)).sum()
    return total


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    rows, comps, v = [], {}, 0
    for c in range(100):
        obs, w = invented(rng, c)
        comps[c] = (np.arange(v, v + len(obs)), obs, w)
        rows += [(c, v + i, *map(float, o), float(x)) for i, (o, x) in enumerate(zip(obs, w))]
        v += len(obs)
    return spark.createDataFrame(rows, "comp bigint, v bigint, x double, y double, w double"), comps


def sides(df):
    return {r["v"]: r["side"] for r in C.kmeans_sides(df, ["x", "y"], P).select("v", "side").collect()}


def test_start_is_seeded_and_not_worse_than_the_median(made):
    df, comps = made
    got = sides(df)
    assert sides(df.repartition(7, "v")) == got
    keys = {r["v"]: np.array(r[1:]) for r in df.select("v", *C._keys(P)).collect()}
    better = 0
    for ids, obs, w in comps.values():
        side = np.array([got[i] for i in ids])
        plain = C.kmeans_first_sides(obs, w, np.stack([keys[i] for i in ids]), P.steps)
        assert (side == plain).all()
        now, middle = energy(obs, w, side), energy(obs, w, C.first_sides(obs))
        assert now <= middle * (1 + 1e-9) + 1e-12
        better += now < middle * 0.95
    assert better > 20
    other = {r["v"]: r["side"] for r in C.kmeans_sides(df, ["x", "y"], CutPursuitParams(start="kmeans", seed=8, restarts=1, steps=0)).select("v", "side").collect()}
    assert other != got and set(other) == set(got)


def test_second_centres_are_drawn_by_weight_and_squared_distance(spark):
    """Of 3,000 components of three places, the second centre is the far one as often as its share of weight times squared distance."""
    n = 3000
    df = spark.createDataFrame(pd.DataFrame({"comp": np.repeat(np.arange(n), 3), "v": np.arange(3 * n), "x": np.tile([0.0, 1.0, 2.0], n), "w": np.tile([1.0, 1.0, 0.5], n)}))
    p = CutPursuitParams(start="kmeans", restarts=1, steps=0)
    keys = df.select("comp", "v", "x", "w", *C._keys(p)).toPandas()
    share = []
    for _, g in keys.groupby("comp"):
        first = int(g["_key0"].argmin())
        if first == 0:
            weight = g["w"].to_numpy() * g["x"].to_numpy() ** 2
            with np.errstate(divide="ignore"):
                share.append(int(np.argmin(np.where(weight > 0, -np.log(g["_key1"].to_numpy()) / np.where(weight > 0, weight, 1), np.inf))) == 2)
    assert 850 < len(share) < 1150 and abs(np.mean(share) - 2 / 3) < 0.05  # 0.5 * 4 against 1 * 1


def test_solver_with_either_start(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (3, 0), (3, 3))])
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    vertices = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(xy)], "v bigint, x double, y double, w double")
    edges = spark.createDataFrame([(i, int(j), 1.0) for i in range(len(xy)) for j in near[i]], "u bigint, v bigint, w double")
    want, rounds = C.cut_pursuit(vertices, edges, ["x", "y"], 0.3, P)
    want = dict(want.collect())
    assert len(set(want.values())) > 2 and [r.energy for r in rounds] == sorted((r.energy for r in rounds), reverse=True)
    assert [r.number for r in rounds] == list(range(1, len(rounds) + 1)) and all(r.seconds > 0 for r in rounds)
    monkeypatch.setattr(C, "REGION", 40)
    got, _ = C.cut_pursuit(vertices, edges, ["x", "y"], 0.3, P)
    assert dict(got.collect()) == want
    with pytest.raises(ValueError, match="start"):
        C.cut_pursuit(vertices, edges, ["x", "y"], 0.3, CutPursuitParams(start="other"))
    assert vertices.select(F.max("v")).first()[0] == 89
