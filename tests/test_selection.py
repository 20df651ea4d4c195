"""Quantiles by selection against sorted values."""

import numpy as np
import pytest

from pointloom.operators import groups


def sets():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(0, 1, 3001),
        "even": rng.random(2000),
        "heavy": np.exp(rng.normal(0, 40, 2500)) * rng.choice([-1, 1], 2500),
        "one value": np.full(500, 2.5),
        "hot value": np.concatenate([np.full(4000, 1.0), rng.random(700) * 3]),
        "two": np.array([1.0, 4.0]),
        "single": np.array([-7.0]),
        "huge": np.array([-1.7e308, 1.7e308, 1.6e308, 5e-324, 0.0, -0.0] * 50),
        "far": np.concatenate([rng.random(1500), [1e300, -1e300]]),
        "neighbours": 1 + np.arange(1200) * 2.220446049250313e-16,
    }


@pytest.mark.parametrize(("ranked", "stretches"), [(1 << 16, 1 << 10), (50, 64), (1, 1024)])
def test_quantiles_of_any_distribution(spark, monkeypatch, ranked, stretches):
    monkeypatch.setattr(groups, "RANKED", ranked)
    monkeypatch.setattr(groups, "STRETCHES", stretches)
    rows = [(g, float(x), float(-x)) for g, v in sets().items() for x in v] + [(None, 3.0, None), (None, 5.0, float("nan")), ("normal", None, None), ("none", None, float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    for share in (0.5, 0.999) if ranked > 50 else (0.5,):
        got = {r["g"]: (r["q_x"], r["q_y"]) for r in groups.quantiles(df, ["g"], share, ("x", "y")).collect()}
        assert set(got) == {*sets(), None} and got[None] == (3 + 2 * share, None)
        for g, v in sets().items():
            for value, of in zip(got[g], (v, -v)):
                of = np.sort(of)
                place = share * (len(of) - 1)
                a, b = of[int(np.floor(place))], of[int(np.ceil(place))]
                part = place - np.floor(place)
                assert value == (1 - part) * a + part * b, (g, share)


def test_medians_without_groups_and_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "x double")
    assert groups.medians(df, [], ("x",)).first()["med_x"] == 4.5
    assert groups.medians(df.selectExpr("1 AS g", "x").limit(0), ["g"], ("x",)).count() == 0


def test_few_values_of_a_large_group_meet(spark, monkeypatch):
    """A group of 200,000 values: after counting, less than an eighth is ranked, and the median is exact."""
    monkeypatch.setattr(groups, "RANKED", 25_000)
    df = spark.range(200_000).selectExpr("'g' AS g", "cast(xxhash64(id) AS double) AS x")
    v = np.sort(df.select("x").toPandas()["x"].to_numpy())
    assert groups.medians(df, ["g"], ("x",)).first()["med_x"] == 0.5 * v[99_999] + 0.5 * v[100_000]
