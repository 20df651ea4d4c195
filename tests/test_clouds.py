"""Many clouds in one plan, rows without a place, and LAS files that are appended and overwritten."""

import numpy as np
import pytest

from pointloom.operators import cutpursuit, knn
from pointloom.params import SegmentationParams
from pointloom.plans.segmentation import LABELS, segment

KIND = "cloud_id string, point_id bigint, x double, y double, z double, extra string"


def tree(rng, x, n=50):
    """A stem and a crown."""
    stem = np.column_stack([x + rng.normal(0, 0.05, n), rng.normal(0, 0.05, n), rng.random(n) * 4])
    crown = rng.normal(0, 0.6, (2 * n, 3)) + [x, 0, 5]
    return np.concatenate([stem, crown])


PARAMS = SegmentationParams(decimate_res1=0.25, decimate_res2=0.5, reg_strength1=0.5)


@pytest.fixture(scope="module")
def clouds():
    """Trees, two and three of them, and a cloud of two points."""
    rng = np.random.default_rng(7)
    sets = {f"c{t}": np.concatenate([tree(rng, 8 * i, 20) for i in range(t)]) for t in (1, 3)} | {"few": rng.random((2, 3)), "d2": np.concatenate([tree(rng, 0, 15), tree(rng, 3, 25)])}
    return [(c, i, *map(float, x), "e") for c, xyz in sets.items() for i, x in enumerate(xyz)]


@pytest.fixture(scope="module")
def single(spark, clouds):
    out = {}
    for c in {r[0] for r in clouds}:
        for r in segment(spark.createDataFrame([r for r in clouds if r[0] == c], KIND), PARAMS).collect():
            out[c, r["point_id"]] = tuple(r[x] for x in LABELS)
    return out


@pytest.mark.parametrize("region", [1 << 17, 90])
def test_clouds_in_one_plan_equal_single_runs(spark, monkeypatch, clouds, single, region):
    """Regions of 90 take the largest cloud through the Spark rounds, beside the small ones."""
    monkeypatch.setattr(cutpursuit, "REGION", region)
    monkeypatch.setattr(knn, "REGION", region)
    got = {(r["cloud_id"], r["point_id"]): tuple(r[x] for x in LABELS) for r in segment(spark.createDataFrame(clouds, KIND).repartition(3), PARAMS).collect()}
    assert got == single and len({x for k, x in got.items() if k[0] == "c3"}) > 2


def test_jobs_do_not_grow_with_clouds(spark):
    p, counts = PARAMS, []
    for n in (1, 12):
        rng = np.random.default_rng(1)
        xyz = tree(rng, 0)
        rows = [(f"c{c}", i, *map(float, x), "e") for c in range(n) for i, x in enumerate(xyz)]
        group = f"clouds-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert segment(spark.createDataFrame(rows, KIND), p).count() == len(rows)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < counts[0] and counts[1] <= counts[0] * 1.2


def test_rows_without_a_place_keep_null_labels(spark):
    rng = np.random.default_rng(2)
    xyz = tree(rng, 0, 20)
    rows = [("c", i, *map(float, x), "kept") for i, x in enumerate(xyz)]
    odd = [("c", 1000, None, 0.0, 0.0, "null"), ("c", 1001, 0.0, float("nan"), 0.0, "nan"), ("c", 1002, 0.0, 0.0, float("-inf"), "inf"), ("c", None, 0.0, 0.0, 0.0, "no id"), ("only", 1, None, None, None, "none")]
    p = SegmentationParams(decimate_res1=0.2, decimate_res2=0.4, isolate_outliers=True)
    got = segment(spark.createDataFrame(rows + odd, KIND), p).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["extra"]: r for r in got}
    assert all(by[o[-1]][x] is None for o in odd for x in LABELS)
    want = {r["point_id"]: tuple(r[x] for x in LABELS) for r in segment(spark.createDataFrame(rows, KIND), p).collect()}
    assert {r["point_id"]: tuple(r[x] for x in LABELS) for r in got if r["extra"] == "kept"} == want and None not in {x for w in want.values() for x in w}
    nameless = [(None, *r[1:]) for r in rows]
    assert {tuple(r[x] for x in LABELS) for r in segment(spark.createDataFrame(nameless, KIND), p).collect()} == set(want.values())


def test_small_clouds_can_be_skipped(spark, clouds, single):
    from dataclasses import replace

    got = segment(spark.createDataFrame([r for r in clouds if r[0] in ("few", "c1")], KIND), replace(PARAMS, min_points=2 * PARAMS.min_nn1)).collect()
    assert {(r["cloud_id"], r["point_id"]): tuple(r[x] for x in LABELS) for r in got} == {k: (None,) * 3 if k[0] == "few" else x for k, x in single.items() if k[0] in ("few", "c1")}


def test_far_parts_are_segments_of_their_own(spark):
    """isolate_outliers: a label is cut where no chain of neighbours joins it."""
    xyz = [(0.3 * i, 0.0, 0.0) for i in range(8)] + [(100 + 0.3 * i, 0.0, 0.0) for i in range(25)]
    df = spark.createDataFrame([("c", i, *x, "e") for i, x in enumerate(xyz)], KIND)
    apart = {r["point_id"]: r["final_segs"] for r in segment(df, SegmentationParams(isolate_outliers=True)).collect()}
    assert not {apart[i] for i in range(8)} & {apart[i] for i in range(8, 33)} and sorted(set(apart.values())) == list(range(len(set(apart.values()))))


def test_las_append_and_overwrite(spark, tmp_path, monkeypatch):
    from pointloom.sources import las

    spark.dataSource.register(las.LasSource)
    kind = "cloud_id string, point_id bigint, x double, y double, z double, mark int"
    frame = lambda a, b: spark.createDataFrame([("c", i, float(i), 0.0, 0.0, i) for i in range(a, b)], kind)
    out = f"file://{tmp_path}/out"
    marks = lambda: sorted(r["mark"] for r in spark.read.format("las").load(out).collect())
    frame(0, 2).coalesce(1).write.format("las").mode("append").save(out)
    frame(2, 3).coalesce(1).write.format("las").mode("append").save(out)
    assert marks() == [0, 1, 2]
    frame(10, 18).repartition(4).write.format("las").mode("overwrite").save(out)
    assert marks() == list(range(10, 18))
    frame(20, 21).coalesce(1).write.format("las").mode("overwrite").save(out)
    assert marks() == [20]
    bad = frame(0, 400).repartition(2).selectExpr("cloud_id", "point_id", "CASE WHEN point_id = 399 THEN raise_error('broken') ELSE x END AS x", "y", "z", "mark")
    with pytest.raises(Exception, match="broken"):
        bad.write.format("las").mode("append").save(out)
    assert marks() == [20] and [f.suffix for f in (tmp_path / "out").iterdir()] == [".las"]
    monkeypatch.setattr(las, "FILE", 1 << 21)
    assert spark.read.format("las").load(f"{out}/*.las").count() == 1
