"""Point operators against brute force, and the small goldens of the design."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.geometry import area, clipped, convex_hull, overlap_ratio
from pointloom.functions.maxflow import parts, sink_side
from pointloom.operators import groups as G
from pointloom.operators.components import components, label_vertices
from pointloom.operators.cutpursuit import cut_pursuit
from pointloom.operators.knn import knn_join, nearest_gaps
from pointloom.operators.merge import best_candidates, merge_score, vertical_overlap
from pointloom.operators.outliers import isolate_gaps
from pointloom.operators.voxels import VOXEL, decimate, label_back, voxelize
from pointloom.params import CutPursuitParams, SegmentationParams
from pointloom.plans.segmentation import segment
from pointloom.sources.points import PointFileError, read_delimited, sniff


def cloud(spark, xyz):
    return spark.createDataFrame([("c", i, *map(float, p)) for i, p in enumerate(xyz)], "cloud_id string, point_id bigint, x double, y double, z double")


def test_decimate_golden(spark):
    v = voxelize(cloud(spark, [(0.01, 0.01, 0.01), (0.04, 0, 0), (0.06, 0, 0), (-0.01, 0, 0)]), 0.05, "zero")
    rep = decimate(v)
    assert {(r["_vx"], r["_vy"], r["_vz"]): r["point_id"] for r in rep.collect()} == {(0, 0, 0): 0, (1, 0, 0): 2, (-1, 0, 0): 3}
    back = label_back(v, rep.withColumnRenamed("point_id", "rep"), "rep")
    assert {r["point_id"]: r["rep"] for r in back.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


@pytest.mark.parametrize("kind", ["uniform", "clustered", "lattice", "same"])
def test_knn_equals_brute_force(spark, kind):
    rng = np.random.default_rng(0)
    p = {"uniform": rng.random((150, 3)), "clustered": np.concatenate([rng.normal(0, 0.01, (100, 3)), rng.normal(5, 2, (40, 3))]), "lattice": np.array(list(itertools.product(range(5), range(5), range(4))), float), "same": np.zeros((12, 3))}[kind]
    c = cloud(spark, p)
    for self_out in (True, False):
        got = {}
        for r in knn_join(c, c, 5, exclude_self=self_out).collect():
            got.setdefault(r["u"], {})[r["rk"]] = r["v"]
        for i, x in enumerate(p):
            d = np.sqrt((x[0] - p[:, 0]) * (x[0] - p[:, 0]) + (x[1] - p[:, 1]) * (x[1] - p[:, 1]) + (x[2] - p[:, 2]) * (x[2] - p[:, 2]))
            order = [int(j) for j in np.lexsort((np.arange(len(p)), d)) if not (self_out and j == i)][:5]
            assert [got[i][k] for k in range(1, 6)] == order


def test_nearest_gaps(spark):
    rng = np.random.default_rng(1)
    p = rng.random((120, 3)) * 4
    lab = rng.integers(0, 6, 120)
    pts = cloud(spark, p).join(spark.createDataFrame([(i, int(g)) for i, g in enumerate(lab)], "point_id bigint, label bigint"), "point_id")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a <= b], "ci bigint, cj bigint")
    got = {(r["ci"], r["cj"]): r["gap"] for r in nearest_gaps(pts, pairs, 0.4).collect()}
    for a in range(6):
        for b in range(a, 6):
            want = 0.0 if a == b else np.sqrt(((p[lab == a][:, None] - p[lab == b][None]) ** 2).sum(axis=2)).min()
            assert (a, b) in got and got[a, b] == pytest.approx(want) if want < 0.4 else (a, b) not in got


def test_trimmed_mean_golden(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [*range(999), 1e6]], "g string, x double")
    assert G.trimmed_means(df, ["g"], 0.2, ("x",)).first()["trim_x"] == pytest.approx(499.5)
    big = spark.range(200_000).select(F.lit("g").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    v = np.sort(np.array([r[0] for r in big.select("x").collect()]))
    assert G.trimmed_means(big, ["g"], 0.2, ("x",)).first()["trim_x"] == pytest.approx(v[200:-200].mean())


def test_scores_golden(spark):
    rows = spark.createDataFrame([(5.0, 5.0, 0.0, 8.0), (2.0, 2.0, 0.0, 10.0), (10.0, 2.0, 0.0, 8.0), (1.0, 0.0, 1.0, 0.0)], "ea double, la double, eb double, lb double")
    assert [round(r[0], 6) for r in rows.select(vertical_overlap(*(F.col(c) for c in ("ea", "la", "eb", "lb")))).collect()] == [0.3, 0.5, 0.0, 0.0]
    one = spark.range(1).select(merge_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), 0.5), merge_score(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(2.0), 0.5)).first()
    assert one[0] == 1 and one[1] == pytest.approx(np.exp(-2.5))
    pairs = spark.createDataFrame([(1, 10, 3.0, 0.9), (1, 11, 1.0, 0.7), (1, 12, 0.1, 0.5), (2, 13, 1.0, 0.0)], "a bigint, b bigint, d3 double, score double")
    assert [(r["a"], r["b"]) for r in best_candidates(pairs, 0.7).collect()] == [(1, 11)]


def test_components(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (5, 5), (4, 3)], "u bigint, v bigint")
    assert dict(label_vertices(spark.range(6).withColumnRenamed("id", "v"), edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    rng = np.random.default_rng(2)
    e = rng.integers(0, 200, (150, 2))
    got = dict(components(spark.createDataFrame(e.tolist(), "u bigint, v bigint")).collect())
    label = parts(200, e[:, 0], e[:, 1])
    assert all(label[v] == l for v, l in got.items()) and len(got) == len({x for a, b in e.tolist() if a != b for x in (a, b)})
    path = spark.range(300).selectExpr("(id * 7919) % 301 u", "((id + 1) * 7919) % 301 v")
    assert {r["label"] for r in components(path).collect()} == {0}


def test_min_cut_is_the_smallest_sink_side():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        s, t = rng.integers(0, 6, n), rng.integers(0, 6, n)
        e = [(a, b, int(rng.integers(0, 5))) for a in range(n) for b in range(a) if rng.random() < 0.5]
        u, v, c = (np.array([x[i] for x in e], np.int64) for i in range(3))
        best = None
        for side in itertools.product((False, True), repeat=n):
            m = np.array(side)
            cost = s[m].sum() + t[~m].sum() + sum(w for a, b, w in e if m[a] != m[b])
            best = min(best, (cost, m.sum(), side)) if best else (cost, m.sum(), side)
        assert tuple(sink_side(n, s, t, u, v, c)) == best[2]


def test_hulls_and_overlap():
    rng = np.random.default_rng(0)
    p = rng.random((60, 2))
    h = convex_hull(p)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-12).all()
    assert convex_hull(np.array([[0, 0], [1, 0], [2, 0]])).tolist() == [[0, 0], [2, 0], [2, 0], [0, 0]]
    a = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    b = a + 5
    assert area(clipped(a, b)) == pytest.approx(25) and overlap_ratio(a, b, "exact") == pytest.approx(0.25) == overlap_ratio(a, b)
    assert overlap_ratio(a, a) == overlap_ratio(a, a, "exact") == 1 and overlap_ratio(a, a + 50) == 0


def test_lattice_rows_count_what_points_count(spark):
    """Overlap by intervals of rows, in the engine, against points tested one by one."""
    from pointloom.operators.hulls import hull_overlap

    rng = np.random.default_rng(3)
    pairs = [(convex_hull(rng.random((int(rng.integers(1, 12)), 2)) * rng.random() * 6), convex_hull(rng.random((int(rng.integers(1, 12)), 2)) * 4 + rng.random(2) * 3)) for _ in range(60)]
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    pairs += [(square, square), (square, square + 5), (square, square + [1, 0]), (square, square * 0), (np.empty((0, 2)), square)]
    df = spark.createDataFrame([(i, *(c.tolist() for h in p for c in h.T)) for i, p in enumerate(pairs)], "i int, ax array<double>, ay array<double>, bx array<double>, by array<double>")
    got = {r["i"]: (r["h"], r["fine"]) for r in df.select("i", hull_overlap("ax", "ay", "bx", "by").alias("h"), hull_overlap("ax", "ay", "bx", "by", scale=37.0).alias("fine")).collect()}
    assert [got[i] for i in range(len(pairs))] == [(overlap_ratio(a, b), overlap_ratio(a, b, scale=37.0)) for a, b in pairs]
    assert sum(0 < h < 1 for h, _ in got.values()) > 5


def test_cut_pursuit_golden(spark):
    v = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.1, 1.0), (2, 10.0, 1.0), (3, 10.1, 1.0)], "v bigint, o double, w double")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "u bigint, v bigint, w double")
    labels, rounds = cut_pursuit(v, e, ["o"], 1.0)
    assert dict(labels.collect()) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert rounds[0].energy == pytest.approx(1.005) and [r.energy for r in rounds] == sorted((r.energy for r in rounds), reverse=True)
    merged, _ = cut_pursuit(v, e, ["o"], 1.0, CutPursuitParams(cutoff=3.0))
    assert len({r["comp"] for r in merged.collect()}) == 1


def test_segments_of_small_forests(spark):
    trees = []
    for t in range(2):
        stem = [(t * 10 + 0.1 * np.cos(a), 0.1 * np.sin(a), a / 4) for a in np.linspace(0, 16, 60)]
        i = np.arange(120)
        up, turn = 1 - 2 * (i + 0.5) / 120, i * 2.399963
        crown = np.stack([t * 10 + 1.5 * np.sqrt(1 - up**2) * np.cos(turn), 1.5 * np.sqrt(1 - up**2) * np.sin(turn), 5 + 1.5 * up], axis=1)
        trees += [*stem, *crown.tolist()]
    out = segment(cloud(spark, trees).withColumn("extra", F.lit("kept")), SegmentationParams(decimate_res1=0.2, decimate_res2=0.3)).collect()
    assert len(out) == len(trees) and all(r["extra"] == "kept" for r in out)
    label = {r["point_id"]: r["final_segs"] for r in out}
    assert set(label.values()) == set(range(max(label.values()) + 1))
    assert not {label[i] for i in range(180)} & {label[i] for i in range(180, 360)}
    by_init = {}
    for r in out:
        by_init.setdefault(r["init_segs"], set()).add(r["final_segs"])
    assert all(len(x) == 1 for x in by_init.values())
    assert segment(cloud(spark, [(1.0, 2.0, 3.0)] * 3)).select("final_segs").distinct().collect()[0][0] == 0
    assert segment(cloud(spark, [(0, 0, 0)]).limit(0)).count() == 0


def test_isolation(spark):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (9, 0, 0), (9.5, 0, 0)])
    assert [r["label"] for r in isolate_gaps(c, 3.0).orderBy("point_id").collect()] == [0, 0, 0, 3, 3]


@pytest.mark.parametrize(("text", "want"), [("0 0 0\n1 0 0\n", [(0, 0, 0), (1, 0, 0)]), ("0,0,0\n1,0,0\n", [(0, 0, 0), (1, 0, 0)]), ("X;Y;Z;intensity\n0;0;0;7\n", [(0, 0, 0)]), ("//X Y Z\n0 0 0\n", [(0, 0, 0)]), ("z\ty\tx\n3\t2\t1\n", [(1, 2, 3)]), ("1e0 2 3\n", [(1, 2, 3)]), ("-1.5,  2 3 9\n", [(-1.5, 2, 3)])])
def test_delimited_files(spark, tmp_path, text, want):
    (tmp_path / "a.csv").write_text(text)
    assert [(r["x"], r["y"], r["z"]) for r in read_delimited(spark, str(tmp_path / "a.csv")).orderBy("point_id").collect()] == want


@pytest.mark.parametrize(("line", "want"), [("0 0 0", " "), ("0,0 0", ","), ("//X Y Z", " "), ("x ; y;z", ";"), ("# z\ty\tx", "\t"), ("1", ",")])
def test_separators(line, want):
    from pointloom.sources.points import separator

    assert separator(line) == want


@pytest.mark.parametrize("sep", [",", ";", "\t", " "])
def test_delimited_files_with_nulls_come_back(spark, tmp_path, sep):
    from pointloom.sources.points import write_delimited

    rows = [("c", i, float(i), None if i == 3 else i / 4, -1.5, None if i % 2 else "a") for i in range(9)]
    df = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, name string")
    write_delimited(df.repartition(3), str(tmp_path / "out"), True, sep, [(c, c.upper()) for c in ("x", "y", "z", "name")])
    back = {r["x"]: (r["y"], r["z"], r["NAME"]) for r in read_delimited(spark, str(tmp_path / "out")).collect()}
    none = "NaN" if sep == " " else None
    assert {k: (str(y), z, n) for k, (y, z, n) in back.items()} == {r[2]: (("nan" if none else "None") if r[3] is None else str(r[3]), r[4], r[5] or none) for r in rows}


def test_labels_are_ranked_over_ranges(spark):
    """Labels of one large and many small clouds, strings and structs among them, with nulls, in many ranges."""
    rng = np.random.default_rng(5)
    rows = [("big", int(x)) for x in rng.integers(-(1 << 40), 1 << 40, 3000)] * 2 + [(f"c{i % 40}", int(x)) for i, x in enumerate(rng.integers(0, 9, 400))] + [("big", None), (None, 1)]
    df = spark.createDataFrame(rows, "cloud_id string, lab bigint").withColumn("text", F.col("lab").cast("string")).withColumn("both", F.struct("text", "lab"))
    for label in ("lab", "text", "both"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {(r["cloud_id"], r[label]): r["n"] for r in G.dense_labels(df.repartition(5).where("lab IS NOT NULL"), label, name="n").collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        of = {}
        for r in df.where("lab IS NOT NULL AND cloud_id IS NOT NULL").collect():
            of.setdefault(r["cloud_id"], set()).add(r[label])
        assert got == {(c, x): i for c, xs in of.items() for i, x in enumerate(sorted(xs))}
    assert G.dense_labels(df, "lab", name="n").count() == len(rows) - 2 and G.dense_labels(df.limit(0), "lab").count() == 0


def test_bad_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a b c\n1 2 3\n")
    with pytest.raises(PointFileError):
        read_delimited(spark, str(tmp_path / "b.csv"))
    with pytest.raises(PointFileError):
        sniff("  ")


def test_las_round_trip(spark, tmp_path):
    from pointloom.sources.las import LasSource

    spark.dataSource.register(LasSource)
    rng = np.random.default_rng(0)
    rows = [("c", i, float(x), float(y), float(z), int(i % 7), int(i % 3)) for i, (x, y, z) in enumerate(np.round(rng.random((500, 3)) * 100, 3))]
    df = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double, intensity int, final_segs int")
    df.coalesce(1).write.format("las").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("las").load(str(tmp_path / "out")).orderBy("point_id").collect()
    assert [(round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), r["intensity"], r["final_segs"]) for r in back] == [r[2:] for r in rows]


def test_stream(spark, tmp_path):
    from pointloom.streaming.clouds import segment_stream

    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    c.write.parquet(str(tmp_path / "in"))
    segment_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "cloud_id string, point_id bigint, x double, y double, z double").awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_las_keeps_numbers_scale_and_format_over_empty_partitions(spark, tmp_path):
    from pointloom.sources.las import Header, LasSource

    spark.dataSource.register(LasSource)
    rows = [("a", i, 100.0 + i * 0.25, -5.0, i * 1e-4, i + 1, 1 << 40, 0.5, 1.5 if i else None, 7, i, 3, 9) for i in range(5)]
    kind = "cloud_id string, point_id bigint, x double, y double, z double, intensity int, big bigint, half float, real double, small smallint, red int, green int, blue int"
    out = str(tmp_path / "out")
    spark.createDataFrame(rows, kind).repartition(8, "point_id").write.format("las").option("scale", "0.25,1,0.0001").option("offset", "100,0,0").mode("append").save(out)
    back = sorted(spark.read.format("las").load(out).collect(), key=lambda r: r["x"])
    assert [(r["x"], r["y"], round(r["z"], 9), r["intensity"], r["big"], r["half"], r["small"], r["red"], r["green"], r["blue"]) for r in back] == [(r[2], r[3], round(r[4], 9), *r[5:8], *r[9:]) for r in rows]
    assert str(back[0]["real"]) == "nan" and back[1]["real"] == 1.5
    files = sorted((tmp_path / "out").iterdir())
    assert all(f.suffix == ".las" for f in files) and all(Header.read(str(f)).scale == (0.25, 1.0, 0.0001) and Header.read(str(f)).format == 7 for f in files)
    with pytest.raises(Exception, match="no type for"):
        spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, "text")], "cloud_id string, point_id bigint, x double, y double, z double, name string").write.format("las").mode("append").save(out)


def test_empty_fields_stay_empty(spark, tmp_path):
    (tmp_path / "e.csv").write_text("x,y,z,i,c\n1,2,3,,7\n4 , 5,  6,8,\n")
    assert [(r["x"], r["y"], r["z"], r["i"], r["c"]) for r in read_delimited(spark, str(tmp_path / "e.csv")).orderBy("point_id").collect()] == [(1, 2, 3, None, "7"), (4, 5, 6, "8", None)]


def test_files_come_back_as_they_were(spark, tmp_path, monkeypatch):
    from pointloom.plans import files
    from pointloom.plans.files import segment_folder
    from pointloom.sources.las import Header, LasSource

    side = (F.col("x") > 15).cast("int")
    monkeypatch.setattr(files, "segment", lambda df, p=None: df.withColumns({c: side for c in ("init_segs", "intermediate_segs", "final_segs")}))

    spark.dataSource.register(LasSource)
    points = [(i % 5 * 0.3 + (i >= 20) * 30, i // 5 % 4 * 0.3, i % 7 * 0.2) for i in range(40)]
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.csv").write_text("Z,X,name,Y\n" + "".join(f"{z},{x},n{i},{y}\n" for i, (x, y, z) in enumerate(points)))
    (folder / "b.txt").write_text("".join(f"{x} {y} {z} {i}\n" for i, (x, y, z) in enumerate(points)))
    df = spark.createDataFrame([("c", i, *p, i) for i, p in enumerate(points)], "cloud_id string, point_id bigint, x double, y double, z double, mark bigint")
    df.coalesce(1).write.format("las").option("scale", "0.01").mode("append").save(str(tmp_path / "las"))
    next((tmp_path / "las").glob("*.las")).rename(folder / "c.las")
    a, b, c = segment_folder(spark, str(folder), str(out))
    lines = [x for f in sorted((out / "a_segmented.csv").glob("part-*.csv")) for x in f.read_text().splitlines() if not x.startswith("Z")]
    assert spark.read.option("header", True).csv(a).columns == ["Z", "X", "name", "Y", "init_segs", "intermediate_segs", "final_segs"]
    assert [x.split(",")[2] for x in lines] == [f"n{i}" for i in range(40)]
    bare = spark.read.option("sep", " ").csv(b).collect()
    assert len(bare) == 40 and len(bare[0]) == 7 and {int(r[3]) for r in bare} == set(range(40))
    back = spark.read.format("las").load(c).collect()
    assert {r["mark"] for r in back} == set(range(40)) and len({r["final_segs"] for r in back if r["x"] < 10} & {r["final_segs"] for r in back if r["x"] > 20}) == 0
    assert Header.read(str(next((out / "c_segmented.las").glob("*.las")))).scale == (0.01, 0.01, 0.01)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "d.laz").write_bytes(b"LASF" + bytes(100) + b"\x80" + bytes(300))
    with pytest.raises(Exception, match="LAZ needs a codec"):
        segment_folder(spark, str(tmp_path / "packed"), str(tmp_path / "more"))


# ---- The first two stages against a plain version


def plain_parts(n, u, v):
    """The smallest vertex that each one reaches."""
    near = [[] for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist()):
        near[a].append(b)
        near[b].append(a)
    label = [-1] * n
    for i in range(n):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for b in near[todo.pop()]:
                    if label[b] < 0:
                        label[b] = i
                        todo.append(b)
    return np.array(label)


def plain_sink_side(to_source, to_sink, u, v, cap):
    """Who still reaches the sink once no shortest path from the source has room, found path by path."""
    n = len(to_source)
    source, sink, room = n, n + 1, [{} for _ in range(n + 2)]

    def line(a, b, there, back):
        room[a][b] = room[a].get(b, 0) + there
        room[b][a] = room[b].get(a, 0) + back

    for i in range(n):
        line(source, i, int(to_source[i]), 0)
        line(i, sink, int(to_sink[i]), 0)
    for a, b, c in zip(u.tolist(), v.tolist(), cap.tolist()):
        line(a, b, c, c)
    while True:
        came, ring = {source: None}, [source]
        while ring and sink not in came:
            after = []
            for a in ring:
                for b, c in room[a].items():
                    if c > 0 and b not in came:
                        came[b] = a
                        after.append(b)
            ring = after
        if sink not in came:
            break
        path, b = [], sink
        while came[b] is not None:
            path.append((came[b], b))
            b = came[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow
    seen, todo = {sink}, [sink]
    while todo:
        b = todo.pop()
        for a in room[b]:
            if room[a].get(b, 0) > 0 and a not in seen:
                seen.add(a)
                todo.append(a)
    return np.array([i in seen for i in range(n)])


def plain_split(obs, u, v, ew, reg, p):
    """The parts of one component, by smallest vertices, and whether it can't be split."""
    spread = [np.mean((o - o.mean()) ** 2) for o in obs.T]
    wide = obs[:, spread.index(max(spread))]
    side = wide > np.median(wide)
    cap = np.trunc(ew * reg * p.scale).astype(int) * p.edge_multiplier
    for _ in range(p.flow_steps):
        if len(set(side.tolist())) == 1:
            return plain_parts(len(obs), u, v), True
        cost = [0.5 * ((obs - obs[side == s].mean(axis=0)) ** 2).sum(axis=1) for s in (False, True)]
        lack = np.trunc(abs(cost[0] - cost[1]) * p.scale).astype(int)
        first = cost[0] <= cost[1]
        side = plain_sink_side(lack * ~first, lack * first, u, v, cap)
    live = side[u] == side[v]
    return plain_parts(len(obs), u[live], v[live]), False


def plain_cut_pursuit(obs, u, v, ew, reg, p):
    """Labels (smallest vertex) of the same method on whole arrays, a component after the other, with cuts of its own."""
    n = len(obs)

    def energy(comp):
        means = {c: obs[comp == c].mean(axis=0) for c in set(comp.tolist())}
        return 0.5 * sum(((obs[i] - means[comp[i]]) ** 2).sum() for i in range(n)) + reg * ew[comp[u] != comp[v]].sum()

    comp, stable, full = np.zeros(n, int), np.zeros(n, bool), np.zeros(n, bool)
    before = energy(comp)
    for number in range(1, p.max_rounds + 1):
        new = comp.copy()
        for c in sorted(set(comp[~stable].tolist())):
            own = np.flatnonzero(comp == c)
            inner = (comp[u] == c) & (comp[v] == c)
            label, saturated = plain_split(obs[own], np.searchsorted(own, u[inner]), np.searchsorted(own, v[inner]), ew[inner], reg, p)
            if saturated and number > 1:
                label = np.zeros(len(own), int)
            new[own], full[own] = own[label], saturated
            stable[own] = number > 1 and len(set(label.tolist())) == 1
        comp = new
        now = energy(comp)
        if full.all() or before <= 0 or (before - now) / before < p.stop_ratio:
            break
        before = now
    return comp


def plain_neighbours(xyz, k):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(xyz)), d.shape), d), axis=1)[:, :k]
    return np.repeat(np.arange(len(xyz)), order.shape[1]), order.ravel()


@pytest.mark.parametrize("region", [1 << 17, 40])
def test_first_stages_equal_a_plain_version(spark, monkeypatch, region):
    """In one task, and in Spark rounds with cuts by regions of some twenty vertices."""
    from pointloom.operators import cutpursuit
    from pointloom.params import SegmentationParams
    from pointloom.plans.segmentation import init_segments, intermediate_segments

    monkeypatch.setattr(cutpursuit, "REGION", region)
    rng = np.random.default_rng(11)
    xyz = np.concatenate([rng.normal(c, 0.4, (30, 3)) for c in ((0, 0, 0), (3, 0, 1), (3.5, 3, 0), (0.5, 2.5, 2))])
    p = SegmentationParams(reg_strength1=0.05, reg_strength2=0.5)
    points = cloud(spark, [tuple(map(float, x)) for x in xyz])
    got = {r["point_id"]: r["init"] for r in init_segments(points, p).collect()}
    u, v = plain_neighbours(xyz - xyz.mean(axis=0), p.min_nn1)
    init = plain_cut_pursuit(xyz - xyz.mean(axis=0), u, v, np.ones(len(u)), p.reg_strength1, p.solver)
    assert [got[i] for i in range(len(xyz))] == init.tolist() and 4 <= len(set(init.tolist())) < 100

    labelled = points.join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(init)], "point_id bigint, init bigint"), "point_id")
    got = {r["point_id"]: r["inter"] for r in intermediate_segments(labelled, p).collect()}
    names = sorted(set(init.tolist()))
    centre = np.array([xyz[init == c].mean(axis=0) for c in names])
    near = {(names[a], names[b]) for a, b in zip(*plain_neighbours(centre, p.min_nn2))}
    gap = {(a, b): np.sqrt(((xyz[init == a][:, None] - xyz[init == b][None]) ** 2).sum(axis=2)).min() for a, b in near}
    gap = {k: g for k, g in gap.items() if g < p.max_gap} | {(c, c): 0.0 for c in names}
    u, v = plain_neighbours(xyz, p.min_nn2)
    known = [(a, b, 10 / ((gap[init[a], init[b]] + 0.01) / 0.01)) for a, b in zip(u, v) if (init[a], init[b]) in gap]
    flat = (xyz - xyz.mean(axis=0))[:, :2]
    inter = plain_cut_pursuit(flat, *(np.array(x) for x in zip(*known)), p.reg_strength2, p.solver)
    assert [got[i] for i in range(len(xyz))] == inter.tolist() and 1 < len(set(inter.tolist())) < len(names)
