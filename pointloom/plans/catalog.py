"""Registered queries of the point operators over the driver's tables, with DuckDB SQL where SQL expresses them.

Three tables serve as clouds: ``emb`` (embeddings), ``evt`` (events) and ``ord`` (orders). Doubles are rounded to six places in both engines, as
sums may differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import groups as G
from pointloom.operators.components import label_vertices
from pointloom.operators.cutpursuit import cut_pursuit, energies, median_sides, terminal_capacities
from pointloom.operators.hulls import hull_overlap, hulls
from pointloom.operators.knn import knn_join, nearest_gaps, radius_edges
from pointloom.operators.merge import best_candidates, centroid_gaps, final_segments, merge_score, nearest_scale, stem_flags, vertical_overlap
from pointloom.operators.outliers import isolate_gaps, sor_filter
from pointloom.operators.voxels import VOXEL, centered, decimate, label_back, min_shifted, voxelize
from pointloom.params import SegmentationParams
from pointloom.plans.segmentation import gap_weight, init_segments, intermediate_segments, segment
from pointloom.plans.storage import shared_folder
from pointloom.sources.las import LasSource
from pointloom.sources.points import distinct_labels, export_graph, global_shift, range_filter, read_delimited, write_delimited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- The clouds, in both engines

EMB = "emb AS (SELECT 'emb' AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, label::BIGINT AS grp FROM embeddings)"
EVT = "evt AS (SELECT 'evt' AS cloud_id, event_id AS point_id, user_id::DOUBLE AS x, value / 10 AS y, epoch_us(ts) / 3600000000.0::DOUBLE AS z, event_type AS grp FROM events)"
ORD = "ord AS (SELECT 'ord' AS cloud_id, o_orderkey AS point_id, o_custkey::DOUBLE AS x, o_totalprice / 1000 AS y, o_orderpriority AS grp FROM orders)"


def emb(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit("emb").alias("cloud_id"), F.col("vec_id").alias("point_id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), F.col("label").cast("long").alias("grp"))


def evt(spark: SparkSession, d: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3600000000D")
    return spark.read.parquet(f"{d}/events.parquet").select(F.lit("evt").alias("cloud_id"), F.col("event_id").alias("point_id"), F.col("user_id").cast("double").alias("x"), (F.col("value") / 10).alias("y"), hours.alias("z"), F.col("event_type").alias("grp"))


def ord_(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.lit("ord").alias("cloud_id"), F.col("o_orderkey").alias("point_id"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"), F.col("o_orderpriority").alias("grp"))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


# ---- Voxels and scalars

VOX = "floor(x / 2.0)::BIGINT AS _vx, floor(y / 2.0)::BIGINT AS _vy, floor(z / 2.0)::BIGINT AS _vz"


@query(f"WITH {EVT} SELECT _vx, _vy, _vz, min(point_id) AS point_id FROM (SELECT *, {VOX} FROM evt) GROUP BY ALL")
def voxel_decimate(spark, d):
    return decimate(voxelize(evt(spark, d), 2.0, "zero")).select(*VOXEL, "point_id")


@query(f"WITH {EVT}, v AS (SELECT *, {VOX} FROM evt) SELECT point_id, min(point_id) OVER (PARTITION BY _vx, _vy, _vz) AS rep FROM v")
def voxel_label_back(spark, d):
    v = voxelize(evt(spark, d), 2.0, "zero")
    return label_back(v, decimate(v).withColumnRenamed("point_id", "rep"), "rep").select("point_id", "rep")


@query(f"WITH {EMB} SELECT point_id, round(x - avg(x) OVER (), 6) AS x, round(y - avg(y) OVER (), 6) AS y, round(z - avg(z) OVER (), 6) AS z FROM emb")
def center_shift(spark, d):
    return centered(emb(spark, d)).select("point_id", *r6("x", "y", "z"))


@query(f"WITH {EMB} SELECT point_id, round(x - min(x) OVER (), 6) AS x, round(y - min(y) OVER (), 6) AS y, round(z - min(z) OVER (), 6) AS z FROM emb")
def min_shift(spark, d):
    return min_shifted(emb(spark, d)).select("point_id", *r6("x", "y", "z"))


@query(f"WITH {EVT} SELECT point_id, x, y FROM evt WHERE y BETWEEN 10 AND 20")
def scalar_range_filter(spark, d):
    return range_filter(evt(spark, d), "y", 10, 20).select("point_id", "x", "y")


@query(f"WITH {EVT} SELECT point_id, x - floor(min(x) OVER () / 100) * 100 AS x, y - floor(min(y) OVER () / 100) * 100 AS y, round(z - floor(min(z) OVER () / 100) * 100, 6) AS z FROM evt")
def global_shift_auto(spark, d):
    return global_shift(evt(spark, d)).select("point_id", "x", "y", *r6("z"))


@query(f"WITH {EVT}, f AS (SELECT arg_min(x, point_id) AS fx, arg_min(y, point_id) AS fy, arg_min(z, point_id) AS fz FROM evt) SELECT point_id, round(x - fx, 6) AS x, round(y - fy, 6) AS y, round(z - fz, 6) AS z FROM evt, f")
def global_shift_first(spark, d):
    return global_shift(evt(spark, d), "first").select("point_id", *r6("x", "y", "z"))


@query(f"WITH {EVT} SELECT point_id, round(x + 1.5, 6) AS x, round(y - 20, 6) AS y, round(z - 400000, 6) AS z FROM evt")
def global_shift_given(spark, d):
    return global_shift(evt(spark, d), (1.5, -20.0, -400_000.0)).select("point_id", *r6("x", "y", "z"))


@query("SELECT count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM (SELECT o_custkey::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders)")
def extent(spark, d):
    return G.extents(ord_(spark, d), [], ("x", "y")).select("n", *r6("min_x", "max_x", "min_y", "max_y"))


# ---- Files: a cloud is written to the shared folder and read back


@query(f"WITH {EVT} SELECT point_id::VARCHAR AS id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, grp AS kind FROM evt")
def delimited_scan(spark, d):
    """With a header, semicolons, and coordinates that are found by their names."""
    to = shared_folder(spark)
    write_delimited(evt(spark, d), to, True, ";", [("z", "Z"), ("point_id", "id"), ("x", "X"), ("grp", "kind"), ("y", "Y")])
    return read_delimited(spark, to).select("id", *r6("x", "y", "z"), "kind")


@query(f"WITH {EVT} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, point_id::VARCHAR AS col4 FROM evt")
def delimited_scan_bare(spark, d):
    """Without a header, between blanks: the first three fields are the coordinates."""
    to = shared_folder(spark)
    write_delimited(evt(spark, d), to, False, " ", [(c, c) for c in ("x", "y", "z", "point_id")])
    return read_delimited(spark, to).select(*r6("x", "y", "z"), "col4")


def _las(spark, d):
    """The labelled points as LAS files in steps of a thousandth, and read back."""
    spark.dataSource.register(LasSource)
    to = shared_folder(spark)
    points = emb(spark, d).withColumn("final_segs", F.col("grp").cast("int")).withColumn("mark", F.col("point_id"))
    points.drop("grp").write.format("las").option("scale", "0.001").option("offset", "0").mode("append").save(to)
    return spark.read.format("las").load(to)


@query(f"WITH {EMB} SELECT point_id AS mark, round(x * 1000)::BIGINT AS x, round(y * 1000)::BIGINT AS y, round(z * 1000)::BIGINT AS z, grp::INTEGER AS final_segs FROM emb")
def las_scan(spark, d):
    """Coordinates in thousandths, with the extra fields."""
    return _las(spark, d).select("mark", *(F.round(F.col(a) * 1000).cast("bigint").alias(a) for a in "xyz"), "final_segs")


@query("SELECT DISTINCT label::INTEGER AS final_segs FROM embeddings")
def label_readback(spark, d):
    return distinct_labels(_las(spark, d))


@query("SELECT a.n_nationkey AS u, b.n_nationkey AS v, 'n' || b.n_nationkey AS name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def graph_export(spark, d):
    """Nations of one region as a graph, exported and read back: its edges with the name of the second end."""
    to = shared_folder(spark)
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("v"), F.col("n_regionkey").alias("r"))
    edges = n.withColumnRenamed("v", "u").join(n, "r").where("u < v").select("u", "v")
    export_graph(n.select("v", F.concat(F.lit("n"), "v").alias("name")), edges, to)
    read = lambda what, schema: spark.read.schema(schema).option("header", True).csv(f"{to}_{what}")
    return read("edges", "u bigint, v bigint").join(read("vertices", "v bigint, name string"), "v").select("u", "v", "name")


# ---- Neighbours

NN3 = "SELECT a.point_id AS u, b.point_id AS v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM emb a, emb b WHERE a.point_id <> b.point_id"
KNN5 = f"nn AS (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM ({NN3})), knn AS (SELECT * FROM nn WHERE rk <= 5)"


def knn5(spark, d):
    e = emb(spark, d)
    return knn_join(e, e, 5, exclude_self=True)


@query(f"WITH {EMB}, {KNN5} SELECT u, v, rk, round(dist, 6) AS dist FROM knn")
def knn3d(spark, d):
    return knn5(spark, d).select("u", "v", F.col("rk").cast("long").alias("rk"), *r6("dist"))


@query(f"""WITH {EMB}, g AS (SELECT grp AS g, avg(x) AS x, avg(y) AS y FROM emb GROUP BY grp), nn AS (SELECT a.g AS u, b.g AS v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM g a, g b),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM nn) SELECT u, v, rk, round(dist, 6) AS dist FROM r WHERE rk <= 4""")
def knn2d_incl_self(spark, d):
    g = G.centroids(emb(spark, d), ["grp"])
    return knn_join(g, g, 4, ("cx", "cy"), "grp", "grp").select("u", "v", F.col("rk").cast("long").alias("rk"), *r6("dist"))


@query(f"WITH {EMB}, g AS (SELECT grp AS g, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM emb GROUP BY grp) SELECT a.g AS u, b.g AS v, row_number() OVER (PARTITION BY a.g ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.g) AS rk FROM g a JOIN g b ON a.g <> b.g")
def knn_more_than_points(spark, d):
    """More neighbours asked for than there are: all of them."""
    g = G.centroids(emb(spark, d), ["grp"])
    return knn_join(g, g, 1000, ("cx", "cy", "cz"), "grp", "grp", exclude_self=True).select("u", "v", F.col("rk").cast("long").alias("rk"))


@query(f"""WITH {EMB}, nn AS (SELECT a.point_id AS u, b.point_id AS v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM emb a, emb b WHERE a.grp < 3 AND b.grp >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM nn) SELECT u, v, rk, round(dist, 6) AS dist FROM r WHERE rk <= 20""")
def knn_bichromatic(spark, d):
    e = emb(spark, d)
    return knn_join(e.where("grp < 3"), e.where("grp >= 3"), 20, ("x", "y")).select("u", "v", F.col("rk").cast("long").alias("rk"), *r6("dist"))


@query(f"WITH {EMB}, {KNN5} SELECT u, v, round(dist, 6) AS dist FROM knn WHERE dist < 0.5")
def radius_edge_list(spark, d):
    return radius_edges(knn5(spark, d), 0.5).select("u", "v", *r6("dist"))


GAPS = "gaps AS (SELECT a.grp AS ci, b.grp AS cj, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS gap FROM emb a, emb b WHERE a.grp < b.grp GROUP BY ALL HAVING gap < 0.5)"


def _gaps(spark, d):
    e = emb(spark, d)
    g = e.select("grp").distinct()
    pairs = g.select(F.col("grp").alias("ci")).join(g.select(F.col("grp").alias("cj")), F.col("ci") < F.col("cj"))
    return nearest_gaps(e, pairs, 0.5, "grp")


@query(f"WITH {EMB}, {GAPS} SELECT ci, cj, round(gap, 6) AS gap FROM gaps")
def nearest_pair_gap(spark, d):
    return _gaps(spark, d).select("ci", "cj", *r6("gap"))


@query(f"""WITH {EMB}, {KNN5}, {GAPS} SELECT u, v, round(10.0 / ((gap + 0.01) / 0.01), 6) AS w FROM knn JOIN emb a ON u = a.point_id JOIN emb b ON v = b.point_id
JOIN (SELECT * FROM gaps UNION ALL SELECT cj, ci, gap FROM gaps UNION ALL SELECT DISTINCT grp, grp, 0.0 FROM emb) g ON g.ci = a.grp AND g.cj = b.grp""")
def edge_gap_lookup(spark, d):
    e, gaps = emb(spark, d), _gaps(spark, d)
    own = e.select(F.col("grp").alias("ci"), F.col("grp").alias("cj"), F.lit(0.0).alias("gap")).distinct()
    both = gaps.union(gaps.select("cj", "ci", "gap")).union(own)
    lab = e.select("point_id", "grp")
    edges = knn5(spark, d).join(lab.toDF("u", "ci"), "u").join(lab.toDF("v", "cj"), "v")
    return edges.join(both, ["ci", "cj"]).select("u", "v", F.round(gap_weight(F.col("gap")), 6).alias("w"))


CLUSTERS = "k AS (SELECT grp * 2 + (z > 0)::INTEGER AS init, grp AS g, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM emb GROUP BY ALL)"


@query(f"""WITH {EMB}, {CLUSTERS} SELECT a.g AS a, b.g AS b, round(min(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))), 6) AS d3 FROM k a JOIN k b ON b.g = a.g + 1 GROUP BY ALL""")
def group_gap_centroids(spark, d):
    """Between each label and the next: the smallest distance of the centroids of their clusters."""
    e = emb(spark, d).withColumn("init", F.col("grp") * 2 + (F.col("z") > 0).cast("int"))
    clusters = G.centroids(e.withColumnRenamed("grp", "g"), ["init", "g"])
    g = clusters.select("g").distinct()
    pairs = g.select(F.col("g").alias("a")).join(g.select(F.col("g").alias("b")), F.col("b") == F.col("a") + 1)
    return centroid_gaps(pairs, clusters).select("a", "b", *r6("d3"))


# ---- Aggregates


@query(f"WITH {EVT} SELECT grp, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM evt GROUP BY grp")
def group_centroid(spark, d):
    return G.centroids(evt(spark, d), ["grp"]).select("grp", *r6("cx", "cy", "cz"))


@query(f"""WITH {EVT}, l AS (SELECT grp, 'x' AS a, x AS v FROM evt UNION ALL SELECT grp, 'y', y FROM evt UNION ALL SELECT grp, 'z', z FROM evt),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY v) AS rn, count(*) OVER (PARTITION BY grp, a) AS n FROM l),
m AS (SELECT grp, a, avg(v) AS m FROM r WHERE rn > round_even(n * 0.01, 0) AND rn <= n - round_even(n * 0.01, 0) GROUP BY grp, a)
SELECT grp, round(max(m) FILTER (a = 'x'), 6) AS trim_x, round(max(m) FILTER (a = 'y'), 6) AS trim_y, round(max(m) FILTER (a = 'z'), 6) AS trim_z FROM m GROUP BY grp""")
def trimmed_mean(spark, d):
    return G.trimmed_means(evt(spark, d), ["grp"], 2.0).select("grp", *r6("trim_x", "trim_y", "trim_z"))


@query(f"WITH {EVT} SELECT grp, round(min(z), 6) AS elev, round(max(z) - min(z), 6) AS len FROM evt GROUP BY grp")
def elev_length(spark, d):
    return G.elevation_length(evt(spark, d), ["grp"]).select("grp", *r6("elev", "len"))


@query(f"WITH {EVT} SELECT grp, round(median(x), 6) AS med_x, round(median(y), 6) AS med_y, round(median(z), 6) AS med_z FROM evt GROUP BY grp")
def group_median(spark, d):
    return G.medians(evt(spark, d), ["grp"]).select("grp", *r6("med_x", "med_y", "med_z"))


@query(f"WITH {EVT}, s AS (SELECT grp, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c FROM evt GROUP BY grp) SELECT grp, (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::INTEGER AS axis FROM s")
def max_var_dim(spark, d):
    return G.widest_axis(evt(spark, d), ["grp"])


@query(f"WITH {EVT} SELECT x, arg_min(grp, point_id) AS grp FROM evt GROUP BY x")
def first_label(spark, d):
    return G.first_label(evt(spark, d), ["x"], "grp")


@query(f"WITH {EVT}, c AS (SELECT x, grp, count(*) AS n FROM evt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, grp) AS k FROM c) SELECT x, grp FROM r WHERE k = 1")
def mode_label(spark, d):
    return G.mode_label(evt(spark, d), ["x"], "grp")


@query(f"WITH {EVT} SELECT grp, count(*) AS n FROM evt GROUP BY grp")
def group_size(spark, d):
    return G.sizes(evt(spark, d), ["grp"])


def _weighted(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("comp"), (F.col("l_linestatus") == "O").alias("side"), F.col("l_extendedprice").alias("o1"), F.col("l_discount").alias("o2"), F.col("l_quantity").alias("w"))


@query("SELECT l_returnflag AS comp, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS m_o1, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS m_o2 FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return G.weighted_means(_weighted(spark, d), ["comp"], ["o1", "o2"]).select("comp", *r6("m_o1", "m_o2"))


@query("""SELECT l_returnflag AS comp, round(sum(l_quantity * l_discount) FILTER (l_linestatus <> 'O') / sum(l_quantity) FILTER (l_linestatus <> 'O'), 6) AS a_o2,
round(sum(l_quantity * l_discount) FILTER (l_linestatus = 'O') / sum(l_quantity) FILTER (l_linestatus = 'O'), 6) AS b_o2,
coalesce(sum(l_quantity) FILTER (l_linestatus <> 'O'), 0) = 0 OR coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) = 0 AS saturated FROM lineitem GROUP BY 1""")
def two_centers(spark, d):
    return G.two_centers(_weighted(spark, d), ["o2"]).select("comp", *r6("a_o2", "b_o2"), "saturated")


CROSS = "cr AS (SELECT u, v, dist AS w, a.grp AS lu, b.grp AS lv FROM knn JOIN emb a ON u = a.point_id JOIN emb b ON v = b.point_id WHERE a.grp <> b.grp)"


def _labelled(spark, d):
    return knn5(spark, d).select("u", "v", F.col("dist").alias("w")), emb(spark, d).select(F.col("point_id").alias("v"), F.col("grp").alias("comp"), "x", "y", "z", F.lit(1.0).alias("w"))


@query(f"""WITH {EMB}, {KNN5}, {CROSS}, m AS (SELECT grp, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM emb GROUP BY grp)
SELECT round((SELECT 0.5 * sum((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) FROM emb JOIN m USING (grp)), 5) AS fidelity, round((SELECT sum(w) FROM cr), 5) AS penalty""")
def energy(spark, d):
    edges, v = _labelled(spark, d)
    near = v.join(G.weighted_means(v, ["comp"], ["x", "y", "z"]), "comp")
    fid = G.fidelity(near, ["x", "y", "z"], ["m_x", "m_y", "m_z"])
    pen = G.penalty(edges, v, 1.0)
    one = fid.select(F.lit(1).alias("k"), F.round("fidelity", 5).alias("fidelity"))
    return one.join(pen.select(F.lit(1).alias("k"), F.round("penalty", 5).alias("penalty")), "k").drop("k")


@query(f"""WITH {EMB}, {KNN5}, {CROSS}, m AS (SELECT grp, avg(x) AS mx, avg(y) AS my FROM emb GROUP BY grp), f AS (SELECT grp % 3 AS key, 0.5 * sum((x-mx)*(x-mx)+(y-my)*(y-my)) AS fidelity FROM emb JOIN m USING (grp) GROUP BY 1),
p AS (SELECT lu % 3 AS key, sum(2.5 * w) AS penalty FROM cr WHERE lu % 3 = lv % 3 GROUP BY 1) SELECT key, round(fidelity, 5) AS fidelity, round(coalesce(penalty, 0), 5) AS penalty FROM f LEFT JOIN p USING (key)""")
def cut_energy(spark, d):
    """The energy of the labels in each of three graphs, which are the labels by their remainders."""
    edges, v = _labelled(spark, d)
    keyed = v.withColumn("key", F.col("comp") % 3)
    ends = keyed.select("v", "key")
    own = edges.join(ends.toDF("u", "key"), "u").join(ends.toDF("v", "_other"), "v").where(F.col("key") == F.col("_other")).drop("_other")
    return energies(keyed.drop("comp"), own, v, ["x", "y"], 2.5).select("key", F.round("fidelity", 5).alias("fidelity"), F.round("penalty", 5).alias("penalty"))


@query(f"""WITH {EMB}, s AS (SELECT grp, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, median(x) AS mx, median(y) AS my, median(z) AS mz FROM emb GROUP BY grp)
SELECT point_id AS v, CASE WHEN a >= b AND a >= c THEN x > mx WHEN b >= c THEN y > my ELSE z > mz END AS side FROM emb JOIN s USING (grp)""")
def median_split_labels(spark, d):
    return median_sides(_labelled(spark, d)[1], ["x", "y", "z"]).select("v", "side")


@query(f"""WITH {EMB}, s AS (SELECT grp, median(x) AS m FROM emb GROUP BY grp), c AS (SELECT grp, avg(x) FILTER (x <= m) AS ca, avg(x) FILTER (x > m) AS cb FROM emb JOIN s USING (grp) GROUP BY grp),
k AS (SELECT point_id, 0.5*(x-ca)*(x-ca) AS p, 0.5*(x-cb)*(x-cb) AS q FROM emb JOIN c USING (grp))
SELECT point_id AS v, CASE WHEN p <= q THEN 0 ELSE trunc(abs(p - q) * 1000)::BIGINT END AS to_source, CASE WHEN p <= q THEN trunc(abs(p - q) * 1000)::BIGINT ELSE 0 END AS to_sink FROM k""")
def terminal_capacity(spark, d):
    e = emb(spark, d)
    m = G.medians(e, ["grp"], ("x",))
    sides = e.join(m, "grp").select(F.col("grp").alias("comp"), F.col("point_id").alias("v"), "x", (F.col("x") > F.col("med_x")).alias("side"), F.lit(1.0).alias("w"))
    return terminal_capacities(sides.join(G.two_centers(sides, ["x"]), "comp"), ["x"])


# ---- Sets, graphs


@query(f"WITH {EMB}, {KNN5} SELECT u, v, round(dist, 6) AS w FROM knn UNION ALL SELECT v, u, round(dist, 6) FROM knn")
def edge_symmetrize(spark, d):
    return G.symmetrized(_labelled(spark, d)[0]).select("u", "v", *r6("w"))


@query(f"WITH {EVT} SELECT point_id, (dense_rank() OVER (ORDER BY grp) - 1)::INTEGER AS lab FROM evt")
def dense_relabel(spark, d):
    return G.dense_labels(evt(spark, d), "grp", name="lab").select("point_id", "lab")


def _customers(spark, d):
    dear = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")), dear


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def set_difference(spark, d):
    return G.without(*_customers(spark, d), "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_members(spark, d):
    return G.members(*_customers(spark, d), "id")


@query(f"WITH {EMB}, {KNN5}, {CROSS} SELECT least(lu, lv) AS ca, greatest(lu, lv) AS cb, round(sum(w) * 0.5, 6) AS weight FROM cr GROUP BY ALL")
def border_weight(spark, d):
    return G.border_weights(*_labelled(spark, d)).select("ca", "cb", *r6("weight"))


@query(f"WITH {EMB}, {KNN5}, {CROSS} SELECT u, v, lu, lv FROM cr")
def crossing_edges(spark, d):
    return G.crossing(*_labelled(spark, d)).select("u", "v", "lu", "lv")


def _reached(limit):
    return f"""e AS (SELECT u, v FROM knn WHERE dist < {limit} UNION SELECT v, u FROM knn WHERE dist < {limit}),
    r AS (SELECT point_id AS v, point_id AS label FROM emb UNION SELECT e.v, r.label FROM r JOIN e ON r.v = e.u WHERE r.label < e.v)"""


@query(f"WITH RECURSIVE {EMB}, {KNN5}, {_reached(0.5)} SELECT v, min(label) AS label FROM r GROUP BY v")
def connected_components(spark, d):
    return label_vertices(emb(spark, d).select(F.col("point_id").alias("v")), radius_edges(knn5(spark, d), 0.5).select("u", "v"))


@query(f"""WITH RECURSIVE {EMB}, nn AS (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM ({NN3})), knn AS (SELECT * FROM nn WHERE rk <= 19), {_reached(0.4)}
SELECT v AS point_id, min(label) AS label FROM r GROUP BY v""")
def gap_isolation(spark, d):
    return isolate_gaps(emb(spark, d), 0.4)


@query(f"""WITH {EMB}, nn AS (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM ({NN3})), m AS (SELECT u, avg(dist) AS d FROM nn WHERE rk <= 10 GROUP BY u)
SELECT u AS point_id FROM m WHERE d <= (SELECT avg(d) + stddev_pop(d) FROM m)""")
def sor_outliers(spark, d):
    return sor_filter(emb(spark, d)).select("point_id")


# ---- Scores of groups

FEAT = "f AS (SELECT grp AS g, avg(x) AS fx, avg(y) AS fy, min(z) AS elev, max(z) - min(z) AS len FROM emb GROUP BY grp)"
NEAR = f"{FEAT}, gn AS (SELECT a.g AS u, b.g AS v, sqrt((a.fx-b.fx)*(a.fx-b.fx)+(a.fy-b.fy)*(a.fy-b.fy)) AS dist FROM f a, f b), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rk FROM gn) WHERE rk <= 5)"


def _features(spark, d):
    e = emb(spark, d).withColumnRenamed("grp", "g")
    return G.centroids(e, ["g"]).select("g", F.col("cx").alias("fx"), F.col("cy").alias("fy")).join(G.elevation_length(e, ["g"]), "g")


def _near(spark, d):
    f = _features(spark, d)
    return f, knn_join(f, f, 5, ("fx", "fy"), "g", "g")


@query(f"WITH {EMB}, {NEAR} SELECT round(avg(d), 6) AS sigma FROM (SELECT u, min(dist) AS d FROM near WHERE u <> v GROUP BY u)")
def sigma_nn(spark, d):
    return nearest_scale(_near(spark, d)[1]).select(*r6("sigma"))


@query(f"""WITH {EMB}, {NEAR}, a AS (SELECT n.u AS g, min(o.elev) AS low, median(o.len) AS mid FROM near n JOIN f o ON n.v = o.g GROUP BY n.u)
SELECT g, abs(elev - low) / len > 0.1 AS flagged, abs(elev - low) / len > 0.1 AND len / mid > 1.05 AS long FROM f JOIN a USING (g)""")
def stem_flag(spark, d):
    f, near = _near(spark, d)
    return stem_flags(f, near, SegmentationParams(rel_height_length_ratio=0.1, long_stem_ratio=1.05)).select("g", "flagged", "long")


PAIRS = f"{NEAR}, p AS (SELECT u AS a, v AS b, dist AS d2, x.elev AS ea, x.len AS la, y.elev AS eb, y.len AS lb FROM near JOIN f x ON u = x.g JOIN f y ON v = y.g WHERE u <> v), vo AS (SELECT *, least(eb+lb-ea, ea+la-eb) AS lo, greatest(eb+lb-ea, ea+la-eb) AS hi FROM p), vv AS (SELECT *, CASE WHEN hi = 0 OR lo <= 0 THEN 0.0 ELSE lo / hi END AS vert FROM vo)"


def _pairs(spark, d):
    f, near = _near(spark, d)
    a, b = (f.select(F.col("g").alias(f"g{t}"), F.col("elev").alias(f"e{t}"), F.col("len").alias(f"l{t}")) for t in "ab")
    p = near.where("u <> v").join(a, F.col("u") == F.col("ga")).join(b, F.col("v") == F.col("gb"))
    return p.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("dist").alias("d2"), vertical_overlap(*(F.col(c) for c in ("ea", "la", "eb", "lb"))).alias("vert"))


@query(f"WITH {EMB}, {PAIRS} SELECT a, b, round(vert, 6) AS vert FROM vv")
def vertical_overlaps(spark, d):
    return _pairs(spark, d).select("a", "b", *r6("vert"))


SCORE = f"{PAIRS}, sc AS (SELECT a, b, d2 AS d3, exp(-((1 - vert)**2) - 0.5 * (1 - vert)**2 - (d2 / 0.3)**2) AS score FROM vv)"


def _scored(spark, d):
    return _pairs(spark, d).select("a", "b", F.col("d2").alias("d3"), merge_score(F.col("vert"), F.col("vert"), F.col("d2"), F.col("d2"), F.lit(0.3), 0.5).alias("score"))


@query(f"WITH {EMB}, {SCORE} SELECT a, b, round(score, 6) AS score FROM sc")
def merge_scores(spark, d):
    return _scored(spark, d).select("a", "b", *r6("score"))


@query(f"WITH {EMB}, {SCORE}, t AS (SELECT a, max(score) AS top FROM sc GROUP BY a) SELECT a, arg_min(b, (d3, -score, b)) AS b FROM sc JOIN t USING (a) WHERE score > 0.7 * top GROUP BY a")
def best_candidate(spark, d):
    return best_candidates(_scored(spark, d), 0.7)


@query(f"""WITH {EMB}, q AS (SELECT DISTINCT grp, x, y FROM emb), e AS (SELECT a.grp, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM q a JOIN q b ON a.grp = b.grp AND (a.x <> b.x OR a.y <> b.y)
WHERE NOT EXISTS (SELECT 1 FROM q c WHERE c.grp = a.grp AND (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0)) SELECT DISTINCT grp, round(x0, 6) AS x, round(y0, 6) AS y FROM e""")
def convex_hulls(spark, d):
    h = hulls(emb(spark, d), "grp").select("grp", F.explode(F.arrays_zip("hx", "hy")).alias("c"))
    return h.select("grp", F.round("c.hx", 6).alias("x"), F.round("c.hy", 6).alias("y"))


@query(f"""WITH {EMB}, {NEAR}, q AS (SELECT DISTINCT grp, x, y FROM emb),
e AS (SELECT a.grp, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM q a JOIN q b ON a.grp = b.grp AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM q c WHERE c.grp = a.grp AND (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0)),
box AS (SELECT grp, min(x0) AS lx, min(y0) AS ly, max(y0) AS hy, 0.5 * sum(x0 * y1 - x1 * y0) AS area FROM e GROUP BY grp),
p AS (SELECT u, v, least(a.lx, b.lx) AS lx, least(a.ly, b.ly) AS ly, greatest(a.hy, b.hy) AS hy, a.area AS area_a, b.area AS area_b FROM near JOIN box a ON a.grp = u JOIN box b ON b.grp = v WHERE u <> v),
s AS (SELECT u, v, s AS side, (x0-lx)*10.0 AS x0, (y0-ly)*10.0 AS y0, (x1-lx)*10.0 AS x1, (y1-ly)*10.0 AS y1 FROM p, (VALUES (0), (1)) t(s), e WHERE e.grp = CASE s WHEN 0 THEN u ELSE v END),
r AS (SELECT u, v, unnest(range(0, ceil((hy - ly) * 10.0)::BIGINT + 1)) AS y FROM p),
i AS (SELECT u, v, side, r.y, ceil(min(x0 + (r.y-y0)*(x1-x0)/(y1-y0))) AS a, ceil(max(x0 + (r.y-y0)*(x1-x0)/(y1-y0))) AS b FROM r JOIN s USING (u, v) WHERE (y0 > r.y) <> (y1 > r.y) GROUP BY ALL),
n AS (SELECT u, v, sum(b - a) FILTER (side = 0) AS one, sum(b - a) FILTER (side = 1) AS two FROM i GROUP BY ALL),
m AS (SELECT k.u, k.v, sum(greatest(least(k.b, l.b) - greatest(k.a, l.a), 0)) AS both_ FROM i k JOIN i l ON k.u = l.u AND k.v = l.v AND k.y = l.y AND k.side = 0 AND l.side = 1 GROUP BY ALL),
h AS (SELECT k.u, k.v, k.side, k.x0, k.y0, k.x1 - k.x0 AS dx, k.y1 - k.y0 AS dy, (l.x1-l.x0)*(k.y0-l.y0) - (l.y1-l.y0)*(k.x0-l.x0) AS num, (l.x1-l.x0)*(k.y1-k.y0) - (l.y1-l.y0)*(k.x1-k.x0) AS den
  FROM s k JOIN s l ON k.u = l.u AND k.v = l.v AND k.side <> l.side),
c AS (SELECT u, v, x0, y0, dx, dy, greatest(0, max(-num / den) FILTER (den > 0)) AS t0, least(1, min(-num / den) FILTER (den < 0)) AS t1, bool_or(den = 0 AND num < 0) AS out_ FROM h GROUP BY u, v, side, x0, y0, dx, dy),
x AS (SELECT u, v, sum(0.5 * ((x0+t0*dx)*(y0+t1*dy) - (x0+t1*dx)*(y0+t0*dy))) / 100.0 AS area FROM c WHERE t1 > t0 AND NOT out_ GROUP BY u, v)
SELECT p.u, p.v, round(coalesce(both_ / least(one, two), 0.0), 6) AS lattice, round(coalesce(area / least(area_a, area_b), 0.0), 6) AS exact
FROM p LEFT JOIN n USING (u, v) LEFT JOIN m USING (u, v) LEFT JOIN x USING (u, v)""")
def hull_overlaps(spark, d):
    """Each group's hull against those of the other groups that are near by centre."""
    h = hulls(emb(spark, d), "grp")
    near = _near(spark, d)[1].where("u <> v").select("u", "v")
    a, b = (h.select(F.col("grp").alias(f"g{t}"), F.col("hx").alias(f"x{t}"), F.col("hy").alias(f"y{t}")) for t in "ab")
    both = near.join(a, F.col("u") == F.col("ga")).join(b, F.col("v") == F.col("gb"))
    return both.select("u", "v", hull_overlap("xa", "ya", "xb", "yb").alias("lattice"), hull_overlap("xa", "ya", "xb", "yb", "exact").alias("exact")).select("u", "v", *r6("lattice", "exact"))


# ---- Cut pursuit and the pipeline (held against brute force in the tests)


@query()
def cut_pursuit_components(spark, d):
    e = emb(spark, d)
    edges = knn_join(e, e, 5, exclude_self=True).select("u", "v", F.lit(1.0).alias("w"))
    return cut_pursuit(e.select(F.col("point_id").alias("v"), "x", "y", "z", F.lit(1.0).alias("w")), edges, ["x", "y", "z"], 0.05)[0]


@query()
def init_segs(spark, d):
    return init_segments(emb(spark, d), SegmentationParams(reg_strength1=0.05))


@query()
def intermediate_segs(spark, d):
    return intermediate_segments(emb(spark, d).withColumnRenamed("grp", "init"), SegmentationParams())


@query()
def final_segs(spark, d):
    """Merging of groups by label, of clusters of the points of a label that lie on one side of the plane z = 0."""
    e = emb(spark, d).withColumn("init", F.col("grp") * 2 + (F.col("z") > 0).cast("int")).withColumn("inter", F.col("init"))
    return final_segments(e, SegmentationParams(rel_height_length_ratio=0.1, long_stem_ratio=1.05))


@query()
def segment_cloud(spark, d):
    return segment(emb(spark, d), SegmentationParams(reg_strength1=0.05)).select("point_id", "init_segs", "intermediate_segs", "final_segs")


