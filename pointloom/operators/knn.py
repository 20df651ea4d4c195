"""Exact nearest neighbours and gaps, over boxes in the order of a space-filling curve.

Places are dealt to regions by ranges of their position on a Z-order curve. A region finds the nearest among its own places, which bounds how far
any other can be; a query goes on only to those regions whose box is within that bound, and these answer with what they have. The boxes of all regions,
with their counts, are a pyramid that is broadcast: some hundred bytes for each REGION places. Inside a region the same is done with boxes of a few
places (pointloom.functions.boxes), so that a dense part of the cloud has small boxes whatever lies around it. Places that repeat count once, with the
k + 1 smallest ids. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.boxes import BLOCK, FAN, SLACK, Places, Pyramid, closest
from pointloom.operators.morton import box, position
from pointloom.plans.storage import released, written

#: Places of a region, of queries and data together, about; and regions at most, beyond which regions grow instead.
REGION, REGIONS = 1 << 16, 1 << 20
#: Points of one label that are held together.
CHUNK = 1 << 10
#: Points that follow a point along the curve to which its distance is taken as a first bound, and pairs of chunks that a task takes, about.
AHEAD, TOGETHER = 16, 1 << 9
#: Rows of a batch that a region passes on.
ROWS = 1 << 13


def distance(a: list[Column], b: list[Column]) -> Column:
    total = (a[0] - b[0]) * (a[0] - b[0])
    for x, y in zip(a[1:], b[1:]):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def located(dims: list[str]) -> Column:
    """Whether a row has a place: no coordinate is null, NaN or infinite."""
    real = F.lit(True)
    for d in dims:
        real = real & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double")) & (F.abs(F.col(d).cast("double")) < float("inf"))
    return real


_LIST = "array<struct<dist: double, v: bigint>>"


def _region(dims: list[str], more: int):
    """Of one partition, sorted by key and along the curve: every query with its nearest of the partition and the bound, then each key's places as one row."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, data, ids = (table.column(c).to_numpy() for c in ("key", "data", "id"))
        xyz = np.stack([table.column(d).to_numpy() for d in dims], axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        spots, blocks = [], []
        for a, b in zip(cuts, cuts[1:]):
            own = data[a:b]
            places, q = Places(xyz[a:b][own], ids[a:b][own].astype(np.int64)), xyz[a:b][~own]
            row, near, dist = places.nearest(q, more)
            reach = np.full(len(q), np.inf)
            last = np.bincount(row, minlength=len(q)) == more
            reach[last] = dist[np.searchsorted(row, np.flatnonzero(last), "right") - 1]
            spots.append((np.full(len(q), key[a]), q, reach, np.bincount(row, minlength=len(q)), near, dist))
            if len(places.ids):
                blocks.append((key[a], places.points.tobytes(), places.ids.tobytes(), np.concatenate([places.points.min(axis=0), places.points.max(axis=0)]).tobytes(), len(places.ids)))
        keys, q, reach, many, near, dist = (np.concatenate(x) for x in zip(*spots))
        ends = np.concatenate([[0], np.cumsum(many)])
        for a in range(0, len(q), ROWS):
            b = min(a + ROWS, len(q))
            found = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x[ends[a] : ends[b]]) for x in (dist, near)], names=["dist", "v"]))
            none = pa.nulls(b - a, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number, np.int64)), pa.array(keys[a:b]), *(pa.array(np.ascontiguousarray(q[a:b, i])) for i in range(len(dims))), pa.array(reach[a:b]), found, none, none, none, pa.nulls(b - a, pa.int64())], names=names)
        for one in blocks:
            head = [pa.array([number], pa.int64()), pa.array([one[0]], pa.int64()), *(pa.nulls(1, pa.float64()) for _ in range(len(dims) + 1)), pa.nulls(1, lists)]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([x]) for x in one[1:])], names=names)

    names, lists = ["region", "key", *dims, "reach", "near", "points", "ids", "box", "n"], pa.list_(pa.struct([("dist", pa.float64()), ("v", pa.int64())]))
    return work, f"region bigint, key bigint, {', '.join(f'{d} double' for d in dims)}, reach double, near {_LIST}, points binary, ids binary, box binary, n bigint"


def _asked(dims: list[str], more: int, directory):
    """The queries that another region may have neighbours for, packed by that region."""

    def work(batches):
        pyramids = {key: (numbers, Pyramid(*boxes)) for key, (numbers, *boxes) in directory.value.items()}
        for batch in batches:
            q, key, own, reach = np.stack([batch.column(d).to_numpy() for d in dims], axis=1), batch.column("key").to_numpy(), batch.column("region").to_numpy(), np.array(batch.column("reach").to_numpy())
            found: dict[tuple[int, int], list[int]] = {}
            cuts = np.unique(np.concatenate([np.arange(0, len(q), BLOCK), np.flatnonzero(np.diff(key)) + 1, [len(q)]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if int(key[a]) not in pyramids:
                    continue
                numbers, pyramid = pyramids[int(key[a])]
                boxes, _ = pyramid.near(q[a:b].min(axis=0), q[a:b].max(axis=0), more, float(reach[a:b].max()) ** 2)
                if not (numbers[boxes][:, None] != own[a:b]).any():
                    continue
                for i in range(a, b):
                    boxes, limit2 = pyramid.near(q[i], q[i], more, float(reach[i]) ** 2)
                    reach[i] = min(reach[i], np.sqrt(limit2) * SLACK)
                    for number in numbers[boxes].tolist():
                        if number != own[i]:
                            found.setdefault((number, int(key[a])), []).append(i)
            to = list(found)
            packed = [pa.array([x[found[t]].tobytes() for t in to], pa.binary()) for x in (q, reach)]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in to], pa.int64()), pa.array([t[1] for t in to], pa.int64()), *packed], names=["to", "key", "spots", "reach"])

    return work, "to bigint, key bigint, spots binary, reach binary"


def _answers(dims: list[str], more: int):
    """For packed queries, beside the region they ask, each query with the nearest that the region has within its reach."""

    def work(batches):
        for batch in batches:
            for key, spots, reach, points, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "spots", "reach", "points", "ids"))):
                q = np.frombuffer(spots).reshape(-1, len(dims))
                row, near, dist = Places(np.frombuffer(points).reshape(-1, len(dims)), np.frombuffer(ids, np.int64)).nearest(q, more, np.frombuffer(reach))
                ends = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(dist), pa.array(near)], names=["dist", "v"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key, np.int64)), *(pa.array(np.ascontiguousarray(q[:, i])) for i in range(len(dims))), found], names=["key", *dims, "near"])

    return work, f"key bigint, {', '.join(f'{d} double' for d in dims)}, near {_LIST}"


def knn_join(queries: DataFrame, data: DataFrame, k: int, dims: tuple[str, ...] = ("x", "y", "z"), query_id: str = "point_id", data_id: str = "point_id", exclude_self: bool = False, by: str | None = None) -> DataFrame:
    """(u, v, dist, rk): the k nearest of ``data`` to each of ``queries``, nearest first, fewer only if there are fewer.

    With ``exclude_self``, v <> u. Ids are integers and unique on either side. With ``by``, an integer column of both such as the cloud, only rows of one value
    are each other's neighbours; all values share the same jobs. Rows without a place (a null, NaN or infinite coordinate) have no neighbours and
    are nobody's.
    """
    more, place = k + (1 if exclude_self else 0), [f"_p{i}" for i in range(len(dims))]
    at = [F.col(d).cast("double").alias(p) for d, p in zip(dims, place)]
    key = (F.col(by) if by else F.lit(0)).cast("bigint").alias("key")
    q_all = queries.where(located(dims)).select(F.col(query_id).alias("u"), key, *at)
    d_all = data.where(located(dims)).select(F.lit(True).alias("data"), key, F.col(data_id).cast("bigint").alias("id"), *at)
    # at one place only the smallest ids can be neighbours
    best = d_all.withColumn("_rk", F.row_number().over(Window.partitionBy("key", *place).orderBy("id"))).where(F.col("_rk") <= more).drop("_rk")
    spots = q_all.select("key", *place).distinct().select(F.lit(False).alias("data"), "key", F.lit(0).cast("bigint").alias("id"), *place)
    both = written(best.unionByName(spots))
    if by:
        stats = both.groupBy(F.col("key").alias("_k")).agg(*(f(p).alias(f"_{n}{i}") for i, p in enumerate(place) for n, f in (("lo", F.min), ("hi", F.max))))
        side = F.greatest(*(F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(len(place))))
        n, located_ = both.count(), both.join(stats, F.col("key") == F.col("_k"))
        ranged = located_.withColumn("_m", position(place, [F.col(f"_lo{i}") for i in range(len(place))], side)).select(*both.columns, "_m")
    else:
        n, low, side = box(both, place)
        ranged = both.withColumn("_m", position(place, low, side))
    parts = max(1, -(-n // max(REGION, -(-n // REGIONS))))
    ranged = (ranged.repartitionByRange(parts, "key", "_m", "data", "id") if parts > 1 else ranged.coalesce(1)).sortWithinPartitions("key", "_m")
    made = written(ranged.mapInArrow(*_region(place, more)))
    released(both)
    found = made.where("n IS NULL").select("key", *place, "near")
    if parts > 1:
        # ranges are consecutive, so at most one key in a region goes on into the next
        wide = made.groupBy("key").agg(F.min("region").alias("a"), F.max("region").alias("b")).where("a < b").select("key")
        directory: dict = {}
        for r in sorted(made.where("n IS NOT NULL").join(wide, "key", "left_semi").select("key", "region", "n", "box").collect()):
            directory.setdefault(r["key"], []).append((r["region"], r["n"], np.frombuffer(r["box"]).reshape(2, -1)))
        packed = {x: (np.array([e[0] for e in rows], np.int64), np.stack([e[2][0] for e in rows]), np.stack([e[2][1] for e in rows]), np.array([e[1] for e in rows], np.int64)) for x, rows in directory.items()}
        asked = made.where("n IS NULL").select("region", "key", *place, "reach").mapInArrow(*_asked(place, more, queries.sparkSession.sparkContext.broadcast(packed)))
        blocks = made.where("n IS NOT NULL").select(F.col("region").alias("to"), "key", "points", "ids")
        every = found.unionByName(asked.join(blocks, ["to", "key"]).mapInArrow(*_answers(place, more)))
        found = every.groupBy("key", *place).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, more).alias("near"))
    rows = q_all.join(found, ["key", *place])
    if exclude_self:
        rows = rows.withColumn("near", F.slice(F.filter("near", lambda x: x["v"] != F.col("u")), 1, k))
    return rows.select("u", F.posexplode("near").alias("rk", "n")).select("u", "n.v", "n.dist", (F.col("rk") + 1).alias("rk"))


def radius_edges(knn: DataFrame, limit: float) -> DataFrame:
    """Neighbours nearer than ``limit``."""
    return knn.where(F.col("dist") < limit)


def _chunks(dims: list[str], kind: str):
    """Of one partition, sorted by label and along the curve: a row for every CHUNK points of a label, with their box."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        label = table.column("label").combine_chunks().dictionary_encode()
        code, xyz = label.indices.to_numpy(), np.stack([table.column(d).to_numpy() for d in dims], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        at = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(starts, np.append(starts[1:], len(code)))])
        low, high = np.minimum.reduceat(xyz, at), np.maximum.reduceat(xyz, at)
        packed = [xyz[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(code)))]
        over = (number << 32) + np.arange(len(at)) // FAN
        columns = [label.dictionary.take(pa.array(code[at])), pa.array(over), pa.array((number << 32) + np.arange(len(at))), pa.array(packed, pa.binary())]
        columns += [pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(dims)) for x in (low, high)]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "over", "chunk", "points", *sides])

    sides = [f"{s}{i}" for i in range(len(dims)) for s in ("lo", "hi")]
    return work, f"label {kind}, over bigint, chunk bigint, points binary, {', '.join(f'{s} double' for s in sides)}"


def _bounds(dims: list[str], limit: float, kind: str):
    """Of one partition, sorted along the curve: the smallest distance below the limit of points of two labels that follow each other at most AHEAD apart."""

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        label = table.column("label").combine_chunks().dictionary_encode()
        code, xyz = label.indices.to_numpy().astype(np.int64), np.stack([table.column(d).to_numpy() for d in dims], axis=1)
        pairs, gaps = [np.zeros(0, np.int64)], [np.zeros(0)]
        for step in range(1, min(AHEAD, len(code) - 1) + 1):
            i = np.flatnonzero(code[:-step] != code[step:])
            total = 0.0
            for x in xyz.T:
                total = total + (x[i] - x[i + step]) * (x[i] - x[i + step])
            gap = np.sqrt(total)
            i, gap = i[gap < limit], gap[gap < limit]
            pair = np.minimum(code[i], code[i + step]) * len(label.dictionary) + np.maximum(code[i], code[i + step])
            pair, gap = np.concatenate([pairs[0], pair]), np.concatenate([gaps[0], gap])
            by = np.argsort(pair, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(pair[by]) != 0])) if len(by) else by
            pairs, gaps = [pair[by][at]], [np.minimum.reduceat(gap[by], at) if len(by) else gap]
        one, two = (label.dictionary.take(pa.array(x)) for x in np.divmod(pairs[0], len(label.dictionary)))
        yield pa.RecordBatch.from_arrays([one, two, pa.array(gaps[0])], names=["a", "b", "bound"])

    return work, f"a {kind}, b {kind}, bound double"


def _near_boxes(met: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Of pairs of boxes (of a and b, of labels ci and cj) those that may hold the closest points of the two labels and are no farther than ``bound``."""
    gap, far = F.lit(0.0), F.lit(0.0)
    for i in range(n):
        apart = F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
        reach = F.greatest(F.col(f"a_hi{i}") - F.col(f"b_lo{i}"), F.col(f"b_hi{i}") - F.col(f"a_lo{i}"))
        gap, far = gap + apart * apart, far + reach * reach
    rows = met.select("ci", "cj", "bound", *keep, gap.alias("_gap"), far.alias("_far")).where(F.col("_gap") <= F.col("bound") * F.col("bound") * SLACK)
    best = rows.groupBy("ci", "cj").agg(F.min("_far").alias("_best"))
    return rows.join(best, ["ci", "cj"]).where(F.col("_gap") <= F.col("_best") * SLACK).select("ci", "cj", "bound", *keep)


def _closest(n: int, kind: str):
    def work(batches):
        for batch in batches:
            sets = [[np.frombuffer(x).reshape(-1, n) for x in batch.column(c).to_pylist()] for c in ("a_points", "b_points")]
            gaps = [closest(a, b, x) for a, b, x in zip(*sets, batch.column("bound").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("ci"), batch.column("cj"), pa.array(gaps, pa.float64())], names=["ci", "cj", "gap"])

    return work, f"ci {kind}, cj {kind}, gap double"


def nearest_gaps(points: DataFrame, pairs: DataFrame, limit: float, label: str = "label", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(ci, cj, gap): for each of ``pairs`` (ci, cj) the smallest distance between points of the two labels, if it is below ``limit``.

    Branch and bound: points of all labels that follow each other along the curve give a first bound of each pair. A label's points are cut into chunks
    along the curve, and chunks gathered into boxes of FAN of them. Of a pair's boxes, then of the chunks in what remains, only those stay whose least distance is
    within the bound and the smallest largest one, and points meet only there, again by boxes and within the bound. So labels that overlap, however many
    points they have, meet in a number of chunks that grows with the points. A label's gap to itself is 0; points without a place or label don't count.
    """
    n, axes = len(dims), [f"_d{i}" for i in range(len(dims))]
    kind = points.schema[label].dataType.simpleString()
    wanted = pairs.select(F.col("ci").cast(kind).alias("ci"), F.col("cj").cast(kind).alias("cj")).distinct()
    own = written(points.where(located(list(dims)) & F.col(label).isNotNull()).select(F.col(label).alias("label"), *(F.col(d).cast("double").alias(a) for d, a in zip(dims, axes))))
    rows, low, side = box(own, axes)
    parts = max(1, -(-rows // REGION))
    ranged = own.withColumn("_m", position(axes, low, side))
    first = (ranged.repartitionByRange(parts, "_m") if parts > 1 else ranged.coalesce(1)).sortWithinPartitions("_m")
    ranged = (ranged.repartitionByRange(parts, "label", "_m") if parts > 1 else ranged.coalesce(1)).sortWithinPartitions("label", "_m")
    chunks = written(ranged.mapInArrow(*_chunks(axes, kind)))
    sides = [f"{s}{i}" for i in range(n) for s in ("lo", "hi")]
    over = chunks.groupBy("label", "over").agg(*((F.min if s.startswith("lo") else F.max)(s).alias(s) for s in sides))
    named = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    once = wanted.where("ci <> cj").select(F.least("ci", "cj").alias("ci"), F.greatest("ci", "cj").alias("cj")).distinct()
    along = first.mapInArrow(*_bounds(axes, limit, kind)).groupBy(F.least("a", "b").alias("ci"), F.greatest("a", "b").alias("cj")).agg(F.min("bound").alias("bound"))
    # a bound is the distance of two points, so it is the gap if nothing is nearer
    once = written(once.join(along, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("bound", F.lit(float(limit))).alias("bound")))
    released(own)
    met = once.join(named(over, "a"), F.col("ci") == F.col("a_label")).join(named(over, "b"), F.col("cj") == F.col("b_label"))
    met = _near_boxes(met, n, ["a_over", "b_over"])
    small = chunks.drop("points")
    met = met.withColumnsRenamed({"a_over": "_a", "b_over": "_b"})
    met = met.join(named(small, "a"), (F.col("_a") == F.col("a_over")) & (F.col("ci") == F.col("a_label"))).join(named(small, "b"), (F.col("_b") == F.col("b_over")) & (F.col("cj") == F.col("b_label")))
    met = written(_near_boxes(met, n, ["a_chunk", "b_chunk"]))
    held, tasks = chunks.select("chunk", "points"), max(1, min(1 << 11, -(-met.count() // TOGETHER)))
    met = met.join(named(held, "a"), "a_chunk").repartition(tasks, "b_chunk").join(named(held, "b").hint("shuffle_hash"), "b_chunk").select("ci", "cj", "bound", "a_points", "b_points")
    near = met.mapInArrow(*_closest(n, kind)).unionByName(once.withColumnRenamed("bound", "gap"))
    gaps = near.groupBy("ci", "cj").agg(F.min("gap").alias("gap")).where(F.col("gap") < limit)
    found = gaps.select(F.col("ci").alias("_i"), F.col("cj").alias("_j"), "gap")
    apart = wanted.where("ci <> cj").join(found, (F.least("ci", "cj") == F.col("_i")) & (F.greatest("ci", "cj") == F.col("_j"))).select("ci", "cj", "gap")
    return apart.union(wanted.where("ci = cj").withColumn("gap", F.lit(0.0)))
