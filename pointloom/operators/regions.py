"""Minimum cuts of networks that no task can hold, by regions.

Vertices are cut into regions of bounded size by ranges of their position on a Z-order curve. In a sweep every region moves its excess to the sink
and across its borders, each in a call of its own (pointloom.functions.maxflow), and then learns what its neighbours sent and how far they
are from the sink. What was sent to a vertex whose label has risen too far comes back; both sides decide that from the same two labels. Sweeps end when
nothing crosses a border. A last walk from the sink over the regions finds the smallest sink side, which doesn't depend on the regions.

Before that, regions settle the vertices whose side is clear from their own arcs. Where few enough are left open, as in large components, whose centres are
far apart, these are solved in one task without sweeps.

A region's state is one row of packed arrays. Only sums and the labels in use come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.maxflow import FAR, Region, arcs, decided, smallest_side
from pointloom.operators.morton import box, position
from pointloom.plans.storage import released, written

#: The arrays of a region: of its vertices, of the arcs between them, and of the arcs to other regions, sorted by region and ends.
ARRAYS = {"ids": "<i8", "excess": "<i8", "sink": "<i8", "ptr": "<i8", "head": "<i4", "cap": "<i8", "rev": "<i4", "at": "<i4", "to": "<i8", "out": "<i8", "far": "<i4", "near": "<i4", "sent": "<i8"}
_STATE = "region bigint, " + ", ".join(f"{a} binary" for a in ARRAYS) + ", pushed bigint, labels array<int>, mail array<struct<to: bigint, sent: binary, near: binary>>"


def by_region(vertices: DataFrame, dims: list[str], most: int) -> DataFrame:
    """``vertices`` (v, ...) with region, numbers of ranges of about ``most`` / 2 vertices along the curve. Written, so that they hold."""
    n, low, side = box(vertices, dims)
    parts = max(1, -(-2 * n // max(1, most)))
    ranged = vertices.withColumn("_m", position(dims, low, side))
    if parts > 1:
        ranged = ranged.repartitionByRange(parts, "_m", "v").withColumn("region", F.spark_partition_id().cast("bigint"))
    else:
        ranged = ranged.withColumn("region", F.lit(0).cast("bigint"))
    return written(ranged.drop("_m"))


def lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, mine, other, to, cap): edges (u, v, cap) by region, those within one once and those between two for each; to is the other end's region."""
    whole = edges.where("u <> v AND cap > 0").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("cap").alias("cap"))
    own = vertices.select("v", "region")
    both = whole.join(own.toDF("a", "ra"), "a").join(own.toDF("b", "rb"), "b")
    one = both.select(F.col("ra").alias("region"), F.col("a").alias("mine"), F.col("b").alias("other"), F.col("rb").alias("to"), "cap")
    two = both.where("ra <> rb").select(F.col("rb").alias("region"), F.col("b").alias("mine"), F.col("a").alias("other"), F.col("ra").alias("to"), "cap")
    return written(one.unionByName(two))


def _loaded(row: pd.Series) -> dict[str, np.ndarray]:
    return {a: np.frombuffer(row[a], t) for a, t in ARRAYS.items()}


def _swept(key: int, s: dict[str, np.ndarray], gap: int) -> pd.DataFrame:
    """The region's row after it has moved its excess, with mail for its neighbours."""
    far = np.where(s["far"] > gap, FAR, s["far"])
    region = Region(s["excess"], s["sink"], s["ptr"], s["head"].astype(np.int64), s["cap"], s["rev"].astype(np.int64), s["at"], s["out"], far)
    sent = region.discharge()
    near = region.label[s["at"]] if len(s["at"]) else s["near"]
    s = s | {"excess": region.excess, "sink": region.sink, "cap": region.cap, "out": region.out, "far": far, "near": near, "sent": sent}
    mail = [{"to": int(to), "sent": sent[a:b].astype("<i8").tobytes(), "near": near[a:b].astype("<i4").tobytes()} for to, a, b in _stretches(s["to"])]
    row = {"region": key} | {a: np.ascontiguousarray(s[a], t).tobytes() for a, t in ARRAYS.items()}
    return pd.DataFrame([row | {"pushed": int(sent.sum()), "labels": np.unique(near).tolist(), "mail": mail}])


def _stretches(to: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
    return [(int(to[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def _begin(vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """The first sweep of a region, from its vertices and lines."""
    vertices = vertices.sort_values("v")
    key, ids, n = int(vertices["region"].iloc[0]), vertices["v"].to_numpy(np.int64), len(vertices)
    inner, outer = near[near["to"] == key], near[near["to"] != key]
    outer = outer.assign(low=outer[["mine", "other"]].min(axis=1), high=outer[["mine", "other"]].max(axis=1)).sort_values(["to", "low", "high"])
    place = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
    source, sink = vertices["to_source"].to_numpy(np.int64), vertices["to_sink"].to_numpy(np.int64)
    straight, zero = np.minimum(source, sink), np.zeros(len(outer), np.int64)
    state = {"ids": ids, "excess": source - straight, "sink": sink - straight, "at": place(outer["mine"]), "to": outer["to"].to_numpy(np.int64), "out": outer["cap"].to_numpy(np.int64), "far": zero, "near": zero, "sent": zero}
    return _swept(key, state | arcs(n, place(inner["mine"]), place(inner["other"]), inner["cap"].to_numpy(np.int64)), FAR)


def _received(s: dict[str, np.ndarray], mail: pd.DataFrame) -> dict[str, np.ndarray]:
    """The state with what neighbours sent taken in, and what they can't take given back."""
    excess, out, far = s["excess"].copy(), s["out"].copy(), s["far"].copy()
    place = {to: slice(a, b) for to, a, b in _stretches(s["to"])}
    for sender, sent, near in zip(mail["sender"], mail["sent"], mail["near"]):
        own = place[sender]
        theirs, label = np.frombuffer(sent, "<i8"), np.frombuffer(near, "<i4")
        back = np.where(label > s["near"][own].astype(np.int64) + 1, s["sent"][own], 0)
        got = np.where(s["near"][own] <= label.astype(np.int64) + 1, theirs, 0)
        out[own] += back + got
        np.add.at(excess, s["at"][own], back + got)
        far[own] = label
    return s | {"excess": excess, "out": out, "far": far}


def _sweep(gap: int):
    def work(state: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        s = _loaded(state.iloc[0])
        return _swept(int(state["region"].iloc[0]), _received(s, mail), gap)

    return work


def _reached(s: dict[str, np.ndarray], mail: pd.DataFrame) -> np.ndarray:
    """Which vertices reach the sink, or a vertex outside that is known to."""
    far = np.full(len(s["at"]), FAR)
    place = {to: slice(a, b) for to, a, b in _stretches(s["to"])}
    for sender, near in zip(mail["sender"], mail["near"]):
        far[place[sender]] = np.frombuffer(near, "<i4")
    region = Region(s["excess"], s["sink"], s["ptr"], s["head"].astype(np.int64), s["cap"], s["rev"].astype(np.int64), s["at"], s["out"], far)
    region.rings()
    return region.label < FAR


def _walk(state: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
    s = _loaded(state.iloc[0])
    flag = np.where(_reached(s, mail)[s["at"]], 0, FAR).astype("<i4")
    rows = [{"sender": int(state["region"].iloc[0]), "to": to, "near": flag[a:b].tobytes(), "reached": int((flag[a:b] == 0).sum())} for to, a, b in _stretches(s["to"])]
    return pd.DataFrame(rows, columns=["sender", "to", "near", "reached"])


def _sides(state: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
    s = _loaded(state.iloc[0])
    return pd.DataFrame({"v": s["ids"], "side": _reached(s, mail)})


def _gap(labels: list[int]) -> int:
    """The largest label below the first that no border vertex has; what lies above it can't reach the sink."""
    have = {x for x in labels if x < FAR}
    gap = 0
    while gap in have:
        gap += 1
    return gap - 1


def _decide(vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """Rows of a region's vertices (other is null; amount: the surplus left), of the arcs between open ones, once, and of the arcs to other regions."""
    vertices = vertices.sort_values("v")
    key, ids = int(vertices["region"].iloc[0]), vertices["v"].to_numpy(np.int64)
    inner, outer = near[near["to"] == key], near[near["to"] != key]
    place = lambda x: np.searchsorted(ids, x.to_numpy(np.int64))
    a, b, c = place(inner["mine"]), place(inner["other"]), inner["cap"].to_numpy(np.int64)
    at, outside = place(outer["mine"]), np.zeros(len(ids), np.int64)
    np.add.at(outside, at, outer["cap"].to_numpy(np.int64))
    net = arcs(len(ids), a, b, c)
    known, rest = decided((vertices["to_source"] - vertices["to_sink"]).to_numpy(np.int64), net["ptr"], net["head"], net["cap"], outside)
    both = (known[a] == 0) & (known[b] == 0)
    rows = [(ids, None, known, rest, False), (ids[a[both]], ids[b[both]], 0, c[both], False), (ids[at], outer["other"].to_numpy(np.int64), known[at], outer["cap"].to_numpy(np.int64), True)]
    return pd.concat([pd.DataFrame({"v": v, "other": pd.array([None] * len(v) if o is None else o, "Int64"), "known": k, "amount": x, "border": t}) for v, o, k, x, t in rows])


def _open_sides(rows: pd.DataFrame) -> pd.DataFrame:
    """The sides of all open vertices, from _decide()'s rows of them; those of borders have open vertices as other ends."""
    one = rows["other"].isna()
    own = rows[one].sort_values("v")
    ids, surplus = own["v"].to_numpy(np.int64), own["amount"].to_numpy(np.int64)
    arc = rows[~one]
    place = lambda x: np.searchsorted(ids, x.to_numpy(np.int64))
    gone = arc[arc["known"] > 0]
    np.add.at(surplus, place(gone["other"]), np.where(gone["known"] == 1, gone["amount"], -gone["amount"]))
    # an arc between two open vertices of two regions comes from both
    arc = arc[(arc["known"] == 0) & (~arc["border"] | (arc["v"] < arc["other"]))]
    return pd.DataFrame({"v": ids, "side": smallest_side(surplus, **arcs(len(ids), place(arc["v"]), place(arc["other"]), arc["amount"].to_numpy(np.int64)))})


def _cut_of_few(vertices: DataFrame, near: DataFrame, most: int) -> DataFrame | None:
    """As cut(), in one task after the regions have settled what is clear, or None if more than ``most`` vertices are open then."""
    made = written(vertices.groupBy("region").cogroup(near.groupBy("region")).applyInPandas(_decide, "v bigint, other bigint, known int, amount bigint, border boolean"))
    left = made.where("other IS NULL AND known = 0")
    if left.count() > most:
        released(made)
        return None
    border = made.where("border").join(left.select(F.col("v").alias("other")), "other", "left_semi").select(made.columns)
    kernel = left.unionByName(made.where("other IS NOT NULL AND NOT border")).unionByName(border)
    solved = kernel.groupBy().applyInPandas(_open_sides, "v bigint, side boolean")
    out = written(made.where("other IS NULL AND known > 0").select("v", (F.col("known") == 2).alias("side")).unionByName(solved))
    released(made)
    return out


def cut(vertices: DataFrame, near: DataFrame, max_sweeps: int = 10_000, most: int = 0) -> DataFrame:
    """(v, side): the smallest sink side of the minimum cuts, of rows of v, region, to_source and to_sink (capacities), and lines().

    Written to the shared folder. Without sweeps if the regions leave at most ``most`` vertices open. Sweeps that don't end are an error.
    """
    if most:
        few = _cut_of_few(vertices, near, most)
        if few is not None:
            return few
    state = written(vertices.groupBy("region").cogroup(near.groupBy("region")).applyInPandas(_begin, _STATE))
    for _ in range(max_sweeps):
        if not state.agg(F.sum("pushed")).first()[0]:
            break
        labels = [r[0] for r in state.select(F.explode("labels")).distinct().collect()]
        mail = state.select(F.col("region").alias("sender"), F.explode("mail").alias("m")).select("sender", F.col("m.to").alias("region"), "m.sent", "m.near")
        then = written(state.groupBy("region").cogroup(mail.groupBy("region")).applyInPandas(_sweep(_gap(labels)), _STATE))
        released(state)
        state = then
    else:
        raise RuntimeError("the flow didn't settle")
    walk, before = None, -1
    while True:
        if walk is None:
            mail = state.select(F.col("region").alias("sender"), F.explode("mail").alias("m")).select("sender", F.col("m.to").alias("to"), "m.near").withColumn("near", _far_flags("near"))
        else:
            mail = walk
        then = written(state.groupBy("region").cogroup(mail.groupBy("to")).applyInPandas(_walk, "sender bigint, to bigint, near binary, reached bigint"))
        reached = then.agg(F.sum("reached")).first()[0] or 0
        if walk is not None:
            released(walk)
        walk = then
        if reached == before:
            break
        before = reached
    out = written(state.groupBy("region").cogroup(walk.groupBy("to")).applyInPandas(_sides, "v bigint, side boolean"))
    released(state, walk)
    return out


def _far_flags(name: str) -> Column:
    """Of packed labels as many that say nothing is reached yet."""
    return F.unhex(F.repeat(F.lit(np.array([FAR], "<i4").tobytes().hex()), (F.octet_length(name) / 4).cast("int")))
