"""Piecewise-constant approximation on a graph by L0 cut pursuit (Landrieu and Obozinski 2017).

Minimises 1/2 sum w |o - x|^2 + reg * sum of the weights of edges whose ends have different x. A component is split by minimum cuts between two
centres, cut edges stay cut, and what remains connected is the next round's component. As no live edge leaves a component, components are
independent: a grouped call splits components of at most REGION vertices, their flows found together. Larger ones, as the whole graph is in its first round,
are split together by Spark rounds: centres are aggregates, and the cuts are found by regions (pointloom.operators.regions), so that no group has more
than that. Once no component is larger, groups of them go through all rounds left, and the sums over groups show which round was the last.
A whole graph of at most REGION vertices goes through all rounds in one grouped call, with the same result.

Graphs: vertices(v, o1..oD, w) and edges(u, v, w), each edge once.
"""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.maxflow import arcs, parts, smallest_side
from pointloom.operators.components import label_vertices
from pointloom.operators.groups import border_weights, crossing, medians, two_centers, weighted_means
from pointloom.operators.regions import by_region, cut, lines
from pointloom.params import CutPursuitParams
from pointloom.plans.storage import released, written

#: Vertices of a graph, component or region that one task solves; each has some hundred bytes, and edges besides.
REGION = 1 << 17


@dataclass(frozen=True)
class Round:
    """One round: how many components, vertices of saturated ones, the energy, and how long it took."""

    number: int
    components: int
    saturated: int
    fidelity: float
    penalty: float
    seconds: float = 0.0

    @property
    def energy(self) -> float:
        return self.fidelity + self.penalty


def first_sides(obs: np.ndarray) -> np.ndarray:
    """Above the median of the widest dimension or not."""
    d = int(np.argmax(obs.var(axis=0)))
    return obs[:, d] > np.median(obs[:, d])


def kmeans_first_sides(obs: np.ndarray, w: np.ndarray, keys: np.ndarray, steps: int) -> np.ndarray:
    """The nearer of two centres: the best, by energy, of those from pairs of seeded vertices and from the median, after ``steps`` means each.

    ``keys``: from 0 to 1, a column for each first vertex, the one of the smallest, and then for each second one, drawn by weight and squared distance.
    """
    square = lambda c: sum((obs[:, i] - c[i]) ** 2 for i in range(obs.shape[1]))
    mean = lambda m: np.array([(w[m] * o[m]).sum() / w[m].sum() for o in obs.T])
    pairs, half = [], keys.shape[1] // 2
    for r in range(half):
        a = obs[int(np.argmin(keys[:, r]))]
        weight = w * square(a)
        late = np.where(weight > 0, -np.log(keys[:, half + r]) / np.where(weight > 0, weight, 1), np.inf)
        pairs.append((a, obs[int(np.argmin(late))]))
    side = first_sides(obs)
    if w[side].sum() > 0 and w[~side].sum() > 0:
        pairs.append((mean(~side), mean(side)))
    best = None
    for a, b in pairs:
        for _ in range(steps):
            side = square(a) > square(b)
            if not (w[side].sum() > 0 and w[~side].sum() > 0):
                break
            a, b = mean(~side), mean(side)
        da, db = square(a), square(b)
        energy = float((w * np.minimum(da, db)).sum())
        if best is None or energy < best[0]:
            best = energy, da > db
    return best[1]


def terminals(obs: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Capacities from the source and to the sink: the difference of the costs of the two centres, scaled and cut off."""
    cost_a = 0.5 * w * ((obs - a) ** 2).sum(axis=1)
    cost_b = 0.5 * w * ((obs - b) ** 2).sum(axis=1)
    diff = (np.abs(cost_a - cost_b) * scale).astype(np.int64)
    near_a = cost_a <= cost_b
    return np.where(near_a, 0, diff), np.where(near_a, diff, 0)


def terminal_capacities(vertices: DataFrame, obs: list[str], scale: int = 1000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(v, to_source, to_sink) and columns to ``keep`` of rows of v, the observations, w and both centres of the vertex's component (a_, b_)."""

    def work(batches):
        for rows in batches:
            near = lambda t: rows[[f"{t}{o}" for o in obs]].to_numpy(float)
            source, sink = terminals(near(""), rows["w"].to_numpy(float), near("a_"), near("b_"), scale)
            yield pd.DataFrame({"v": rows["v"], "to_source": source, "to_sink": sink} | {c: rows[c] for c in keep})

    kept = "".join(f", {c} {vertices.schema[c].dataType.simpleString()}" for c in keep)
    return vertices.mapInPandas(work, f"v long, to_source long, to_sink long{kept}")


def split_components(obs: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, ew: np.ndarray, cuts: np.ndarray, reg: float, p: CutPursuitParams, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The parts that components fall into, as smallest vertices, and for each component whether it is saturated. ``keys``: see kmeans_first_sides().

    A component's vertices follow each other, from one of ``cuts`` to before the next. No edge joins two, so that their flows are found together.
    """
    n, of, spans = len(obs), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    side = np.concatenate([first_sides(obs[a:b]) if keys is None else kmeans_first_sides(obs[a:b], w[a:b], keys[a:b], p.steps) for a, b in spans])
    net = arcs(n, u, v, (ew * reg * p.scale).astype(np.int64) * p.edge_multiplier)
    saturated, a_, b_ = np.zeros(len(spans), bool), *np.zeros((2, len(spans), obs.shape[1]))
    for _ in range(p.flow_steps):
        for i, (a, b) in enumerate(spans):
            if not saturated[i]:
                o, x, s = obs[a:b], w[a:b], side[a:b]
                wa, wb = x[~s].sum(), x[s].sum()
                saturated[i] = wa == 0 or wb == 0
                if not saturated[i]:
                    a_[i], b_[i] = (x[~s, None] * o[~s]).sum(axis=0) / wa, (x[s, None] * o[s]).sum(axis=0) / wb
        if saturated.all():
            break
        to_source, to_sink = terminals(obs, w, a_[of], b_[of], p.scale)
        # the sides of saturated ones don't matter any more; without terminals they have no flow
        side = smallest_side(np.where(saturated[of], 0, to_source - to_sink), **net)
    live = (side[u] == side[v]) & ~saturated[of[u]]
    return np.where(saturated[of], np.asarray(cuts)[of], parts(n, u[live], v[live])), saturated


def _energy(obs: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, ew: np.ndarray, reg: float, comp: np.ndarray) -> tuple[float, float]:
    total = np.bincount(comp, w)
    mean = np.stack([np.bincount(comp, w * o) / np.where(total > 0, total, 1) for o in obs.T], axis=1)
    return float(0.5 * (w * ((obs - mean[comp]) ** 2).sum(axis=1)).sum()), float(reg * ew[comp[u] != comp[v]].sum())


def solved(obs: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, ew: np.ndarray, reg: float, p: CutPursuitParams, keys: np.ndarray | None = None) -> tuple[np.ndarray, list[Round]]:
    """The smallest vertex of each vertex's component, and the rounds, of a whole graph."""
    n = len(obs)
    comp, stable, full = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    before = _energy(obs, w, u, v, ew, reg, comp)[0]
    rounds: list[Round] = []
    for number in range(1, p.max_rounds + 1):
        began = time.perf_counter()
        comp, stable, full = split_all(obs, w, u, v, ew, comp, stable, full, reg, p, number == 1, keys)
        fid, pen = _energy(obs, w, u, v, ew, reg, comp)
        rounds.append(Round(number, len(np.unique(comp)), int(full.sum()), fid, pen, time.perf_counter() - began))
        if full.all() or before <= 0 or (before - fid - pen) / before < p.stop_ratio:
            break
        before = fid + pen
    return comp, rounds


def split_all(obs: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, ew: np.ndarray, comp: np.ndarray, stable: np.ndarray, full: np.ndarray, reg: float, p: CutPursuitParams, first: bool = False, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest vertex of each vertex's component, whether that was left whole, and whether it is saturated, after all that weren't left whole before are split."""
    n = len(obs)
    todo = np.flatnonzero(~stable)
    own = todo[np.argsort(comp[todo], kind="stable")]
    if not len(own):
        return comp, stable, full
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(comp[own])) + 1, [len(own)]])
    place = np.zeros(n, np.int64)
    place[own] = np.arange(len(own))
    inner = np.flatnonzero((comp[u] == comp[v]) & ~stable[u])
    label, saturated = split_components(obs[own], w[own], place[u[inner]], place[v[inner]], ew[inner], cuts, reg, p, None if keys is None else keys[own])
    if first and saturated.all():  # the whole graph may have several parts
        label = parts(n, u, v)
    whole = np.logical_and.reduceat(label == np.repeat(cuts[:-1], np.diff(cuts)), cuts[:-1])
    comp, stable, full = comp.copy(), stable.copy(), full.copy()
    comp[own], full[own], stable[own] = own[label], np.repeat(saturated, np.diff(cuts)), np.repeat(whole & (not first), np.diff(cuts))
    return comp, stable, full


def _keys(p: CutPursuitParams) -> list:
    """The columns of a vertex that seed the starts, if k-means is asked for: numbers between 0 and 1 that depend on the vertex alone."""
    if p.start not in ("median", "kmeans"):
        raise ValueError(f"start {p.start!r}")
    number = lambda i: (F.shiftrightunsigned(F.xxhash64(F.col("v").cast("bigint"), F.lit(p.seed), F.lit(i)), 11) + 0.5) / float(1 << 53)
    return [number(i).alias(f"_key{i}") for i in range(2 * p.restarts)] if p.start == "kmeans" else []


def _keys_of(vertices: pd.DataFrame, p: CutPursuitParams) -> np.ndarray | None:
    return vertices[[f"_key{i}" for i in range(2 * p.restarts)]].to_numpy(float) if p.start == "kmeans" else None


_ROUND = ["number", "components", "saturated", "fidelity", "penalty", "seconds"]
_SOLVED = "key long, v long, comp long, number int, components long, saturated long, fidelity double, penalty double, seconds double"


def _whole(obs: list[str], reg: float, p: CutPursuitParams):
    def work(vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("v")
        ids = vertices["v"].to_numpy()
        u, v = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("u", "v"))
        comp, rounds = solved(vertices[obs].to_numpy(float), vertices["w"].to_numpy(float), u, v, edges["w"].to_numpy(float), reg, p, _keys_of(vertices, p))
        labels = pd.DataFrame({"v": ids, "comp": ids[comp]}).astype("Int64")
        done = pd.DataFrame([vars(r) for r in rounds]).astype({"number": "Int32", "components": "Int64", "saturated": "Int64"})
        out = pd.concat([labels, done], ignore_index=True)
        out["key"] = int(vertices["key"].iloc[0])
        return out[["key", "v", "comp", *_ROUND]]

    return work


_BINNED = f"key long, v long, comp long, full boolean, stable boolean, final boolean, {_SOLVED.split('comp long, ')[1]}"


def _grouped(obs: list[str], reg: float, p: CutPursuitParams, most: int):
    """Of components c of one graph: each vertex's component and how that is, in ``most`` rounds or until all are left whole, the round then being final; and each round's sums."""

    def work(vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("v")
        ids, o, w, ew = vertices["v"].to_numpy(), vertices[obs].to_numpy(float), vertices["w"].to_numpy(float), edges["w"].to_numpy(float)
        u, v, comp = (np.searchsorted(ids, x.to_numpy()) for x in (edges["u"], edges["v"], vertices["c"]))
        keys, stable, full = _keys_of(vertices, p), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        labels, rounds = [], []
        for number in range(1, most + 1):
            began = time.perf_counter()
            if not stable.all():
                comp, stable, full = split_all(o, w, u, v, ew, comp, stable, full, reg, p, keys=keys)
                sums = len(np.unique(comp)), int(full.sum()), *_energy(o, w, u, v, ew, reg, comp)
                labels.append(pd.DataFrame({"v": ids, "comp": ids[comp], "full": full, "stable": stable, "final": number == most or bool(stable.all()), "number": number}))
            rounds.append(Round(number, *sums, time.perf_counter() - began))
        done = pd.DataFrame([vars(r) for r in rounds]).astype({"number": "Int32", "components": "Int64", "saturated": "Int64"})
        labels = pd.concat(labels).astype({"v": "Int64", "comp": "Int64", "full": "boolean", "stable": "boolean", "final": "boolean", "number": "Int32"})
        out = pd.concat([labels, done], ignore_index=True)
        out["key"] = int(vertices["key"].iloc[0])
        return out[["key", "v", "comp", "full", "stable", "final", *_ROUND]]

    return work


def median_sides(vertices: DataFrame, obs: list[str], by: str = "comp") -> DataFrame:
    """``vertices`` with side: above the component's median in its widest dimension."""
    middle = medians(vertices, [by], tuple(obs)).withColumnsRenamed({f"med_{o}": f"_m{i}" for i, o in enumerate(obs)})
    stats = vertices.groupBy(by).agg(*(F.var_pop(o).alias(f"_v{i}") for i, o in enumerate(obs))).join(middle, by)
    side = F.lit(False)
    best = F.greatest(*(F.col(f"_v{i}") for i in range(len(obs)))) if len(obs) > 1 else F.col("_v0")
    for i in reversed(range(len(obs))):
        side = F.when(F.col(f"_v{i}") == best, F.col(obs[i]) > F.col(f"_m{i}")).otherwise(side)
    return vertices.join(stats, by).withColumn("side", side).drop(*(f"_{k}{i}" for k in "vm" for i in range(len(obs))))


def kmeans_sides(vertices: DataFrame, obs: list[str], p: CutPursuitParams, by: str = "comp") -> DataFrame:
    """``vertices`` with side, as kmeans_first_sides() has it, of components of any size: centres are drawn by smallest keys and moved by sums of groups.

    All starts of all components go on together, a join and an aggregate for each step.
    """
    names, starts = [f"_key{i}" for i in range(2 * p.restarts)], range(p.restarts + 1)
    if not set(names) <= set(vertices.columns):
        vertices = vertices.select(*vertices.columns, *_keys(p))
    square = lambda c: sum((F.col(o) - F.col(f"{c}_{o}")) * (F.col(o) - F.col(f"{c}_{o}")) for o in obs)
    drawn = lambda c, key: F.min_by(F.struct(*obs), F.struct(key, F.col("v"))).alias(c)
    spread = lambda cs: [F.col(f"{c}.{o}").alias(f"{c}_{o}") for c in cs for o in obs]
    one = vertices.groupBy(by).agg(*(drawn(f"a{r}", F.col(f"_key{r}")) for r in range(p.restarts))).select(by, *spread([f"a{r}" for r in range(p.restarts)]))
    late = lambda r: F.coalesce(-F.ln(f"_key{p.restarts + r}") / F.when(F.col("w") * square(f"a{r}") > 0, F.col("w") * square(f"a{r}")), F.lit(float("inf")))
    two = vertices.join(one, by).groupBy(by).agg(*(drawn(f"b{r}", late(r)) for r in range(p.restarts))).select(by, *spread([f"b{r}" for r in range(p.restarts)]))
    last = p.restarts
    middle = two_centers(median_sides(vertices, obs, by), obs, by)
    middle = middle.select(by, *(F.when(~F.col("saturated"), F.col(f"{t}_{o}")).alias(f"{t}{last}_{o}") for t in "ab" for o in obs))
    centres = written(one.join(two, by).join(middle, by))
    columns = [f"{t}{r}_{o}" for r in starts for t in "ab" for o in obs]
    for _ in range(p.steps):
        met = vertices.join(centres, by)
        sums = []
        for r in starts:
            far = square(f"a{r}") > square(f"b{r}")
            sums += [F.sum(F.when(on, F.col("w") * x)).alias(f"_{t}{r}_{i}") for t, on in (("a", ~far), ("b", far)) for i, x in enumerate((F.lit(1.0), *map(F.col, obs)))]
        moved = met.groupBy(by).agg(*sums, *(F.first(c).alias(c) for c in columns))
        both = lambda r: (F.col(f"_a{r}_0") > 0) & (F.col(f"_b{r}_0") > 0)
        before, centres = centres, written(moved.select(by, *(F.when(both(r), F.try_divide(F.col(f"_{t}{r}_{i + 1}"), F.col(f"_{t}{r}_0"))).otherwise(F.col(f"{t}{r}_{o}")).alias(f"{t}{r}_{o}") for r in starts for t in "ab" for i, o in enumerate(obs))))
        released(before)
    met = vertices.join(centres, by)
    energies_ = [F.coalesce(F.sum(F.col("w") * F.least(square(f"a{r}"), square(f"b{r}"))), F.lit(float("inf"))) for r in starts]
    best = met.groupBy(by).agg(F.array_min(F.array(*(F.struct(e.alias("e"), F.lit(r).alias("r")) for r, e in zip(starts, energies_))))["r"].alias("_best"))
    side = F.lit(False)
    for r in starts:
        side = F.when(F.col("_best") == r, F.coalesce(square(f"a{r}") > square(f"b{r}"), F.lit(False))).otherwise(side)
    return met.join(best, by).withColumn("side", side).select(*vertices.columns, "side")


def split_large(vertices: DataFrame, edges: DataFrame, obs: list[str], reg: float, p: CutPursuitParams, most: int | None = None) -> DataFrame:
    """(v, comp, saturated): the parts that components fall into, by smallest vertices, of any size and all at once.

    vertices have comp, the observations and w; edges (u, v, w) are those within components. A region holds about ``most`` / 2 vertices.
    """
    placed = by_region(vertices, obs, most or REGION)
    capacity = (F.col("w") * reg * p.scale).cast("bigint") * p.edge_multiplier
    near = lines(placed, edges.select("u", "v", capacity.alias("cap")))
    start = median_sides(placed, obs) if p.start == "median" else kmeans_sides(placed, obs, p)
    sides = written(start.select("v", "side"))
    made = [placed, near]
    for _ in range(p.flow_steps):
        now = placed.join(sides.select("v", "side"), "v")
        now = now.join(two_centers(now, obs), "comp")
        own = now.select("v", *obs, "w", *(F.coalesce(f"{t}_{o}", F.lit(0.0)).alias(f"{t}_{o}") for t in "ab" for o in obs), "region", "side", "saturated")
        asked = terminal_capacities(own, obs, p.scale, ("region", "side", "saturated"))
        asked = written(asked.select("v", "region", "side", "saturated", *(F.when(F.col("saturated"), 0).otherwise(F.col(c)).alias(c) for c in ("to_source", "to_sink"))))
        cuts = cut(asked, near, most=most or REGION)
        made += [sides, asked, cuts]
        sides = written(asked.join(cuts.withColumnRenamed("side", "_cut"), "v").select("v", F.when(F.col("saturated"), F.col("side")).otherwise(F.col("_cut")).alias("side"), "saturated"))
    live = edges.join(sides.select(F.col("v").alias("_u"), F.col("side").alias("su")), F.col("u") == F.col("_u")).join(sides.select(F.col("v").alias("_v"), F.col("side").alias("sv")), F.col("v") == F.col("_v")).where("su = sv").select("u", "v")
    out = written(label_vertices(vertices, live).withColumnRenamed("label", "comp").join(sides.select("v", "saturated"), "v"))
    released(*made, sides)
    return out


def energies(vertices: DataFrame, edges: DataFrame, labels: DataFrame, obs: list[str], reg: float) -> DataFrame:
    """(key, fidelity, penalty) of labels (v, comp), for each key of vertices and edges."""
    now = vertices.join(labels.select("v", "comp"), "v")
    near = now.join(weighted_means(now, ["comp"], obs), "comp")
    square = sum((F.col(o) - F.col(f"m_{o}")) * (F.col(o) - F.col(f"m_{o}")) for o in obs)
    fid = near.groupBy("key").agg(F.sum(0.5 * F.col("w") * square).alias("fidelity"))
    pen = crossing(edges, labels).groupBy("key").agg((F.lit(float(reg)) * F.sum("w")).alias("penalty"))
    return fid.join(pen, "key", "left").select("key", "fidelity", F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


def energy(vertices: DataFrame, edges: DataFrame, labels: DataFrame, obs: list[str], reg: float) -> tuple[float, float]:
    """Fidelity and penalty of labels (v, comp)."""
    one = energies(vertices.withColumn("key", F.lit(0)), edges.withColumn("key", F.lit(0)), labels, obs, reg).first()
    return (one["fidelity"] or 0.0, one["penalty"]) if one else (0.0, 0.0)


def cut_pursuit(vertices: DataFrame, edges: DataFrame, obs: list[str], reg: float, params: CutPursuitParams | None = None) -> tuple[DataFrame, list[Round]]:
    """(v, comp), comp the smallest vertex of the component, and what each round did.

    Rounds end when all vertices are in saturated components, when the energy falls by less than stop_ratio of it, or at max_rounds. The round that
    ends them counts. A component that was left whole once is left alone from then on.
    """
    labels, rounds = cut_pursuits(vertices, edges, obs, reg, params)
    return labels, [Round(*r) for r in rounds.orderBy("number").select(*_ROUND).collect()]


def cut_pursuits(vertices: DataFrame, edges: DataFrame, obs: list[str], reg: float, params: CutPursuitParams | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As cut_pursuit() for many graphs at once, one for each value of ``by``, an integer column of vertices; edges join vertices of one graph.

    The rounds come as a table (key, number, components, saturated, fidelity, penalty, seconds). Graphs share their jobs, and each ends by itself.
    """
    p = params or CutPursuitParams()
    key = (F.col(by) if by else F.lit(0)).cast("bigint").alias("key")
    vertices = written(vertices.select("v", key, *(F.col(o).cast("double").alias(o) for o in obs), F.col("w").cast("double").alias("w"), *_keys(p)))
    edges = edges.where("u <> v").select("u", "v", F.col("w").cast("double").alias("w"))
    edges = written(edges.join(vertices.select(F.col("v").alias("u"), "key"), "u") if by else edges.withColumn("key", F.lit(0).cast("bigint")))
    large = written(vertices.groupBy("key").count().where(F.col("count") > REGION).select("key"))
    some = not large.isEmpty()
    only = lambda df, how: df.join(large, "key", how) if some else df
    one = only(vertices, "left_anti").groupBy("key").cogroup(only(edges, "left_anti").groupBy("key"))
    made = written(one.applyInPandas(_whole(obs, reg, p), _SOLVED))
    labels, rounds = made.where("v IS NOT NULL").select("v", "comp"), made.where("number IS NOT NULL").select("key", *_ROUND)
    if some:
        more, what = _in_rounds(written(only(vertices, "left_semi")), written(only(edges, "left_semi")), obs, reg, p)
        labels, rounds = labels.unionByName(more), rounds.unionByName(what)
    return (merge_back(vertices, edges, labels, obs, reg, p) if p.cutoff > 0 or p.merge_step else labels), rounds


def _in_rounds(vertices: DataFrame, edges: DataFrame, obs: list[str], reg: float, p: CutPursuitParams) -> tuple[DataFrame, DataFrame]:
    """The labels and the rounds of graphs of more than REGION vertices."""
    labels = vertices.select("v", "key", F.col("key").alias("comp"), F.lit(False).alias("stable"), F.lit(False).alias("saturated"))
    sizes = vertices.groupBy("key").agg(F.count("*").alias("n"))
    open_ = written(energies(vertices, edges.limit(0), labels, obs, reg).join(sizes, "key").select("key", "n", F.col("fidelity").alias("before")))
    rounds = None
    for number in range(1, p.max_rounds + 1):
        began, last = time.perf_counter(), labels
        todo = written(labels.where("NOT stable").groupBy("key", F.col("comp").alias("c")).count())
        if number > 1 and todo.where(F.col("count") > REGION).isEmpty():
            labels, one = _last_rounds(vertices, edges, labels, todo, open_, number, obs, reg, p)
            return labels, rounds.unionByName(one)
        labels = written(_round(vertices, edges, labels, todo, obs, reg, p, number == 1))
        released(todo)
        counts = labels.groupBy("key").agg(F.countDistinct("comp").alias("components"), F.sum(F.col("saturated").cast("long")).alias("saturated"))
        now = open_.join(counts, "key").join(energies(vertices, edges, labels, obs, reg), "key")
        total = F.col("fidelity") + F.col("penalty")
        now = written(now.select("key", "n", F.lit(number).alias("number"), "components", "saturated", "fidelity", "penalty", total.alias("before"), _ended(p).alias("ended")))
        one = now.withColumn("seconds", F.lit(time.perf_counter() - began)).select("key", *_ROUND)
        rounds = one if rounds is None else rounds.unionByName(one)
        if number > 1:
            released(last)
        open_ = now.where("NOT ended").select("key", "n", "before")
        if open_.isEmpty():
            break
        if not now.where("ended").isEmpty():
            over = now.where("ended").select("key", F.lit(True).alias("_over"))
            labels = written(labels.join(over, "key", "left").withColumn("stable", F.col("stable") | F.coalesce("_over", F.lit(False))).drop("_over"))
    return labels.select("v", "comp"), rounds


def _ended(p: CutPursuitParams) -> Column:
    """Whether the round of a row is a graph's last, by its sums and the energy before."""
    total = F.col("fidelity") + F.col("penalty")
    return (F.col("saturated") == F.col("n")) | (F.col("before") <= 0) | (F.try_divide(F.col("before") - total, F.col("before")) < p.stop_ratio)


def _binned(vertices: DataFrame, edges: DataFrame, labels: DataFrame, todo: DataFrame, obs: list[str], reg: float, p: CutPursuitParams, most: int) -> DataFrame:
    """What _grouped() makes of the components ``todo`` (key, c, count) of at most REGION vertices. Written.

    A large component is alone in its group. Small ones are dealt by hash, so that a group has a quarter of REGION, about.
    """
    alone = F.col("count") > REGION // 8
    few = todo.where((F.col("count") <= REGION) & ~alone).agg(F.sum("count")).first()[0] or 0
    bins = F.pmod(F.xxhash64("c"), F.lit(max(1, -(-4 * few // REGION))))
    dealt = todo.where(F.col("count") <= REGION).select("key", "c", alone.alias("alone"), F.when(alone, F.col("c")).otherwise(bins).alias("bin"))
    own = labels.where("NOT stable").select("v", "key", F.col("comp").alias("c")).join(dealt, ["key", "c"])
    ends = own.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
    within = edges.select("u", "v", "w").join(own.withColumnRenamed("v", "_u"), F.col("u") == F.col("_u")).join(ends, F.col("v") == F.col("_v")).where("c = _c")
    group = ["key", "alone", "bin"]
    other = within.select(*(F.col(c).alias(f"_{c}") for c in group), "u", "v", "w").groupBy(*(f"_{c}" for c in group))
    one = own.join(vertices.drop("key"), "v").groupBy(*group).cogroup(other)
    return written(one.applyInPandas(_grouped(obs, reg, p, most), _BINNED))


def _last_rounds(vertices: DataFrame, edges: DataFrame, labels: DataFrame, todo: DataFrame, open_: DataFrame, number: int, obs: list[str], reg: float, p: CutPursuitParams) -> tuple[DataFrame, DataFrame]:
    """The labels, and the rounds from ``number`` on, once no component that may still be split has more than REGION vertices.

    Components don't depend on each other, so each group of them goes through all rounds by itself. The sums of a round over all groups then show
    which round is a graph's last, and its labels are taken.
    """
    most = p.max_rounds - number + 1
    made = _binned(vertices, edges, labels, todo, obs, reg, p, most)
    sums = made.where("v IS NULL").groupBy("key", "number").agg(*(F.sum(c).alias(c) for c in ("components", "saturated", "fidelity", "penalty")), F.max("seconds").alias("seconds"))
    fixed = labels.where("stable")
    counts = fixed.groupBy("key").agg(F.countDistinct("comp").alias("_components"), F.sum(F.col("saturated").cast("long")).alias("_saturated"))
    kept = counts.join(energies(vertices, edges.limit(0), fixed, obs, reg).select("key", F.col("fidelity").alias("_fidelity")), "key")
    border = crossing(edges, labels).groupBy("key").agg((F.lit(float(reg)) * F.sum("w")).alias("_penalty"))
    every = open_.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(most)))).join(sums, ["key", "number"], "left").join(kept, "key", "left").join(border, "key", "left")
    every = every.select("key", "n", "before", "number", *((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("components", "saturated", "fidelity", "penalty")), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    order = Window.partitionBy("key").orderBy("number")
    every = every.withColumn("before", F.coalesce(F.lag(F.col("fidelity") + F.col("penalty")).over(order), "before")).withColumn("ended", _ended(p))
    every = written(every.withColumn("last", F.coalesce(F.min(F.when(F.col("ended"), F.col("number"))).over(Window.partitionBy("key")), F.lit(most))).where("number <= last"))
    took = made.where("v IS NOT NULL").join(every.select("key", "last").distinct(), "key").where("number = last OR final AND number < last").select("v", "comp")
    return fixed.select("v", "comp").unionByName(took), every.withColumn("number", F.col("number") + (number - 1)).select("key", *_ROUND)


def _round(vertices: DataFrame, edges: DataFrame, labels: DataFrame, todo: DataFrame, obs: list[str], reg: float, p: CutPursuitParams, first: bool) -> DataFrame:
    """The labels (v, key, comp, stable, saturated) after every component ``todo`` (key, c, count), that isn't stable, was split."""
    big = todo if first else todo.where(F.col("count") > REGION)
    was = labels.where("NOT stable").select("v", "key", F.col("comp").alias("c")).join(big.select("c"), "c", "left_semi")
    ends = was.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
    within = edges.join(was.select(F.col("v").alias("_u"), "c"), F.col("u") == F.col("_u")).join(ends, F.col("v") == F.col("_v")).where("c = _c")
    split = split_large(was.drop("key").join(vertices, "v").withColumnRenamed("c", "comp"), within.select("u", "v", "w"), obs, reg, p)
    was = was.join(split, "v")
    whole = was.groupBy("c").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    stable = F.lit(False) if first else F.col("_low") == F.col("_high")
    out = labels.where("stable").unionByName(was.join(whole, "c").select("v", "key", "comp", stable.alias("stable"), "saturated"))
    if not first:
        made = _binned(vertices, edges, labels, todo, obs, reg, p, 1).where("v IS NOT NULL")
        out = out.unionByName(made.select("v", "key", "comp", "stable", F.col("full").alias("saturated")))
    return out


def greedy_pairs(wanted: DataFrame) -> DataFrame:
    """(ca, cb): what a queue of pairs (ca, cb, gain) takes that is emptied by falling gain, ties by ca and then cb, skipping pairs of which a side is taken.

    In rounds: a pair that is the best left of both its sides is taken by the queue whatever else there is, as any pair that comes before it has other sides. So
    all such pairs are taken at once, and the pairs of their sides go. The best pair left is always among them, so rounds end. Written.
    """
    left, taken = written(wanted.select("ca", "cb", "gain")), None
    while not left.isEmpty():
        key = F.struct(-F.col("gain"), F.col("ca"), F.col("cb"))
        ends = left.withColumn("c", F.explode(F.array("ca", "cb")))
        best = ends.groupBy("c").agg(F.min_by(F.struct("ca", "cb"), key).alias("p"))
        now = written(best.groupBy("p").count().where("count = 2").select("p.ca", "p.cb"))
        gone = now.select(F.explode(F.array("ca", "cb")).alias("c"))
        before = left
        left = written(left.join(gone.withColumnRenamed("c", "ca"), "ca", "left_anti").join(gone.withColumnRenamed("c", "cb"), "cb", "left_anti").select("ca", "cb", "gain"))
        released(before)
        taken = now if taken is None else taken.unionByName(now)
    return left.select("ca", "cb") if taken is None else written(taken)


def merge_back(vertices: DataFrame, edges: DataFrame, labels: DataFrame, obs: list[str], reg: float, p: CutPursuitParams, most: int | None = None) -> DataFrame:
    """Undoes cuts whose merging lowers the energy (merge_step), and merges components lighter than cutoff into the neighbour that costs least.

    A pass takes pairs by falling gain, every component once at most, and gains are found anew for the next. Every pass has fewer components, so passes end;
    with ``most``, that more would follow is warned of.
    """
    number = 0
    while True:
        now = vertices.join(labels, "v")
        comps = weighted_means(now, ["comp"], obs).join(now.groupBy("comp").agg(F.sum("w").alias("weight")), "comp")
        a = comps.withColumnsRenamed({c: f"{c}_a" for c in comps.columns})
        b = comps.withColumnsRenamed({c: f"{c}_b" for c in comps.columns})
        pairs = border_weights(edges, labels).join(a, F.col("ca") == F.col("comp_a")).join(b, F.col("cb") == F.col("comp_b"))
        square = sum((F.col(f"m_{o}_a") - F.col(f"m_{o}_b")) ** 2 for o in obs)
        both = F.col("weight_a") + F.col("weight_b")
        worse = F.when(both > 0, 0.5 * F.col("weight_a") * F.col("weight_b") / F.when(both > 0, both) * square).otherwise(0.0)
        gain = F.lit(2.0 * reg) * F.col("weight") - worse
        small = F.least("weight_a", "weight_b") < p.cutoff
        wanted = pairs.withColumn("gain", gain).where((small if p.cutoff > 0 else F.lit(False)) | ((F.col("gain") > 0) if p.merge_step else F.lit(False))).select("ca", "cb", "gain")
        taken = greedy_pairs(wanted)
        if taken.isEmpty():
            return labels
        if most is not None and number >= most:
            warnings.warn(f"merging was stopped after {most} passes", stacklevel=2)
            return labels
        into = taken.select(F.col("ca").alias("into"), F.col("cb").alias("gone"))
        labels = written(labels.join(into, F.col("comp") == F.col("gone"), "left").select("v", F.coalesce("into", "comp").alias("comp")))
        number += 1
