"""Merging and the whole segmentation against plain versions, which share no code with the library but its settings."""

import numpy as np
import pytest
from test_points import plain_cut_pursuit, plain_neighbours

from pointloom.operators.merge import final_segments
from pointloom.params import SegmentationParams
from pointloom.plans.segmentation import LABELS, segment

KIND = "cloud bigint, point_id bigint, x double, y double, z double, init bigint, inter bigint"


def corners(p):
    """Counter-clockwise corners: a side has all points on its left. Points on one line give the box around them."""
    p = np.unique(p, axis=0)
    after = {}
    for i, a in enumerate(p):
        for j, b in enumerate(p):
            left = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
            if i != j and (left >= 0).all() and (left > 0).any():
                on = np.flatnonzero(left == 0)
                far = on[np.argmax(((p[on] - a) ** 2).sum(axis=1))]
                if far == j:
                    after[i] = j
    if not after:
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    start = i = min(after)
    out = []
    while True:
        out.append(p[i])
        i = after[i]
        if i == start:
            return np.array(out)


def lattice_overlap(a, b, scale):
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    a, b = (a - low) * scale, (b - low) * scale
    width, height = np.ceil(np.maximum(a.max(axis=0), b.max(axis=0))).astype(int) + 1

    def member(poly, px, py):
        odd = False
        for (x0, y0), (x1, y1) in zip(poly, np.roll(poly, -1, axis=0)):
            if (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    cells = [(member(a, i, j), member(b, i, j)) for i in range(width) for j in range(height)]
    one, two, both = sum(x for x, _ in cells), sum(y for _, y in cells), sum(x and y for x, y in cells)
    return both / min(one, two) if one and two else 0.0


def plain_final(xyz, init, inter, p, passes):
    """The final label of each point, from groups merged in passes by plain loops. ``passes`` gets what every pass flagged."""
    names = sorted(set(init.tolist()))
    centre = {c: xyz[init == c].mean(axis=0) for c in names}
    group = {c: int(inter[np.flatnonzero(init == c)[0]]) for c in names}
    targets, features, before, number = set(), {}, -1, 0
    dist = lambda a, b: float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))

    def gap(a, b):
        return min(dist(centre[c], centre[d]) for c in names if group[c] == a for d in names if group[d] == b)

    while len(set(group.values())) > 1:
        groups = sorted(set(group.values()))
        features = {}
        for g in groups:
            own = xyz[[group[int(c)] == g for c in init]]
            k = round(len(own) * p.trim_percent / 200)
            trim = [np.sort(own[:, i])[k : len(own) - k].mean() for i in range(2)]
            mean = np.mean([centre[c] for c in names if group[c] == g], axis=0)
            features[g] = {"at": trim, "low": own[:, 2].min(), "len": own[:, 2].max() - own[:, 2].min(), "hull": corners(own[:, :2]), "mean": mean}

        def nearest(g, among):
            return sorted(among, key=lambda h: (dist(features[g]["at"], features[h]["at"]), h))[: p.min_nn3]  # noqa: B023

        sigma = np.mean([min(dist(features[g]["at"], features[h]["at"]) for h in groups if h != g) for g in groups])
        flagged, long = set(), set()
        for g in groups:
            around = nearest(g, groups)
            rise, own = abs(features[g]["low"] - min(features[h]["low"] for h in around)), features[g]["len"]
            middle = np.median([features[h]["len"] for h in around])
            if rise / own > p.rel_height_length_ratio if own > 0 else rise > 0:
                flagged.add(g)
                if own / middle > p.long_stem_ratio if middle > 0 else own > 0:
                    long.add(g)
        staying = set(groups) - flagged
        targets |= staying
        going = long if number == 0 and long else flagged
        count = len(going) if staying else 0
        passes.append(count)
        moves = {}
        for g in going if count else ():
            scored = []
            for h in nearest(g, staying):
                f, o = features[g], features[h]
                one, two = o["low"] + o["len"] - f["low"], f["low"] + f["len"] - o["low"]
                v = 0.0 if max(one, two) == 0 or min(one, two) <= 0 else min(one, two) / max(one, two)
                d3 = gap(g, h)
                near = min(d3, dist(f["mean"][:2], o["mean"][:2]))
                share = lattice_overlap(f["hull"], o["hull"], p.raster_scale)
                scored.append((np.exp(-((1 - share) ** 2) - p.vertical_weight * (1 - v) ** 2 - (near / sigma) ** 2), d3, h))
            top = max(s for s, _, _ in scored)
            if top > 0:
                moves[g] = min((d3, -s, h) for s, d3, h in scored if s > p.score_candidate_ratio * top)[2]
        group = {c: moves.get(g, g) for c, g in group.items()}
        number += 1
        if count in (0, before):
            break
        before = count
    left = set(group.values()) - targets
    if left and features:
        known = set(group.values()) & targets
        moves = {g: min((gap(g, h), h) for h in nearest(g, known))[1] for g in left}
        group = {c: moves.get(g, g) for c, g in group.items()}
    rank = {g: i for i, g in enumerate(sorted(set(group.values())))}
    return np.array([rank[group[int(c)]] for c in init])


def layered(rng, stems):
    """Clusters of points stacked and scattered, so that some hang over others: (xyz, init, inter)."""
    xyz, init, inter = [], [], []
    for g in range(stems):
        at = np.array([*(rng.random(2) * 6), rng.random() * 3 * (rng.random() < 0.6)])
        for c in range(int(rng.integers(1, 4))):
            n = int(rng.integers(2, 14))
            xyz.append(at + [*(rng.normal(0, 0.6, 2)), 0.9 * c] + rng.normal(0, 0.5, (n, 3)) * [1, 1, rng.random() * 2])
            init += [3 * g + c] * n
            inter += [g] * n
    return np.concatenate(xyz), np.array(init), np.array(inter)


@pytest.mark.parametrize("p", [SegmentationParams(min_nn3=4, rel_height_length_ratio=0.3, long_stem_ratio=1.2, trim_percent=20), SegmentationParams(rel_height_length_ratio=0.15, raster_scale=5.0, long_stem_ratio=9.0)], ids=["near", "all"])
def test_merging_equals_plain_passes(spark, p):
    rng = np.random.default_rng(21)
    clouds = [layered(rng, int(n)) for n in (1, 2, 5, 9, 14, 14, 20)]
    rows, want, passes = [], {}, []
    for number, (xyz, init, inter) in enumerate(clouds):
        base = 1000 * number
        rows += [(number, base + i, *map(float, x), base + int(a), base + int(b)) for i, (x, a, b) in enumerate(zip(xyz, init, inter))]
        passes.append([])
        want |= {base + int(a): int(f) for a, f in zip(init, plain_final(xyz, init, inter, p, passes[-1]))}
    got = {r["init"]: r["final"] for r in final_segments(spark.createDataFrame(rows, KIND).repartition(3), p, by="cloud").collect()}
    assert got == want
    assert max(map(len, passes)) > 1 and sum(x[0] > 0 for x in passes if x) > 2


def plain_segments(xyz, p):
    """init, intermediate and final labels of all points of one cloud."""

    def voxels(res):
        cell = np.floor((xyz - xyz.mean(axis=0)) / res).astype(int)
        _, first, of = np.unique(cell, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        return first[order], np.argsort(order)[of.ravel()]

    fine, of_fine = voxels(p.decimate_res1)
    small = xyz[fine]
    u, v = plain_neighbours(small - small.mean(axis=0), p.min_nn1)
    init = fine[plain_cut_pursuit(small - small.mean(axis=0), u, v, np.ones(len(u)), p.reg_strength1, p.solver)]
    labelled = init[of_fine]
    coarse, of_coarse = voxels(p.decimate_res2)
    large, own = xyz[coarse], labelled[coarse]
    names = sorted(set(own.tolist()))
    near = {(names[a], names[b]) for a, b in zip(*plain_neighbours(np.array([large[own == c].mean(axis=0) for c in names]), p.min_nn2))}
    gaps = {k: np.sqrt(((large[own == k[0]][:, None] - large[own == k[1]][None]) ** 2).sum(axis=2)).min() for k in near}
    gaps = {k: g for k, g in gaps.items() if g < p.max_gap} | {(c, c): 0.0 for c in names}
    known = [(a, b, 10 / ((gaps[own[a], own[b]] + 0.01) / 0.01)) for a, b in zip(*plain_neighbours(large, p.min_nn2)) if (own[a], own[b]) in gaps]
    inter = coarse[plain_cut_pursuit((large - large.mean(axis=0))[:, :2], *(np.array(x) for x in zip(*known)), p.reg_strength2, p.solver)][of_coarse]
    final = plain_final(small, init, inter[fine], p, [])[of_fine]
    dense = lambda x: np.unique(x, return_inverse=True)[1].ravel()
    return np.column_stack([dense(labelled), dense(inter), final])


def test_segmentation_equals_the_plain_stages(spark):
    p = SegmentationParams(decimate_res1=0.3, decimate_res2=0.5, reg_strength1=0.05, reg_strength2=0.5, rel_height_length_ratio=0.3, long_stem_ratio=1.2)
    rng = np.random.default_rng(4)
    clouds = {f"c{n}": layered(rng, n)[0] for n in (6, 9)}
    rows = [(c, i, *map(float, x)) for c, xyz in clouds.items() for i, x in enumerate(xyz)]
    df = spark.createDataFrame(rows, "cloud_id string, point_id bigint, x double, y double, z double").repartition(3)
    got = {(r["cloud_id"], r["point_id"]): tuple(r[x] for x in LABELS) for r in segment(df, p).collect()}
    for c, xyz in clouds.items():
        want = plain_segments(xyz, p)
        assert [got[c, i] for i in range(len(xyz))] == [tuple(x) for x in want.tolist()]
        assert all(1 < len(set(want[:, i].tolist())) < len(xyz) for i in range(3))
