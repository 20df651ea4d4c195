"""Merging components back, against a queue."""

import heapq

import numpy as np
import pytest

from pointloom.operators.cutpursuit import greedy_pairs, merge_back
from pointloom.params import CutPursuitParams


def by_queue(pairs):
    heap = [(-g, a, b) for a, b, g in pairs]
    heapq.heapify(heap)
    used, out = set(), set()
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


def test_pairs_are_those_of_a_queue(spark):
    """200 random graphs side by side, with ties, and a path of rising gains."""
    rng = np.random.default_rng(0)
    pairs, start = [], 0
    for _ in range(200):
        n = int(rng.integers(2, 14))
        every = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        pairs += [(start + a, start + b, float(rng.integers(0, 6)) / 2) for a, b in every]
        start += n
    pairs += [(start + i, start + i + 1, float(i)) for i in range(7)]
    df = spark.createDataFrame(pairs, "ca bigint, cb bigint, gain double").repartition(5)
    got = {(r["ca"], r["cb"]) for r in greedy_pairs(df).collect()}
    assert got == by_queue(pairs) and len(got) > 300
    assert greedy_pairs(df.limit(0)).count() == 0


def plain_merge(obs, w, edges, comp, reg, p):
    """Passes of a queue over weighted means and border weights; each component merges once in a pass."""
    while True:
        names = sorted(set(comp))
        weight = {c: sum(w[i] for i in range(len(w)) if comp[i] == c) for c in names}
        mean = {c: sum(w[i] * obs[i] for i in range(len(w)) if comp[i] == c) / weight[c] for c in names}
        border = {}
        for a, b, x in edges:
            if comp[a] != comp[b]:
                k = tuple(sorted((comp[a], comp[b])))
                border[k] = border.get(k, 0.0) + x / 2
        pairs = []
        for (a, b), x in border.items():
            gain = 2 * reg * x - 0.5 * weight[a] * weight[b] / (weight[a] + weight[b]) * (mean[a] - mean[b]) ** 2
            if p.cutoff > 0 and min(weight[a], weight[b]) < p.cutoff or p.merge_step and gain > 0:
                pairs.append((a, b, gain))
        into = {b: a for a, b in by_queue(pairs)}
        if not into:
            return comp
        comp = [into.get(c, c) for c in comp]


@pytest.mark.parametrize("p", [CutPursuitParams(cutoff=3.0), CutPursuitParams(merge_step=True), CutPursuitParams(cutoff=2.0, merge_step=True)])
def test_merge_back_equals_plain_passes(spark, p):
    rng = np.random.default_rng(2)
    n = 60
    obs, w = np.cumsum(rng.normal(0, 1, n)), rng.random(n) + 0.5
    edges = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(i, int(rng.integers(0, n)), float(rng.random())) for i in range(0, n, 4)]
    edges = [(a, b, x) for a, b, x in edges if a != b]
    comp = [i - i % 2 for i in range(n)]
    vertices = spark.createDataFrame([(i, float(o), float(x)) for i, (o, x) in enumerate(zip(obs, w))], "v bigint, o double, w double")
    links = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    labels = spark.createDataFrame(list(enumerate(comp)), "v bigint, comp bigint")
    want = plain_merge(obs, w, edges, comp, 0.4, p)
    got = dict(merge_back(vertices, links, labels, ["o"], 0.4, p).collect())
    assert [got[i] for i in range(n)] == want and 1 <= len(set(want)) < n / 2
    if p.cutoff == 3.0:
        with pytest.warns(UserWarning, match="stopped after 1 passes"):
            few = dict(merge_back(vertices, links, labels, ["o"], 0.4, p, 1).collect())
        assert len(set(few.values())) > len(set(want))
