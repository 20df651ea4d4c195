"""Boxes over points in the order of a space-filling curve, in a pyramid of counts, and what can be near by them. Plain numpy, for use inside grouped functions."""

from __future__ import annotations

import numpy as np

#: Points of a lowest box, queries that go down together, and boxes below a box.
LEAF, BLOCK, FAN = 16, 32, 64
#: Lowest boxes that queries meet without a closer look.
MANY = 64
#: Squared distances may be off by some last bits.
SLACK = 1 + 1e-9


def leaves(points: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, count) of runs of ``size`` points."""
    at = np.arange(0, len(points), size)
    if not len(at):
        return np.empty((0, points.shape[1])), np.empty((0, points.shape[1])), np.empty(0, np.int64)
    return np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.diff(np.append(at, len(points)))


def _mind2(low, high, q_low, q_high):
    gap = np.maximum(0.0, np.maximum(low - q_high, q_low - high))
    return (gap * gap).sum(axis=1)


def _maxd2(low, high, q_low, q_high):
    far = np.maximum(np.abs(high - q_low), np.abs(q_high - low))
    return (far * far).sum(axis=1)


class Pyramid:
    """Boxes with counts; every box above holds FAN consecutive ones below."""

    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray):
        self.levels = [(low, high, count)]
        while len(count) > FAN:
            at = np.arange(0, len(count), FAN)
            low, high, count = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(count, at)
            self.levels.append((low, high, count))

    def near(self, q_low: np.ndarray, q_high: np.ndarray, k: int, limit2: float = np.inf) -> tuple[np.ndarray, float]:
        """The lowest boxes that may hold one of the k nearest of any place in a box, no farther than the root of ``limit2``, and a bound on that."""
        index = np.arange(len(self.levels[-1][2]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, count = (x[index] for x in self.levels[depth])
            if k and len(index):
                far = _maxd2(low, high, q_low, q_high)
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(count[order]), k)
                if enough < len(order):
                    limit2 = min(limit2, float(far[order[enough]]))
            index = index[_mind2(low, high, q_low, q_high) <= limit2 * SLACK]
            if depth:
                index = (index[:, None] * FAN + np.arange(FAN)).ravel()
                index = index[index < len(self.levels[depth - 1][2])]
        return index, limit2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of places, the squares added one axis after the other."""
    total = 0.0
    for x, y in zip(a.T, b.T):
        gap = x[:, None] - y[None, :]
        total = total + gap * gap
    return np.sqrt(total)


class Places:
    """Places with ids, in the order of a curve, that answer which are nearest."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.pyramid = Pyramid(*leaves(points))

    def members(self, boxes: np.ndarray) -> np.ndarray:
        at = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return at[at < len(self.points)]

    def narrowed(self, boxes: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Of lowest boxes those that may hold one of the k nearest of a query, by how far these are in the boxes next to each query."""
        if len(boxes) <= MANY:
            return boxes
        low, high, _ = self.pyramid.levels[0]
        low, high, gap = low[boxes], high[boxes], 0.0
        for i in range(q.shape[1]):
            apart = np.maximum(0.0, np.maximum(low[:, i] - q[:, i, None], q[:, i, None] - high[:, i]))
            gap = gap + apart * apart
        first = self.members(boxes[np.unique(np.argpartition(gap, 2, axis=1)[:, :3])])
        if len(first) < k:
            return boxes
        most = np.partition(distances(q, self.points[first]), k - 1, axis=1)[:, k - 1]
        return boxes[(gap <= (most * most * SLACK)[:, None]).any(axis=0)]

    def nearest(self, queries: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest, nearest first and the smaller id among equals, of every query; none beyond its ``limit``."""
        out = []
        for a in range(0, len(queries) if len(self.points) else 0, BLOCK):
            q = queries[a : a + BLOCK]
            far = None if limit is None else limit[a : a + BLOCK]
            boxes, _ = self.pyramid.near(q.min(axis=0), q.max(axis=0), k, np.inf if far is None else float(far.max()) ** 2)
            boxes = self.narrowed(boxes, q, k)
            at = self.members(boxes)
            if not len(at):
                continue
            d = distances(q, self.points[at])
            most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(at) > k else np.full(len(q), np.inf)
            if far is not None:
                most = np.minimum(most, far)
            row, col = np.nonzero(d <= most[:, None])
            dist, ids = d[row, col], self.ids[at[col]]
            order = np.lexsort((ids, dist, row))
            row, dist, ids = row[order], dist[order], ids[order]
            first = np.searchsorted(row, np.arange(len(q)))
            use = np.arange(len(row)) - first[row] < k
            out.append((row[use] + a, ids[use], dist[use]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*out))


#: Distances that two sets of places may have to be compared at once, and pairs of lowest boxes that are.
FEW, PAIRS = 1 << 14, 1 << 9


def _filled(points: np.ndarray) -> np.ndarray:
    """(box, place, axis) of the lowest boxes, the last one filled up with its last place."""
    short = -len(points) % LEAF
    return (np.concatenate([points, np.repeat(points[-1:], short, axis=0)]) if short else points).reshape(-1, LEAF, points.shape[1])


def closest(a: np.ndarray, b: np.ndarray, limit: float = np.inf) -> float:
    """The smallest distance between two sets of places, each in the order of a curve; the limit if none is below. Pairs of boxes are taken by their least
    distance, PAIRS at once, and those beyond the best so far are left out."""
    if not len(a) or not len(b):
        return limit
    if len(a) * len(b) <= FEW:
        return min(limit, float(distances(a, b).min()))
    a_low, a_high, _ = leaves(a)
    b_low, b_high, b_n = leaves(b)
    pyramid, best = Pyramid(b_low, b_high, b_n), limit
    own = np.flatnonzero(_mind2(a_low, a_high, b_low.min(axis=0), b_high.max(axis=0)) <= best * best * SLACK)
    found = []
    if len(own) * len(b_n) <= FEW:
        gap, far = 0.0, 0.0
        for i in range(a.shape[1]):
            low, high = a_low[own, i, None], a_high[own, i, None]
            apart, reach = np.maximum(0.0, np.maximum(low - b_high[:, i], b_low[:, i] - high)), np.maximum(high - b_low[:, i], b_high[:, i] - low)
            gap, far = gap + apart * apart, far + reach * reach
        if len(own):
            best = min(best, float(np.sqrt(far.min())))
            one, two = np.nonzero(gap <= best * best * SLACK)
            found.append((own[one], two, gap[one, two]))
    else:
        for i in own.tolist():
            index, bound2 = pyramid.near(a_low[i], a_high[i], 1, best * best)
            best = min(best, np.sqrt(bound2)) if np.isfinite(bound2) else best
            if len(index):
                found.append((np.full(len(index), i), index, _mind2(b_low[index], b_high[index], a_low[i], a_high[i])))
    if not found:
        return limit
    one, two, gap = (np.concatenate(x) for x in zip(*found))
    best, result = min(best, limit) * np.sqrt(SLACK), limit
    by = np.argsort(gap, kind="stable")
    a_boxes, b_boxes = _filled(a), _filled(b)
    for at in range(0, len(by), PAIRS):
        j = by[at : at + PAIRS]
        j = j[gap[j] <= min(best, result) ** 2 * SLACK]
        if not len(j):
            break
        total = 0.0
        for i in range(a.shape[1]):
            apart = a_boxes[one[j], :, None, i] - b_boxes[two[j], None, :, i]
            total = total + apart * apart
        result = min(result, float(np.sqrt(total.min())))
    return result
