"""Plane geometry on small arrays: convex hulls, overlap of hulls. Plain numpy, for use inside grouped functions."""

from __future__ import annotations

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the leftmost lowest, by monotone chain; collinear points are no corners.

    Fewer than three distinct points, or points on one line, give the four corners of their bounding box.
    """
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if not len(p):
        return p

    def chain(q):
        out: list = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    hull = np.array(chain(p)[:-1] + chain(p[::-1])[:-1]) if len(p) > 2 else p
    if len(hull) < 3:
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
    return hull


def inside(polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test, half-open: a point on a lower or left border is inside, on an upper or right one not."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for (x0, y0), (x1, y1) in zip(polygon, np.roll(polygon, -1, axis=0)):
        if y0 != y1:
            out ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return out


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def clipped(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a convex polygon within another, both counter-clockwise (Sutherland and Hodgman)."""
    out = [tuple(p) for p in subject]
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def overlap_ratio(a: np.ndarray, b: np.ndarray, mode: str = "lattice", scale: float = 10.0) -> float:
    """The larger of the two shares that the hulls' common area has of either; 0 where both areas are empty.

    ``lattice`` counts points of a lattice of ``scale`` to the unit, laid from the joint minimum; ``exact`` clips one polygon by the other.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a) or not len(b):
        return 0.0
    if mode == "exact":
        both, one, two = area(c) if len(c := clipped(a, b)) > 2 else 0.0, area(a), area(b)
        return max([both / s for s in (one, two) if s > 0], default=0.0)
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    a, b = (a - low) * scale, (b - low) * scale
    # only the smaller box matters to what is common
    top = np.ceil(np.maximum(a.max(axis=0), b.max(axis=0))).astype(int)
    one = two = both = 0
    step = max(1, (1 << 22) // (int(top[0]) + 1))
    x = np.arange(top[0] + 1)[None, :]
    for start in range(0, int(top[1]) + 1, step):
        y = np.arange(start, min(start + step, int(top[1]) + 1))[:, None]
        in_a, in_b = inside(a, x, y), inside(b, x, y)
        one, two, both = one + int(in_a.sum()), two + int(in_b.sum()), both + int((in_a & in_b).sum())
    return max([both / s for s in (one, two) if s], default=0.0)
