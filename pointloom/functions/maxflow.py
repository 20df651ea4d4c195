"""Minimum cuts with integer capacities, on arrays.

A region is a part of a network, with what is left of its capacities. Excess is pushed towards the sink along exact distances, whole rings of
vertices at once, and distances are found again until no excess can move. Any number of networks are solved as one: vertices whose side is clear
from their own arcs are set aside first, and parts of the rest drop out as they settle. Regions that exchange what crosses their borders solve a network together:
``discharge`` also pushes to neighbours outside, those with the lowest labels first, a label being the number of borders on the way to the sink
(Shekhovtsov and Hlavac 2013).
"""

from __future__ import annotations

import numpy as np

#: The label of what can't reach the sink.
FAR = 1 << 30


def _ranges(ptr: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries of ``v``, and for each the place of its owner in ``v``."""
    n = ptr[v + 1] - ptr[v]
    owner = np.repeat(np.arange(len(v)), n)
    return np.arange(len(owner)) + np.repeat(ptr[v] - np.cumsum(n) + n, n), owner


def _dealt(excess: np.ndarray, owner: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What each place takes of its owner's excess, the first places first."""
    before = np.cumsum(room) - room
    if len(owner):
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(owner))))
    return np.clip(excess[owner] - before, 0, room)


def arcs(n: int, u: np.ndarray, v: np.ndarray, capacity: np.ndarray) -> dict[str, np.ndarray]:
    """Both directions of edges between ``n`` vertices, by vertex: ptr, head, cap and rev, the place of the other direction."""
    real = (u != v) & (capacity > 0)
    u, v, capacity = u[real], v[real], capacity[real]
    tail, head = np.concatenate([u, v]), np.concatenate([v, u])
    by = np.argsort(tail, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return {"ptr": np.searchsorted(tail[by], np.arange(n + 1)), "head": head[by].astype(np.int64), "cap": np.concatenate([capacity, capacity])[by].astype(np.int64), "rev": np.roll(place, len(u))[by]}


class Region:
    """Excess and room to the sink of n vertices, arcs() between them, and arcs to vertices outside: from ``at``, with room ``out``, to label ``far``."""

    def __init__(self, excess, sink, ptr, head, cap, rev, at=(), out=(), far=()):
        self.excess, self.sink = np.array(excess, np.int64), np.array(sink, np.int64)
        self.ptr, self.head, self.cap, self.rev = ptr, head, np.array(cap, np.int64), rev
        self.at, self.out, self.far = (np.array(x, np.int64) for x in (at, out, far))
        self.by = np.argsort(self.at, kind="stable")
        self.border = np.searchsorted(self.at[self.by], np.arange(len(self.excess) + 1))
        self.label = np.full(len(self.excess), FAR)

    def rings(self) -> list[tuple[np.ndarray, int | None]]:
        """Vertices by their distance from the sink, then from outside vertices by ascending labels; sets level and label.

        The first ring of each kind comes with the label that it is next to, -1 for the sink.
        """
        n = len(self.excess)
        self.level, self.label = np.full(n, -1), np.full(n, FAR)
        open_ = (self.out > 0) & (self.far < FAR)
        found, number = [], 0
        for mark in (-1, *np.unique(self.far[open_]).tolist()):
            ring = np.flatnonzero(self.sink > 0) if mark < 0 else np.unique(self.at[open_ & (self.far == mark)])
            ring, next_to = ring[self.level[ring] < 0], mark
            while len(ring):
                self.level[ring], self.label[ring] = number, mark + 1
                found.append((ring, next_to))
                place, _ = _ranges(self.ptr, ring)
                near = self.head[place]
                ring, next_to, number = np.unique(near[(self.cap[self.rev[place]] > 0) & (self.level[near] < 0)]), None, number + 1
        return found

    def discharge(self) -> np.ndarray:
        """Moves all excess that can reach the sink or an outside vertex; returns what crossed each outside arc. Labels are exact afterwards."""
        sent = np.zeros(len(self.out), np.int64)
        while True:
            rings = self.rings()
            if not (self.excess[self.level >= 0] > 0).any():
                return sent
            self.push(rings, sent)

    def push(self, rings: list[tuple[np.ndarray, int | None]], sent: np.ndarray) -> None:
        """Moves excess once, from the farthest ring to the nearest and on to the sink or outside; adds to ``sent`` what crosses outside arcs."""
        for ring, mark in reversed(rings):
            v = ring[self.excess[ring] > 0]
            if not len(v):
                continue
            if mark == -1:
                x = np.minimum(self.excess[v], self.sink[v])
                self.sink[v] -= x
                self.excess[v] -= x
            elif mark is not None:
                place, owner = _ranges(self.border, v)
                place = self.by[place]
                use = (self.out[place] > 0) & (self.far[place] == mark)
                place, owner = place[use], owner[use]
                x = _dealt(self.excess[v], owner, self.out[place])
                self.out[place] -= x
                sent[place] += x
                np.subtract.at(self.excess, v[owner], x)
            else:
                place, owner = _ranges(self.ptr, v)
                use = (self.cap[place] > 0) & (self.level[self.head[place]] == self.level[v[0]] - 1)
                place, owner = place[use], owner[use]
                x = _dealt(self.excess[v], owner, self.cap[place])
                self.cap[place] -= x
                self.cap[self.rev[place]] += x
                np.subtract.at(self.excess, v[owner], x)
                np.add.at(self.excess, self.head[place], x)

    def within(self, keep: np.ndarray) -> Region:
        """The vertices to ``keep`` and the arcs between them, without outside arcs."""
        index = np.flatnonzero(keep)
        place, _ = _ranges(self.ptr, index)
        inner = keep[self.head[place]]
        ends = np.concatenate([[0], np.cumsum(inner)])[np.concatenate([[0], np.cumsum(np.diff(self.ptr)[index])])]
        place = place[inner]
        number, moved = np.cumsum(keep) - 1, np.zeros(len(self.head), np.int64)
        moved[place] = np.arange(len(place))
        return Region(self.excess[index], self.sink[index], ends, number[self.head[place]], self.cap[place], moved[self.rev[place]])


def decided(surplus: np.ndarray, ptr: np.ndarray, head: np.ndarray, cap: np.ndarray, outside: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex 1 if it can't be on the smallest sink side, 2 if it must be, 0 if that is open; and the surplus of the open ones.

    ``surplus``: from the source, below 0 to the sink. One that fills all arcs of its vertex is on the source's side at no cost, and one that can take more than
    they bring on the sink's. Then the neighbours have these arcs from the source or to the sink, and are looked at again. ``outside``: what further arcs of each
    vertex carry, whose other ends aren't known.
    """
    surplus, side = surplus.copy(), np.zeros(len(surplus), np.int8)
    room = np.diff(np.concatenate([[0], np.cumsum(cap)])[ptr]) + outside
    look = np.arange(len(surplus))
    while len(look):
        new = np.concatenate([look[surplus[look] >= room[look]], look[-surplus[look] > room[look]]])
        side[new] = np.where(surplus[new] >= room[new], 1, 2)
        place, owner = _ranges(ptr, new)
        near, c = head[place], cap[place]
        np.add.at(surplus, near, np.where(side[new[owner]] == 1, c, -c))
        np.subtract.at(room, near, c)
        look = np.unique(near)
        look = look[side[look] == 0]
    return side, surplus


def smallest_side(surplus: np.ndarray, ptr: np.ndarray, head: np.ndarray, cap: np.ndarray, rev: np.ndarray) -> np.ndarray:
    """Which vertices can still reach the sink after a maximum flow, of arcs() and each vertex's capacity from the source, below 0 to the sink."""
    known, rest = decided(surplus, ptr, head, cap)
    side, ids = known == 2, np.flatnonzero(known == 0)
    left = Region(np.maximum(rest, 0), np.maximum(-rest, 0), ptr, head, cap, rev).within(known == 0)
    part = parts(len(ids), np.repeat(np.arange(len(ids)), np.diff(left.ptr)), left.head)
    while True:
        rings = left.rings()
        moving = (left.excess > 0) & (left.level >= 0)
        if not moving.any():
            side[ids] = left.level >= 0
            return side
        busy = np.zeros(len(surplus), bool)
        busy[part[moving]] = True
        keep = busy[part]
        if 4 * keep.sum() < 3 * len(keep):  # the others have settled
            side[ids[~keep]] = left.level[~keep] >= 0
            left, ids, part = left.within(keep), ids[keep], part[keep]
            rings = left.rings()
        left.push(rings, left.out)


def sink_side(n: int, to_source: np.ndarray, to_sink: np.ndarray, u: np.ndarray, v: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Which of ``n`` vertices can still reach the sink after a maximum flow: the smallest sink side of all minimum cuts.

    ``to_source`` is the capacity from the source to each vertex, ``to_sink`` from each to the sink, ``capacity`` that of an edge either way.
    """
    return smallest_side(np.asarray(to_source, np.int64) - to_sink, **arcs(n, u, v, capacity))


def parts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's connected part."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
