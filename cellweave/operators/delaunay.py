"""Delaunay edges of one set of points, by insertion into a triangulation that is closed by a vertex at infinity.

A triangle is three entries of a dictionary from directed edges to the vertex on their left, so neighbours need no
bookkeeping. Points come in rounds that double, each along a Hilbert curve, and a point's triangle is found by a walk
from the last one made: a bounded number of steps a point, as a rule. Signs of determinants that rounding leaves open are
settled in whole numbers, so flat, collinear and cocircular sets are triangulated as they are.
"""

from __future__ import annotations

import numpy as np

FAR = -1  # the vertex at infinity
# fixed values: bounds of the rounding errors of the two determinants, as multiples of their terms' magnitudes
TURN_BOUND, CIRCLE_BOUND = 3.4e-16, 1.2e-15


def delaunay_edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index pairs (i < j) of the Delaunay triangulation; coincident points are connected to the first of them.

    Fewer than three distinct points, or points on one line, give the path along them. Of four points on one circle the
    smallest by (x, y) is taken to lie a little outside, so any set that holds them all is triangulated alike there.
    """
    points = np.column_stack([x, y]).astype(float)
    distinct, first, inverse = np.unique(points, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    extra = [(min(first[c], i), max(first[c], i)) for i, c in enumerate(inverse) if first[c] != i]
    if len(distinct) < 2:
        return np.array(sorted(extra), int).reshape(-1, 2)
    # np.unique sorts along the line, if there is one
    pairs = Triangulation(distinct).edges() or {(i, i + 1) for i in range(len(distinct) - 1)}
    named = [(min(first[a], first[b]), max(first[a], first[b])) for a, b in pairs]
    return np.array(sorted(set(named) | set(extra)), int)


def hilbert(points: np.ndarray, bits: int = 16) -> np.ndarray:
    """The place of each point along a Hilbert curve through the points' bounding box."""
    low, span = points.min(axis=0), np.ptp(points, axis=0)
    x, y = (np.minimum((points - low) / np.where(span > 0, span, 1.0) * (1 << bits), (1 << bits) - 1)).astype(np.int64).T
    place = np.zeros(len(points), np.int64)
    for k in range(bits - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        place = place << 2 | (3 * right ^ up)
        turned, mirrored = up == 0, (up == 0) & (right == 1)
        x, y = np.where(mirrored, ~x, x), np.where(mirrored, ~y, y)
        x, y = np.where(turned, y, x), np.where(turned, x, y)
    return place


def insertion_order(points: np.ndarray) -> np.ndarray:
    shuffled, along = np.random.default_rng(0).permutation(len(points)), hilbert(points)
    rounds, end = [], len(points)
    while end:
        begin = end // 2 if end > 64 else 0
        own = shuffled[begin:end]
        rounds.append(own[np.argsort(along[own], kind="stable")])
        end = begin
    return np.concatenate(rounds[::-1])


class Triangulation:
    def __init__(self, points: np.ndarray):
        self.p: list[tuple[float, float]] = [tuple(q) for q in points.tolist()]
        self.whole: list[tuple[int, int]] | None = None
        self.left: dict[tuple[int, int], int] = {}  # directed edge -> the vertex on its left
        self.last = (0, 0)
        order = insertion_order(points).tolist()
        a, b = order[:2]
        c = next((k for k in order[2:] if self._turn(a, b, k)), None)
        if c is None:
            return
        if self._turn(a, b, c) < 0:
            a, b = b, a
        self._add(a, b, c)
        for u, v in ((a, b), (b, c), (c, a)):
            self._add(v, u, FAR)
        self.last = (a, b)
        for k in order:
            if k not in (a, b, c):
                self._insert(k)

    def edges(self) -> set[tuple[int, int]]:
        return {(u, v) for u, v in self.left if FAR < u < v}

    def _add(self, a: int, b: int, c: int) -> None:
        self.left[a, b], self.left[b, c], self.left[c, a] = c, a, b

    def _whole(self, *which: int) -> list[tuple[int, int]]:
        """The points in whole numbers, by one power of two."""
        if self.whole is None:
            ratios = [(x.as_integer_ratio(), y.as_integer_ratio()) for x, y in self.p]
            unit = max(max(a[1], b[1]) for a, b in ratios)
            self.whole = [(a[0] * (unit // a[1]), b[0] * (unit // b[1])) for a, b in ratios]
        return [self.whole[k] for k in which]

    def _turn(self, a: int, b: int, c: int) -> float:
        """Above 0 if c lies to the left of a -> b, below if to the right."""
        (ax, ay), (bx, by), (cx, cy) = self.p[a], self.p[b], self.p[c]
        one, two = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
        if abs(one - two) > TURN_BOUND * (abs(one) + abs(two)):
            return one - two
        (ax, ay), (bx, by), (cx, cy) = self._whole(a, b, c)
        exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        return (exact > 0) - (exact < 0)

    def _in_circle(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d lies inside the circle through a, b, c, which turn left."""
        p = self.p
        (dx, dy), (ax, ay), (bx, by), (cx, cy) = p[d], p[a], p[b], p[c]
        ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        terms = bx * cy, by * cx, cx * ay, cy * ax, ax * by, ay * bx
        value = a2 * (terms[0] - terms[1]) + b2 * (terms[2] - terms[3]) + c2 * (terms[4] - terms[5])
        most = a2 * (abs(terms[0]) + abs(terms[1])) + b2 * (abs(terms[2]) + abs(terms[3])) + c2 * (abs(terms[4]) + abs(terms[5]))
        if abs(value) > CIRCLE_BOUND * most:
            return value > 0
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = self._whole(a, b, c, d)
        ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
        exact = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if exact:
            return exact > 0
        # four points on one circle: the first of them is taken to lie a little outside the circle of the others
        lowest = min(a, b, c, d)
        others = {a: (d, b, c), b: (d, c, a), c: (d, a, b)}
        return lowest != d and self._turn(*others[lowest]) > 0

    def _conflicts(self, u: int, v: int, w: int, k: int) -> bool:
        """Whether point k does away with triangle u, v, w; a triangle at infinity goes if k sees its edge or is on it."""
        if FAR not in (u, v, w):
            return self._in_circle(u, v, w, k)
        while w != FAR:
            u, v, w = v, w, u
        side = self._turn(u, v, k)
        if side:
            return side > 0
        (kx, ky), (ux, uy), (vx, vy) = self.p[k], self.p[u], self.p[v]
        return min(ux, vx) <= kx <= max(ux, vx) and min(uy, vy) <= ky <= max(uy, vy)

    def _locate(self, k: int) -> tuple[int, int]:
        """An edge of a triangle that k does away with."""
        u, v = self.last
        while True:
            w = self.left[u, v]
            if w == FAR:
                return u, v
            for a, b in ((u, v), (v, w), (w, u)):
                if self._turn(a, b, k) < 0:
                    u, v = b, a
                    break
            else:
                return u, v

    def _insert(self, k: int) -> None:
        left = self.left
        u, v = self._locate(k)
        w = left[u, v]
        border, open_ = [], [(u, v), (v, w), (w, u)]
        for e in open_:
            del left[e]
        while open_:
            u, v = open_.pop()
            # the triangle on the other side of a hole's edge
            w = left.get((v, u))
            if w is None:
                continue  # another edge of the hole
            if self._conflicts(v, u, w, k):
                for e in ((v, u), (u, w), (w, v)):
                    del left[e]
                open_ += [(u, w), (w, v)]
            else:
                border.append((u, v))
        for u, v in border:
            self._add(u, v, k)
            if FAR not in (u, v):
                self.last = (u, v)
