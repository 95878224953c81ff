"""Shapes of connected induced subgraphs of four vertices, derived from their adjacency masks.

Bit i of a mask stands for pair i of PAIRS. Everything here follows from the masks by rule.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, permutations

PAIRS = tuple(combinations(range(4), 2))
#: (edges, sorted degrees) of each class
CLASSES = {(3, (1, 1, 1, 3)): "claw", (3, (1, 1, 2, 2)): "path", (4, (2, 2, 2, 2)): "cycle", (4, (1, 2, 2, 3)): "paw", (5, (2, 2, 3, 3)): "diamond", (6, (3, 3, 3, 3)): "K4"}


def linked(mask: int) -> set[tuple[int, int]]:
    return {e for i, e in enumerate(PAIRS) if mask >> i & 1}


def mask_of(edges) -> int:
    found = {tuple(sorted(e)) for e in edges}
    return sum(1 << i for i, e in enumerate(PAIRS) if e in found)


def degrees(mask: int) -> tuple[int, ...]:
    e = linked(mask)
    return tuple(sum(v in pair for pair in e) for v in range(4))


def connected(vertices: set[int], edges: set[tuple[int, int]]) -> bool:
    seen, todo = set(), [min(vertices)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [u for e in edges if v in e for u in e if u in vertices]
    return seen == vertices


@cache
def class_of(mask: int) -> str | None:
    e = linked(mask)
    return CLASSES.get((len(e), tuple(sorted(degrees(mask))))) if connected(set(range(4)), e) else None


@cache
def last_removable(mask: int) -> int:
    """The largest vertex without which the rest is connected: a set grows from one 3-set only."""
    e = linked(mask)
    return max((v for v in range(4) if connected(set(range(4)) - {v}, {x for x in e if v not in x})), default=-1)


@cache
def walk(mask: int) -> tuple[int, ...]:
    """The vertices of a path or cycle in walking order; for other shapes by degree."""
    if class_of(mask) in ("path", "cycle"):
        e = linked(mask)
        return next(p for p in permutations(range(4)) if all(tuple(sorted(x)) in e for x in zip(p, p[1:])))
    return tuple(sorted(range(4), key=lambda v: degrees(mask)[v]))


def grown(rank: int, three: int, joined: int) -> int:
    """Mask of a sorted 3-set with mask `three` (bits 01, 02, 12) and a vertex of the given rank joined to `joined`."""
    place = [i + (i >= rank) for i in range(3)]
    edges = [(place[a], place[b]) for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))) if three >> i & 1]
    return mask_of(edges + [(place[i], rank) for i in range(3) if joined >> i & 1])
