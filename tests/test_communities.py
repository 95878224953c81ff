"""Shared neighbours, communities and markers against plain Python."""

import random
from collections import defaultdict

import pytest

from cellweave.operators.communities import communities, gini_markers, shared_neighbours

EDGE = "a string, b string, weight double"


def plain_modularity(edges, of, resolution=1.0):
    inner, degree, total = 0.0, defaultdict(float), 0.0
    for a, b, w in edges:
        degree[of[a]] += w
        degree[of[b]] += w
        total += 2 * w
        inner += 2 * w * (of[a] == of[b])
    return inner / total - resolution * sum(d * d for d in degree.values()) / total**2


def connected(edges, group):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a in group and b in group:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [min(group)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == group


def found_groups(spark, edges, nodes=None, **kw):
    found = communities(spark.createDataFrame(edges, EDGE).repartition(3), nodes, **kw)
    of = {r.cell_id: r.community for r in found.members.collect()}
    groups = defaultdict(set)
    for x, c in of.items():
        groups[c].add(x)
    assert all(c == min(g) for c, g in groups.items())
    return of, sorted(map(sorted, groups.values())), found.modularity


def test_planted_communities(spark):
    rng = random.Random(3)
    group = {f"n{i:03d}": i % 4 for i in range(72)}
    names = sorted(group)
    edges = [(a, b, rng.choice((0.5, 1.0))) for i, a in enumerate(names) for b in names[:i] if rng.random() < (0.5 if group[a] == group[b] else 0.02)]
    edges += [edges[0], ("n000", "n000", 2.0)]  # a repeated edge and one to itself
    of, groups, q = found_groups(spark, edges + [("n001", None, 1.0), ("n001", "n002", 0.0)], spark.createDataFrame([("n000",), ("lone",), (None,)], "cell_id string"))
    assert groups == sorted([["lone"], *([x for x in names if group[x] == g] for g in range(4))])
    assert q == pytest.approx(plain_modularity(edges, of)) and q >= plain_modularity(edges, group) - 1e-9
    assert all(connected(edges, set(g)) for g in groups)


def test_ring_of_cliques_and_resolution(spark):
    cliques = [[f"c{i}-{j}" for j in range(5)] for i in range(6)]
    edges = [(a, b, 1.0) for c in cliques for i, a in enumerate(c) for b in c[:i]] + [(cliques[i][0], cliques[(i + 1) % 6][1], 1.0) for i in range(6)]
    of, groups, q = found_groups(spark, edges)
    assert groups == sorted(map(sorted, cliques)) and q == pytest.approx(plain_modularity(edges, of))
    of, groups, q = found_groups(spark, edges, resolution=0.05)
    assert len(groups) < 6 and q == pytest.approx(plain_modularity(edges, of, 0.05)) and all(connected(edges, set(g)) for g in groups)


def test_no_edges(spark):
    assert found_groups(spark, []) == ({}, [], 0.0)
    assert found_groups(spark, [], spark.createDataFrame([("x",), ("x",)], "cell_id string"))[0] == {"x": "x"}


def test_shared_neighbours(spark):
    rng = random.Random(5)
    lists = {f"p{i:02d}": {f"p{j:02d}" for j in rng.sample(range(40), 6)} - {f"p{i:02d}"} for i in range(40)}
    rows = [(a, b) for a, x in lists.items() for b in x]
    want = {}
    for a, b in rows:
        shared = lists[a] & lists[b]
        if len(shared) >= 2:
            want[min(a, b), max(a, b)] = (len(shared), len(shared) / len(lists[a] | lists[b]))
    got = shared_neighbours(spark.createDataFrame(rows + rows[:3] + [("p00", "p00"), ("p00", None)], "a string, b string"), least=2).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.shared, pytest.approx(r.weight)) for r in got} == want


def test_markers(spark):
    rng = random.Random(6)
    of = {f"c{i}": ["u", "v", "w", None][i % 4] for i in range(40)}
    values = {(f"g{g}", c): float(rng.randint(1, 9)) for g in range(6) for c in of if rng.random() < (0.9 if of[c] == "uvw"[g % 3] else 0.2)}
    got = gini_markers(spark.createDataFrame([(g, c, v) for (g, c), v in values.items()], "gene string, cell_id string, value double"), spark.createDataFrame(list(of.items()), "cell_id string, cluster string")).collect()
    scores = {}
    for cluster in "uvw":
        inside, outside = [c for c in of if of[c] == cluster], [c for c in of if of[c] not in (cluster, None)]
        for g in {g for g, c in values if of[c] == cluster}:
            pair = []
            for f in (lambda x: x, lambda x: float(x > 0)):
                x, y = (sum(f(values.get((g, c), 0.0)) for c in cells) / len(cells) for cells in (inside, outside))
                pair.append(max(x - y, 0.0) / (x + y))
            scores[cluster, g] = pair[0] * pair[1]
    assert {(r.cluster, r.gene): pytest.approx(r.score, abs=1e-8) for r in got} == scores
    for cluster in "uvw":
        own = sorted((r for r in got if r.cluster == cluster), key=lambda r: r["rank"])
        assert [(r.score, r.gene) for r in own] == sorted(((r.score, r.gene) for r in own), key=lambda x: (-x[0], x[1]))
        assert {own[0].gene, own[1].gene} == {f"g{i}" for i in range(6) if "uvw"[i % 3] == cluster}
