"""Small graphs with known motifs and seeded random ones."""

import itertools

import numpy as np
import pandas as pd

from cellweave.graph import SpatialGraph

NODES = "cell_id string, x double, y double, cell_type string, sample_id string, region_id string"
EDGES = "source string, target string, distance double, sample_id string"


def small_graph(spark, extra=()):
    """Two squares with all diagonals and a bridge; types alternate."""
    spots = [(0, 0), (1, 0), (0, 1), (1, 1), (10, 10), (11, 10), (10, 11), (11, 11)]
    nodes = [(c, float(x), float(y), "TB"[i % 2], "s1" if i < 4 else "s2", "r1" if i < 4 else "r2") for i, (c, (x, y)) in enumerate(zip("abcdefgh", spots))]
    at = {n[0]: n for n in nodes}
    pairs = [*itertools.combinations("abcd", 2), *itertools.combinations("efgh", 2), ("d", "e")]
    edges = [(a, b, float(np.hypot(at[a][1] - at[b][1], at[a][2] - at[b][2])), at[a][4]) for a, b in pairs]
    return SpatialGraph.create(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges + list(extra), EDGES))


def line_graph(spark, edges, types=None):
    """Nodes a.. on a line with hand-written edges such as "ab bc"."""
    pairs = [tuple(e) for e in edges.split()]
    names = sorted({v for p in pairs for v in p})
    types = types or "T" * len(names)
    nodes = [(v, float(i), 0.0, t, "s1", "r1") for i, (v, t) in enumerate(zip(names, types))]
    return SpatialGraph.create(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, 1.0, "s1") for a, b in pairs], EDGES))


def random_points(n, seed, types="TBM"):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"cell_id": [f"c{i}" for i in range(n)], "x": rng.random(n), "y": rng.random(n), "cell_type": rng.choice(list(types), n), "sample_id": "s1"})
