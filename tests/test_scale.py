"""Counting, order statistics, corrections and selections that no task does alone, against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.stats import with_bh
from cellweave.graph import SpatialGraph
from cellweave.operators import counting, triangles
from cellweave.operators import motifs as M
from cellweave.operators.compare import motifs_by_sample
from cellweave.plans import ranks
from cellweave.sources.graph_io import integer_graph
from tests.fixtures import NODES, small_graph


def catalog(df):
    return {(r.motif_id, r.size, r.canonical_iso_class, r.color_tuple): r["count"] for r in df.collect()}


def random_graph(spark, n, p, seed, types="ABC"):
    rng = random.Random(seed)
    nodes = [(f"n{i:03d}", 0.0, 0.0, rng.choice(types), f"s{i % 2}", "r") for i in range(n)]
    edges = [(a[0], b[0], 1.0, "s") for a, b in itertools.combinations(nodes, 2) if rng.random() < p]
    return SpatialGraph.create(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "source string, target string, distance double, sample_id string"))


@pytest.mark.parametrize("colored", [True, False])
@pytest.mark.parametrize("seed, p", [(1, 0.15), (2, 0.5)])
def test_counted_catalog_equals_the_enumerated_one(spark, colored, seed, p):
    sg = random_graph(spark, 30, p, seed)
    found = M.find_motifs(sg, 3, colored=colored)
    assert catalog(found.catalog) == catalog(M.catalog_of(found.instances, 3))
    anchors = [f"n{i:03d}" for i in range(0, 30, 7)]
    found = M.find_motifs(sg, 3, colored=colored, anchored_on=anchors)
    assert catalog(found.catalog) == catalog(M.catalog_of(found.instances, 3))


def test_counted_catalog_by_sample(spark):
    sg = random_graph(spark, 30, 0.4, 3)
    for name, found in motifs_by_sample(sg, 3).items():
        own = M.find_motifs(sg.subset_sample(F.col("sample_id") == name), 3)
        assert catalog(found.catalog) == catalog(own.catalog) and catalog(own.catalog)
        assert catalog(M.catalog_of(found.instances, 3)) == catalog(own.catalog)


def test_counted_catalog_without_edges(spark):
    sg = small_graph(spark)
    assert M.find_motifs(SpatialGraph(sg.nodes, sg.edges.limit(0), {}), 3).catalog.collect() == []


def test_a_hub_costs_its_degree(spark):
    """A star of 300000 leaves and a ring through some of them: pairs of leaves would be 4.5e10 rows."""
    n = 300_000
    spokes = spark.range(1, n + 1).select(F.lit("0").alias("source"), F.col("id").cast("string").alias("target"))
    ring = spark.range(1, 1001).select(F.col("id").cast("string").alias("source"), (F.col("id") % 1000 + 1).cast("string").alias("target"))
    edges = spokes.unionByName(ring).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    color = lambda c: F.when(F.col(c) == "0", "H").otherwise("L")
    found = counting.counted_classes(edges.withColumns({"sc": color("source"), "tc": color("target")}))
    counts = {(r.topology, "".join(r.sorted)): r["count"] for r in found.collect()}
    assert counts == {("triangle", "HLL"): 1000, ("wedge", "LLH"): n * (n - 1) // 2 - 1000, ("wedge", "LLL"): 1000}
    up = counting.directed(edges.withColumns({"sc": F.lit(""), "tc": F.lit("")}), [])
    assert up.groupBy("u").count().agg(F.max("count")).first()[0] <= 3


@pytest.mark.parametrize("values", [[3.0], [1.0] * 40_000, [float(i % 7) for i in range(30_000)], "normal", "wide", "hot"])
def test_quantiles_against_numpy(spark, values):
    rng = np.random.default_rng(1)
    if values == "normal":
        values = rng.normal(size=60_000)
    elif values == "wide":
        values = 10 ** rng.uniform(-200, 200, 40_000) * rng.choice([-1, 1], 40_000)
    elif values == "hot":
        values = np.concatenate([np.full(50_000, 0.25), rng.random(40_000)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    ps = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    assert ranks.quantiles(df, "x", ps) == pytest.approx(np.quantile(np.array(values), ps).tolist(), rel=1e-12)
    assert ranks.quantiles(df.where("x IS NULL"), "x", ps) is None


def plain_bh(p):
    order = sorted((v, i) for i, v in enumerate(p) if v is not None)
    out, low = [None] * len(p), 1.0
    for rank in range(len(order), 0, -1):
        v, i = order[rank - 1]
        low = min(low, v * len(order) / rank)
        out[i] = low
    return out


def test_bh_in_lanes(spark):
    rng = random.Random(2)
    p = [None, 0.0, 0.0, 1.0, 1e-300, 5e-324] + [rng.random() ** rng.choice([1, 9]) for _ in range(3000)] + [0.037] * 1500
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double").repartition(6)
    found = {r.i: r.q for r in with_bh(df, "p", "q").collect()}
    assert len(found) == len(p)
    assert all(found[i] is None if w is None else found[i] == pytest.approx(w, rel=1e-12) for i, w in enumerate(plain_bh(p)))
    plan = with_bh(df, "p", "q")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__bh_lane" in plan
    grouped = with_bh(df.withColumn("g", F.col("i") % 2), "p", "q", ["g"]).where("g = 0").collect()
    want = plain_bh([p[i] for i in range(0, len(p), 2)])
    assert all(r.q is None if want[r.i // 2] is None else r.q == pytest.approx(want[r.i // 2]) for r in grouped)


@pytest.mark.parametrize("n", [1, 999, 25_000, 40_000, 50_000])
def test_smallest_digests(spark, monkeypatch, n):
    monkeypatch.setattr(ranks, "FEW", 50)
    df = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    got = {r.k for r in ranks.smallest(df, F.md5("k"), n, "k").collect()}
    assert got == set(sorted(map(str, range(40_000)), key=lambda k: hashlib.md5(k.encode()).hexdigest())[:n])


def test_first_of_each_group(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 3 if i < 900 else 0}", f"{rng.random():.12f}") for i in range(5000)]
    got = sorted(map(tuple, M.first_of_each(spark.createDataFrame(rows, "g string, c string").repartition(4), "g", "c", 1500).collect()))
    assert got == sorted(r for g in ("g0", "g1", "g2") for r in sorted(x for x in rows if x[0] == g)[:1500])


def test_ranks_in_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"))
    rows = ranks.ranked_in_ranges(df, ["g"], ["v"]).collect()
    for g in (0, 1):
        own = sorted(r.v for r in rows if r.g == g)
        assert {r.v: r.r for r in rows if r.g == g} == {v: i for i, v in enumerate(own, 1)}


@pytest.mark.parametrize("cell", [triangles.CELL, 1500, 150])
def test_a_store_without_colors_is_counted_by_cells(spark, monkeypatch, cell):
    """One part, some and many; edges are repeated, turned, loops, or end in no node."""
    monkeypatch.setattr(triangles, "CELL", cell)
    rng = random.Random(4)
    ids = [-(2**62), 2**62, *range(-5, 90)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(1200)] + [(7, i) for i in range(90)] + [(5, 5), (3, 1000), (1000, 4), (None, 3)]
    edges = {(min(e), max(e)) for e in pairs if None not in e and 1000 not in e and e[0] != e[1]}
    near = {i: {a + b - i for a, b in edges if i in (a, b)} for i in ids}
    closed = sum(len(near[a] & near[b]) for a, b in edges) // 3
    paths = sum(len(x) * (len(x) - 1) // 2 for x in near.values())
    nodes = spark.createDataFrame([(i, "a") for i in ids], "int_id long, cell_type string")
    sg = integer_graph(nodes, spark.createDataFrame(pairs, "from_id long, to_id long"))
    found = {r.motif_id: r["count"] for r in M.find_motifs(sg, 3, colored=False).catalog.collect()}
    assert found == {"size3_closed": closed, "size3_open": paths - 3 * closed}
    assert M.find_motifs(integer_graph(nodes, spark.createDataFrame([], "from_id long, to_id long")), 3, colored=False).catalog.collect() == []


def test_pairs_of_neighbours_of_a_store_are_not_shuffled(spark):
    """All pairs of 600 nodes: 36 million triangles, half as many pairs of neighbours beyond each node."""
    shuffled = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)).get(0).totalShuffleWrite()
    n = 600
    nodes = spark.range(n).select(F.col("id").alias("int_id"), F.lit("a").alias("cell_type"))
    edges = spark.range(n).select(F.col("id").alias("from_id"), F.explode(F.sequence(F.col("id"), F.lit(n - 1))).alias("to_id"))
    before = shuffled()
    found = {r.motif_id: r["count"] for r in M.find_motifs(integer_graph(nodes, edges), 3, colored=False).catalog.collect()}
    assert found == {"size3_closed": n * (n - 1) * (n - 2) // 6}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    assert shuffled() - before < 8 << 20
