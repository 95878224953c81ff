"""Graph model, construction, storage."""

import hashlib
import itertools
import math
import warnings

import pytest
from pyspark.sql import functions as F

from cellweave.functions.stats import chi2_upper_tail, two_sided_normal, with_bh
from cellweave.graph import SpatialGraph
from cellweave.operators import niche
from cellweave.operators.build import build_spatial_graph, coordinates, numbered
from cellweave.sources.graph_io import expression_from_frame, read_spatial_graph, store_graph, store_node_order, write_spatial_graph
from cellweave.streaming.edges import EdgeAccumulator
from tests.fixtures import random_points, small_graph


def edges(sg):
    return {(r.source, r.target) for r in sg.edges.collect()}


def test_missing_columns(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, "T", "s")], "cell_id string, x double, y double, cell_type string, sample_id string")
    with pytest.raises(ValueError, match="edges lacks target"):
        SpatialGraph.create(nodes, spark.createDataFrame([("a", "s")], "source string, sample_id string"))
    with pytest.raises(ValueError, match="nodes lacks x"):
        SpatialGraph.create(nodes.drop("x"), spark.createDataFrame([], "source string, target string, sample_id string"))
    with pytest.raises(TypeError):
        SpatialGraph.create(nodes, spark.createDataFrame([], "source string, target string, sample_id string"), meta=["no"])


def test_normalisation(spark):
    sg = small_graph(spark, extra=[("b", "a", None, "s1"), ("a", "a", None, "s1")])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        sg = small_graph(spark, extra=[("b", "a", None, "s1"), ("a", "a", None, "s1")])
    assert any("1 edges from a cell to itself" in str(w.message) for w in seen)
    assert sg.edges.count() == 13 and all(s < t for s, t in edges(sg))
    assert "z" in sg.nodes.columns and sg.meta["build_method"] == "unknown"


def test_duplicates_and_dangling(spark):
    with pytest.raises(ValueError, match="end in a cell"):
        small_graph(spark, extra=[("a", "nowhere", None, "s1")])
    sg = small_graph(spark)
    with pytest.raises(ValueError, match="several rows"):
        SpatialGraph.create(sg.nodes.unionByName(sg.nodes.limit(1)), sg.edges)


def test_subset(spark):
    sg = small_graph(spark).subset_region("region_id = 'r1'")
    assert sg.nodes.count() == 4 and sg.edges.count() == 6 and sg.meta["build_method"] == "unknown+subset_region"
    assert small_graph(spark).subset_sample(F.col("sample_id") == "s2").edges.count() == 6
    assert small_graph(spark).subset_region("region_id = 'none'").edges.count() == 0


def test_round_trip(spark, tmp_path):
    sg = small_graph(spark)
    write_spatial_graph(sg, f"{tmp_path}/n", f"{tmp_path}/e")
    back = read_spatial_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert edges(back) == edges(sg) and back.meta["build_method"] == "unknown"
    assert back.fingerprint() == sg.fingerprint()
    with pytest.raises(FileNotFoundError):
        read_spatial_graph(spark, f"{tmp_path}/none", f"{tmp_path}/e")
    assert "8 cells and 13 edges" in sg.summary()


def test_radius_against_brute_force(spark):
    points = random_points(80, 5)
    sg = build_spatial_graph(spark.createDataFrame(points), "radius", radius=0.15)
    want = {tuple(sorted((a.cell_id, b.cell_id))) for a, b in itertools.combinations(points.itertuples(), 2) if math.hypot(a.x - b.x, a.y - b.y) <= 0.15}
    assert edges(sg) == want
    with pytest.raises(ValueError, match="radius"):
        build_spatial_graph(spark.createDataFrame(points), "radius")


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_knn_against_brute_force(spark, scale):
    points = random_points(70, 9)
    points.loc[:5, ["x", "y"]] *= 20  # outliers, whose neighbours are far
    points[["x", "y"]] *= scale
    sg = build_spatial_graph(spark.createDataFrame(points), "knn", k=4)
    want = set()
    for a in points.itertuples():
        near = sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell_id) for b in points.itertuples() if b.cell_id != a.cell_id)[:4]
        want |= {tuple(sorted((a.cell_id, b))) for _, b in near}
    assert edges(sg) == want and 70 * 4 / 2 <= len(want) <= 70 * 4
    capped = build_spatial_graph(spark.createDataFrame(points), "knn", k=4, max_distance=0.1 * scale)
    assert capped.edges.where(F.col("distance") > 0.1 * scale).count() == 0
    with pytest.raises(ValueError, match="more than 70 points"):
        build_spatial_graph(spark.createDataFrame(points), "knn", k=70)


def test_knn_of_clusters(spark):
    points = random_points(160, 4)
    points.loc[:119, ["x", "y"]] = points.loc[:119, ["x", "y"]] * 1e-4 + 0.5  # most points in one spot
    sg = build_spatial_graph(spark.createDataFrame(points), "knn", k=3)
    want = set()
    for a in points.itertuples():
        near = sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell_id) for b in points.itertuples() if b.cell_id != a.cell_id)[:3]
        want |= {tuple(sorted((a.cell_id, b))) for _, b in near}
    assert edges(sg) == want


def test_knn_coincident_and_few_distinct(spark):
    points = random_points(12, 1).assign(x=0.5, y=0.5)
    assert build_spatial_graph(spark.createDataFrame(points), "knn", k=2).edges.count() > 0


def circle_edges(points):
    """Pairs through which a circle passes that holds no other point."""
    found = set()
    for a, b in itertools.combinations(points.itertuples(), 2):
        low, high = -math.inf, math.inf
        for c in points.itertuples():
            if c.cell_id not in (a.cell_id, b.cell_id):
                side = (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)
                at = ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y)) / (2 * side)
                low, high = (low, min(high, at)) if side > 0 else (max(low, at), high)
        if low <= high:
            found.add(tuple(sorted((a.cell_id, b.cell_id))))
    return found


@pytest.mark.parametrize("height", [1.0, 1e-3, 1e-5])
def test_delaunay(spark, height):
    points = random_points(90, 2)
    points["y"] *= height
    assert edges(build_spatial_graph(spark.createDataFrame(points), "delaunay")) == circle_edges(points)


def test_delaunay_of_degenerate_points(spark):
    points = random_points(60, 2)
    assert build_spatial_graph(spark.createDataFrame(points.assign(y=0.0)), "delaunay").edges.count() == 59
    grid = points.assign(x=[i // 6 for i in range(60)], y=[i % 6 for i in range(60)]).astype({"x": float, "y": float})
    # ten by six points, 28 of them on the border: every face is a triangle
    assert build_spatial_graph(spark.createDataFrame(grid), "delaunay").edges.count() == 3 * 60 - 3 - 28
    twice = points.assign(x=[i // 2 for i in range(60)], y=[(i // 2) ** 2 % 7 for i in range(60)]).astype({"x": float, "y": float})
    found = build_spatial_graph(spark.createDataFrame(twice), "delaunay").edges
    assert found.where("distance = 0").count() == 30


def test_coordinates_and_ids(spark):
    df = coordinates(spark, [[0.0, 1.0], [2.0, 3.0]])
    assert df.columns == ["x", "y"]
    with pytest.raises(ValueError):
        coordinates(spark, [[1.0]])
    sg = build_spatial_graph(df.withColumn("cell_type", F.lit("T")), "radius", radius=5.0, sample_id="s1")
    assert edges(sg) == {("cell_1", "cell_2")}


def test_store_and_stream(spark, tmp_path):
    nodes = spark.createDataFrame([("b", 2), ("a", 1), ("c", 5)], "node_id string, int_id long")
    nodes.write.parquet(f"{tmp_path}/nodes")
    assert [r.int_id for r in store_node_order(spark, f"{tmp_path}/nodes").collect()] == [1, 2, 5]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 5), (5, 5)], "from_id long, to_id long")
    sg = store_graph(nodes, pairs, ["T", "B", "M"])
    assert sg.edges.count() == 2
    assert {int(r.cell_id): r.cell_type for r in sg.nodes.collect()} == {1: "T", 2: "B", 5: "M"}
    gathered = EdgeAccumulator(spark, f"{tmp_path}/stream")
    gathered.add(pairs, 0)
    gathered.add(pairs, 0)
    gathered.add(pairs.limit(1), 1)
    assert gathered.edges().count() == 2


def test_live_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, 2), (2, 3)], "from_id long, to_id long").write.parquet(source)
    gathered = EdgeAccumulator(spark, f"{tmp_path}/out")
    stream = spark.readStream.schema("from_id long, to_id long").parquet(source)
    q = gathered.start(stream, f"{tmp_path}/check", availableNow=True)
    q.awaitTermination(60)
    assert gathered.edges().count() == 2


def test_statistics(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    rows = with_bh(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p", "q").orderBy("i").collect()
    assert [round(r.q, 6) if r.q is not None else None for r in rows] == [0.04, 0.053333, 0.053333, 0.5, None]
    z = spark.createDataFrame([(1.959963984540054,), (10.0,)], "z double").select(two_sided_normal("z").alias("p")).collect()
    assert z[0].p == pytest.approx(0.05) and 0 < z[1].p < 1e-20
    x = spark.createDataFrame([(5.991464547, 2), (3.841458821, 1), (7.814727903, 3), (11.07049769, 5)], "x double, k int").select(chi2_upper_tail("x", "k").alias("p")).collect()
    assert [r.p for r in x] == pytest.approx([0.05] * 4, rel=1e-6)


def test_niches(spark):
    points = spark.createDataFrame(random_points(40, 3))
    c = niche.neighborhood_composition(points, 5)
    assert c.groupBy("cell_id").agg(F.round(F.sum("fraction"), 9).alias("s")).where("s <> 1").count() == 0
    assert niche.niches(c, ["B", "M", "T"], k=2, starts=2).select("niche").distinct().count() == 2
    assert niche.pseudo_samples(points, 4).select("sample_id").distinct().count() == 4


def squares(v, centres):
    return [sum((a / 1e9 - b) * (a / 1e9 - b) for a, b in zip(v, c)) for c in centres]


def plain_niches(vectors, k, starts, iterations, seed):
    """Lloyd's steps, one start and one cell at a time; vectors in billionths."""
    fits = []
    for start in range(starts):
        drawn = sorted(set(vectors.values()), key=lambda v: hashlib.md5(f"{seed}:{start}:{','.join(map(str, v))}".encode()).hexdigest())
        centres = [[a / 1e9 for a in v] for v in drawn[:k]]
        for _ in range(iterations):
            members = [[] for _ in centres]
            for v in vectors.values():
                d = squares(v, centres)
                members[d.index(min(d))].append(v)
            centres = [[sum(col) / (len(own) * 1e9) for col in zip(*own)] if own else c for own, c in zip(members, centres)]
        fits.append((round(sum(min(squares(v, centres)) for v in vectors.values()), 6), start, centres))
    centres = sorted(min(fits)[2])
    return {cell: (d := squares(v, centres)).index(min(d)) for cell, v in vectors.items()}


@pytest.mark.parametrize("k", [1, 3, 200])
def test_niches_against_plain_steps(spark, k):
    points = spark.createDataFrame(random_points(60, 8))
    c = niche.neighborhood_composition(points, 5)
    types = ["B", "M", "T"]
    vectors = {r.cell_id: tuple(round(r[t] * 10**9) for t in types) for r in niche.composition_matrix(c, types).collect()}
    got = {r.cell_id: r.niche for r in niche.niches(c, types, k=k, starts=4, iterations=6, seed=2).collect()}
    assert got == plain_niches(vectors, k, 4, 6, 2)
    assert niche.niches(c.limit(0), types).count() == 0


@pytest.mark.parametrize("xs", [[], [2.0] * 6, [None, 0.5, float("nan"), 7.25, -3.0, 0.5, 7.25, None, 1e300, -1e300]])
def test_numbers_of_points(spark, xs):
    points = spark.createDataFrame([(x, float(i % 3), "t") for i, x in enumerate(xs)], "x double, y double, cell_type string")
    want = points.orderBy("x", "y", "cell_type").collect()
    got = sorted(numbered(points).collect(), key=lambda r: int(r.cell_id[5:]))
    assert [r.cell_id for r in got] == [f"cell_{i}" for i in range(1, len(xs) + 1)]
    assert [str(r[:3]) for r in got] == [str(tuple(r)) for r in want]


def test_expression_input(spark):
    import pandas as pd

    e, cells, genes = expression_from_frame(spark, pd.DataFrame([[0.0, 2.0], [1.0, 0.0]], index=["g1", "g2"], columns=["a", "b"]))
    assert e.count() == 2 and cells.count() == 2 and genes.count() == 2
