"""Enumeration against brute force, labels, enrichment, association, comparison."""

import itertools
import warnings
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import motifs as M
from cellweave.operators.build import build_spatial_graph
from cellweave.operators.compare import compare_motifs
from cellweave.operators.enrichment import motif_enrichment, motif_enrichment_stream, permuted_labels, test_motif_enrichment as enrichment_test
from cellweave.operators.genes import associate_genes
from tests.fixtures import line_graph, random_points, small_graph


def catalog(m):
    return {r.motif_id: r["count"] for r in m.catalog.collect()}


def brute(sg, size):
    """{(class, sorted colors by degree)}: counts over all connected induced subgraphs."""
    color = {r.cell_id: r.cell_type for r in sg.nodes.collect()}
    links = {frozenset((r.source, r.target)) for r in sg.edges.collect()}
    classes = {(2, (1, 1)): "edge", (3, (2, 2, 2)): "triangle", (3, (1, 1, 2)): "wedge", (4, (1, 1, 1, 3)): "claw", (4, (1, 1, 2, 2)): "path", (4, (2, 2, 2, 2)): "cycle", (4, (1, 2, 2, 3)): "paw", (4, (2, 2, 3, 3)): "diamond", (4, (3, 3, 3, 3)): "K4"}
    found = Counter()
    for s in itertools.combinations(sorted(color), size):
        d = {v: sum(frozenset((v, u)) in links for u in s if u != v) for v in s}
        k = classes.get((size, tuple(sorted(d.values()))))
        if k and not (k == "path" and min(d.values()) == 0):
            found[k, tuple(color[v] for v in sorted(s, key=lambda v: (d[v], color[v])))] += 1
    return found


def test_golden(spark):
    sg = small_graph(spark)
    assert catalog(M.find_motifs(sg, 2)) == {"size2_edge_B-B": 2, "size2_edge_B-T": 9, "size2_edge_T-T": 2}
    assert catalog(M.find_motifs(sg, 3)) == {"size3_closed_B-B-T": 4, "size3_closed_B-T-T": 4, "size3_open_B-B_T": 2, "size3_open_B-T_B": 1, "size3_open_B-T_T": 1, "size3_open_T-T_B": 2}
    assert catalog(M.find_motifs(sg, 4, colored=False)) == {"size4_K4": 2, "size4_paw": 6, "size4_path": 9}


@pytest.mark.parametrize(
    "edges,want",
    [
        ("ab ac ad bc bd cd", {"K4": 1}), ("ab bc cd", {"path": 1}), ("ab ac ad", {"claw": 1}), ("ab bc cd ad", {"cycle": 1}), ("ab bc ac cd", {"paw": 1}), ("ab ac ad bc bd", {"diamond": 1}),
        ("ac ad ae bc bd be", {"claw": 2, "cycle": 3}), (" ".join(map("".join, itertools.combinations("abcde", 2))), {"K4": 5}),
    ],
)
def test_four_shapes(spark, edges, want):
    assert catalog(M.find_motifs(line_graph(spark, edges), 4, colored=False)) == {f"size4_{k}": n for k, n in want.items()}


@pytest.mark.parametrize("size", [2, 3, 4])
def test_brute_force(spark, size):
    sg = build_spatial_graph(spark.createDataFrame(random_points(26, size)), "knn", k=3).persist()
    m = M.find_motifs(sg, size)
    got = Counter()
    for r in m.instances.collect():
        order = sorted(range(size), key=lambda i: (r.degrees[i], r.colors[i]))
        got[r.topology, tuple(r.colors[i] for i in order)] += 1
    assert got == brute(sg, size)
    assert m.instances.count() == m.instances.select("cells").distinct().count()
    # colored classes partition the uncolored ones
    plain = catalog(M.find_motifs(sg, size, colored=False))
    sums = Counter()
    for r in m.catalog.collect():
        sums[r.canonical_iso_class] += r["count"]
    assert sorted(plain.values()) == sorted(sums.values())
    # incidence: `size` rows per instance, an orbit per (degree, color)
    assert m.incidence.count() == size * sum(plain.values())
    assert m.incidence.groupBy("motif_id", "orbit_id").agg(F.count_distinct("cell_id").alias("n")).count() >= len(catalog(m))


def test_exact_labels(spark):
    one, two = line_graph(spark, "ab bc cd", "AABB"), line_graph(spark, "ab bc cd", "ABAB")
    assert catalog(M.find_motifs(one, 4)) == catalog(M.find_motifs(two, 4)) == {"size4_path_A-B-A-B": 1}
    assert catalog(M.find_motifs(one, 4, labeling="exact")) == {"size4_path_A-A-B-B": 1}
    assert catalog(M.find_motifs(two, 4, labeling="exact")) == {"size4_path_A-B-A-B": 1}
    rings = [catalog(M.find_motifs(line_graph(spark, "ab bc cd ad", t), 4, labeling="exact")) for t in ("AABB", "ABAB", "BBAA", "ABBA")]
    assert rings[0] == rings[2] == rings[3] == {"size4_cycle_A-A-B-B": 1} and rings[1] == {"size4_cycle_A-B-A-B": 1}


@pytest.mark.parametrize("size", [2, 3, 4])
def test_anchors(spark, size):
    sg = build_spatial_graph(spark.createDataFrame(random_points(40, 8)), "knn", k=3).persist()
    wanted = {"c3", "c17"}
    everything = {tuple(r.cells) for r in M.find_motifs(sg, size).instances.collect() if wanted & set(r.cells)}
    assert {tuple(r.cells) for r in M.find_motifs(sg, size, anchored_on=sorted(wanted)).instances.collect()} == everything
    with pytest.raises(ValueError, match="1 of the anchors"):
        M.find_motifs(sg, size, anchored_on=["c3", "nowhere"])


def test_cap_and_checks(spark):
    sg = small_graph(spark)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        m = M.find_motifs(sg, 3, max_instances=5)
    assert any("smallest digests" in str(w.message) for w in seen)
    assert sum(catalog(m).values()) == 5 and m.incidence.select("instance_id").distinct().count() == 5
    assert catalog(M.find_motifs(sg, 3, max_instances=5)) == catalog(m)
    for bad in (dict(size=5), dict(max_instances=0), dict(backend="none")):
        with pytest.raises(ValueError):
            M.find_motifs(sg, **bad)
    ids = [r.instance_id for r in M.find_motifs(sg, 2, compat_ids=True).instances.collect()]
    assert sorted(ids, key=lambda x: int(x[2:])) == [f"e_{i}" for i in range(1, 14)]
    with pytest.raises(ValueError, match="catalog lacks"):
        M.Motifs(m.catalog.drop("count"), m.incidence)


def test_views(spark):
    sg = small_graph(spark)
    m = M.find_motifs(sg, 3)
    assert m.instance_table("wedge").columns == ["instance_id", "end1", "end2", "center"]
    assert M.find_motifs(sg, 4).instance_table("paw").columns[1:] == ["w1", "w2", "w3", "w4", "d1", "d2", "d3", "d4"]
    top = m.plot_data(2, 10).collect()
    assert len(top) == 2 and all(len(r.label) == 10 and r.label.endswith("...") for r in top)
    assert "14 instances of" in m.summary()
    density = {r.cell_id: r.n for r in M.motif_density(sg, m).collect()}
    assert sum(density.values()) == 14 * 3
    inside = M.motifs_within(m, sg.nodes.where("region_id = 'r1'"))
    assert sum(catalog(inside).values()) == 4
    got = M.motif_instances(sg, ["size3_open_B-T-T"], 3).collect()
    assert len(got) == 6 and {r.slot for r in got} == {1, 2, 3}
    assert M.motif_instances(sg, [], 3).count() == 0


def test_empty_graph(spark):
    sg = small_graph(spark).subset_region("cell_id = 'a'")
    for size in (2, 3, 4):
        assert M.find_motifs(sg, size).catalog.count() == 0
    with pytest.raises(ValueError, match="no motif class"):
        M.find_motifs(sg, 2).plot_data()


def test_null_type_counts_as_a_type(spark):
    sg = small_graph(spark)
    sg = type(sg)(sg.nodes.withColumn("cell_type", F.when(F.col("cell_id") != "a", F.col("cell_type"))), sg.edges, {})
    assert sum(catalog(M.find_motifs(sg, 2)).values()) == 13


def test_permutations_keep_composition(spark):
    sg = small_graph(spark)
    drawn = permuted_labels(sg.nodes, 4, 3, F.col("region_id"))
    rows = drawn.join(sg.nodes.select("cell_id", "region_id"), "cell_id").groupBy("perm", "region_id", "label").count().collect()
    assert {r["count"] for r in rows} == {2} and len(rows) == 16
    for stratum in (None, F.col("region_id")):
        one, many = (permuted_labels(sg.nodes, 3, 5, stratum, rows_per_lane=n).orderBy("perm", "cell_id").collect() for n in (100, 3))
        assert one == many
    held = permuted_labels(sg.nodes, 2, 3, None, F.col("cell_id") == "a").where("cell_id = 'a'").collect()
    assert [r.label for r in held] == ["T", "T"]


@pytest.mark.parametrize("null", ["label_permutation", "region_stratified"])
def test_enrichment_against_plain_python(spark, null):
    sg = small_graph(spark)
    m = M.find_motifs(sg, 3)
    n = 70  # more than a block
    table = {r.motif_id: r for r in enrichment_test(m, sg, null, n, 5).table.collect()}
    labels = permuted_labels(sg.nodes, n, 5, F.col("region_id") if null == "region_stratified" else None).toPandas()
    instances = m.instances.collect()
    counts = []
    for _, own in labels.groupby("perm"):
        color = dict(zip(own["cell_id"], own["label"]))
        c = Counter()
        for r in instances:
            k = [color[v] for v in r.cells]
            c["size3_closed_" + "-".join(sorted(k)) if r.topology == "triangle" else f"size3_open_{'-'.join(sorted(k[:2]))}_{k[2]}"] += 1
        counts.append(c)
    for motif, row in table.items():
        x = np.array([c[motif] for c in counts], float)
        assert row.mean_null == pytest.approx(x.mean()) and row.sd_null == pytest.approx(x.std(ddof=1), abs=1e-9)
        assert row.p_emp == pytest.approx((1 + (x >= row.observed).sum()) / (1 + n))
    assert set(table) == set(catalog(m))


def test_one_call_enrichment(spark):
    sg = build_spatial_graph(spark.createDataFrame(random_points(60, 4).assign(region_id=["r1", "r2"] * 30)), "knn", k=4).persist()
    e = motif_enrichment(sg, 3, 20, 1)
    rows = e.table.collect()
    assert sum(r.observed for r in rows) == e.n_instances and all(len(r.color_tuple) == 3 for r in rows)
    assert e.table.columns == ["motif_id", "topology", "size", "color_tuple", "observed", "expected", "sd_null", "z", "fold", "p_enrich", "p_deplete", "p_adj"]
    again = motif_enrichment(sg, 3, 20, 1).table.collect()
    assert again == rows and motif_enrichment(sg, 3, 20, 2).table.collect() != rows
    assert motif_enrichment(sg, 2, 5, strata_column="region_id").null == "stratified"
    four = motif_enrichment(sg, 4, 4)
    assert sum(r.observed for r in four.table.collect()) == four.n_instances
    with pytest.raises(ValueError, match="not found"):
        motif_enrichment(sg, 2, 5, strata_column="none")
    mono = M.find_motifs(sg, 3, colored=False)
    assert all(r.sd_null == 0 and r.z == 0 for r in enrichment_test(mono, sg, n_perm=5).table.collect())


def test_conditional_null(spark):
    sg = build_spatial_graph(spark.createDataFrame(random_points(40, 6, "AB")), "knn", k=3).persist()
    e = motif_enrichment(sg, 2, 4, 1, "conditional", cond_temp=0.5, cond_steps=3000)
    free = motif_enrichment(sg, 2, 4, 1)
    spread = lambda x: sum(abs(r.observed - r.expected) for r in x.table.collect())
    assert e.diagnostics.count() == 4 and spread(e) <= spread(free)


def test_jitter(spark):
    sg = build_spatial_graph(spark.createDataFrame(random_points(40, 6)), "knn", k=3).persist()
    m = M.find_motifs(sg, 2)
    rows = enrichment_test(m, sg, "geometric_jitter", 3, 1, null_args={"sd": 0.05}).table.collect()
    assert all(r.mean_null > 0 for r in rows if r.observed > 8)
    tiny = enrichment_test(m, sg, "geometric_jitter", 2, 1, null_args={"sd": 1e-12}).table.collect()
    assert all(r.mean_null == r.observed for r in tiny)
    with pytest.raises(ValueError, match="sd"):
        enrichment_test(m, sg, "geometric_jitter", 2)
    with pytest.raises(ValueError, match="build_spatial_graph"):
        enrichment_test(m, sg.subset_region("true"), "geometric_jitter", 2, null_args={"sd": 1.0})


def test_stream_equals_graph(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, j) for i, j in itertools.combinations(range(30), 2) if rng.random() < 0.12]
    edges = spark.createDataFrame(pairs, "from_id long, to_id long")
    labels = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(40)], "int_id long, cell_type string")
    e = motif_enrichment_stream(edges, labels, 2, 5)
    assert sum(r.observed for r in e.table.collect()) == len(pairs)
    with pytest.raises(ValueError, match="no label"):
        motif_enrichment_stream(edges, labels.where("int_id < 5"), 2, 5)
    with pytest.raises(ValueError, match="duplicates"):
        motif_enrichment_stream(edges, labels.unionByName(labels.limit(1)), 2, 5)


def dense_rank_sum(values, inside):
    r = pd.Series(values).rank().to_numpy()
    n, a = len(values), inside.sum()
    t = Counter(values.tolist())
    u = r[inside].sum() - a * (a + 1) / 2
    s2 = a * (n - a) / 12 * ((n + 1) - sum(k**3 - k for k in t.values()) / (n * (n - 1)))
    return u, (u - a * (n - a) / 2) / np.sqrt(max(s2, 2.220446049250313e-16))


@pytest.mark.parametrize("by", ["motif", "orbit"])
def test_genes_against_dense(spark, by):
    rng = np.random.default_rng(11)
    points = random_points(60, 11)
    sg = build_spatial_graph(spark.createDataFrame(points), "knn", k=4).persist()
    x = rng.poisson(0.5, (8, 60)).astype(float)
    x[0] += rng.poisson(5, 60) * (points["cell_type"] == "T")
    x[1] -= rng.poisson(0.3, 60)  # some negative values
    long = [(f"g{g}", f"c{c}", float(x[g, c])) for g in range(8) for c in range(60) if x[g, c] != 0]
    e = spark.createDataFrame(long, "gene string, cell_id string, value double")
    m = M.find_motifs(sg, 2)
    out = associate_genes(m, e, sg, by=by, min_cells=5)
    assert out.columns == ["motif_id", "orbit_id", "gene", "n_in", "n_out", "n_in_expressed", "mean_in", "mean_out", "log2FC", "U", "z", "p", "p_adj_BH"]
    members = m.incidence.select("motif_id", "orbit_id" if by == "orbit" else F.lit(None).alias("orbit_id"), "cell_id").distinct().toPandas()
    rows = out.collect()
    assert rows
    for r in rows[::7]:
        own = members[(members["motif_id"] == r.motif_id) & ((members["orbit_id"] == r.orbit_id) | (by == "motif"))]
        inside = np.isin([f"c{i}" for i in range(60)], own["cell_id"])
        u, z = dense_rank_sum(x[int(r.gene[1:])], inside)
        assert r.n_in == inside.sum() and r.U == pytest.approx(u) and r.z == pytest.approx(z)
    scored = associate_genes(m, e, sg, method="module_score", modules={"m": ["g0", "g2", "none"], "gone": ["none"]}, min_cells=5)
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    for r in scored.collect():
        own = members[members["motif_id"] == r.motif_id]
        inside = np.isin([f"c{i}" for i in range(60)], own["cell_id"])
        score = z[[0, 2]].mean(axis=0)
        assert r.gene == "m" and r.log2FC == pytest.approx(score[inside].mean() - score[~inside].mean())
    assert associate_genes(m, e, sg, min_cells=1000).count() == 0
    with pytest.raises(ValueError, match="module scores"):
        associate_genes(m, e, sg, method="module_score")


def test_genes_per_sample(spark):
    frames = [random_points(60, s).assign(sample_id=f"s{s}") for s in (1, 2, 3)]
    for i, f in enumerate(frames):
        f["cell_id"], f["x"] = [f"s{i}_{j}" for j in range(60)], f["x"] + 10 * i
    points = pd.concat(frames)
    rng = np.random.default_rng(0)
    sg = build_spatial_graph(spark.createDataFrame(points), "knn", k=4, per_sample=True).persist()
    rows = [("g1", c, float(v)) for c, t, v in zip(points["cell_id"], points["cell_type"], rng.poisson(0.5, 180)) for v in [v + 5 * (t == "T")] if v]
    e = spark.createDataFrame(rows, "gene string, cell_id string, value double")
    m = M.find_motifs(sg, 2)
    out = {r.motif_id: r for r in associate_genes(m, e, sg, pooling="per_sample", min_cells=5).collect()}
    assert out["size2_edge_T-T"].n_samples_tested == 3 and out["size2_edge_T-T"].z_combined > 5
    one = sg.subset_sample("sample_id = 's1'")
    with pytest.warns(UserWarning, match="single sample"):
        assert "U" in associate_genes(M.find_motifs(one, 2), e, one, pooling="per_sample", min_cells=5).columns


def test_compare(spark):
    sg = small_graph(spark)
    a, b = (M.find_motifs(sg.subset_region(f"region_id = '{r}'"), 3) for r in ("r1", "r2"))
    out = compare_motifs({"a": a, "b": b})
    rows = out.collect()
    assert all(r.count_a + r.count_b == r.total and r.df == 1 and r.chi2 == pytest.approx(0) and r.p == pytest.approx(1) for r in rows)
    whole = compare_motifs([a, a, M.find_motifs(sg, 3)], group=["x", "x", "y"]).collect()
    assert {r.motif_id: (r.count_x, r.count_y) for r in whole}["size3_closed_B-B-T"] == (4, 4)
    assert any(r.count_x == 0 for r in whole)
    with pytest.raises(ValueError, match="two groups"):
        compare_motifs([a, b], group=["x", "x"])
    with pytest.raises(ValueError, match="no group has"):
        empty = M.find_motifs(sg.subset_region("false"), 3)
        compare_motifs({"a": empty, "b": empty})


def test_relabelling_and_partitions_do_not_matter(spark):
    points = random_points(50, 13)
    sg = build_spatial_graph(spark.createDataFrame(points), "knn", k=3).persist()
    want = catalog(M.find_motifs(sg, 4))
    other = points.assign(cell_id=["z" + str(997 * i % 1009) for i in range(50)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert catalog(M.find_motifs(build_spatial_graph(spark.createDataFrame(other).repartition(7), "knn", k=3), 4)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conditional_query_grows_with_the_cells(monkeypatch):
    from cellweave import queries

    asked = {}

    class Stop(Exception):
        pass

    def enrich(*args, **named):
        asked.update(named)
        raise Stop

    monkeypatch.setattr(queries, "graph", lambda *a: None)
    monkeypatch.setattr(queries, "motif_enrichment", enrich)
    with pytest.raises(Stop):
        queries.QUERIES["enrich_conditional"](None, "")
    assert asked.get("cond_steps") is None


def test_swap_chain_keeps_its_books():
    import numpy as np

    from cellweave.operators.enrichment import Chain

    rng = np.random.default_rng(5)
    n = 80
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (240, 2)).tolist() if p[0] != p[1]})
    a, b = np.array(pairs).T
    codes = (np.arange(n) >= 40).astype(int) + (np.arange(n) % 5 == 0)
    chain = Chain(codes, a, b, 3)
    observed = chain.counts(codes)
    # the change of a batch is what counting anew gives, one proposal at a time
    labels = rng.permutation(codes)
    u, v = rng.integers(0, n, 30), rng.integers(0, n, 30)
    at, types, change = chain._changes(u, v, labels)
    for i in range(30):
        swapped = labels.copy()
        swapped[u[i]], swapped[v[i]] = labels[v[i]], labels[u[i]]
        want = chain.counts(swapped) - chain.counts(labels)
        got = np.zeros(9, int)
        got[types[at == i]] = change[at == i]
        assert (got == want).all()
    for temperature in (0.5, 4.0):
        labels, accepted, residual = chain.run(np.random.default_rng(1), 4000, temperature)
        assert sorted(labels) == sorted(codes) and residual == np.abs(chain.counts(labels) - observed).sum() and 0 < accepted < 1
        again = chain.run(np.random.default_rng(1), 4000, temperature)[0]
        assert (labels == again).all() and (labels != codes).any()
    free = np.mean([np.abs(chain.counts(rng.permutation(codes)) - observed).sum() for _ in range(20)])
    assert np.mean([chain.run(np.random.default_rng(k), 4000, 0.5)[2] for k in range(5)]) < free / 3
