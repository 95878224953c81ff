"""The live catalog against the batch one, and sparse matrix files cut at many places."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import motifs as M
from cellweave.sources import matrix_market as mm
from cellweave.sources.graph_io import integer_graph
from cellweave.streaming.catalog import LiveCatalog


def catalog(df):
    return {(r.motif_id, r.size, r.canonical_iso_class, r.color_tuple): r["count"] for r in df.collect()}


def test_live_catalog_after_each_batch_and_replays(spark, tmp_path):
    rng = random.Random(6)
    labels = spark.createDataFrame([(i, rng.choice(["A", "B", None])) for i in range(1, 20)], "int_id long, cell_type string")
    live = LiveCatalog(spark, f"{tmp_path}/live", labels)
    assert live.catalog().collect() == [] and live.edges().collect() == []
    batches = [[(rng.randint(1, 21), rng.randint(1, 21)) for _ in range(n)] for n in (12, 30, 25)]
    batches[1] += batches[0][:4] + [(b, a) for a, b in batches[1][:5]] + [(3, 3)]
    frames, seen = [spark.createDataFrame(b, "from_id long, to_id long") for b in batches], []
    for number, batch in enumerate(frames):
        live.add(batch, number)
        seen += batches[number]
    live.add(frames[-1], len(frames) - 1)  # the last one is replayed
    every = spark.createDataFrame(seen, "from_id long, to_id long")
    ids = spark.range(1, 22).select(F.col("id").alias("int_id")).join(labels, "int_id", "left")
    found = M.find_motifs(integer_graph(ids, every), 3)
    assert catalog(live.catalog()) == catalog(M.catalog_of(found.instances, 3))
    assert live.edges().count() == len({(min(e), max(e)) for e in seen if e[0] != e[1]})


def test_live_hub_costs_its_degree(spark, tmp_path):
    n = 50_000
    live = LiveCatalog(spark, f"{tmp_path}/live", spark.createDataFrame([(0, "H")], "int_id long, cell_type string"))
    live.add(spark.range(1, n + 1).select(F.lit(0).alias("from_id"), F.col("id").alias("to_id")), 0)
    live.add(spark.createDataFrame([(1, 2), (2, 3), (0, n + 1)], "from_id long, to_id long"), 1)
    m = n + 1
    assert {r.motif_id: r["count"] for r in live.catalog().collect()} == {"size3_open_NA-NA_H": m * (m - 1) // 2 - 2, "size3_closed_H-NA-NA": 2, "size3_open_NA-NA_NA": 1}


def matrix(tmp_path, kind="real general", entries=(), size=(40, 30), comments=3, name="m.mtx"):
    lines = [f"%%MatrixMarket matrix coordinate {kind}", *["% note"] * comments, f"{size[0]} {size[1]} {len(entries)}", *[" ".join(map(str, e)) for e in entries]]
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    (tmp_path / "genes.tsv").write_text("".join(f"id{i}\tg{i}\n" for i in range(1, size[0] + 1)))
    (tmp_path / "cells.tsv").write_text("".join(f"c{i}\n" for i in range(1, size[1] + 1)))
    return str(path), str(tmp_path / "genes.tsv"), str(tmp_path / "cells.tsv")


@pytest.mark.parametrize("width", [64, 101, 1 << 20])
def test_matrix_is_whole_wherever_it_is_cut(spark, tmp_path, width):
    rng = random.Random(width)
    # an entry that reads as the size line does
    entries = [(40, 30, 121), *[(i, j, rng.choice([0, 1, 2.5, 1e-3])) for i, j in rng.sample([(i, j) for i in range(1, 40) for j in range(1, 31)], 120)]]
    paths = matrix(tmp_path, entries=entries)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found, cells, genes = mm.read_expression(spark, *paths, gene_field=1)
        got = sorted(map(tuple, found.collect()))
        assert got == sorted((f"g{i}", f"c{j}", float(v)) for i, j, v in entries if v)
        assert cells.count() == 30 and {r.gene for r in genes.collect()} == {f"g{i}" for i in range(1, 41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_matrix_kinds_and_errors(spark, tmp_path):
    entries, size = mm.read_matrix(spark, matrix(tmp_path, "pattern symmetric", [(1, 1), (3, 2)], (4, 4))[0])
    assert sorted(map(tuple, entries.collect())) == [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)] and size == (4, 4, 2)
    entries, size = mm.read_matrix(spark, matrix(tmp_path, entries=[], name="e.mtx")[0])
    assert entries.collect() == [] and size == (40, 30, 0)
    for kind in ("complex general", "real skew-symmetric"):
        with pytest.raises(ValueError, match="not read"):
            mm.read_matrix(spark, matrix(tmp_path, kind, name=f"{kind[:4]}.mtx")[0])
    plain = tmp_path / "plain.txt"
    plain.write_text("1 2 3\n")
    with pytest.raises(ValueError, match="begins with"):
        mm.read_matrix(spark, str(plain))
    with pytest.raises(ValueError, match="outside"):
        mm.read_expression(spark, *matrix(tmp_path, entries=[(41, 1, 2)], name="o.mtx"))
    paths = matrix(tmp_path, entries=[(1, 1, 2)], name="n.mtx")
    with pytest.raises(ValueError, match="names"):
        mm.read_expression(spark, paths[0], paths[2], paths[2])


def test_matrix_round_trip(spark, tmp_path):
    rows = [("g2", "c10", 1.5), ("g1", "c1", 2.0), ("g2", "c2", -1e-7)]
    values = spark.createDataFrame(rows, "gene string, cell_id string, value double")
    genes, cells = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene string"), spark.createDataFrame([("c1",), ("c2",), ("c10",)], "cell_id string")
    found, got_cells, got_genes = mm.read_expression(spark, *mm.write_expression(values, genes, cells, f"{tmp_path}/m"))
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert sorted(r.cell_id for r in got_cells.collect()) == ["c1", "c10", "c2"] and got_genes.count() == 3
