"""From raw counts to cells in few dimensions: quality filters, normalisation and principal components.

Expression is a long table of non-zero values (gene, cell_id, value). Filters and normalisation are aggregations. The
components come from the genes' Gram matrix: tasks multiply tiles of it from the cells that they hold, 64 or so genes
times as many, and the tiles are added where they meet. Power iterations then turn a small basis by the staged tiles,
until the shares of variance stand still. What the driver holds is that basis: genes x components numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.lineage import checkpointed
from cellweave.plans.ranks import ranked_in_ranges


def quality_filtered(expression: DataFrame, threshold: float = 1.0, min_cells: int = 3, min_genes: int = 5) -> DataFrame:
    """The values of genes that reach the threshold in min_cells cells or more, in cells where min_genes such genes do."""
    seen = F.count_if(F.col("value") >= threshold).alias("n")
    genes = expression.groupBy("gene").agg(seen).where(F.col("n") >= min_cells).select("gene")
    kept = expression.join(genes, "gene", "left_semi")
    cells = kept.groupBy("cell_id").agg(seen).where(F.col("n") >= min_genes).select("cell_id")
    return kept.join(cells, "cell_id", "left_semi").select("gene", "cell_id", "value")


def normalised(expression: DataFrame, scale: float = 6000.0) -> DataFrame:
    """log2(1 + scale * value / sum of the cell's values). Cells whose sum isn't positive are left out."""
    totals = expression.groupBy("cell_id").agg(F.sum("value").alias("__total")).where("__total > 0")
    value = F.log2(1 + F.lit(scale) * F.col("value") / F.col("__total"))
    return expression.join(totals, "cell_id").select("gene", "cell_id", value.alias("value"))


@dataclass(frozen=True)
class Components:
    """scores(cell_id, pc long, value), loadings(gene, pc, value), shares of the variance by component, total variance."""

    scores: DataFrame
    loadings: DataFrame
    shares: list[float]
    variance: float


def _tiles(rows: DataFrame, n_genes: int, side: int, cells_at_once: int) -> DataFrame:
    """(i, j, tile) with i <= j of the Gram matrix of rows(g array<int>, v array<double>), staged; a task sends one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros((side, side)))
        for batch in batches:
            for start in range(0, batch.num_rows, cells_at_once):
                part = batch.slice(start, cells_at_once)
                lists, values = part.column("g"), part.column("v")
                at = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                g, v = lists.flatten().to_numpy(), values.flatten().to_numpy()
                blocks = {}
                for b in np.unique(g // side):
                    own = g // side == b
                    dense = np.zeros((part.num_rows, side))
                    dense[at[own], g[own] % side] = v[own]
                    blocks[int(b)] = dense
                for i in blocks:
                    for j in blocks:
                        if i <= j:
                            sums[i, j] += blocks[i].T @ blocks[j]
        for (i, j), tile in sums.items():
            yield pa.record_batch([pa.array([i]), pa.array([j]), pa.array([tile.astype("<f8").tobytes()])], names=["i", "j", "tile"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
                tile = np.frombuffer(data, "<f8")
                if (i, j) == now:
                    total = total + tile
                    continue
                if now is not None:
                    yield pa.record_batch([pa.array([now[0]]), pa.array([now[1]]), pa.array([total.tobytes()])], names=["i", "j", "tile"])
                now, total = (i, j), tile
        if now is not None:
            yield pa.record_batch([pa.array([now[0]]), pa.array([now[1]]), pa.array([total.tobytes()])], names=["i", "j", "tile"])

    schema = "i long, j long, tile binary"
    parts = rows.mapInArrow(run, schema).repartition("i", "j").sortWithinPartitions("i", "j")
    return checkpointed(parts.mapInArrow(add, schema))


def _turned(tiles: DataFrame, basis: np.ndarray, side: int) -> np.ndarray:
    """The Gram matrix times a basis: products by tiles, added by gene and column."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((side, k)))
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
                tile = np.frombuffer(data, "<f8").reshape(side, side)
                sums[i] += tile @ basis[j * side : (j + 1) * side]
                if i != j:
                    sums[j] += tile.T @ basis[i * side : (i + 1) * side]
        for b, y in sums.items():
            yield pa.record_batch([pa.array(np.arange(b * side * k, (b + 1) * side * k)), pa.array(y.ravel())], names=["at", "v"])

    out = np.zeros(basis.size)
    for row in tiles.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # genes x components
        out[row["at"]] = row["v"]
    return out.reshape(basis.shape)


def principal_components(expression: DataFrame, cells: DataFrame, k: int = 20, side: int = 64, iterations: int = 60, tolerance: float = 1e-9, seed: int = 1, extra: int = 10) -> Components:
    """The first k components of the cells(cell_id) by genes matrix whose non-zero values are expression's, genes centered.

    Cells without values count as zeros. A component's sign makes its largest loading positive. k is at most the number of
    genes; a matrix without variance has no components.
    """
    spark = expression.sparkSession
    genes = ranked_in_ranges(expression.select("gene").distinct(), [], ["gene"], "at").select("gene", (F.col("at") - 1).cast("int").alias("g"))
    genes = checkpointed(genes)
    n, n_genes = cells.select("cell_id").distinct().count(), genes.count()
    long = expression.join(cells.select("cell_id").distinct(), "cell_id", "left_semi").join(genes, "gene")
    pairs = F.sort_array(F.collect_list(F.struct("g", "value")))
    rows = checkpointed(long.groupBy("cell_id").agg(pairs.alias("p")).select("cell_id", F.col("p.g").alias("g"), F.col("p.value").cast("array<double>").alias("v")))
    sums, own = np.zeros(n_genes), long.groupBy("g").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).collect()
    square = 0.0
    for r in own:  # a row per gene
        sums[r.g], square = r.s, square + r.q
    mean = sums / max(n, 1)
    total = max(square - n * float(mean @ mean), 0.0)
    empty = (spark.createDataFrame([], "cell_id string, pc int, value double"), spark.createDataFrame([], "gene string, pc int, value double"))
    k = min(k, n_genes)
    if n < 2 or not k or total <= 1e-12 * max(square, 1e-300):
        return Components(*empty, [], 0.0)
    tiles = _tiles(rows.select("g", "v"), n_genes, side, 512)
    width = -(-n_genes // side) * side
    padded = np.zeros(width)
    padded[:n_genes] = mean
    wide = min(k + extra, n_genes)
    basis = np.zeros((width, wide))
    basis[:n_genes] = np.random.default_rng(seed).normal(size=(n_genes, wide))
    basis = np.linalg.qr(basis)[0]
    shares = np.zeros(k)
    for _ in range(iterations):
        turned = _turned(tiles, basis, side) - n * np.outer(padded, padded @ basis)
        values, inner = np.linalg.eigh((basis.T @ turned + turned.T @ basis) / 2)
        order = np.argsort(-values)
        vectors, now = basis @ inner[:, order], np.maximum(values[order][:k], 0) / total
        done = np.abs(now - shares).max() <= tolerance
        shares = now
        if done:
            break
        basis = np.linalg.qr(turned)[0]
    axes = vectors[:n_genes, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shift = mean @ axes

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("g")
            at = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            out = np.zeros((batch.num_rows, k)) - shift
            np.add.at(out, at, batch.column("v").flatten().to_numpy()[:, None] * axes[lists.flatten().to_numpy()])
            yield pa.record_batch([batch.column("cell_id"), pa.array(list(out), pa.list_(pa.float64()))], names=["cell_id", "x"])

    bare = cells.select("cell_id").distinct().join(rows.select("cell_id"), "cell_id", "left_anti").select("cell_id", F.array().cast("array<int>").alias("g"), F.array().cast("array<double>").alias("v"))
    placed = rows.select("cell_id", "g", "v").unionByName(bare).mapInArrow(scores, "cell_id string, x array<double>")
    found = placed.select("cell_id", F.posexplode("x").alias("pc", "value")).select("cell_id", (F.col("pc") + 1).alias("pc"), "value")
    table = spark.createDataFrame([(g, [float(x) for x in axes[g]]) for g in range(n_genes)], "g int, x array<double>")
    loadings = table.join(genes, "g").select("gene", F.posexplode("x").alias("pc", "value")).select("gene", (F.col("pc") + 1).alias("pc"), "value")
    return Components(found, loadings, shares.tolist(), total / (n - 1))
