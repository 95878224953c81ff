"""Sparse expression matrices in the MatrixMarket coordinate format, read and written as text by many tasks.

A matrix is a file, or several that are its parts, the first beginning with the banner `%%MatrixMarket`. Spark splits
the files at line ends wherever it likes; only the size line, the first after the banner's comments, has a meaning by
its place, and it is found by the place of its block and its number there. Names of genes and cells stand one a line, in the
order of the matrix's rows and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.ranks import ranked_in_lanes, ranked_in_ranges

BANNER = "%%MatrixMarket"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, number): a text's lines; number grows within a block of a file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return text.withColumn("number", F.monotonically_increasing_id())


def read_names(spark: SparkSession, path: str, field: int = 0) -> DataFrame:
    """(at, name): the given tab-separated field of each line, and its line's number from 1."""
    lines = _lines(spark, path).withColumn("block", F.struct("file", "start"))
    ranked = ranked_in_lanes(lines, [], F.col("block"), ["number"], "at")
    return ranked.select(F.col("at").cast("long").alias("at"), F.split("value", "\t")[field].alias("name"))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """((i, j, value) of the stored entries, counted from 1, (rows, columns, entries)).

    Fields real, integer and pattern (whose entries are 1), general and symmetric. ValueError where there is no banner or size
    line, or another kind of matrix.
    """
    lines = _lines(spark, path)
    banner = lines.where(F.col("value").startswith(BANNER)).select("value", "file").limit(2).collect()
    if len(banner) != 1:
        raise ValueError(f"{path} has {'no' if not banner else 'more than one'} line that begins with {BANNER}")
    kind = banner[0]["value"].lower().split()[1:]
    if len(kind) != 4 or kind[:2] != ["matrix", "coordinate"] or kind[2] not in ("real", "integer", "pattern") or kind[3] not in ("general", "symmetric"):
        raise ValueError(f"matrices of the kind {' '.join(kind)} are not read")
    plain = ~F.col("value").startswith("%") & (F.trim("value") != "")
    size = lines.where(plain & (F.col("file") == banner[0]["file"])).agg(F.min(F.struct("start", "number", "value")).alias("m")).first()["m"]
    if size is None:
        raise ValueError(f"{path} has no size line")
    rows, columns, entries = map(int, size["value"].split())
    own = (F.col("file") == banner[0]["file"]) & (F.col("start") == size["start"]) & (F.col("number") == size["number"])
    parts = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if kind[2] == "pattern" else parts[2].cast("double")
    found = lines.where(plain & ~own).select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), value.alias("value"))
    if kind[3] == "symmetric":
        found = found.unionByName(found.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return found, (rows, columns, entries)


def read_expression(spark: SparkSession, matrix: str, genes: str, cells: str, gene_field: int = 0, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expression(gene, cell_id, value), cells(cell_id), genes(gene)) of a matrix with genes as rows and cells as columns.

    Zeros that are stored are left out. With check, entries outside the size, names that are more or fewer than it says, and
    another number of entries raise a ValueError.
    """
    entries, (n_genes, n_cells, stored) = read_matrix(spark, matrix)
    gene, cell = read_names(spark, genes, gene_field), read_names(spark, cells)
    if check:
        counts = (gene.count(), cell.count())
        if counts != (n_genes, n_cells):
            raise ValueError(f"the matrix is {n_genes} x {n_cells}, but there are {counts[0]} and {counts[1]} names")
        lower = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("i") < 1) | (F.col("i") > n_genes) | (F.col("j") < 1) | (F.col("j") > n_cells)).alias("out")).first()
        if lower.out or lower.n < stored or lower.n > 2 * stored:
            raise ValueError(f"{stored} entries were announced; {lower.n} stand there, {lower.out} of them outside the matrix")
    found = entries.where("value <> 0").join(gene.select(F.col("at").alias("i"), F.col("name").alias("gene")), "i").join(cell.select(F.col("at").alias("j"), F.col("name").alias("cell_id")), "j")
    return found.select("gene", "cell_id", "value"), cell.select(F.col("name").alias("cell_id")), gene.select(F.col("name").alias("gene"))


def write_expression(expression: DataFrame, genes: DataFrame, cells: DataFrame, path: str) -> tuple[str, str, str]:
    """Folders `matrix`, `genes` and `cells` below path, genes and cells in the order of their names; their paths."""
    spark = expression.sparkSession
    named = [ranked_in_ranges(df.select(F.col(c).alias("value")).distinct(), [], ["value"], "at") for df, c in ((genes, "gene"), (cells, "cell_id"))]
    for df, name in zip(named, ("genes", "cells")):
        df.orderBy("at").select("value").write.text(f"{path}/{name}")
    gene, cell = named
    placed = expression.where("value <> 0").join(gene.toDF("gene", "i"), "gene").join(cell.toDF("cell_id", "j"), "cell_id")
    placed.select(F.concat_ws(" ", "i", "j", F.col("value").cast("string"))).write.text(f"{path}/matrix")
    head = [f"{BANNER} matrix coordinate real general", f"{gene.count()} {cell.count()} {placed.count()}"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(f"{path}/matrix")
    return f"{path}/matrix", f"{path}/genes", f"{path}/cells"
