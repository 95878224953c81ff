"""Graphs and expression tables on storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.graph import SpatialGraph
from cellweave.plans.ranks import ranked_in_ranges


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def read_spatial_graph(spark: SparkSession, nodes_path: str, edges_path: str, validate: bool = True) -> SpatialGraph:
    """Two parquet tables and, where there is one, the sidecar `<nodes>.meta.json`, whose entries win."""
    for name, path in (("nodes_path", nodes_path), ("edges_path", edges_path)):
        if not _exists(spark, path):
            raise FileNotFoundError(f"{name} not found: {path}")
    meta = {"build_method": "read_spatial_graph", "nodes_path": nodes_path, "edges_path": edges_path}
    side = f"{nodes_path}.meta.json"
    if _exists(spark, side):
        text = "\n".join(r.value for r in spark.read.text(side).collect())
        try:
            extra = json.loads(text)
        except ValueError:
            extra = None
        if isinstance(extra, dict):
            meta |= extra
    return SpatialGraph.create(spark.read.parquet(nodes_path), spark.read.parquet(edges_path), meta, validate)


def write_spatial_graph(sg: SpatialGraph, nodes_path: str, edges_path: str) -> SpatialGraph:
    """Nodes, edges and the JSON sidecar of those entries of meta that JSON can hold."""
    spark = sg.nodes.sparkSession
    sg.nodes.write.mode("overwrite").parquet(nodes_path)
    sg.edges.write.mode("overwrite").parquet(edges_path)
    kept = {k: v for k, v in sg.meta.items() if isinstance(v, (str, int, float, bool, list, dict, type(None)))}
    fs, p = _file_system(spark, f"{nodes_path}.meta.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(kept, indent=2).encode()))
    out.close()
    return sg


def store_node_order(spark: SparkSession, nodes_path: str) -> DataFrame:
    """(node_id, int_id) of an edge store, by int_id."""
    return spark.read.parquet(nodes_path).select("node_id", "int_id").orderBy("int_id")


def store_graph(nodes: DataFrame, edges: DataFrame, labels: DataFrame | list) -> SpatialGraph:
    """nodes(node_id, int_id), edges(from_id, to_id), and labels: one per node in int_id order, or (int_id, cell_type)."""
    if not isinstance(labels, DataFrame):
        spark = nodes.sparkSession
        values = spark.createDataFrame([(i, v) for i, v in enumerate(labels, 1)], "__nth long, cell_type string")
        ordered = ranked_in_ranges(nodes.select("int_id"), [], ["int_id"], "__nth")
        labels = ordered.join(values, "__nth").select("int_id", "cell_type")
    ids = nodes.select(F.col("int_id").cast("long").alias("int_id")).join(labels.select(F.col("int_id").cast("long").alias("int_id"), "cell_type"), "int_id", "left")
    return integer_graph(ids, edges)


def integer_graph(ids: DataFrame, edges: DataFrame) -> SpatialGraph:
    """ids(int_id, cell_type) and edges(from_id, to_id) as a graph without coordinates; ids are padded so that their
    order as strings is their order as numbers."""
    name = lambda c: F.lpad(F.col(c).cast("long").cast("string"), 19, "0")
    nodes = ids.select(name("int_id").alias("cell_id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("cell_type").cast("string").alias("cell_type"), F.lit("s1").alias("sample_id"))
    pairs = edges.where("from_id <> to_id").select(name("from_id").alias("source"), name("to_id").alias("target"), F.lit("s1").alias("sample_id"))
    both = pairs.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "sample_id").distinct()
    numbers = ids.select(F.col("int_id").cast("long").alias("id")), edges.select(F.col("from_id").cast("long").alias("source"), F.col("to_id").cast("long").alias("target"))
    return SpatialGraph(nodes, both, {"build_method": "edge_store", "version": "0.1.0"}, numbers)


def expression_from_frame(spark: SparkSession, matrix) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expression(gene, cell_id, value), cells, genes) of a pandas frame with genes as rows and cells as columns."""
    long = matrix.rename_axis(index="gene", columns="cell_id").stack().rename("value").reset_index()
    long = long[long["value"] != 0]
    expression = spark.createDataFrame(long.astype({"gene": str, "cell_id": str, "value": float}), "gene string, cell_id string, value double")
    cells = spark.createDataFrame([(str(c),) for c in matrix.columns], "cell_id string")
    return expression, cells, spark.createDataFrame([(str(g),) for g in matrix.index], "gene string")
