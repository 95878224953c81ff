"""Tables as text files, and the figures that describe a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.graph import SpatialGraph
from cellweave.operators.niche import edge_quantiles


def write_table(df: DataFrame, path: str, kind: str = "parquet", header: bool = True) -> str:
    """df as a folder of parquet or CSV files; in CSV nulls are empty fields and empty strings are quoted."""
    if kind not in ("parquet", "csv"):
        raise ValueError("kind is parquet or csv")
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=header, nullValue="", emptyValue='""')
    return path


def report_table(sg: SpatialGraph) -> DataFrame:
    """(item, group, value): how many cells and edges, cells by type, sample and region, quantiles of edge length."""
    one = lambda df, item: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), F.lit("").alias("group"), F.col("n").cast("double").alias("value"))
    out = one(sg.nodes, "cells").unionByName(one(sg.edges, "edges"))
    for column, item in (("cell_type", "cells by type"), ("sample_id", "cells by sample"), ("region_id", "cells by region")):
        if column in sg.nodes.columns:
            n = sg.nodes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            out = out.unionByName(n.select(F.lit(item).alias("item"), F.col(column).alias("group"), F.col("n").cast("double").alias("value")))
    if "distance" in sg.edges.columns:
        out = out.unionByName(edge_quantiles(sg).select(F.lit("edge length").alias("item"), F.col("p").cast("string").alias("group"), F.col("distance").alias("value")))
    return out


def report(sg: SpatialGraph, title: str = "Graph") -> str:
    """The figures of report_table as a page of Markdown."""
    lines, last = [f"# {title}", ""], None
    for row in report_table(sg).orderBy("item", "group").collect():
        if row.item != last:
            lines += [f"## {row.item}", ""]
            last = row.item
        value = f"{row.value:.0f}" if row.value == int(row.value) else f"{row.value:.6g}"
        lines.append(f"* {row.group}: {value}" if row.group else value)
    return "\n".join(lines) + "\n"
