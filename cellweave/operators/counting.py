"""Catalogs of three-node motifs by counting, without forming the pairs of a node's neighbours.

Two-paths of a class follow from color histograms: a center with h(c) neighbours of color c is the center of h(c) * h(d)
paths to colors c < d and of h(c) * (h(c) - 1) / 2 paths within c. Triangles are found by edges directed from the lower
to the higher (degree, id): a node has few such edges however many neighbours it has, at most the root of twice the
number of edges. Open motifs are the paths that no triangle closes: each triangle closes one path at each of its nodes.
A hub of degree d so costs d rows, not d * d.

Motifs that hold an anchor are all of them less those of the graph without its anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import motifs as M
from cellweave.operators.triangles import number_catalog
from cellweave.plans.lineage import cached


def _paths(edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, center, lo, hi, n): two-paths by the colors of center and ends, open and closed."""
    one = edges.select(*by, F.col("source").alias("b"), F.col("sc").alias("center"), F.col("tc").alias("k"))
    adj = one.unionByName(edges.select(*by, F.col("target").alias("b"), F.col("tc").alias("center"), F.col("sc").alias("k")))
    bins = adj.groupBy(*by, "b", "center", "k").agg(F.count(F.lit(1)).alias("h"))
    # at most as many bins as colors; nodes of equal histograms are one row
    nodes = bins.groupBy(*by, "b", "center").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("bins"))
    kinds = nodes.groupBy(*by, "center", "bins").agg(F.count(F.lit(1)).alias("m"))
    left = kinds.select(*by, "center", "m", "bins", F.posexplode("bins").alias("i", "p"))
    pairs = left.select(*by, "center", "m", "p", F.explode(F.expr("slice(bins, i + 1, size(bins))")).alias("q"))
    n = F.when(F.col("p.k") == F.col("q.k"), F.expr("p.h * (p.h - 1) div 2")).otherwise(F.col("p.h") * F.col("q.h"))
    return pairs.groupBy(*by, "center", F.col("p.k").alias("lo"), F.col("q.k").alias("hi")).agg(F.sum(F.col("m") * n).alias("n"))


def directed(edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, u, v, uc, vc, vd): edges from the lower to the higher (degree, id), vd being the higher one's degree."""
    ends = edges.select(F.col("source").alias("w")).unionByName(edges.select(F.col("target").alias("w")))
    degree = ends.groupBy("w").agg(F.count(F.lit(1)).alias("d"))
    known = edges.join(degree.toDF("source", "sd"), "source").join(degree.toDF("target", "td"), "target")
    up = F.struct("sd", "source") < F.struct("td", "target")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return known.select(*by, pick("source", "target").alias("u"), pick("target", "source").alias("v"), pick("sc", "tc").alias("uc"), pick("tc", "sc").alias("vc"), pick("td", "sd").alias("vd"))


def _triangles(edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, colors, n): triangles by their sorted colors."""
    up = cached(directed(edges, by))  # read three times
    left = up.select(*by, "u", F.col("uc").alias("c1"), "v", F.col("vc").alias("c2"), "vd")
    right = up.select("u", F.col("v").alias("w"), F.col("vc").alias("c3"), F.col("vd").alias("wd"))
    spread = left.join(right, "u").where(F.struct("vd", "v") < F.struct("wd", "w"))
    closing = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
    closed = spread.join(closing, ["v", "w"])
    return closed.groupBy(*by, F.array_sort(F.array("c1", "c2", "c3")).alias("colors")).agg(F.count(F.lit(1)).alias("n"))


def counted_classes(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, topology, sorted, count) of edges(source, target, sc, tc, *by), each once with source < target; an edge's
    columns `by` are those of all edges that it shares a node with."""
    by = by or []
    triangles = _triangles(edges, by)
    ends = lambda i, j: F.struct(F.element_at("colors", i).alias("lo"), F.element_at("colors", j).alias("hi"))
    at = F.explode(F.array(*[F.struct(F.element_at("colors", c).alias("center"), ends(i, j).alias("e")) for c, i, j in ((1, 2, 3), (2, 1, 3), (3, 1, 2))])).alias("at")
    closed = triangles.select(*by, (-F.col("n")).alias("n"), at).select(*by, "at.center", "at.e.lo", "at.e.hi", "n")
    opened = _paths(edges, by).unionByName(closed).groupBy(*by, "center", "lo", "hi").agg(F.sum("n").alias("count")).where("count > 0")
    wedges = opened.select(*by, F.lit("wedge").alias("topology"), F.array("lo", "hi", "center").alias("sorted"), "count")
    return wedges.unionByName(triangles.select(*by, F.lit("triangle").alias("topology"), F.col("colors").alias("sorted"), F.col("n").alias("count")))


def counted_catalog(edges: DataFrame, colored: bool = True, anchored: bool = False, by: list[str] | None = None) -> DataFrame:
    """(*by, the columns of a catalog) of size 3; edges as _colored_edges() of the enumeration gives them."""
    by = by or []
    blank: Column = F.lit("")
    if not colored:
        edges = edges.withColumns({"sc": blank, "tc": blank})
    found = counted_classes(edges, by)
    if anchored:
        rest = counted_classes(edges.where("NOT sa AND NOT ta"), by)
        both = found.unionByName(rest.withColumn("count", -F.col("count")))
        found = both.groupBy(*by, "topology", "sorted").agg(F.sum("count").alias("count")).where("count > 0")
    motif, tuple_ = M.motif_label(3, colored)
    return found.select(*by, motif.alias("motif_id"), F.lit(3).alias("size"), F.col("topology").alias("canonical_iso_class"), tuple_.alias("color_tuple"), "count")


def uncolored_catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A catalog of size 3 without colors, of nodes(id) and edges(source, target) by whole numbers."""
    motif, tuple_ = M.motif_label(3, False)
    found = number_catalog(nodes, edges)
    return found.select(motif.alias("motif_id"), F.lit(3).alias("size"), F.col("topology").alias("canonical_iso_class"), tuple_.alias("color_tuple"), "count")
