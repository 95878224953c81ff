"""Neighbourhood composition, niches and other summaries of a graph's surroundings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.graph import SpatialGraph
from cellweave.plans.grid import nearest
from cellweave.plans.lineage import cached
from cellweave.plans.ranks import quantiles


def neighborhood_composition(points: DataFrame, k: int = 10) -> DataFrame:
    """(cell_id, cell_type, fraction): shares of each type among a cell and its k - 1 nearest others."""
    near = nearest(points, k - 1).select(F.col("a").alias("cell_id"), F.col("b").alias("other"))
    own = near.unionByName(points.select("cell_id", F.col("cell_id").alias("other")))
    typed = own.join(points.select(F.col("cell_id").alias("other"), "cell_type"), "other")
    return typed.groupBy("cell_id", "cell_type").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("fraction"))


def composition_matrix(composition: DataFrame, types: list[str]) -> DataFrame:
    """One column per type, 0 where a type is absent; rows sum to 1."""
    return composition.groupBy("cell_id").pivot("cell_type", types).agg(F.sum("fraction")).na.fill(0.0)


#: compositions are taken in units of a billionth, whose sums are exact whatever their order
UNIT = 1_000_000_000


def _closest(centres: list[list[list[float]]]) -> Column:
    """Per start the squared distance and the number of the centre closest to `x`; of equally close ones the first."""
    literal = F.from_json(F.lit(json.dumps(centres)), "array<array<array<double>>>")
    square = lambda a, b: (a - b) * (a - b)
    distance = lambda c: F.aggregate(F.zip_with("x", c, square), F.lit(0.0), lambda s, v: s + v)
    return F.transform(literal, lambda cs: F.array_min(F.transform(cs, lambda c, i: F.struct(distance(c).alias("d"), i.alias("c")))))


def niches(composition: DataFrame, types: list[str], k: int = 3, starts: int = 25, iterations: int = 50, seed: int = 1) -> DataFrame:
    """(cell_id, niche) by k-means over compositions; of several starts the one of the smallest cost.

    Cells of equal composition are one weighted point, and all starts share each pass over the points: an iteration is
    one aggregation that gives starts x k rows to the driver. A start's centres are the k distinct compositions of the smallest
    md5(seed:start:units), so any engine draws the same. A centre that loses all its points stays where it is.
    Niches are numbered in the order of their centres; without cells the result is empty.
    """
    units = F.array(*[F.round(F.col(f"`{t}`") * UNIT).cast("long") for t in types])
    cells = cached(composition_matrix(composition, types).select("cell_id", units.alias("units")))
    shares = F.transform("units", lambda u: u / F.lit(float(UNIT)))
    points = cached(cells.groupBy("units").agg(F.count(F.lit(1)).alias("w")).withColumn("x", shares))

    drawn = points.select("units", "x", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("start").cast("string"), F.array_join("units", ",")))
    first = drawn.withColumn("at", F.row_number().over(Window.partitionBy("start").orderBy(mark))).where(F.col("at") <= k)
    centres: list[list[list[float]]] = [[] for _ in range(starts)]
    for row in first.select("start", "at", "x").orderBy("start", "at").collect():
        centres[row.start].append(list(row.x))

    totals = [F.sum(F.col("units")[t].cast("decimal(20,0)") * F.col("w")).alias(f"t{t}") for t in range(len(types))]
    moving = [s for s in range(starts) if centres[s]]
    for _ in range(iterations):
        if not moving:
            break
        found = points.select("units", "w", F.posexplode(_closest([centres[s] for s in moving])).alias("i", "to"))
        before = {s: list(centres[s]) for s in moving}
        for row in found.groupBy("i", F.col("to.c").alias("c")).agg(F.sum("w").alias("n"), *totals).collect():
            centres[moving[row.i]][row.c] = [float(row[f"t{t}"]) / (float(row.n) * float(UNIT)) for t in range(len(types))]
        moving = [s for s in moving if centres[s] != before[s]]

    if not centres[0]:
        return cells.select("cell_id", F.lit(0).alias("niche"))
    costs = points.select("w", F.posexplode(_closest(centres)).alias("start", "to")).groupBy("start").agg(F.sum(F.col("w") * F.col("to.d")).alias("cost"))
    best = centres[min((round(row.cost, 6), row.start) for row in costs.collect())[1]]
    return cells.withColumn("x", shares).select("cell_id", _closest([sorted(best)])[0]["c"].alias("niche"))


def edge_quantiles(sg: SpatialGraph, probabilities: tuple[float, ...] = (0.0, 0.5, 0.95, 1.0)) -> DataFrame:
    """(p, distance): exact quantiles with linear interpolation; no row where no edge has a length."""
    found = quantiles(sg.edges, "distance", [float(p) for p in probabilities])
    return sg.edges.sparkSession.createDataFrame([] if found is None else list(zip(map(float, probabilities), map(float, found))), "p double, distance double")


def pseudo_samples(nodes: DataFrame, n: int = 3) -> DataFrame:
    """nodes with sample_id s1.. by the quantiles of x."""
    rank = F.lit(1)
    for b in quantiles(nodes, "x", [i / n for i in range(1, n)]) or []:
        rank = rank + (F.col("x") > F.lit(b)).cast("int")
    return nodes.withColumn("sample_id", F.concat(F.lit("s"), rank.cast("string")))


def region_shares(compared: DataFrame, groups: list[str]) -> DataFrame:
    """(motif_id, group, share): how a motif's instances divide over groups, from the columns of compare_motifs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"`count_{g}`").alias("n")) for g in groups]))
    rows = compared.select("motif_id", pairs.alias("r")).select("motif_id", "r.group", "r.n")
    return rows.select("motif_id", "group", (F.col("n") / F.sum("n").over(Window.partitionBy("motif_id"))).alias("share"))


def top_per_group(compared: DataFrame, groups: list[str]) -> DataFrame:
    """(group, motif_id, n): the most frequent motif of each group; ties by id."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"`count_{g}`").alias("n")) for g in groups]))
    rows = compared.select("motif_id", pairs.alias("r")).select("r.group", "motif_id", "r.n")
    return rows.groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("m"), "motif_id")).alias("t")).select("group", "t.motif_id", (-F.col("t.m")).alias("n"))


def bridging(catalog: DataFrame, first: str, second: str) -> DataFrame:
    """The motifs whose colors name both types."""
    word = lambda t: F.col("color_tuple").rlike(rf"(^|[-_])\Q{t}\E([-_]|$)")
    return catalog.where(word(first) & word(second))
