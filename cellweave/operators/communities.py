"""Cells in groups: the graph of shared neighbours, communities of any weighted graph, and the genes that mark a group.

Communities are found by moves that raise the modularity, a refinement, and a coarser graph of the refined parts. A round of
moves is a join of the edges with their ends' communities and an aggregation by (node, community), so a hub costs its
degree. All nodes decide at once: in each round communities are dealt two colors, and nodes may only leave communities of the
one for communities of the other, so nobody moves to where others leave from. What the driver holds are counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.lineage import checkpointed, discard, written


def shared_neighbours(neighbours: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared long, weight) with a < b of neighbours(a, b): pairs of which one lists the other and that list `least` or more
    in common. The weight is the share of what they list in common in all that they list.

    Rows that repeat count once, and rows with a null or a = b not at all. A list is one row, so it should be short.
    """
    rows = neighbours.select("a", "b").where("a <> b").distinct()
    lists = rows.groupBy("a").agg(F.collect_list("b").alias("l"))
    pairs = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(lists.withColumnRenamed("l", "la"), "a").join(lists.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b")
    shared = F.size(F.array_intersect("la", "lb")).cast("long")
    found = both.select("a", "b", shared.alias("shared"), (F.size("la") + F.size("lb") - shared).alias("all"))
    return found.where(F.col("shared") >= least).select("a", "b", "shared", (F.col("shared") / F.col("all")).alias("weight"))


@dataclass(frozen=True)
class Communities:
    """members(cell_id, community: the smallest cell_id of it) and the modularity."""

    members: DataFrame
    modularity: float


def _modularity(edges: DataFrame, state: DataFrame, two_m: float, resolution: float) -> float:
    """Of state(i, c, k, own), own: the weight within node i, counted from both ends."""
    ends = edges.join(state.select("i", "c"), "i").join(state.select(F.col("i").alias("j"), F.col("c").alias("d")), "j")
    inner = (ends.where("c = d").agg(F.sum("w")).first()[0] or 0.0) + (state.agg(F.sum("own")).first()[0] or 0.0)
    squares = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inner / two_m - resolution * squares / two_m**2


def _moved(edges: DataFrame, state: DataFrame, two_m: float, resolution: float, singles: bool, rounds: int, seed: int) -> DataFrame:
    """state(i, c, k, own) after moves along edges(i, j, w) until all but a fiftieth of the nodes are content.

    singles: only nodes alone in their community move, so a community stays connected.
    """
    last = None
    for r in range(rounds):
        color = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(r)), F.lit(2)) == 0
        sums = state.groupBy("c").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
        ends = edges.join(state.select(F.col("i").alias("j"), "c"), "j").select("i", "c", "w")
        links = ends.unionByName(state.select("i", "c", F.lit(0.0).alias("w"))).groupBy("i", "c").agg(F.sum("w").alias("w"))
        choices = links.join(state.select("i", F.col("c").alias("home"), "k", "own"), "i").join(sums, "c")
        at_home = F.col("c") == F.col("home")
        gain = F.round(F.col("w") - resolution / two_m * F.col("k") * (F.col("t") - F.when(at_home, F.col("k")).otherwise(0.0)), 9)
        choice = F.struct(gain.alias("g"), F.col("c").alias("c"))
        best = choices.groupBy("i").agg(
            *[F.any_value(x).alias(x) for x in ("home", "k", "own")],
            F.max(F.when(at_home, F.col("n"))).alias("n"), F.max(F.when(at_home, gain)).alias("stay"),
            F.max(F.when(~at_home, choice)).alias("any"), F.max(F.when(~at_home & ~color("c"), choice)).alias("open"),
        )
        free = F.col("n") == 1 if singles else F.lit(True)
        leaves = free & color("home") & (F.col("open.g") > F.col("stay"))
        wants = F.coalesce(free & (F.col("any.g") > F.col("stay")), F.lit(False))
        new = written(best.select("i", F.when(leaves, F.col("open.c")).otherwise(F.col("home")).alias("c"), "k", "own", wants.alias("wants")), "moves")
        if last is not None:
            discard(last)
        n, wanting = new.agg(F.count(F.lit(1)), F.count_if("wants")).first()
        last, state = new, new.drop("wants")
        if wanting * 50 <= n:
            break
    return state


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, levels: int = 10, rounds: int = 20, seed: int = 1) -> Communities:
    """The communities of edges(a, b, weight) between strings, undirected; nodes(cell_id) may name more than those with edges.

    Repeated edges add up, an edge to oneself counts within its node, edges with a null or without a positive weight don't count. A node
    without edges is a community of its own. The result depends on the seed, not on how the rows are split.
    """
    plain = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("w")).where("a IS NOT NULL AND b IS NOT NULL AND w > 0")
    sides = plain.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(plain.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    summed = written(sides.groupBy("i", "j").agg(F.sum("w").alias("w")), "links")
    names = summed.select("i", "w", F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0).alias("own"))
    if nodes is not None:
        names = names.unionByName(nodes.select(F.col("cell_id").cast("string").alias("i"), F.lit(0.0).alias("w"), F.lit(0.0).alias("own")).where("i IS NOT NULL"))
    state = written(names.groupBy("i").agg(F.sum("w").alias("k"), F.sum("own").alias("own")).select("i", F.col("i").alias("c"), "k", "own"), "nodes")
    links = summed.where("i <> j")
    members = found = state.select(F.col("i").alias("cell_id"), "i")
    found = found.withColumnRenamed("i", "c")
    two_m = state.agg(F.sum("k")).first()[0] or 0.0
    if not two_m:
        return Communities(found.withColumnRenamed("c", "community"), 0.0)
    reached = _modularity(links, state, two_m, resolution)
    for level in range(levels):
        state = _moved(links, state, two_m, resolution, False, rounds, seed + 2 * level)
        q = _modularity(links, state, two_m, resolution)
        if q <= reached + 1e-9:
            break
        reached, found = q, members.join(state.select("i", "c"), "i").select("cell_id", "c")
        at, to = state.select("i", "c"), state.select(F.col("i").alias("j"), F.col("c").alias("d"))
        within = written(links.join(at, "i").join(to, "j").where("c = d").select("i", "j", "w"), "links")
        alone = state.select("i", F.col("i").alias("c"), "k", "own")
        parts = _moved(within, alone, two_m, resolution, True, rounds, seed + 2 * level + 1).select("i", F.col("c").alias("part"))
        placed = written(state.join(parts, "i"), "nodes")
        ends = links.join(placed.select("i", F.col("part").alias("p")), "i").join(placed.select(F.col("i").alias("j"), F.col("part").alias("q")), "j")
        joined = written(ends.groupBy("p", "q").agg(F.sum("w").alias("w")), "links")
        inner = joined.where("p = q").select(F.col("p").alias("part"), F.col("w").alias("inner"))
        links = joined.where("p <> q").select(F.col("p").alias("i"), F.col("q").alias("j"), "w")
        merged = placed.groupBy("part").agg(F.any_value("c").alias("c"), F.sum("k").alias("k"), F.sum("own").alias("own")).join(inner, "part", "left")
        before = placed.count()
        state = written(merged.select(F.col("part").alias("i"), "c", "k", (F.col("own") + F.coalesce("inner", F.lit(0.0))).alias("own")), "nodes")
        members = written(members.join(parts, "i").select("cell_id", F.col("part").alias("i")), "members")
        if state.count() == before:
            break
    least = found.groupBy("c").agg(F.min("cell_id").alias("community"))
    return Communities(found.join(least, "c").select("cell_id", "community"), reached)


def gini_markers(expression: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster, gene, mean_in, mean_out, share_in, share_out, score, rank) of expression(gene, cell_id, value), non-zero values not
    below 0, and groups(cell_id, cluster): each cluster against all other cells of groups.

    The Gini coefficient of two values, as a share of the largest possible, is |x - y| / (x + y). A gene's score is that of the mean
    values times that of the shares of cells with a value; where the cluster has less of either than the others, it is 0. Cells
    without a cluster take no part; a gene without values in a cluster has no row there. Sums decide, so ranks of cells aren't
    needed, and a gene of all cells is aggregated before it is shuffled. rank: by score, ties by gene.
    """
    cells = groups.select("cell_id", "cluster").where("cluster IS NOT NULL")
    sizes = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.count(F.lit(1)).alias("all"))  # one row
    values = expression.where("value > 0").join(cells, "cell_id").groupBy("cluster", "gene").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("d"))
    values = checkpointed(values)
    genes = values.groupBy("gene").agg(F.sum("s").alias("ts"), F.sum("d").alias("td"))
    own = values.join(genes, "gene").join(sizes, "cluster").join(F.broadcast(total))
    rest = F.col("all") - F.col("n")
    share = lambda x: F.when(rest > 0, x / rest).otherwise(0.0)
    means = own.select(
        "cluster", "gene", (F.col("s") / F.col("n")).alias("mean_in"), share(F.greatest(F.col("ts") - F.col("s"), F.lit(0.0))).alias("mean_out"),
        (F.col("d") / F.col("n")).alias("share_in"), share(F.col("td") - F.col("d")).alias("share_out"),
    )
    more = lambda x: F.greatest(F.col(f"{x}_in") - F.col(f"{x}_out"), F.lit(0.0)) / (F.col(f"{x}_in") + F.col(f"{x}_out"))
    scored = means.withColumn("score", F.round(more("mean") * more("share"), 9))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "gene")  # a row per gene
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))
