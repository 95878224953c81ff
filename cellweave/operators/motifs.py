"""Enumeration of motifs of two, three and four nodes as joins, and the catalogs and incidences that follow.

An instance is one row: topology, cells, their colors and degrees inside the motif (size 4 also the adjacency mask).
Catalog, incidence and labels are projections of that table.
"""

from __future__ import annotations

import datetime
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.graph import SpatialGraph
from cellweave.operators import shapes
from cellweave.plans.lineage import cached, checkpointed
from cellweave.plans.ranks import ranked_in_ranges, smallest

PREFIX = {2: "e_", 3: None, 4: "q_"}
CATALOG = ("motif_id", "size", "canonical_iso_class", "color_tuple", "count")
INCIDENCE = ("motif_id", "instance_id", "cell_id", "orbit_id")


@dataclass(frozen=True)
class Motifs:
    """catalog and incidence; instances is the wide table they come from (None for hand-built ones)."""

    catalog: DataFrame
    incidence: DataFrame
    instances: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, df, needed in (("catalog", self.catalog, CATALOG), ("incidence", self.incidence, INCIDENCE)):
            missing = [c for c in needed if c not in df.columns]
            if missing:
                raise ValueError(f"{name} lacks {', '.join(missing)}")

    def instance_table(self, topology: str) -> DataFrame:
        """(instance_id, one column per position[, degrees]) of a class: edge v1 v2, triangle v1-v3, wedge end1 end2
        center, size 4 w1-w4 d1-d4."""
        names = {"edge": ["v1", "v2"], "triangle": ["v1", "v2", "v3"], "wedge": ["end1", "end2", "center"]}.get(topology, ["w1", "w2", "w3", "w4"])
        cells = [F.col("cells")[i].alias(c) for i, c in enumerate(names)]
        if topology not in ("edge", "triangle", "wedge"):
            cells += [F.col("degrees")[i].alias(f"d{i + 1}") for i in range(4)]
        return self.instances.where(F.col("topology") == topology).select("instance_id", *cells)

    def plot_data(self, top: int = 20, max_label_chars: int = 60) -> DataFrame:
        """(label, count) of the most frequent motifs, labels shortened with an ellipsis."""
        if self.catalog.isEmpty():
            raise ValueError("there is nothing to draw: no motif class was found")
        short = F.when(F.length("motif_id") > max_label_chars, F.concat(F.substring("motif_id", 1, max_label_chars - 3), F.lit("..."))).otherwise(F.col("motif_id"))
        return self.catalog.orderBy(F.desc("count"), "motif_id").limit(top).select(short.alias("label"), "count")

    def plot(self, top: int = 20, max_label_chars: int = 60):
        """A horizontal bar chart, where matplotlib is installed."""
        import matplotlib.pyplot as plt

        rows = self.plot_data(top, max_label_chars).collect()
        figure, axes = plt.subplots()
        axes.barh([r.label for r in reversed(rows)], [r["count"] for r in reversed(rows)])
        axes.set(xlabel="instance count", title=f"Top {len(rows)} motifs (size {self.meta.get('size')})")
        return figure

    def summary(self) -> str:
        total = self.catalog.agg(F.count(F.lit(1)), F.sum("count")).first()
        kind = "colored" if self.meta.get("colored") else "uncolored"
        lines = [f"Motifs of {self.meta.get('size')} cells, {kind}: {total[1] or 0} instances of {total[0]} classes"]
        top = self.catalog.orderBy(F.desc("count"), "motif_id").limit(5).collect()
        return "\n".join(lines + [f"{r['count']:>12}  {r.motif_id}" for r in top])


# ---- enumeration -----------------------------------------------------------------------------------------------


def _colored_edges(sg: SpatialGraph, anchors: DataFrame | None, size: int) -> DataFrame:
    """(source, target, sc, tc, sa, ta): edges with the endpoints' colors and whether they are anchors.

    With anchors, edges farther than size - 1 steps from all of them are left out: no wanted motif holds them.
    """
    nodes = sg.nodes.select("cell_id", F.coalesce("cell_type", F.lit("NA")).alias("color"))
    edges = sg.edges.select("source", "target")
    if anchors is None:
        nodes = nodes.withColumn("anchor", F.lit(False))
    else:
        wanted = anchors.select("cell_id").distinct()
        # a step leads to the neighbours and stays: each step reads the one before once
        steps = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
        steps = steps.unionByName(nodes.select(F.col("cell_id").alias("source"), F.col("cell_id").alias("target")))
        near = wanted
        for _ in range(size - 1):
            near = steps.join(near.withColumnRenamed("cell_id", "source"), "source", "left_semi").select(F.col("target").alias("cell_id")).distinct()
        near = checkpointed(near)
        for c in ("source", "target"):
            edges = edges.join(near.withColumnRenamed("cell_id", c), c, "left_semi").select("source", "target")
        nodes = nodes.join(wanted.withColumn("anchor", F.lit(True)), "cell_id", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    edges = edges.join(nodes.toDF("source", "sc", "sa"), "source").join(nodes.toDF("target", "tc", "ta"), "target")
    return edges.select("source", "target", "sc", "tc", "sa", "ta")


def _adjacency(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("source").alias("b"), F.col("sc").alias("bc"), F.col("sa").alias("ba"), F.col("target").alias("x"), F.col("tc").alias("xc"), F.col("ta").alias("xa"))
    return one.unionByName(edges.select(F.col("target").alias("b"), F.col("tc").alias("bc"), F.col("ta").alias("ba"), F.col("source").alias("x"), F.col("sc").alias("xc"), F.col("sa").alias("xa")))


def _two_paths(edges: DataFrame) -> DataFrame:
    """(b, bc, ba, a, ac, aa, c, cc, ca, closed): each pair a < c of b's neighbours, and whether it is an edge."""
    adj = _adjacency(edges)
    left = adj.select("b", "bc", "ba", F.col("x").alias("a"), F.col("xc").alias("ac"), F.col("xa").alias("aa"))
    right = adj.select("b", F.col("x").alias("c"), F.col("xc").alias("cc"), F.col("xa").alias("ca"))
    pairs = left.join(right, "b").where("a < c")
    closing = edges.select(F.col("source").alias("a"), F.col("target").alias("c"), F.lit(True).alias("closed"))
    return pairs.join(closing, ["a", "c"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def _three_sets(edges: DataFrame) -> DataFrame:
    """(cells, colors, anchor, three): connected 3-sets in ascending order, three holding the edges 01, 02, 12."""
    paths = _two_paths(edges).where("NOT closed OR b < a")
    # the centre's rank decides which of the three pairs are edges
    rank = F.when(F.col("b") < F.col("a"), 0).when(F.col("b") < F.col("c"), 1).otherwise(2)
    mask = F.when(F.col("closed"), 7).otherwise(F.element_at(_ints(0b011, 0b101, 0b110), rank + 1))
    verts = F.array_sort(F.array(*[F.struct(F.col(v).alias("v"), F.col(k).alias("k")) for v, k in (("a", "ac"), ("b", "bc"), ("c", "cc"))]))
    return paths.select(verts.alias("s"), (F.col("aa") | F.col("ba") | F.col("ca")).alias("anchor"), mask.cast("int").alias("three"))


def _four_sets(edges: DataFrame) -> DataFrame:
    """Connected 4-sets with their masks, each exactly once.

    A 3-set meets every neighbour of its vertices; one aggregation per (3-set, neighbour) gives the edges between
    them, so no further joins and no distinct over 4-sets are needed: of the 3-sets that a 4-set grows from, the
    one without the last removable vertex counts.
    """
    three = _three_sets(edges)
    grow = three.select("s", "anchor", "three", F.posexplode("s").alias("p", "w")).withColumn("b", F.col("w.v"))
    adj = _adjacency(edges).select("b", F.col("x").alias("d"), F.col("xc").alias("dc"), F.col("xa").alias("da"))
    met = grow.join(adj, "b").where("NOT array_contains(transform(s, q -> q.v), d)")
    sets = met.groupBy("s", "d").agg(
        F.bit_or(F.expr("shiftleft(1, p)")).alias("joined"), F.first("three").alias("three"), F.first("dc").alias("dc"), F.first(F.col("anchor") | F.col("da")).alias("anchor")
    )
    rank = F.size(F.filter("s", lambda q: q["v"] < F.col("d")))
    table = _ints(*[shapes.grown(r, t, j) for r in range(4) for t in range(8) for j in range(8)])
    masked = sets.withColumn("rank", rank).withColumn("mask", F.element_at(table, F.col("rank") * 64 + F.col("three") * 8 + F.col("joined") + 1))
    last = _ints(*[shapes.last_removable(m) for m in range(64)])
    once = masked.where(F.element_at(last, F.col("mask") + 1) == F.col("rank"))
    verts = F.array_sort(F.array_append("s", F.struct(F.col("d").alias("v"), F.col("dc").alias("k"))))
    names = F.array(*[F.lit(shapes.class_of(m) or "none") for m in range(64)])
    degrees = F.array(*[_ints(*shapes.degrees(m)) for m in range(64)])
    return once.select(
        F.element_at(names, F.col("mask") + 1).alias("topology"),
        F.transform(verts, lambda q: q["v"]).alias("cells"),
        F.transform(verts, lambda q: q["k"]).alias("colors"),
        F.element_at(degrees, F.col("mask") + 1).alias("degrees"),
        F.col("mask").cast("int").alias("mask"),
        "anchor",
    )


def enumerate_instances(sg: SpatialGraph, size: int, anchors: DataFrame | None = None) -> DataFrame:
    """(topology, cells, colors, degrees, mask) of all connected induced subgraphs, each once."""
    edges = _colored_edges(sg, anchors, size)
    if size > 2:
        edges = cached(edges)  # read four times or more below
    none = F.lit(0).cast("int").alias("mask")
    if size == 2:
        out = edges.select(F.lit("edge").alias("topology"), F.array("source", "target").alias("cells"), F.array("sc", "tc").alias("colors"), _ints(1, 1).alias("degrees"), none, (F.col("sa") | F.col("ta")).alias("anchor"))
    elif size == 3:
        paths = _two_paths(edges).where("NOT closed OR b < a")
        pick = lambda x, y, z: F.when(F.col("closed"), F.array(y, x, z)).otherwise(F.array(x, z, y))
        out = paths.select(
            F.when(F.col("closed"), "triangle").otherwise("wedge").alias("topology"),
            pick("a", "b", "c").alias("cells"),
            pick("ac", "bc", "cc").alias("colors"),
            F.when(F.col("closed"), _ints(2, 2, 2)).otherwise(_ints(1, 1, 2)).alias("degrees"),
            none,
            (F.col("aa") | F.col("ba") | F.col("ca")).alias("anchor"),
        )
    elif size == 4:
        out = _four_sets(edges)
    else:
        raise ValueError("size must be one of 2, 3, 4")
    return (out if anchors is None else out.where("anchor")).drop("anchor")


# ---- labels ----------------------------------------------------------------------------------------------------


def ordered_colors(colors: str = "colors", exact: bool = False) -> Column:
    """Colors in canonical order: by degree, then color. exact separates the paths and cycles that this confuses."""
    pairs = F.arrays_zip(F.col("degrees").alias("d"), F.col(colors).alias("k"))
    plain = F.transform(F.array_sort(pairs), lambda q: q["k"])
    if not exact:
        return plain
    walks = F.array(*[_ints(*shapes.walk(m)) for m in range(64)])
    walked = F.transform(F.element_at(walks, F.col("mask") + 1), lambda i: F.get(F.col(colors), i))
    turned = [F.concat(F.slice(w, i + 1, 4 - i), F.slice(w, 1, i)) if i else w for w in (walked, F.reverse(walked)) for i in range(4)]
    return F.when(F.col("topology") == "path", F.least(walked, F.reverse(walked))).when(F.col("topology") == "cycle", F.array_min(F.array(*turned))).otherwise(plain)


def motif_label(size: int, colored: bool = True, sorted_: Column | None = None) -> tuple[Column, Column]:
    """(motif_id, color_tuple) in the catalog grammar: an open 3-motif is ends, then _center."""
    kind = {2: F.lit("size2_edge"), 3: F.when(F.col("topology") == "triangle", "size3_closed").otherwise("size3_open"), 4: F.concat(F.lit("size4_"), F.col("topology"))}[size]
    if not colored:
        return kind, F.lit(None).cast("string")
    s = F.col("sorted") if sorted_ is None else sorted_
    tuple_ = F.array_join(s, "-")
    if size == 3:
        tuple_ = F.when(F.col("topology") == "wedge", F.concat(s[0], F.lit("-"), s[1], F.lit("_"), s[2])).otherwise(tuple_)
    return F.concat(kind, F.lit("_"), tuple_), tuple_


def labelled(instances: DataFrame, size: int, colored: bool = True, labeling: str = "degree_color") -> DataFrame:
    """instances with instance_id, motif_id and color_tuple."""
    prefix = F.lit("e_") if size == 2 else F.lit("q_") if size == 4 else F.when(F.col("topology") == "triangle", "tri_").otherwise("wedge_")
    df = instances.withColumn("sorted", ordered_colors(exact=labeling == "exact")) if colored else instances.withColumn("sorted", F.lit(None).cast("array<string>"))
    motif, tuple_ = motif_label(size, colored)
    return df.withColumns({"instance_id": F.concat(prefix, F.array_join("cells", "~")), "motif_id": motif, "color_tuple": tuple_}).drop("sorted")


def catalog_of(instances: DataFrame, size: int) -> DataFrame:
    return instances.groupBy("motif_id", F.lit(size).alias("size"), F.col("topology").alias("canonical_iso_class"), "color_tuple").agg(F.count(F.lit(1)).alias("count")).select(*CATALOG)


def incidence_of(instances: DataFrame, colored: bool = True) -> DataFrame:
    """A row per instance and cell. The orbit is the rank of (degree, color) among the instance's distinct ones: all
    instances of a motif have the same, so no window over the motif is needed."""
    pairs = F.arrays_zip(F.col("degrees").alias("d"), F.col("colors").alias("k")) if colored else F.transform("degrees", lambda d: F.struct(d.alias("d")))
    ranked = instances.withColumn("__p", pairs).withColumn("__u", F.array_distinct(F.array_sort("__p")))
    return ranked.select("motif_id", "instance_id", F.posexplode("cells").alias("__i", "cell_id"), "__p", "__u").select("motif_id", "instance_id", "cell_id", F.expr("cast(array_position(__u, __p[__i]) as int)").alias("orbit_id"))


def with_ordinal_ids(instances: DataFrame) -> DataFrame:
    """Content ids replaced by ordinals per class in the order of (motif_id, cells): one sort over all instances of a
    class, for comparisons on small graphs."""
    kind = F.regexp_extract("instance_id", "^[a-z]+_", 0)
    order = Window.partitionBy(kind).orderBy("motif_id", "cells")
    return instances.withColumn("instance_id", F.concat(kind, F.row_number().over(order).cast("string")))


def anchor_frame(sg: SpatialGraph, anchored_on) -> DataFrame | None:
    """Anchors as a DataFrame; ValueError if some aren't nodes."""
    if anchored_on is None:
        return None
    if not isinstance(anchored_on, DataFrame):
        anchored_on = sg.nodes.sparkSession.createDataFrame([(str(a),) for a in anchored_on], "cell_id string")
    missing = anchored_on.join(sg.nodes.select("cell_id"), "cell_id", "left_anti").select("cell_id").distinct().count()
    if missing:
        raise ValueError(f"{missing} of the anchors are no cells of the graph")
    return anchored_on.select("cell_id")


def capped(instances: DataFrame, max_instances: int, seed: int = 1) -> DataFrame:
    """At most max_instances of all instances together: those of the smallest md5(seed:instance_id)."""
    total = instances.count()
    if total <= max_instances:
        return instances
    warnings.warn(f"{total} instances were found; the {max_instances} of the smallest digests are kept", stacklevel=3)
    return smallest(instances, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("instance_id"))), max_instances, "instance_id")


def find_motifs(
    sg: SpatialGraph, size: int = 3, backend: str = "spark", colored: bool = True, anchored_on=None, max_instances: int | None = None, labeling: str = "degree_color", compat_ids: bool = False, fingerprint: bool = False
) -> Motifs:
    """All motifs of a size. backend is accepted for compatibility; there is one engine.

    Without a cap, the catalog of size 3 is counted without enumerating the instances.
    """
    if not isinstance(sg, SpatialGraph):
        raise TypeError("sg must be a SpatialGraph")
    if size not in (2, 3, 4):
        raise ValueError("size must be one of 2, 3, 4")
    if backend not in ("spark", "igraph", "rust"):
        raise ValueError("unknown backend")
    if max_instances is not None and (not isinstance(max_instances, int) or max_instances < 1):
        raise ValueError("max_instances must be a positive integer")
    anchors = anchor_frame(sg, anchored_on)
    found = labelled(enumerate_instances(sg, size, anchors), size, colored, labeling)
    if max_instances is not None:
        found = capped(cached(found), max_instances)
    if compat_ids:
        found = with_ordinal_ids(found)
    meta = {"size": size, "backend": "spark", "colored": colored, "labeling": labeling, "anchored": anchored_on is not None, "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    if fingerprint:
        meta["sg_hash"] = sg.fingerprint()
    if size == 3 and max_instances is None:
        from cellweave.operators.counting import counted_catalog, uncolored_catalog

        plain = sg.numbers is not None and anchors is None and not colored
        catalog = uncolored_catalog(*sg.numbers) if plain else counted_catalog(cached(_colored_edges(sg, anchors, size)), colored, anchors is not None)
    else:
        catalog = catalog_of(found, size)
    return Motifs(catalog, incidence_of(found, colored), found, meta)


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group. Of every lane of a group n rows at most go on, and these are numbered in ranges, so no
    task holds a group."""
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64(order), F.lit(lanes))
    w = Window.partitionBy(group, lane).orderBy(order)
    few = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    return ranked_in_ranges(few, [group], [order], "__rn").where(F.col("__rn") <= n).drop("__rn")


def motif_instances(sg: SpatialGraph, motif_ids, size: int = 3, max_per_class: float | None = 5000, grammar: str = "enrichment") -> DataFrame:
    """(motif_id, instance, slot, cell_id) of the named classes, at most max_per_class each (None or inf: all).

    slot counts from 1 along the canonical order of the label. motif_ids: a list or a DataFrame with motif_id.
    """
    from cellweave.operators.enrichment import enrichment_label

    spark = sg.nodes.sparkSession
    wanted = motif_ids if isinstance(motif_ids, DataFrame) else spark.createDataFrame([(m,) for m in motif_ids], "motif_id string")
    found = enumerate_instances(sg, size)
    if grammar == "enrichment":
        found = found.withColumn("sorted", ordered_colors(exact=True)).withColumn("motif_id", enrichment_label(size)[0])
    else:
        found = labelled(found, size)
    found = found.join(wanted.select("motif_id").distinct(), "motif_id", "left_semi").withColumn("instance", F.array_join("cells", "~"))
    if max_per_class is not None and max_per_class != float("inf"):
        found = first_of_each(found, "motif_id", "cells", int(max_per_class))
    center_first = F.when(F.col("topology") == "wedge", F.array(F.col("cells")[2], F.col("cells")[0], F.col("cells")[1])).otherwise(F.col("cells")) if grammar == "enrichment" else F.col("cells")
    return found.select("motif_id", "instance", F.posexplode(center_first).alias("slot", "cell_id")).withColumn("slot", F.col("slot") + 1)


def motif_density(sg: SpatialGraph, motifs: Motifs) -> DataFrame:
    """(cell_id, n): instances that touch each cell, 0 where none does."""
    n = motifs.incidence.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return sg.nodes.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def motifs_within(motifs: Motifs, cells: DataFrame) -> Motifs:
    """The instances all of whose cells are in cells(cell_id)."""
    inside = motifs.incidence.join(cells.select("cell_id", F.lit(True).alias("__in")), "cell_id", "left").groupBy("motif_id", "instance_id").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("ok"))
    kept = inside.where("ok").select("motif_id", "instance_id")
    incidence = motifs.incidence.join(kept, ["motif_id", "instance_id"], "left_semi").select(*INCIDENCE)
    counts = kept.groupBy("motif_id").agg(F.count(F.lit(1)).alias("count"))
    catalog = motifs.catalog.drop("count").join(counts, "motif_id").select(*CATALOG)
    instances = None if motifs.instances is None else motifs.instances.join(kept, ["motif_id", "instance_id"], "left_semi")
    return Motifs(catalog, incidence, instances, motifs.meta)
