"""Registered queries over the driver's tables and their DuckDB oracles.

The default graph takes `embeddings` as points: x and y are the first two components, the label is the type.
Doubles are rounded before they are compared.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.stats import with_bh
from cellweave.graph import SpatialGraph, canonical_edges
from cellweave.operators import motifs as M
from cellweave.operators import niche
from cellweave.operators.build import build_spatial_graph, knn_edges
from cellweave.operators.communities import communities, gini_markers, shared_neighbours
from cellweave.operators.compare import compare_motifs, motifs_by_sample
from cellweave.operators.enrichment import motif_enrichment, motif_enrichment_store, motif_enrichment_stream, test_motif_enrichment
from cellweave.operators.genes import associate_genes
from cellweave.operators.ingest import normalised, principal_components, quality_filtered
from cellweave.operators.tiles import tiled_delaunay
from cellweave.plans.grid import nearest
from cellweave.plans.lineage import checkpointed, scratch
from cellweave.plans.ranks import ranked_in_lanes
from cellweave.sources.graph_io import integer_graph, read_spatial_graph, store_graph, store_node_order, write_spatial_graph
from cellweave.sources.matrix_market import read_expression, write_expression
from cellweave.sources.reports import report_table, write_table
from cellweave.streaming.catalog import LiveCatalog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PERMS, SEED = 20, 7


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    side = lambda c, a, b: F.when(c >= 0, a).otherwise(b)
    return e.select(
        F.col("vec_id").cast("string").alias("cell_id"), x.alias("x"), y.alias("y"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("cell_type"),
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("sample_id"), F.concat(side(x, "E", "W"), side(y, "N", "S")).alias("region_id"),
    )


def graph(spark: SparkSession, sf: str, method: str = "radius", **kw) -> SpatialGraph:
    if method == "radius" and "radius" not in kw:
        # about six neighbours each: the radius follows from the number of points
        kw["radius"] = 0.6 / read(spark, sf, "embeddings").count() ** 0.5
    return build_spatial_graph(points(spark, sf), method, validate=False, **kw)


P_SQL = """p AS (SELECT cast(vec_id AS varchar) cell_id, cast(embedding[1] AS double) x, cast(embedding[2] AS double) y, 'c' || label cell_type, 's' || (vec_id % 3) sample_id,
  (CASE WHEN embedding[1] >= 0 THEN 'E' ELSE 'W' END) || (CASE WHEN embedding[2] >= 0 THEN 'N' ELSE 'S' END) region_id FROM embeddings)"""
E_SQL = f"""{P_SQL}, r AS (SELECT 0.6 / sqrt(count(*)) r FROM embeddings),
 e AS (SELECT a.cell_id source, b.cell_id target, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d2, a.sample_id sample_id, a.cell_type sc, b.cell_type tc
  FROM p a JOIN p b ON a.cell_id < b.cell_id, r WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r * r)"""
AN_SQL = "an AS (SELECT cell_id FROM p WHERE cell_type = 'c3' AND region_id = 'EN')"
ADJ_SQL = "adj AS (SELECT source b, target x FROM e UNION ALL SELECT target, source FROM e)"
K_SQL = f"""{P_SQL}, nn AS (SELECT a.cell_id a, b.cell_id b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d2,
   row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) rn FROM p a JOIN p b ON a.cell_id <> b.cell_id),
 ke AS (SELECT DISTINCT least(a, b) source, greatest(a, b) target, d2 FROM nn WHERE rn <= 6)"""
# instances of size 3 with cells, colors and the sorted colors
I3_SQL = f"""{E_SQL}, {ADJ_SQL}, ek AS (SELECT source, target FROM e),
 tp AS (SELECT l.b b, l.x a, r.x c, k.source IS NOT NULL closed FROM adj l JOIN adj r ON l.b = r.b AND l.x < r.x LEFT JOIN ek k ON k.source = l.x AND k.target = r.x),
 i0 AS (SELECT CASE WHEN closed THEN 'triangle' ELSE 'wedge' END topology, CASE WHEN closed THEN [b, a, c] ELSE [a, c, b] END cells FROM tp WHERE NOT closed OR b < a),
 i3 AS (SELECT topology, cells, k1.cell_type c1, k2.cell_type c2, k3.cell_type c3 FROM i0 JOIN p k1 ON k1.cell_id = cells[1] JOIN p k2 ON k2.cell_id = cells[2] JOIN p k3 ON k3.cell_id = cells[3])"""
L3 = """CASE WHEN topology = 'triangle' THEN 'size3_closed_' || array_to_string(list_sort([c1, c2, c3]), '-') ELSE 'size3_open_' || least(c1, c2) || '-' || greatest(c1, c2) || '_' || c3 END"""
T3 = """CASE WHEN topology = 'triangle' THEN array_to_string(list_sort([c1, c2, c3]), '-') ELSE least(c1, c2) || '-' || greatest(c1, c2) || '_' || c3 END"""
N3 = """CASE WHEN topology = 'triangle' THEN 'size3_closed_' || array_to_string(list_sort([c1, c2, c3]), '-') ELSE 'size3_open_' || c3 || '-' || least(c1, c2) || '-' || greatest(c1, c2) END"""
# size 4 by extension of connected 3-sets, distinct 4-sets, six edge flags
I4_SQL = f"""{E_SQL}, {ADJ_SQL}, ek AS (SELECT source, target FROM e),
 t3 AS (SELECT DISTINCT list_sort([l.b, l.x, r.x]) s FROM adj l JOIN adj r ON l.b = r.b AND l.x < r.x),
 x4 AS (SELECT DISTINCT list_sort(list_append(s, a.x)) q FROM (SELECT s, unnest(s) v FROM t3) u JOIN adj a ON a.b = u.v WHERE NOT list_contains(s, a.x)),
 f4 AS (SELECT q, (e12.source IS NOT NULL)::int e12, (e13.source IS NOT NULL)::int e13, (e14.source IS NOT NULL)::int e14, (e23.source IS NOT NULL)::int e23, (e24.source IS NOT NULL)::int e24, (e34.source IS NOT NULL)::int e34 FROM x4
  LEFT JOIN ek e12 ON e12.source = q[1] AND e12.target = q[2] LEFT JOIN ek e13 ON e13.source = q[1] AND e13.target = q[3] LEFT JOIN ek e14 ON e14.source = q[1] AND e14.target = q[4]
  LEFT JOIN ek e23 ON e23.source = q[2] AND e23.target = q[3] LEFT JOIN ek e24 ON e24.source = q[2] AND e24.target = q[4] LEFT JOIN ek e34 ON e34.source = q[3] AND e34.target = q[4]),
 d4 AS (SELECT *, e12 + e13 + e14 d1, e12 + e23 + e24 d2, e13 + e23 + e34 d3, e14 + e24 + e34 d4, e12 + e13 + e14 + e23 + e24 + e34 m FROM f4),
 i4 AS (SELECT d4.*, CASE WHEN m = 6 THEN 'K4' WHEN m = 5 THEN 'diamond' WHEN m = 4 AND greatest(d1, d2, d3, d4) = 2 THEN 'cycle' WHEN m = 4 THEN 'paw' WHEN greatest(d1, d2, d3, d4) = 3 THEN 'claw' ELSE 'path' END topology,
  k1.cell_type c1, k2.cell_type c2, k3.cell_type c3, k4.cell_type c4 FROM d4 JOIN p k1 ON k1.cell_id = q[1] JOIN p k2 ON k2.cell_id = q[2] JOIN p k3 ON k3.cell_id = q[3] JOIN p k4 ON k4.cell_id = q[4])"""
T4 = "array_to_string(list_transform(list_sort([{'d': d1, 'k': c1}, {'d': d2, 'k': c2}, {'d': d3, 'k': c3}, {'d': d4, 'k': c4}]), lambda z: z.k), '-')"


# ---- graph construction -----------------------------------------------------------------------------------------


@query("edges_radius", f"WITH {E_SQL} SELECT source, target, round(sqrt(d2), 9) distance, sample_id FROM e")
def _(spark, sf):
    return graph(spark, sf).edges.select("source", "target", F.round("distance", 9).alias("distance"), "sample_id")


@query("edges_knn", f"WITH {K_SQL} SELECT source, target, round(sqrt(d2), 9) distance FROM ke")
def _(spark, sf):
    return knn_edges(points(spark, sf), 6).select(F.col("a").alias("source"), F.col("b").alias("target"), F.round("distance", 9).alias("distance"))


@query("edges_knn_capped", f"WITH {K_SQL} SELECT source, target, round(sqrt(d2), 9) distance FROM ke WHERE sqrt(d2) <= 0.02")
def _(spark, sf):
    return graph(spark, sf, "knn", k=6, max_distance=0.02).edges.select("source", "target", F.round("distance", 9).alias("distance"))


# a pair is linked if a circle through both holds no other point: among those through the pair, others on its left bound
# the circle's place on the bisector from above, others on its right from below
D_SQL = f"""{P_SQL}, pr AS (SELECT a.cell_id source, b.cell_id target, a.x x0, a.y y0, b.x x1, b.y y1 FROM p a JOIN p b ON a.cell_id < b.cell_id),
 tt AS (SELECT source, target, x0, y0, x1, y1, (x1 - x0) * (c.y - y0) - (y1 - y0) * (c.x - x0) s, (c.x - x0) * (c.x - x1) + (c.y - y0) * (c.y - y1) q FROM pr JOIN p c ON c.cell_id <> source AND c.cell_id <> target),
 de AS (SELECT source, target, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) d FROM tt GROUP BY source, target, x0, y0, x1, y1
  HAVING coalesce(max(q / (2 * s)) FILTER (WHERE s < 0), '-inf'::double) <= coalesce(min(q / (2 * s)) FILTER (WHERE s > 0), 'inf'::double))"""


@query("edges_delaunay", f"WITH {D_SQL} SELECT source, target, round(d, 9) distance FROM de")
def _(spark, sf):
    return graph(spark, sf, "delaunay").edges.select("source", "target", F.round("distance", 9).alias("distance"))


@query("edges_delaunay_tiles", f"WITH {D_SQL} SELECT source, target, round(d, 9) distance FROM de")
def _(spark, sf):
    """The same by tiles of at most 100 points, so that small tables have rounds too."""
    found = tiled_delaunay(points(spark, sf), capacity=100)
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.round("distance", 9).alias("distance"))


@query(
    "canonicalize_edges",
    """WITH raw AS (SELECT cast(l_partkey AS varchar) a, cast(l_suppkey AS varchar) b, l_quantity d FROM lineitem), o AS (SELECT least(a, b) source, greatest(a, b) target, d FROM raw WHERE a <> b)
 SELECT source, target, min(d) distance, 's1' sample_id FROM o GROUP BY source, target""",
)
def _(spark, sf):
    raw = read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_quantity").alias("distance"), F.lit("s1").alias("sample_id"))
    return canonical_edges(raw.where("source <> target"))


@query("subset_region", f"WITH {E_SQL} SELECT source, target FROM e JOIN p a ON a.cell_id = source JOIN p b ON b.cell_id = target WHERE a.region_id = 'EN' AND b.region_id = 'EN'")
def _(spark, sf):
    return graph(spark, sf).subset_region("region_id = 'EN'").edges.select("source", "target")


@query("subset_sample", f"WITH {E_SQL} SELECT source, target FROM e JOIN p a ON a.cell_id = source JOIN p b ON b.cell_id = target WHERE a.sample_id <> 's2' AND b.sample_id <> 's2'")
def _(spark, sf):
    return graph(spark, sf).subset_sample(F.col("sample_id") != "s2").edges.select("source", "target")


@query("adjacency", f"WITH {E_SQL} SELECT source cell_id, target neighbor FROM e UNION ALL SELECT target, source FROM e")
def _(spark, sf):
    return graph(spark, sf).adjacency()


@query("degrees", f"WITH {E_SQL}, {ADJ_SQL} SELECT cell_id, count(adj.x) degree FROM p LEFT JOIN adj ON b = cell_id GROUP BY cell_id")
def _(spark, sf):
    return graph(spark, sf).degrees()


@query("graph_summary", f"WITH {P_SQL} SELECT cell_type, count(*) n FROM p GROUP BY cell_type")
def _(spark, sf):
    return graph(spark, sf).counts("cell_type")


@query("edge_quantiles", f"WITH {E_SQL}, q AS (SELECT unnest([0.0, 0.5, 0.95, 1.0]) p) SELECT cast(p AS double) p, round(CASE p WHEN 0 THEN (SELECT min(sqrt(d2)) FROM e) WHEN 0.5 THEN (SELECT quantile_cont(sqrt(d2), 0.5) FROM e) WHEN 0.95 THEN (SELECT quantile_cont(sqrt(d2), 0.95) FROM e) ELSE (SELECT max(sqrt(d2)) FROM e) END, 9) distance FROM q")
def _(spark, sf):
    return niche.edge_quantiles(graph(spark, sf)).select("p", F.round("distance", 9).alias("distance"))


# ---- enumeration ------------------------------------------------------------------------------------------------


@query("catalog2", f"WITH {E_SQL}, t AS (SELECT least(sc, tc) || '-' || greatest(sc, tc) k FROM e) SELECT 'size2_edge_' || k motif_id, 2 size, 'edge' canonical_iso_class, k color_tuple, count(*) \"count\" FROM t GROUP BY k")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 2).catalog


@query("catalog2_uncolored", f"WITH {E_SQL} SELECT 'size2_edge' motif_id, 2 size, 'edge' canonical_iso_class, cast(NULL AS varchar) color_tuple, count(*) \"count\" FROM e")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 2, colored=False).catalog


@query("catalog3", f"WITH {I3_SQL} SELECT {L3} motif_id, 3 size, topology canonical_iso_class, {T3} color_tuple, count(*) \"count\" FROM i3 GROUP BY ALL")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 3).catalog


@query("catalog3_uncolored", f"WITH {I3_SQL} SELECT CASE WHEN topology = 'triangle' THEN 'size3_closed' ELSE 'size3_open' END motif_id, 3 size, topology canonical_iso_class, cast(NULL AS varchar) color_tuple, count(*) \"count\" FROM i3 GROUP BY topology")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 3, colored=False).catalog


@query("catalog4", f"WITH {I4_SQL} SELECT 'size4_' || topology || '_' || {T4} motif_id, 4 size, topology canonical_iso_class, {T4} color_tuple, count(*) \"count\" FROM i4 GROUP BY ALL")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 4).catalog


@query("catalog4_uncolored", f"WITH {I4_SQL} SELECT 'size4_' || topology motif_id, 4 size, topology canonical_iso_class, cast(NULL AS varchar) color_tuple, count(*) \"count\" FROM i4 GROUP BY topology")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 4, colored=False).catalog


# walking orders of paths and cycles, over ordered quadruples of linked cells
W4_SQL = """w AS (SELECT a.b v1, a.x v2, b.x v3, c.x v4 FROM adj a JOIN adj b ON b.b = a.x AND b.x <> a.b JOIN adj c ON c.b = b.x AND c.x <> a.x AND c.x <> a.b),
 wf AS (SELECT w.*, o13.b IS NOT NULL e13, o24.b IS NOT NULL e24, o14.b IS NOT NULL e14 FROM w LEFT JOIN adj o13 ON o13.b = v1 AND o13.x = v3 LEFT JOIN adj o24 ON o24.b = v2 AND o24.x = v4 LEFT JOIN adj o14 ON o14.b = v1 AND o14.x = v4)"""
@query(
    "catalog4_exact",
    f"""WITH {I4_SQL}, {W4_SQL}, ws AS (SELECT list_sort([v1, v2, v3, v4]) q, CASE WHEN e14 THEN 'cycle' ELSE 'path' END topology, min(k1.cell_type || '-' || k2.cell_type || '-' || k3.cell_type || '-' || k4.cell_type) t FROM wf
  JOIN p k1 ON k1.cell_id = v1 JOIN p k2 ON k2.cell_id = v2 JOIN p k3 ON k3.cell_id = v3 JOIN p k4 ON k4.cell_id = v4 WHERE NOT e13 AND NOT e24 GROUP BY ALL),
 al AS (SELECT topology, t FROM ws UNION ALL SELECT topology, {T4} FROM i4 WHERE topology NOT IN ('path', 'cycle')) SELECT 'size4_' || topology || '_' || t motif_id, topology canonical_iso_class, t color_tuple, count(*) "count" FROM al GROUP BY ALL""",
)
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 4, labeling="exact").catalog.drop("size")


@query(
    "incidence3_orbits",
    f"""WITH {I3_SQL}, u AS (SELECT {L3} motif_id, cells, topology, unnest([1, 2, 3]) i, c1, c2, c3 FROM i3),
 v AS (SELECT motif_id, cells[i] cell_id, CASE WHEN topology = 'wedge' AND i = 3 THEN 2 WHEN topology = 'wedge' THEN 1 ELSE 2 END d, [c1, c2, c3][i] k FROM u),
 o AS (SELECT motif_id, cell_id, dense_rank() OVER (PARTITION BY motif_id ORDER BY d, k) orbit_id FROM v) SELECT motif_id, cell_id, orbit_id, count(*) n FROM o GROUP BY ALL""",
)
def _(spark, sf):
    i = M.find_motifs(graph(spark, sf), 3).incidence
    return i.groupBy("motif_id", "cell_id", F.col("orbit_id").cast("long").alias("orbit_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "incidence4_orbits",
    f"""WITH {I4_SQL}, u AS (SELECT 'size4_' || topology || '_' || {T4} motif_id, q, unnest([1, 2, 3, 4]) i, [d1, d2, d3, d4] ds, [c1, c2, c3, c4] ks FROM i4),
 o AS (SELECT motif_id, q[i] cell_id, dense_rank() OVER (PARTITION BY motif_id ORDER BY ds[i], ks[i]) orbit_id FROM u) SELECT motif_id, cell_id, orbit_id, count(*) n FROM o GROUP BY ALL""",
)
def _(spark, sf):
    i = M.find_motifs(graph(spark, sf), 4).incidence
    return i.groupBy("motif_id", "cell_id", F.col("orbit_id").cast("long").alias("orbit_id")).agg(F.count(F.lit(1)).alias("n"))


def anchors(spark, sf) -> DataFrame:
    return points(spark, sf).where("cell_type = 'c3' AND region_id = 'EN'").select("cell_id")


@query("anchored2", f"WITH {E_SQL}, {AN_SQL} SELECT 'size2_edge_' || least(sc, tc) || '-' || greatest(sc, tc) motif_id, count(*) \"count\" FROM e WHERE source IN (SELECT cell_id FROM an) OR target IN (SELECT cell_id FROM an) GROUP BY ALL")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 2, anchored_on=anchors(spark, sf)).catalog.select("motif_id", "count")


@query("anchored3", f"WITH {I3_SQL}, {AN_SQL} SELECT {L3} motif_id, count(*) \"count\" FROM i3 WHERE list_has_any(cells, (SELECT list(cell_id) FROM an)) GROUP BY ALL")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 3, anchored_on=anchors(spark, sf)).catalog.select("motif_id", "count")


@query("anchored4", f"WITH {I4_SQL}, {AN_SQL} SELECT 'size4_' || topology || '_' || {T4} motif_id, count(*) \"count\" FROM i4 WHERE list_has_any(q, (SELECT list(cell_id) FROM an)) GROUP BY ALL")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 4, anchored_on=anchors(spark, sf)).catalog.select("motif_id", "count")


@query(
    "capped3",
    f"""WITH {I3_SQL}, n AS (SELECT *, CASE WHEN topology = 'triangle' THEN 'tri_' ELSE 'wedge_' END || array_to_string(cells, '~') instance_id FROM i3),
 k AS (SELECT * FROM n ORDER BY md5('1:' || instance_id), instance_id LIMIT 500) SELECT {L3} motif_id, count(*) \"count\" FROM k GROUP BY ALL""",
)
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 3, max_instances=500).catalog.select("motif_id", "count")


@query("plot_data", f"""WITH {I3_SQL}, c AS (SELECT {L3} m, count(*) n FROM i3 GROUP BY 1 ORDER BY n DESC, m LIMIT 15) SELECT CASE WHEN length(m) > 18 THEN left(m, 15) || '...' ELSE m END "label", n "count" FROM c""")
def _(spark, sf):
    return M.find_motifs(graph(spark, sf), 3).plot_data(15, 18)


@query("motif_density", f"WITH {I3_SQL}, u AS (SELECT unnest(cells) c FROM i3) SELECT cell_id, count(c) n FROM p LEFT JOIN u ON c = cell_id GROUP BY cell_id")
def _(spark, sf):
    sg = graph(spark, sf)
    return M.motif_density(sg, M.find_motifs(sg, 3))


@query(
    "motif_instances",
    f"""WITH {I3_SQL}, n AS (SELECT {N3} motif_id, cells, topology FROM i3), w AS (SELECT motif_id FROM n GROUP BY 1 HAVING count(*) >= 8), c AS (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY cells) rn FROM n JOIN w USING (motif_id)),
 s AS (SELECT motif_id, array_to_string(cells, '~') instance, CASE WHEN topology = 'wedge' THEN [cells[3], cells[1], cells[2]] ELSE cells END v FROM c WHERE rn <= 20) SELECT motif_id, instance, cast(i AS integer) slot, v[i] cell_id FROM s, (SELECT unnest([1, 2, 3]) i)""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    found = M.enumerate_instances(sg, 3).withColumn("sorted", M.ordered_colors())
    from cellweave.operators.enrichment import enrichment_label

    wanted = found.groupBy(enrichment_label(3)[0].alias("motif_id")).count().where("count >= 8").select("motif_id")
    return M.motif_instances(sg, wanted, 3, 20)


@query("bridging_motifs", f"WITH {I3_SQL}, c AS (SELECT {L3} motif_id, {T3} color_tuple, count(*) \"count\" FROM i3 GROUP BY ALL) SELECT * FROM c WHERE regexp_matches(color_tuple, '(^|[-_])c1([-_]|$)') AND regexp_matches(color_tuple, '(^|[-_])c2([-_]|$)')")
def _(spark, sf):
    return niche.bridging(M.find_motifs(graph(spark, sf), 3).catalog, "c1", "c2").select("motif_id", "color_tuple", "count")


# ---- enrichment -------------------------------------------------------------------------------------------------


def perm_sql(stratum: str, fixed: str = "FALSE") -> str:
    """(perm, cell_id, label): the r-th smallest md5 of a stratum gets the label of the r-th smallest id."""
    return f"""pn AS (SELECT cell_id, cell_type label, {stratum} g FROM p WHERE NOT {fixed}), pf AS (SELECT cell_id, cell_type label FROM p WHERE {fixed}), ps AS (SELECT unnest(range({PERMS})) perm),
 ph AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY cell_id) r, label FROM pn), pd AS (SELECT perm, cell_id, g, row_number() OVER (PARTITION BY perm, g ORDER BY md5('{SEED}:' || perm || ':' || cell_id), cell_id) r FROM pn, ps),
 pl AS (SELECT perm, cell_id, label FROM pd JOIN ph USING (g, r) UNION ALL SELECT perm, cell_id, label FROM pf, ps)"""


NULL2 = "nc AS (SELECT l1.perm perm, 'size2_edge_' || least(l1.label, l2.label) || '-' || greatest(l1.label, l2.label) motif_id, count(*) n FROM e JOIN pl l1 ON l1.cell_id = source JOIN pl l2 ON l2.cell_id = target AND l2.perm = l1.perm GROUP BY ALL), ob AS (SELECT 'size2_edge_' || least(sc, tc) || '-' || greatest(sc, tc) motif_id, count(*) o FROM e GROUP BY ALL)"


def null3(label: str, observed: str) -> str:
    return f"""rl AS (SELECT l1.perm perm, topology, l1.label c1, l2.label c2, l3.label c3 FROM i3 JOIN pl l1 ON l1.cell_id = cells[1] JOIN pl l2 ON l2.cell_id = cells[2] AND l2.perm = l1.perm JOIN pl l3 ON l3.cell_id = cells[3] AND l3.perm = l1.perm),
 nc AS (SELECT perm, {label} motif_id, count(*) n FROM rl GROUP BY ALL), ob AS (SELECT {observed} motif_id, count(*) o FROM i3 GROUP BY ALL)"""


def moments(how: str) -> str:
    return f"""mo AS (SELECT motif_id, coalesce(max(o), 0) obs, sum(coalesce(n, 0)) s, sum(coalesce(n, 0) * coalesce(n, 0)) ss, count(perm) k, count(*) FILTER (WHERE n >= coalesce(o, 0)) ge, count(*) FILTER (WHERE n <= coalesce(o, 0)) le FROM ob {how} JOIN nc USING (motif_id) GROUP BY motif_id),
 st AS (SELECT motif_id, obs, s / {PERMS}::double mean, sqrt(greatest((ss * {PERMS} - s * s)::double, 0) / ({PERMS} * {PERMS - 1})) sd, ge + CASE WHEN obs <= 0 THEN {PERMS} - k ELSE 0 END ge, le + {PERMS} - k le FROM mo)"""


def bh(table: str, p: str, out: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT * EXCLUDE (rk, step), least(1.0, min(step) OVER ({part} ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) {out} FROM
 (SELECT *, {p} * count({p}) OVER ({part}) / rk step FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}) rk FROM {table})))"""


ENR = f"""SELECT motif_id, obs::double observed, round(mean, 9) expected, round(sd, 9) sd_null, round((obs - mean) / greatest(sd, 1.4901161193847656e-08), 4) z, round(obs / greatest(mean, 2.220446049250313e-16), 3) fold, round(pe, 9) p_enrich, round(pd, 9) p_deplete, round(p_adj, 9) p_adj FROM
 {bh(f"(SELECT *, (1 + ge) / {PERMS + 1}.0::double pe, (1 + le) / {PERMS + 1}.0::double pd, least(1.0::double, 2 * least((1 + ge) / {PERMS + 1}.0::double, (1 + le) / {PERMS + 1}.0::double)) pp FROM st)", "pp", "p_adj")}"""
TST = f"""SELECT motif_id, obs observed, round(mean, 9) mean_null, round(sd, 9) sd_null, round((obs - mean) / greatest(sd, 1.4901161193847656e-08), 4) z, round(pe, 9) p_emp, round(p_adj, 9) p_adj_BH, round(obs / greatest(mean, 2.220446049250313e-16), 3) fold FROM
 {bh(f"(SELECT *, (1 + ge) / {PERMS + 1}.0::double pe FROM st)", "pe", "p_adj")}"""


def enriched(df: DataFrame) -> DataFrame:
    r = lambda c, d=9: F.round(c, d).alias(c)
    return df.select("motif_id", "observed", r("expected"), r("sd_null"), r("z", 4), r("fold", 3), r("p_enrich"), r("p_deplete"), r("p_adj"))


def tested(df: DataFrame) -> DataFrame:
    r = lambda c, d=9: F.round(c, d).alias(c)
    return df.select("motif_id", "observed", r("mean_null"), r("sd_null"), r("z", 4), r("p_emp"), r("p_adj_BH"), r("fold", 3))


# z is large and inexact where a sum of squares leaves no spread: such rows compare by their rounded spread


@query("enrich_label_s2", f"WITH {E_SQL}, {perm_sql(repr(''))}, {NULL2}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 2, PERMS, SEED).table)


@query("enrich_label_s3", f"WITH {I3_SQL}, {perm_sql(repr(''))}, {null3(N3, N3)}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 3, PERMS, SEED).table)


@query("enrich_stratified_s3", f"WITH {I3_SQL}, {perm_sql('region_id')}, {null3(N3, N3)}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 3, PERMS, SEED, strata_column="region_id").table)


@query("enrich_anchored_s2", f"WITH {E_SQL}, {perm_sql(repr(''))}, {NULL2.replace('FROM e ', 'FROM ae ')}, {moments('FULL')} {ENR}".replace("pn AS", f"{AN_SQL}, ae AS (SELECT * FROM e WHERE source IN (SELECT cell_id FROM an) OR target IN (SELECT cell_id FROM an)), pn AS", 1))
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 2, PERMS, SEED, anchored_on=anchors(spark, sf)).table)


@query("enrich_test_label", f"WITH {I3_SQL}, {perm_sql(repr(''))}, {null3(L3, L3)}, {moments('LEFT')} {TST}")
def _(spark, sf):
    sg = graph(spark, sf)
    return tested(test_motif_enrichment(M.find_motifs(sg, 3), sg, "label_permutation", PERMS, SEED).table)


@query("enrich_test_region", f"WITH {I3_SQL}, {perm_sql('region_id')}, {null3(L3, L3)}, {moments('LEFT')} {TST}")
def _(spark, sf):
    sg = graph(spark, sf)
    return tested(test_motif_enrichment(M.find_motifs(sg, 3), sg, "region_stratified", PERMS, SEED).table)


@query(
    "enrich_test_s4",
    f"""WITH {I4_SQL}, {perm_sql(repr(''))}, rl AS (SELECT l1.perm perm, topology, d1, d2, d3, d4, l1.label c1, l2.label c2, l3.label c3, l4.label c4 FROM i4 JOIN pl l1 ON l1.cell_id = q[1] JOIN pl l2 ON l2.cell_id = q[2] AND l2.perm = l1.perm JOIN pl l3 ON l3.cell_id = q[3] AND l3.perm = l1.perm JOIN pl l4 ON l4.cell_id = q[4] AND l4.perm = l1.perm),
 nc AS (SELECT perm, 'size4_' || topology || '_' || {T4} motif_id, count(*) n FROM rl GROUP BY ALL), ob AS (SELECT 'size4_' || topology || '_' || {T4} motif_id, count(*) o FROM i4 GROUP BY ALL), {moments('LEFT')} {TST}""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    return tested(test_motif_enrichment(M.find_motifs(sg, 4), sg, "label_permutation", PERMS, SEED).table)


# permuted and observed labels of all walks of paths and cycles, the least of which names the class, and of other shapes
S4_SQL = f"""wk AS (SELECT list_sort([v1, v2, v3, v4]) q, CASE WHEN e14 THEN 'cycle' ELSE 'path' END topology, v1, v2, v3, v4 FROM wf WHERE NOT e13 AND NOT e24),
 oth AS (SELECT * FROM i4 WHERE topology NOT IN ('path', 'cycle')),
 rw AS (SELECT l1.perm perm, q, topology, min(l1.label || '-' || l2.label || '-' || l3.label || '-' || l4.label) t FROM wk JOIN pl l1 ON l1.cell_id = v1 JOIN pl l2 ON l2.cell_id = v2 AND l2.perm = l1.perm JOIN pl l3 ON l3.cell_id = v3 AND l3.perm = l1.perm JOIN pl l4 ON l4.cell_id = v4 AND l4.perm = l1.perm GROUP BY ALL),
 ro AS (SELECT l1.perm perm, topology, d1, d2, d3, d4, l1.label c1, l2.label c2, l3.label c3, l4.label c4 FROM oth JOIN pl l1 ON l1.cell_id = q[1] JOIN pl l2 ON l2.cell_id = q[2] AND l2.perm = l1.perm JOIN pl l3 ON l3.cell_id = q[3] AND l3.perm = l1.perm JOIN pl l4 ON l4.cell_id = q[4] AND l4.perm = l1.perm),
 nc AS (SELECT perm, motif_id, count(*) n FROM (SELECT perm, 'size4_' || topology || '_' || t motif_id FROM rw UNION ALL SELECT perm, 'size4_' || topology || '_' || {T4} FROM ro) GROUP BY ALL),
 ow AS (SELECT q, topology, min(k1.cell_type || '-' || k2.cell_type || '-' || k3.cell_type || '-' || k4.cell_type) t FROM wk JOIN p k1 ON k1.cell_id = v1 JOIN p k2 ON k2.cell_id = v2 JOIN p k3 ON k3.cell_id = v3 JOIN p k4 ON k4.cell_id = v4 GROUP BY ALL),
 ob AS (SELECT motif_id, count(*) o FROM (SELECT 'size4_' || topology || '_' || t motif_id FROM ow UNION ALL SELECT 'size4_' || topology || '_' || {T4} FROM oth) GROUP BY ALL)"""


@query("enrich_s4", f"WITH {I4_SQL}, {W4_SQL}, {perm_sql(repr(''))}, {S4_SQL}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 4, PERMS, SEED).table)


@query("enrich_conditional")
def _(spark, sf):
    return enriched(motif_enrichment(graph(spark, sf), 3, PERMS, SEED, "conditional").table)


def uniform_sql(tag: str) -> str:
    return f"((('0x' || substr(md5('{SEED}:' || perm || ':' || cell_id || ':{tag}'), 1, 13))::bigint + 1) / 4503599627370496.0::double)"


@query(
    "enrich_jitter",
    f"""WITH {E_SQL}, pj AS (SELECT perm, cell_id, cell_type, x + sqrt(-2 * ln({uniform_sql('r')})) * 0.01 * cos(2 * pi() * {uniform_sql('a')}) x, y + sqrt(-2 * ln({uniform_sql('r')})) * 0.01 * sin(2 * pi() * {uniform_sql('a')}) y
  FROM p, (SELECT unnest(range({PERMS})) perm)), ej AS (SELECT a.perm perm, a.cell_type sc, b.cell_type tc FROM pj a JOIN pj b ON a.perm = b.perm AND a.cell_id < b.cell_id, r WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r * r),
 nc AS (SELECT perm, 'size2_edge_' || least(sc, tc) || '-' || greatest(sc, tc) motif_id, count(*) n FROM ej GROUP BY ALL), ob AS (SELECT 'size2_edge_' || least(sc, tc) || '-' || greatest(sc, tc) motif_id, count(*) o FROM e GROUP BY ALL), {moments('LEFT')} {TST}""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    return tested(test_motif_enrichment(M.find_motifs(sg, 2), sg, "geometric_jitter", PERMS, SEED, null_args={"sd": 0.01}).table)


# a seventh of the cells has no region: such cells keep their labels, or are a stratum of their own
def bare(spark, sf) -> SpatialGraph:
    sg = graph(spark, sf)
    return SpatialGraph(sg.nodes.withColumn("region_id", F.when(F.col("cell_id").cast("long") % 7 != 0, F.col("region_id"))), sg.edges, sg.meta)


BARE = ("embedding[2] >= 0 THEN 'N' ELSE 'S' END) region_id", "embedding[2] >= 0 THEN 'N' ELSE 'S' END) || CASE WHEN vec_id % 7 = 0 THEN NULL ELSE '' END region_id")


@query("enrich_null_stratum", f"WITH {E_SQL}, {perm_sql('region_id', 'region_id IS NULL')}, {NULL2}, {moments('FULL')} {ENR}".replace(*BARE))
def _(spark, sf):
    return enriched(motif_enrichment(bare(spark, sf), 2, PERMS, SEED, "stratified").table)


@query("enrich_test_null_region", f"WITH {E_SQL}, {perm_sql(repr('<NA>')).replace(repr('<NA>'), 'coalesce(region_id, ' + repr('<NA>') + ')')}, {NULL2}, {moments('LEFT')} {TST}".replace(*BARE))
def _(spark, sf):
    sg = bare(spark, sf)
    return tested(test_motif_enrichment(M.find_motifs(sg, 2), sg, "region_stratified", PERMS, SEED).table)


def numbered(df: DataFrame) -> DataFrame:
    """df with the place of each row in its order, by partitions."""
    at = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    return ranked_in_lanes(at, [], F.shiftright("__row", 33), ["__row"], "place").drop("__row").withColumn("place", F.col("place").cast("int"))


@query("enrich_order", f"WITH {E_SQL}, {perm_sql(repr(''))}, {NULL2}, {moments('FULL')}, o AS ({ENR}) SELECT row_number() OVER (ORDER BY p_adj, z DESC, motif_id) place, motif_id, p_adj FROM o")
def _(spark, sf):
    return numbered(enriched(motif_enrichment(graph(spark, sf), 2, PERMS, SEED).table)).select("place", "motif_id", "p_adj")


# parts bought in one order, as an edge store with integer ids
S_SQL = f"""li AS (SELECT DISTINCT l_orderkey o, l_partkey k FROM lineitem), se AS (SELECT DISTINCT a.k f, b.k t FROM li a JOIN li b ON a.o = b.o AND a.k < b.k),
 p AS (SELECT lpad(cast(p_partkey AS varchar), 19, '0') cell_id, p_brand cell_type FROM part), e AS (SELECT lpad(cast(f AS varchar), 19, '0') source, lpad(cast(t AS varchar), 19, '0') target, a.cell_type sc, b.cell_type tc FROM se JOIN p a ON a.cell_id = lpad(cast(f AS varchar), 19, '0') JOIN p b ON b.cell_id = lpad(cast(t AS varchar), 19, '0'))"""


def bought_together(spark, sf) -> DataFrame:
    """Pairs of parts, one for each order that has both; an order's lines are dealt once."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    left, right = li.toDF("o", "from_id"), li.toDF("o", "to_id")
    return left.join(right, "o").where("from_id < to_id").select("from_id", "to_id")


def purchases(spark, sf) -> DataFrame:
    return bought_together(spark, sf).distinct()


def brands(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("int_id"), F.col("p_brand").alias("cell_type"))


@query("edge_store_enrich", f"WITH {S_SQL}, {perm_sql(repr(''))}, {NULL2}, {moments('FULL')} {ENR}")
def _(spark, sf):
    nodes = read(spark, sf, "part").select(F.col("p_name").alias("node_id"), F.col("p_partkey").alias("int_id"))
    return enriched(motif_enrichment(store_graph(nodes, purchases(spark, sf), brands(spark, sf)), 2, PERMS, SEED).table)


@query("edge_stream_enrich", f"WITH {S_SQL.replace('p_brand cell_type FROM part)', 'p_brand cell_type FROM part WHERE p_partkey IN (SELECT f FROM se UNION SELECT t FROM se))')}, {perm_sql(repr(''))}, {NULL2}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment_stream(purchases(spark, sf), brands(spark, sf), 2, PERMS, SEED).table)


def stored(spark, sf) -> tuple[str, str]:
    """The parquet tables of the edge store, written to the shared folder."""
    base = scratch(spark, "store")
    read(spark, sf, "part").select(F.col("p_name").alias("node_id"), F.col("p_partkey").alias("int_id")).write.parquet(f"{base}/nodes")
    purchases(spark, sf).write.parquet(f"{base}/edges")
    return f"{base}/nodes", f"{base}/edges"


@query("edge_store_parquet_enrich", f"WITH {S_SQL}, {perm_sql(repr(''))}, {NULL2}, {moments('FULL')} {ENR}")
def _(spark, sf):
    return enriched(motif_enrichment_store(spark, *stored(spark, sf), brands(spark, sf), 2, PERMS, SEED).table)


@query("edge_store_node_order", "SELECT p_name node_id, p_partkey int_id, row_number() OVER (ORDER BY p_partkey) place FROM part")
def _(spark, sf):
    return numbered(store_node_order(spark, stored(spark, sf)[0]))


@query("graph_round_trip", f"WITH {E_SQL} SELECT source, target, round(sqrt(d2), 9) distance, e.sample_id sample_id, a.cell_type source_type, b.region_id target_region FROM e JOIN p a ON a.cell_id = source JOIN p b ON b.cell_id = target")
def _(spark, sf):
    base = scratch(spark, "graph")
    write_spatial_graph(graph(spark, sf), f"{base}/nodes", f"{base}/edges")
    sg = read_spatial_graph(spark, f"{base}/nodes", f"{base}/edges")
    types, regions = sg.nodes.select(F.col("cell_id").alias("source"), F.col("cell_type").alias("source_type")), sg.nodes.select(F.col("cell_id").alias("target"), F.col("region_id").alias("target_region"))
    return sg.edges.join(types, "source").join(regions, "target").select("source", "target", F.round("distance", 9).alias("distance"), "sample_id", "source_type", "target_region")


@query("csv_round_trip", f"WITH {P_SQL} SELECT cell_id, x, y, cell_type, sample_id, CASE WHEN cast(cell_id AS bigint) % 7 = 0 THEN NULL ELSE region_id END region_id FROM p")
def _(spark, sf):
    path = f"{scratch(spark, 'csv')}/nodes"
    write_table(bare(spark, sf).nodes.drop("z"), path, "csv")
    return spark.read.csv(path, header=True, schema="cell_id string, x double, y double, cell_type string, sample_id string, region_id string", nullValue="", emptyValue='""')


@query(
    "graph_report",
    f"""WITH {E_SQL}, s AS (SELECT 'cells' item, '' "group", count(*)::double "value" FROM p UNION ALL SELECT 'edges', '', count(*)::double FROM e UNION ALL SELECT 'cells by type', cell_type, count(*)::double FROM p GROUP BY cell_type
 UNION ALL SELECT 'cells by sample', sample_id, count(*)::double FROM p GROUP BY sample_id UNION ALL SELECT 'cells by region', region_id, count(*)::double FROM p GROUP BY region_id
 UNION ALL SELECT 'edge length', q, v FROM (SELECT unnest(['0.0', '0.5', '0.95', '1.0']) q, unnest([min(sqrt(d2)), quantile_cont(sqrt(d2), 0.5), quantile_cont(sqrt(d2), 0.95), max(sqrt(d2))]) v FROM e)) SELECT item, "group", round("value", 9) "value" FROM s""",
)
def _(spark, sf):
    return report_table(graph(spark, sf)).withColumn("value", F.round("value", 9))


@query(
    "graph_create",
    """WITH raw AS (SELECT cast(o_custkey AS varchar) a, cast(o_orderkey % 1000 AS varchar) b, o_totalprice d, o_orderpriority s FROM orders), o AS (SELECT least(a, b) source, greatest(a, b) target, d, s FROM raw WHERE a <> b)
 SELECT source, target, distance, sample_id FROM (SELECT source, target, d distance, s sample_id, row_number() OVER (PARTITION BY source, target ORDER BY d, s) rn FROM o) WHERE rn = 1""",
)
def _(spark, sf):
    o = read(spark, sf, "orders")
    raw = o.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 1000).alias("target"), F.col("o_totalprice").alias("distance"), F.col("o_orderpriority").alias("sample_id"))
    ids = raw.select(F.col("source").alias("cell_id")).unionByName(raw.select(F.col("target").alias("cell_id"))).distinct()
    nodes = ids.select("cell_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit("t").alias("cell_type"), F.lit("s").alias("sample_id"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # loops are dropped here on purpose
        return SpatialGraph.create(nodes, raw).edges.select("source", "target", "distance", "sample_id")


def digest_sql(table: str, mark: str) -> str:
    return f"(SELECT count(*) || ':' || " + " || ':' || ".join(f"coalesce(sum(('0x' || substr({mark}, {at}, 13))::bigint), 0)" for at in (1, 14)) + f" FROM {table})"


@query("graph_fingerprint", f"WITH {E_SQL} SELECT md5({digest_sql('p', 'md5(cell_id)')} || ':' || {digest_sql('e', 'md5(md5(source) || md5(target))')}) fingerprint")
def _(spark, sf):
    return spark.createDataFrame([(graph(spark, sf).fingerprint(),)], "fingerprint string")


@query("graph_without_ids", f"WITH {E_SQL.replace('cast(vec_id AS varchar) cell_id', repr('cell_') + ' || row_number() OVER (ORDER BY embedding[1], embedding[2], label) cell_id')} SELECT source, target, round(sqrt(d2), 9) distance FROM e")
def _(spark, sf):
    radius = 0.6 / read(spark, sf, "embeddings").count() ** 0.5
    return build_spatial_graph(points(spark, sf).drop("cell_id"), "radius", radius=radius).edges.select("source", "target", F.round("distance", 9).alias("distance"))


@query(
    "summaries",
    f"""WITH {I3_SQL}, m AS (SELECT {L3} motif_id, count(*) n FROM i3 GROUP BY ALL), t AS (SELECT cell_type v, count(*) n FROM p GROUP BY ALL ORDER BY n DESC, v LIMIT 5), g AS (SELECT region_id v, count(*) n FROM p GROUP BY ALL)
 SELECT 1 place, 'Graph of ' || (SELECT count(*) FROM p) || ' cells and ' || (SELECT count(*) FROM e) || ' edges, made by radius' line
 UNION ALL SELECT 2, count(DISTINCT sample_id) || ' samples, first ' || string_agg(DISTINCT sample_id, ', ' ORDER BY sample_id) FROM p
 UNION ALL SELECT 3, count(*) || ' regions: ' || string_agg(v || ' ' || n, ', ' ORDER BY n DESC, v) FROM g
 UNION ALL SELECT 4, (SELECT count(DISTINCT cell_type) FROM p) || ' types, most frequent ' || string_agg(v || ' ' || n, ', ' ORDER BY n DESC, v) FROM t
 UNION ALL SELECT 5, 'Motifs of 3 cells, colored: ' || sum(n) || ' instances of ' || count(*) || ' classes' FROM m
 UNION ALL SELECT 5 + row_number() OVER (ORDER BY n DESC, motif_id), lpad(n::varchar, 12, ' ') || '  ' || motif_id FROM (SELECT * FROM m ORDER BY n DESC, motif_id LIMIT 5)""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    lines = f"{sg.summary()}\n{M.find_motifs(sg, 3).summary()}".split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")


@query("motifs_by_hand", f"WITH {P_SQL} SELECT cell_id, (cast(cell_id AS bigint) % 2 = 0)::bigint + (cast(cell_id AS bigint) % 5 = 0)::bigint n FROM p")
def _(spark, sf):
    sg = graph(spark, sf)
    number = F.col("cell_id").cast("long")
    rows = [sg.nodes.where(number % n == 0).select(F.lit(f"by{n}").alias("motif_id"), F.concat(F.lit(f"i{n}_"), "cell_id").alias("instance_id"), "cell_id", F.lit(1).alias("orbit_id")) for n in (2, 5)]
    incidence = rows[0].unionByName(rows[1])
    catalog = incidence.groupBy("motif_id", F.lit(1).alias("size"), F.lit("cell").alias("canonical_iso_class"), F.lit("").alias("color_tuple")).agg(F.count(F.lit(1)).alias("count"))
    return M.motif_density(sg, M.Motifs(catalog, incidence))


@query("edge_store_catalog3", f"""WITH {S_SQL}, {ADJ_SQL}, ek AS (SELECT source, target FROM e), tp AS (SELECT l.b b, l.x a, r.x c, k.source IS NOT NULL closed FROM adj l JOIN adj r ON l.b = r.b AND l.x < r.x LEFT JOIN ek k ON k.source = l.x AND k.target = r.x)
 SELECT CASE WHEN closed THEN 'size3_closed' ELSE 'size3_open' END motif_id, count(*) \"count\" FROM tp WHERE NOT closed OR b < a GROUP BY ALL""")
def _(spark, sf):
    sg = integer_graph(brands(spark, sf), bought_together(spark, sf))
    return M.find_motifs(sg, 3, colored=False).catalog.select("motif_id", "count")


# users and the items of their clicks, as edges that come in several batches
L_SQL = """l AS (SELECT user_id a, 1000 + cast(regexp_extract(props, '[0-9]+') AS bigint) % 500 b FROM events WHERE event_type = 'click' UNION SELECT user_id, 1 + user_id * 7 % 1999 FROM events),
 e AS (SELECT DISTINCT least(a, b) f, greatest(a, b) t FROM l WHERE a <> b), adj AS (SELECT f b, t x FROM e UNION ALL SELECT t, f FROM e),
 i0 AS (SELECT l.b b, l.x a, r.x c, k.f IS NOT NULL closed FROM adj l JOIN adj r ON l.b = r.b AND l.x < r.x LEFT JOIN e k ON k.f = l.x AND k.t = r.x),
 i3 AS (SELECT CASE WHEN closed THEN 'triangle' ELSE 'wedge' END topology, 't' || a % 3 c1, 't' || c % 3 c2, 't' || b % 3 c3 FROM i0 WHERE NOT closed OR b < a)"""


@query("live_catalog3", f"WITH {L_SQL} SELECT {L3} motif_id, 3 size, topology canonical_iso_class, {T3} color_tuple, count(*) \"count\" FROM i3 GROUP BY ALL")
def _(spark, sf):
    e = read(spark, sf, "events")
    item = 1000 + F.regexp_extract("props", "[0-9]+", 0).cast("long") % 500
    pairs = e.where("event_type = 'click'").select(F.col("user_id").alias("from_id"), item.alias("to_id"))
    pairs = pairs.unionByName(e.select(F.col("user_id").alias("from_id"), (1 + F.col("user_id") * 7 % 1999).alias("to_id")))
    base = scratch(spark, "live")
    pairs.repartition(3).write.parquet(f"{base}/in")
    ends = pairs.select(F.col("from_id").alias("int_id")).unionByName(pairs.select(F.col("to_id").alias("int_id"))).distinct()
    live = LiveCatalog(spark, f"{base}/state", ends.withColumn("cell_type", F.concat(F.lit("t"), F.col("int_id") % 3)))
    stream = spark.readStream.schema("from_id long, to_id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    live.start(stream, f"{base}/check", availableNow=True).awaitTermination()
    return live.catalog()


# ---- comparison, association, niches ----------------------------------------------------------------------------


def sample_motifs(spark, sf) -> dict[str, M.Motifs]:
    return motifs_by_sample(graph(spark, sf), 3)


def catalogs_sql() -> str:
    ins = " AND ".join(f"k{i}.sample_id = k1.sample_id" for i in (2, 3))
    return f"""{I3_SQL}, rg AS (SELECT {L3.replace('topology', 'i3.topology')} motif_id, k1.sample_id g FROM i3 JOIN p k1 ON k1.cell_id = cells[1] JOIN p k2 ON k2.cell_id = cells[2] JOIN p k3 ON k3.cell_id = cells[3] WHERE {ins})"""


def tail_sql(z: str) -> str:
    """P(|Z| >= |z|) by the series of the normal distribution's centre, whose terms are all positive."""
    series = f"list_sum(list_transform(range(0, 120), lambda i: exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2))))"
    return f"(CASE WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}, 0.0) END)"


def chi_sql(groups: dict[str, str], df: int) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE g IN {members}) AS count_{name}" for name, members in groups.items())
    total = " + ".join(f"count_{n}" for n in groups)
    terms = " + ".join(f"(count_{n} - ex_{n}) * (count_{n} - ex_{n}) / greatest(ex_{n}, 2.220446049250313e-16)" for n in groups)
    exp = ", ".join(f"total * (SELECT count(*) FROM rg WHERE g IN {members}) / (SELECT count(*) FROM rg)::double ex_{n}" for n, members in groups.items())
    cols = ", ".join(f"count_{n}" for n in groups)
    body = f"cc AS (SELECT motif_id, {counts} FROM rg GROUP BY motif_id), ct AS (SELECT *, {total} total FROM cc), cx AS (SELECT *, {exp} FROM ct), ch AS (SELECT motif_id, {cols}, total, {terms} chi2 FROM cx)"
    tail = {1: tail_sql("sqrt(chi2)"), 2: "exp(-chi2 / 2)"}[df]
    return f"{body} SELECT motif_id, {cols}, total, round(chi2, 8) chi2, round(p, 8) p, round(p_adj_BH, 8) \"p_adj_BH\" FROM {bh(f'(SELECT *, {tail} p FROM ch)', 'p', 'p_adj_BH')}"


@query("compare_samples", f"WITH {catalogs_sql()}, {chi_sql({s: f'({s!r})' for s in ('s0', 's1', 's2')}, 2)}")
def _(spark, sf):
    out = compare_motifs(sample_motifs(spark, sf))
    return out.select("motif_id", "count_s0", "count_s1", "count_s2", "total", F.round("chi2", 8).alias("chi2"), F.round("p", 8).alias("p"), F.round("p_adj_BH", 8).alias("p_adj_BH"))


@query("compare_replicates", f"WITH {catalogs_sql()}, {chi_sql({'a': str(('s0', 's1')), 'b': '(' + repr('s2') + ')'}, 1)}")
def _(spark, sf):
    out = compare_motifs(list(sample_motifs(spark, sf).values()), group=["a", "a", "b"])
    return out.select("motif_id", "count_a", "count_b", "total", F.round("chi2", 8).alias("chi2"), F.round("p", 8).alias("p"), F.round("p_adj_BH", 8).alias("p_adj_BH"))


@query("sample_shares", f"WITH {catalogs_sql()}, gs AS (SELECT unnest(['s0', 's1', 's2']) \"group\"), ms AS (SELECT DISTINCT motif_id FROM rg) SELECT ms.motif_id, \"group\", round(count(rg.g)::double / any_value(t.n), 9) share FROM ms CROSS JOIN gs JOIN (SELECT motif_id, count(*) n FROM rg GROUP BY 1) t ON t.motif_id = ms.motif_id LEFT JOIN rg ON rg.motif_id = ms.motif_id AND rg.g = \"group\" GROUP BY ALL")
def _(spark, sf):
    return niche.region_shares(compare_motifs(sample_motifs(spark, sf)), ["s0", "s1", "s2"]).withColumn("share", F.round("share", 9))


@query("top_motif_per_sample", f"WITH {catalogs_sql()}, c AS (SELECT g \"group\", motif_id, count(*) n FROM rg GROUP BY ALL) SELECT \"group\", motif_id, n FROM (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, motif_id) rn FROM c) WHERE rn = 1")
def _(spark, sf):
    return niche.top_per_group(compare_motifs(sample_motifs(spark, sf)), ["s0", "s1", "s2"])


def expression(spark, sf) -> DataFrame:
    """Genes with many ties: the embedding's positive components in steps."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.posexplode("embedding").alias("g", "v"))
    return e.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("gene"), "cell_id", F.floor(F.greatest(F.col("v").cast("double") * 20, F.lit(0.0))).cast("double").alias("value")).where("value <> 0")


X_SQL = """xr AS (SELECT cast(vec_id AS varchar) cell_id, unnest(range(len(embedding))) g, embedding FROM embeddings), x AS (SELECT 'g' || g gene, cell_id, floor(greatest(cast(embedding[g + 1] AS double) * 20, 0)) v FROM xr)"""
# dense ranks and ties by gene (and sample), independent of the sparse method
W_SQL = """nn AS (SELECT s, gene, count(*) n, sum(v) total FROM xs GROUP BY ALL), tv AS (SELECT s, gene, v, count(*) t FROM xs GROUP BY ALL), ti AS (SELECT s, gene, sum(t::double * t * t - t) ties FROM tv GROUP BY ALL),
 rk AS (SELECT *, rank() OVER (PARTITION BY s, gene ORDER BY v) + (count(*) OVER (PARTITION BY s, gene, v) - 1) / 2.0 r FROM xs),
 ag AS (SELECT s, motif_id, orbit_id, gene, count(*) n_in, sum(r)::double r1, sum(v) sv, count(*) FILTER (WHERE v > 0) nx FROM mem JOIN rk USING (s, cell_id) GROUP BY ALL),
 wx AS (SELECT ag.*, n, n - n_in n_out, total, r1 - n_in * (n_in + 1) / 2.0 u, sqrt(greatest(n_in::double * (n - n_in) / 12 * ((n + 1) - ties / (n::double * (n - 1))), 2.220446049250313e-16)) sg FROM ag JOIN nn USING (s, gene) JOIN ti USING (s, gene)),
 wz AS (SELECT *, (u - n_in::double * n_out / 2) / sg z, sv / n_in mi, (total - sv) / n_out mo FROM wx WHERE n_out >= 1)"""


def member_sql(by: str, per_sample: bool) -> str:
    orbit = "dense_rank() OVER (PARTITION BY motif_id ORDER BY d, k)" if by == "orbit" else "cast(NULL AS bigint)"
    s = "k1.sample_id" if per_sample else "''"
    where = "WHERE k1.sample_id = k2.sample_id AND k1.sample_id = k3.sample_id" if per_sample else ""
    return f"""u AS (SELECT {L3.replace('topology', 'i3.topology')} motif_id, cells, topology, unnest([1, 2, 3]) i, c1, c2, c3, {s} s FROM i3 JOIN p k1 ON k1.cell_id = cells[1] JOIN p k2 ON k2.cell_id = cells[2] JOIN p k3 ON k3.cell_id = cells[3] {where}),
 vv AS (SELECT s, motif_id, cells[i] cell_id, CASE WHEN topology = 'wedge' AND i < 3 THEN 1 ELSE 2 END d, [c1, c2, c3][i] k FROM u), mo AS (SELECT DISTINCT s, motif_id, {orbit} orbit_id, cell_id FROM vv),
 mem AS (SELECT * FROM mo SEMI JOIN (SELECT s a, motif_id b, orbit_id c FROM mo GROUP BY ALL HAVING count(*) >= 10) z ON s = a AND motif_id = b AND orbit_id IS NOT DISTINCT FROM c)"""


GENES = "SELECT motif_id, orbit_id, gene, n_in, n_out, nx n_in_expressed, round(mi, 9) mean_in, round(mo, 9) mean_out, round(log2((mi + 1) / (mo + 1)), 7) \"log2FC\", u \"U\", round(z, 7) z, round(p, 7) p, round(p_adj, 7) \"p_adj_BH\" FROM " + bh(f"(SELECT *, {tail_sql('z')} p FROM wz WHERE nx >= 3)", "p", "p_adj", "motif_id")


def associated(df: DataFrame) -> DataFrame:
    r = lambda c, d: F.round(c, d).alias(c)
    return df.select("motif_id", F.col("orbit_id").cast("long").alias("orbit_id"), "gene", "n_in", "n_out", "n_in_expressed", r("mean_in", 9), r("mean_out", 9), r("log2FC", 7), "U", r("z", 7), r("p", 7), r("p_adj_BH", 7))


@query("genes_wilcoxon", f"WITH {I3_SQL}, {member_sql('motif', False)}, {X_SQL}, xs AS (SELECT '' s, * FROM x), {W_SQL} {GENES.replace('orbit_id, ', '')}")
def _(spark, sf):
    sg = graph(spark, sf)
    return associated(associate_genes(M.find_motifs(sg, 3), expression(spark, sf), sg)).drop("orbit_id")


@query("genes_sparse_file", f"WITH {I3_SQL}, {member_sql('motif', False)}, {X_SQL}, xs AS (SELECT '' s, * FROM x), {W_SQL} {GENES.replace('orbit_id, ', '')}")
def _(spark, sf):
    sg, values = graph(spark, sf), expression(spark, sf)
    dims = read(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    genes = spark.range(dims).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"))
    paths = write_expression(values, genes, sg.nodes, scratch(spark, "matrix"))
    return associated(associate_genes(M.find_motifs(sg, 3), read_expression(spark, *paths)[0], sg)).drop("orbit_id")


@query("genes_orbit", f"WITH {I3_SQL}, {member_sql('orbit', False)}, {X_SQL}, xs AS (SELECT '' s, * FROM x), {W_SQL} {GENES}")
def _(spark, sf):
    sg = graph(spark, sf)
    return associated(associate_genes(M.find_motifs(sg, 3), expression(spark, sf), sg, by="orbit"))


@query(
    "genes_module",
    f"""WITH {I3_SQL}, {member_sql('motif', False)}, {X_SQL}, gs AS (SELECT gene, avg(v) mu, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) sd FROM x GROUP BY gene),
 ms AS (SELECT CASE WHEN gene IN ('g0', 'g1', 'g2', 'g3') THEN 'm1' ELSE 'm2' END gene, cell_id, round(avg((v - mu) / greatest(sd, 1.4901161193847656e-08)), 12) v FROM x JOIN gs USING (gene) WHERE gene IN ('g0', 'g1', 'g2', 'g3', 'g7', 'g8') GROUP BY ALL),
 xs AS (SELECT '' s, * FROM ms), {W_SQL} SELECT motif_id, gene, n_in, n_out, round(mi, 6) mean_in, round(mi - mo, 6) \"log2FC\", round(z, 4) z, round(p, 5) p, round(p_adj, 5) \"p_adj_BH\" FROM {bh(f"(SELECT *, {tail_sql('z')} p FROM wz)", 'p', 'p_adj', 'motif_id')}""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    out = associate_genes(M.find_motifs(sg, 3), expression(spark, sf), sg, method="module_score", modules={"m1": ["g0", "g1", "g2", "g3"], "m2": ["g7", "g8", "none"]})
    return out.select("motif_id", "gene", "n_in", "n_out", F.round("mean_in", 6).alias("mean_in"), F.round("log2FC", 6).alias("log2FC"), F.round("z", 4).alias("z"), F.round("p", 5).alias("p"), F.round("p_adj_BH", 5).alias("p_adj_BH"))


@query(
    "genes_per_sample",
    f"""WITH {I3_SQL}, {member_sql('motif', True)}, {X_SQL}, xs AS (SELECT sample_id s, x.* FROM x JOIN p USING (cell_id)), {W_SQL}, k AS (SELECT *, log2((mi + 1) / (mo + 1)) fc FROM wz WHERE nx >= 3), g AS (SELECT motif_id, gene, count(*) n_samples_tested, sum(n_in)::bigint n_in_total, sum(n_out)::bigint n_out_total, round(avg(fc), 7) \"mean_log2FC\", round(stddev_samp(fc), 7) \"sd_log2FC\", sum(sqrt(n_in) * z) / sqrt(sum(n_in)) zc FROM k GROUP BY motif_id, gene)
 SELECT * EXCLUDE (zc, p, p_adj), round(zc, 7) z_combined, round(p, 7) p_combined, round(p_adj, 7) \"p_adj_BH\" FROM {bh(f"(SELECT *, {tail_sql('zc')} p FROM g)", 'p', 'p_adj', 'motif_id')}""",
)
def _(spark, sf):
    sg = graph(spark, sf)
    out = associate_genes(M.find_motifs(sg, 3), expression(spark, sf), sg, pooling="per_sample")
    r = lambda c: F.round(c, 7).alias(c)
    return out.select("motif_id", "gene", "n_samples_tested", "n_in_total", "n_out_total", r("mean_log2FC"), r("sd_log2FC"), r("z_combined"), r("p_combined"), r("p_adj_BH"))


@query("genes_none", "SELECT '' motif_id, '' gene, 0::bigint n_in, 0.0::double z FROM embeddings WHERE false")
def _(spark, sf):
    sg = graph(spark, sf)
    return associate_genes(M.find_motifs(sg, 3), expression(spark, sf), sg, min_cells=1 << 30).select("motif_id", "gene", "n_in", "z")


# genes seen in three cells, then cells with five such genes, and their logarithms
N_SQL = f"""{X_SQL}, kg AS (SELECT gene FROM x WHERE v >= 1 GROUP BY gene HAVING count(*) >= 3), kx AS (SELECT * FROM x SEMI JOIN kg USING (gene)), kc AS (SELECT cell_id FROM kx WHERE v >= 1 GROUP BY cell_id HAVING count(*) >= 5),
 nx AS (SELECT gene, cell_id, log2(1 + 6000 * v / sum(v) OVER (PARTITION BY cell_id)) v FROM kx SEMI JOIN kc USING (cell_id) WHERE v <> 0)"""


@query("expression_normalised", f"WITH {N_SQL} SELECT gene, cell_id, round(v, 9) \"value\" FROM nx")
def _(spark, sf):
    return normalised(quality_filtered(expression(spark, sf))).withColumn("value", F.round("value", 9))


# the total variance, and that the components' scores are uncorrelated with variances that fall: checked from the scores
@query("expression_pca", f"WITH {N_SQL}, m AS (SELECT count(DISTINCT cell_id)::double n FROM nx), g AS (SELECT sum(v) s, sum(v * v) q FROM nx GROUP BY gene) SELECT 'variance' item, round(sum(q - s * s / n) / (any_value(n) - 1), 6) \"value\" FROM g, m UNION ALL SELECT 'scores', 5 * n FROM m UNION ALL SELECT 'correlated pairs', 0.0")
def _(spark, sf):
    values = normalised(quality_filtered(expression(spark, sf)))
    values = checkpointed(values)
    found = principal_components(values, values.select("cell_id").distinct(), k=5)
    scores = checkpointed(found.scores)
    a, b = scores.toDF("cell_id", "p", "x"), scores.toDF("cell_id", "q", "y")
    pairs = a.join(b, "cell_id").where("p < q").groupBy("p", "q").agg(F.corr("x", "y").alias("r")).where("abs(r) > 1e-4")
    out = pairs.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("correlated pairs").alias("item"), "value")
    out = out.unionByName(scores.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("scores").alias("item"), "value"))
    return out.unionByName(spark.createDataFrame([("variance", round(found.variance, 6))], "item string, value double"))


@query(
    "shared_neighbours",
    f"""WITH {K_SQL}, li AS (SELECT a, list(b) l FROM nn WHERE rn <= 10 GROUP BY a), pr AS (SELECT DISTINCT least(a, b) a, greatest(a, b) b FROM nn WHERE rn <= 10),
 sh AS (SELECT pr.a, pr.b, len(list_intersect(u.l, w.l)) shared, len(u.l) + len(w.l) total FROM pr JOIN li u ON u.a = pr.a JOIN li w ON w.a = pr.b) SELECT a, b, shared, round(shared / (total - shared)::double, 9) weight FROM sh WHERE shared >= 1""",
)
def _(spark, sf):
    return shared_neighbours(nearest(points(spark, sf), 10)).withColumn("weight", F.round("weight", 9))


@query("cell_communities")
def _(spark, sf):
    cells = points(spark, sf)
    return communities(shared_neighbours(nearest(cells, 10)), cells, resolution=0.4).members


@query(
    "gini_markers",
    f"""WITH {P_SQL}, {N_SQL}, cz AS (SELECT cell_type "cluster", count(*) n FROM p GROUP BY ALL), tt AS (SELECT count(*) al FROM p), cv AS (SELECT cell_type "cluster", gene, sum(v) s, count(*)::double d FROM nx JOIN p USING (cell_id) WHERE v > 0 GROUP BY ALL),
 gv AS (SELECT gene, sum(s) ts, sum(d) td FROM cv GROUP BY gene), mm AS (SELECT "cluster", gene, s / n mi, greatest(ts - s, 0) / (al - n) mo, d / n si, (td - d) / (al - n) so FROM cv JOIN gv USING (gene) JOIN cz USING ("cluster"), tt),
 sc AS (SELECT *, round(greatest(mi - mo, 0) / (mi + mo) * (greatest(si - so, 0) / (si + so)), 9) score FROM mm)
 SELECT "cluster", gene, round(mi, 7) mean_in, round(mo, 7) mean_out, round(si, 9) share_in, round(so, 9) share_out, round(score, 7) score, row_number() OVER (PARTITION BY "cluster" ORDER BY score DESC, gene) "rank" FROM sc""",
)
def _(spark, sf):
    found = gini_markers(normalised(quality_filtered(expression(spark, sf))), points(spark, sf).select("cell_id", F.col("cell_type").alias("cluster")))
    return found.withColumns({c: F.round(c, 7 if c[:5] in ("mean_", "score") else 9) for c in ("mean_in", "mean_out", "share_in", "share_out", "score")})


@query("bh_adjust", f"SELECT o_orderkey, round(p_adj, 12) p_adj FROM {bh('(SELECT o_orderkey, o_totalprice / 1000000.0 p FROM orders)', 'p', 'p_adj')}")
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000.0).alias("p"))
    return with_bh(o, "p", "p_adj").select("o_orderkey", F.round("p_adj", 12).alias("p_adj"))


@query("neighborhood_composition", f"WITH {K_SQL}, own AS (SELECT a, b FROM nn WHERE rn <= 9 UNION ALL SELECT cell_id, cell_id FROM p) SELECT a cell_id, cell_type, round(count(*) / 10.0::double, 9) fraction FROM own JOIN p ON p.cell_id = b GROUP BY ALL")
def _(spark, sf):
    return niche.neighborhood_composition(points(spark, sf), 10).withColumn("fraction", F.round("fraction", 9))


# closest centres of all starts by lists, and their means by unnested types, in a recursion of as many steps as the operator may take
SQUARES = "list_reduce(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda m, n: m + n)"
NICHES_SQL = f"""WITH RECURSIVE {K_SQL}, own AS (SELECT a, b FROM nn WHERE rn <= 9 UNION ALL SELECT cell_id, cell_id FROM p), co AS (SELECT a, cell_type, count(*) n FROM own JOIN p ON p.cell_id = b GROUP BY ALL), ty AS (SELECT DISTINCT cell_type t FROM p),
 mx AS (SELECT cell_id, list(cast(round(coalesce(n, 0) / 10.0::double * 1e9::double) AS bigint) ORDER BY t) u FROM (SELECT cell_id, t FROM p, ty) LEFT JOIN co ON a = cell_id AND cell_type = t GROUP BY cell_id),
 vs AS (SELECT u, list_transform(u, lambda v: v / 1e9::double) x, count(*) w FROM mx GROUP BY u),
 fs AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY md5('1:' || s || ':' || array_to_string(u, ','))) c FROM vs, (SELECT unnest(range(25)) s)),
 it AS (SELECT 0 i, s, list(x ORDER BY c) cs FROM fs WHERE c <= 3 GROUP BY s
  UNION ALL SELECT i + 1, s, list(coalesce(y, cs[c]) ORDER BY c) FROM (SELECT i, s, cs, unnest(range(1, len(cs) + 1)) c FROM it WHERE i < 50) LEFT JOIN
   (SELECT s, c, list(y ORDER BY t) y FROM (SELECT s, c, t, sum(u[t] * w)::double / (sum(w)::double * 1e9::double) y FROM (SELECT s, u, w, list_position(ds, list_min(ds)) c, unnest(range(1, len(u) + 1)) t FROM
     (SELECT s, u, w, list_transform(cs, lambda y: {SQUARES}) ds FROM it, vs WHERE i < 50)) GROUP BY ALL) GROUP BY ALL) USING (s, c) GROUP BY ALL),
 ct AS (SELECT s, cs, round(sum(w * list_min(list_transform(cs, lambda y: {SQUARES}))), 6) cost FROM it, vs WHERE i = 50 GROUP BY ALL), be AS (SELECT list_sort(cs) cs FROM ct ORDER BY cost, s LIMIT 1),
 ni AS (SELECT u, list_transform(cs, lambda y: {SQUARES}) ds FROM vs, be) SELECT cell_id, (list_position(ds, list_min(ds)) - 1)::int niche FROM mx JOIN ni USING (u)"""


@query("niche_kmeans", NICHES_SQL)
def _(spark, sf):
    types = [r[0] for r in points(spark, sf).select("cell_type").distinct().orderBy("cell_type").collect()]
    return niche.niches(niche.neighborhood_composition(points(spark, sf), 10), types)


@query("pseudo_samples", f"WITH {P_SQL}, b AS (SELECT quantile_cont(x, 1 / 3.0::double) q1, quantile_cont(x, 2 / 3.0::double) q2 FROM p), t AS (SELECT 's' || (1 + (x > q1)::int + (x > q2)::int) sample_id FROM p, b) SELECT sample_id, count(*) n FROM t GROUP BY sample_id")
def _(spark, sf):
    return niche.pseudo_samples(points(spark, sf), 3).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
