"""The catalog of three-node motifs of a live stream of edges, kept up to date batch by batch.

A batch changes only the motifs that hold one of its new edges. What a batch adds to the counts follows from the color
histograms of the nodes that its edges touch, before and after, and from the triangles that its edges close: each new
edge meets the neighbours of its end of fewer neighbours, and a triangle counts at the smallest of its new edges.
Open motifs are two-paths less the paths that triangles close, so all of these are sums, and the catalog is their sum
over the batches.

A batch's new edges and its changes are written under its number and follow from the batches before it, so a batch
that is replayed after a failure replaces itself. Batches come in the order of their numbers, as a streaming query's do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators import motifs as M
from cellweave.plans.lineage import checkpointed

EDGES = "from_id long, to_id long"
CHANGES = "topology string, sorted array<string>, n long"


def _pairs(h: Column, g: Column, same: Column) -> Column:
    """Two-paths between h and g neighbours of two colors, or of one."""
    return F.when(same, F.floor(h * (h - 1) / 2)).otherwise(h * g).cast("long")


class LiveCatalog:
    """labels: (int_id, cell_type) of all nodes that the stream may hold; others have the type NA."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame):
        self.spark, self.path = spark, path.rstrip("/")
        self.labels = labels.select(F.col("int_id").cast("long").alias("id"), F.coalesce(F.col("cell_type").cast("string"), F.lit("NA")).alias("color"))

    def _read(self, what: str, schema: str, before: int | None = None) -> DataFrame:
        """A table of all batches, or of those before a number."""
        base = f"{self.path}/{what}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, batch long").parquet(base)
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")

    def edges(self, before: int | None = None) -> DataFrame:
        return self._read("edges", EDGES, before)

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in the edges (from_id, to_id) of a batch; loops, edges of before and repeated ones change nothing."""
        known = self.edges(number)
        pairs = batch.where("from_id <> to_id").select(F.least("from_id", "to_id").cast("long").alias("from_id"), F.greatest("from_id", "to_id").cast("long").alias("to_id")).distinct()
        pairs.join(known, ["from_id", "to_id"], "left_anti").write.mode("overwrite").parquet(f"{self.path}/edges/batch={number}")
        new = self.spark.read.schema(EDGES).parquet(f"{self.path}/edges/batch={number}")
        self._changes(known, new).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")

    def _changes(self, known: DataFrame, new: DataFrame) -> DataFrame:
        marked = known.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        both = marked.select(F.col("from_id").alias("b"), F.col("to_id").alias("x"), "new").unionByName(marked.select(F.col("to_id").alias("b"), F.col("from_id").alias("x"), "new"))
        touched = new.select(F.col("from_id").alias("b")).unionByName(new.select(F.col("to_id").alias("b"))).distinct()
        color = lambda at, name: self.labels.select(F.col("id").alias(at), F.col("color").alias(name))
        filled = lambda c: F.coalesce(c, F.lit("NA")).alias(c)
        near = both.join(touched, "b", "left_semi").join(color("b", "bc"), "b", "left").join(color("x", "xc"), "x", "left")
        near = checkpointed(near.select("b", "x", "new", filled("bc"), filled("xc")))

        bins = near.groupBy("b", "bc", F.col("xc").alias("k")).agg(F.count(F.lit(1)).alias("h1"), (F.count(F.lit(1)) - F.sum("new")).alias("h0"))
        nodes = bins.groupBy("b", "bc").agg(F.sort_array(F.collect_list(F.struct("k", "h0", "h1"))).alias("bins"))
        left = nodes.select("bc", "bins", F.posexplode("bins").alias("i", "p"))
        rows = left.select("bc", "p", F.explode(F.expr("slice(bins, i + 1, size(bins))")).alias("q"))
        same = F.col("p.k") == F.col("q.k")
        gained = _pairs(F.col("p.h1"), F.col("q.h1"), same) - _pairs(F.col("p.h0"), F.col("q.h0"), same)
        paths = rows.groupBy(F.array("p.k", "q.k", "bc").alias("sorted")).agg(F.sum(gained).alias("n"))

        degree = near.groupBy("b").agg(F.count(F.lit(1)).alias("d"))
        ends = new.join(degree.toDF("from_id", "df"), "from_id").join(degree.toDF("to_id", "dt"), "to_id")
        fewer = F.struct("df", "from_id") < F.struct("dt", "to_id")
        ends = ends.select(F.when(fewer, F.col("from_id")).otherwise(F.col("to_id")).alias("b"), F.when(fewer, F.col("to_id")).otherwise(F.col("from_id")).alias("v"))
        step = ends.join(near.select("b", "x", F.col("new").alias("bn"), "bc", "xc"), "b").where("x <> v")
        closing = near.select(F.col("b").alias("v"), "x", F.col("new").alias("vn"), F.col("bc").alias("vc"))
        closed = step.join(closing, ["v", "x"])
        edge = lambda a, b: F.struct(F.least(a, b), F.greatest(a, b))
        first = ((F.col("bn") == 0) | (edge("b", "v") < edge("b", "x"))) & ((F.col("vn") == 0) | (edge("b", "v") < edge("v", "x")))
        triangles = closed.where(first).groupBy(F.array_sort(F.array("bc", "vc", "xc")).alias("sorted")).agg(F.count(F.lit(1)).alias("n"))

        at = F.explode(F.array(*[F.array(F.element_at("sorted", i), F.element_at("sorted", j), F.element_at("sorted", c)) for c, i, j in ((1, 2, 3), (2, 1, 3), (3, 1, 2))])).alias("sorted")
        opened = paths.unionByName(triangles.select(at, (-F.col("n")).alias("n"))).groupBy("sorted").agg(F.sum("n").alias("n"))
        return opened.select(F.lit("wedge").alias("topology"), "sorted", "n").unionByName(triangles.select(F.lit("triangle").alias("topology"), "sorted", "n")).where("n <> 0")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def catalog(self) -> DataFrame:
        """The catalog of all edges taken in so far."""
        motif, tuple_ = M.motif_label(3)
        counts = self._read("changes", CHANGES).groupBy("topology", "sorted").agg(F.sum("n").alias("count")).where("count > 0")
        return counts.select(motif.alias("motif_id"), F.lit(3).alias("size"), F.col("topology").alias("canonical_iso_class"), tuple_.alias("color_tuple"), "count")
