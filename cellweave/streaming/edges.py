"""A live stream of edges gathered into a graph: micro-batches append deduplicated edges to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class EdgeAccumulator:
    """Gathers edges(from_id, to_id) of a stream below `path`; `edges()` is the deduplicated state so far.

    A batch is written under its number, so a batch that is replayed after a failure replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch: DataFrame, number: int) -> None:
        pairs = batch.where("from_id <> to_id").select(F.least("from_id", "to_id").cast("long").alias("from_id"), F.greatest("from_id", "to_id").cast("long").alias("to_id")).distinct()
        pairs.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def edges(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").select("from_id", "to_id").distinct()
