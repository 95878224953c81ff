"""What the operators of this subpackage share: tables, the shared folder, small column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.lineage import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of a row group where texts are written beside other memory-hungry work: a task holds a group until it is full
ROW_GROUP = 4 << 20
#: rows that a scan of texts decodes at once where little heap is left for it
SCAN_ROWS, SCAN_KEY = 256, "spark.sql.parquet.columnarReaderBatchSize"
#: rows of texts that go to a Python worker at once: the executor and its worker hold a batch each
ARROW_ROWS, ARROW_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends here, lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


@contextmanager
def small_scans(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read in batches of SCAN_ROWS rows and goes to Python in batches of ARROW_ROWS: by Spark's
    default a task decodes 4096 texts before it takes the first, and hands 10000 to its worker at once; where many tasks
    share a heap, or an executor's memory with their workers, that is most of it. The session's own settings come back."""
    before = {k: spark.conf.get(k) for k in (SCAN_KEY, ARROW_KEY)}
    for key, most in ((SCAN_KEY, SCAN_ROWS), (ARROW_KEY, ARROW_ROWS)):
        # no limit at all is 0 or less
        spark.conf.set(key, min(most, int(before[key])) if int(before[key]) > 0 else most)
    try:
        yield
    finally:
        for key, own in before.items():
            spark.conf.set(key, own)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged frames. What was made of them must have been staged itself."""
    for df in frames:
        delete(df.sparkSession, df.staged_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def guarded(docs: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """(docs whose columns don't begin with prefix, in whatever case; their new names and the old ones)."""
    names, hidden = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower().startswith(prefix):
            new = f"user_{c}"
            while new.lower() in names:
                new = f"user_{new}"
            names.add(new.lower())
            hidden[new] = c
    return docs.withColumnsRenamed({old: new for new, old in hidden.items()}), hidden


def chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts) of runs of rows with some `size` bytes; only one run at a time is held as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        stop = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1, n)
        yield start, stop, texts.slice(start, stop - start).to_pylist()
        start = stop


@cache
def _libc():
    return ctypes.CDLL(None)


def free_memory() -> None:
    """Gives unused memory back to the system at the end of a task: Spark keeps its Python workers, and they count against
    the executor while others run."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
