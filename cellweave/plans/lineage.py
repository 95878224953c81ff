"""Folders that driver and executors share, and cutting the lineage of frames that a loop builds on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections import deque

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session may go without: it gets a temporary one, which goes when
    Python ends; on a cluster a folder that the executors don't share would lose what they write."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"


#: frames that were cached last; older ones are let go, and would be computed again
CACHED: deque[DataFrame] = deque()
MOST_CACHED = 8


def cached(df: DataFrame) -> DataFrame:
    """df, cached until MOST_CACHED others have been: a long session doesn't fill the executors."""
    CACHED.append(df.persist())
    while len(CACHED) > MOST_CACHED:
        release(CACHED.popleft())
    return df


def release(*frames: DataFrame) -> None:
    """Lets go of some cached frames, or of all that this library has cached."""
    for df in frames or [CACHED.popleft() for _ in range(len(CACHED))]:
        if df.sparkSession.sparkContext._jsc is not None:  # the session may have ended
            df.unpersist()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, which all executors share, and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table below the shared folder. Unlike a checkpoint it forgets what the plan knew of its columns, which in a loop of
    joins grows with every turn."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table; what was made of it must have been written too."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
