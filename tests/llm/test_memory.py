"""The pipeline's first stage where eight tasks share the smallest heap that Spark takes, and the Python worker of its last."""

import os
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellweave.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
from pyspark.sql import SparkSession
from cellweave.llm import common, quality_rules
at = sys.argv[1]
conf = {"spark.driver.memory": "480m", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{at}/shared", "spark.local.dir": f"{at}/local"}
spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
kept = quality_rules.filter_documents(common.table(spark, at, "documents"), common.table(spark, at, "labels"))
print("KEPT", kept.select("doc_id").distinct().count())
"""


def test_rules_in_a_small_heap(tmp_path):
    """4096 texts of 12 kB, which Spark decodes at once by default, are 49 MB for each of eight tasks."""
    words = " ".join(f"word{i}" for i in range(60))
    (tmp_path / "documents.parquet").mkdir()
    for k in range(8):
        ids = range(k * 4096, (k + 1) * 4096)
        own = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [words + " " * 11_600 + str(i) for i in ids]})
        pq.write_table(own, tmp_path / f"documents.parquet/{k}.parquet", compression="zstd", use_dictionary=False)
    pq.write_table(pa.table({"doc_id": pa.array([1], pa.int64()), "quality": pa.array([1], pa.int32())}), tmp_path / "labels.parquet")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=env, capture_output=True, text=True, timeout=600)
    assert f"KEPT {8 * 4096}" in done.stdout, done.stderr[-2000:]


def test_the_sessions_batches_come_back(spark):
    before = spark.conf.get(common.SCAN_KEY)
    with common.small_scans(spark):
        assert int(spark.conf.get(common.SCAN_KEY)) <= 256
    assert spark.conf.get(common.SCAN_KEY) == before


@pytest.mark.parametrize("own, inside", [("10000", 1000), ("50", 50), ("0", 1000)])
def test_workers_get_small_batches(spark, own, inside):
    before = spark.conf.get(common.ARROW_KEY)
    spark.conf.set(common.ARROW_KEY, own)
    try:
        with common.small_scans(spark):
            assert int(spark.conf.get(common.ARROW_KEY)) == inside
        assert spark.conf.get(common.ARROW_KEY) == own
    finally:
        spark.conf.set(common.ARROW_KEY, before)


PACK = """
import os, re, sys
import public_tokenizers
from pyspark.sql import SparkSession
from cellweave.llm import common, packing
at = sys.argv[1]
conf = {"spark.driver.memory": "1g", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{at}/shared", "spark.local.dir": f"{at}/local"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
pieces = packing.packed(common.table(spark, at, "documents"), public_tokenizers.path("word_bpe_49k.json"))

def parents(pid):
    while pid > 1:
        yield pid
        try:
            pid = int(re.search(r"PPid:\\s+(\\d+)", open(f"/proc/{pid}/status").read())[1])
        except OSError:
            return

def peak(pid):
    try:
        ours = b"pyspark.daemon" in open(f"/proc/{pid}/cmdline", "rb").read() and os.getpid() in parents(pid)
        return int(re.search(r"VmHWM:\\s+(\\d+)", open(f"/proc/{pid}/status").read())[1]) >> 10 if ours else 0
    except (OSError, TypeError):
        return 0

print("PEAK", max(peak(int(p)) for p in os.listdir("/proc") if p.isdigit()))
print("PACKED", pieces.select("doc_id").distinct().count())
"""


def test_a_packing_worker_stays_small(tmp_path):
    """10000 texts of 8 kB, which Spark hands to a worker at once by default, are 80 MB."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choices(words, k=100)) for _ in range(500)]
    own = pa.table({"doc_id": pa.array(range(10_000), pa.int64()), "text": ["\n".join(rng.choices(lines, k=12)) for _ in range(10_000)]})
    pq.write_table(own, tmp_path / "documents.parquet", compression="zstd", use_dictionary=False)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", PACK, str(tmp_path)], env=env, capture_output=True, text=True, timeout=600)
    assert "PACKED 10000" in done.stdout, done.stderr[-2000:]
    assert 0 < int(done.stdout.split("PEAK ")[1].split()[0]) < 300, done.stdout
