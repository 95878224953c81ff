"""Sharding by balanced label propagation.

Documents that share a link key belong together. Linked documents start in the order of their keys, so that most
groups lie in one shard and a large one in a run of shards; then, for a number of rounds, a group's counts per
shard (one pre-aggregated row per group and shard, never pairs of documents) tell every member how many
neighbours each shard holds. A document asks for the shard that holds most of them, of those that have room. A
shard takes requests, those of the largest gain in each lane first, up to its free capacity: requests are numbered
within (shard, lane) and offset by lane, so no task sees all requests for one shard, and a shard never outgrows
its quota. The assignment is written to the shared folder after each round.

Law: rows. With n documents, shard s holds as many as there are whole numbers from n * s / shards to below
n * (s + 1) / shards: counts are at most one apart. Linked documents never take more than that; documents without links fill what is left, numbered by a
two-level count (per lane, then offsets over at most `shards * lanes` rows), as are the slots within shards.

Defined results: null texts count as empty (size 8, crc 0); rows with a null or repeated id
are rows of their own; an empty table gives an empty result; shards beyond the number of documents stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, staged, table


@dataclass(frozen=True)
class Params:
    shards: int = 24
    rounds: int = 4
    #: share of a shard that linked documents fill at the start, where shards are large enough to leave room
    fill: float = 0.9
    rows_per_lane: int = 20_000


HOT = 1000
SUB = 64


def lanes_for(spark: SparkSession, n: int, params: Params) -> int:
    """As many lanes as shuffle partitions, or more where a lane would exceed rows_per_lane, up to four times that."""
    return max(1, min(4 * partitions(spark), max(partitions(spark), -(-n // params.rows_per_lane))))


def numbered(df: DataFrame, by: list[str], lane: Column, order: list, name: str) -> DataFrame:
    """df with a gapless number from 0 within the groups of `by`, without a task that holds a whole group."""
    laned = df.withColumn("__lane", lane)
    counts = laned.groupBy(*by, "__lane").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn("__at", F.sum("__n").over(over.orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__lane").alias("__k_lane"), F.coalesce("__at", F.lit(0)).alias("__at"))
    same = F.col("__lane") == F.col("__k_lane")
    for c in by:
        same = same & (F.col(c) == F.col(f"__k_{c}"))
    own = F.row_number().over(Window.partitionBy(*by, "__lane").orderBy(*order)) - 1
    # offsets has lanes * groups rows: a bound that lanes_for and the number of shards give
    return (
        laned.withColumn("__own", own)
        .join(F.broadcast(offsets), same)
        .withColumn(name, (F.col("__at") + F.col("__own")).cast("long"))
        .drop("__lane", "__own", "__at", "__k_lane", *[f"__k_{c}" for c in by])
    )


def quota(shard: Column, n: int, shards: int) -> Column:
    """How many of n documents shard holds."""
    return F.ceil((shard + 1) * F.lit(n) / shards) - F.ceil(shard * F.lit(n) / shards)


def propagated(linked: DataFrame, n: int, params: Params) -> DataFrame:
    """linked(row, grp, m) -> (row, grp, shard): rows of a group gather in few shards, within the shards' quotas.

    m is the group's size. Each round moves single rows to where more of their group is.
    """
    spark, shards = linked.sparkSession, params.shards
    lanes = lanes_for(spark, n, params)
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")
    # groups in the order of their hash; a group too large for a lane has SUB lanes of its own after its lane
    large = F.col("m") > F.greatest(F.lit(1), F.lit(params.rows_per_lane // 8))
    by_group = F.pmod(F.xxhash64("grp"), F.lit(lanes)) * SUB + F.when(large, 1 + F.pmod(F.xxhash64("row"), F.lit(SUB - 1))).otherwise(0)
    start = numbered(linked, [], by_group.cast("long"), ["grp", "row"], "i")
    many = linked.count()
    fill = params.fill if n * (1 - params.fill) >= 2 * shards and many <= n * params.fill else 1.0
    first = F.least(F.floor(F.col("i") * shards / F.lit(n * fill)), F.lit(shards - 1))
    state = staged(start.select("row", "grp", first.cast("int").alias("shard")), "labels")
    for k in range(params.rounds):
        held = state.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("c"))
        load = state.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
        free = spark.range(shards).select(F.col("id").cast("int").alias("goal")).join(load, F.col("goal") == F.col("shard"), "left")
        free = free.select("goal", (quota(F.col("goal"), n, shards) - F.coalesce("load", F.lit(0))).cast("long").alias("room")).where("room > 0")
        # the goal of a group: of the shards with room the one that holds most of it; ties go by a draw from the group
        draw = F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 20))
        reachable = held.join(F.broadcast(free.select("goal")), F.col("shard") == F.col("goal"), "left_semi")
        goal = reachable.groupBy("grp").agg(F.max(F.struct("c", draw.alias("draw"), "shard")).alias("g")).select("grp", F.col("g.shard").alias("goal"), F.col("g.c").alias("goal_c"))
        own = held.join(goal, "grp").where("shard <> goal").select("grp", "shard", "goal", (F.col("goal_c") - F.col("c") + 1).alias("gain")).where("gain > 0")
        asks = state.join(own, ["grp", "shard"])
        # what leaves a shard makes room in the next round, so a shard never exceeds its quota
        ranked = numbered(asks.select("row", "grp", "shard", "goal", "gain"), ["goal"], lane, [F.desc("gain"), "row"], "rank")
        moves = ranked.join(F.broadcast(free), "goal").where("rank < room").select(F.col("row").alias("moved"), F.col("goal"))
        after = state.join(moves, F.col("row") == F.col("moved"), "left").select("row", "grp", F.coalesce("goal", "shard").alias("shard"))
        state = staged(after, f"labels{k}")
    return state


def assigned(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs(row, grp) -> (row, shard, slot). row: unique, not null; grp: link key, or null for none."""
    spark, shards = docs.sparkSession, params.shards
    n = docs.count()
    lanes = lanes_for(spark, n, params)
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")
    sizes = docs.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("grp").alias("g"), "m")
    sizes = staged(sizes, "sizes")
    # groups of more than a HOT-th of all rows number less than HOT: their rows find them without a shuffle
    hot = F.broadcast(sizes.where(F.col("m") * HOT > n))
    rest = docs.join(hot.select("g"), F.col("grp") == F.col("g"), "left_anti").join(sizes.where(F.col("m") * HOT <= n), F.col("grp") == F.col("g"), "left")
    marked = staged(docs.join(hot, F.col("grp") == F.col("g")).select("row", "g", "m").unionByName(rest.select("row", "g", "m")), "marked")
    linked = propagated(marked.where("g IS NOT NULL").select("row", F.col("g").alias("grp"), "m"), n, params).select("row", "shard")
    load = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    room = spark.range(shards).select(F.col("id").cast("int").alias("s")).join(load, F.col("s") == F.col("shard"), "left")
    room = room.select("s", (quota(F.col("s"), n, shards) - F.coalesce("load", F.lit(0))).cast("long").alias("room"))
    # one number per shard reaches the driver; a rest row is placed by counting the ends at or below its number
    ends, at = [], 0
    for r in sorted(room.collect(), key=lambda r: r.s):
        ends.append(at := at + r.room)
    single = numbered(marked.where("g IS NULL").select("row"), [], lane, ["row"], "i")
    rest = single.select("row", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("i"))).cast("int").alias("shard"))
    both = staged(linked.unionByName(rest), "assigned")
    return numbered(both, ["shard"], lane, ["row"], "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked by equal texts, in 24 shards of equal row counts."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    facts = raw.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.md5(body).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = staged(facts, "facts")
    out = facts.select("doc_id", "size", "text_crc32", F.col("row").alias("r")).join(assigned(facts.select("row", "grp")), F.col("r") == F.col("row"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
