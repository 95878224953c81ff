"""Order over large groups without a task that holds one: row numbers in two levels, within lanes and by the counts of the
lanes before; order statistics by narrowing brackets; the smallest rows by a cut through their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.lineage import checkpointed


def ranked_in_lanes(df: DataFrame, by: list[str], lane: Column, order: list[Column | str], name: str = "r") -> DataFrame:
    """df with a number from 1 in the order of (lane, order) within the groups of `by`; no task holds a whole group.

    lane must not decrease along the wanted order.
    """
    laned = df.withColumn("__lane", lane)
    counts = laned.groupBy(*by, "__lane").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    own = F.row_number().over(Window.partitionBy(*by, "__lane").orderBy(*order))
    return laned.withColumn(name, own).join(offsets, [*by, "__lane"]).withColumn(name, F.col(name) + F.col("__at")).drop("__lane", "__at")


def hex_lane(column: Column, lanes: int) -> Column:
    """The lane of a hexadecimal digest: equal ranges of its first eight digits."""
    return F.floor(F.conv(F.substring(column, 1, 8), 16, 10).cast("double") * lanes / F.lit(float(1 << 32))).cast("int")


def ranked_in_ranges(df: DataFrame, by: list[str], order: list[str], name: str = "r", lanes: int | None = None) -> DataFrame:
    """df with a number from 1 in the order of `order` within the groups of `by`, ranges of (by, order) being the lanes.

    The ranges are written down: a range partitioning that is computed again may cut elsewhere.
    """
    lanes = lanes or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(lanes, *by, *order).withColumn("__range", F.spark_partition_id()))
    return ranked_in_lanes(ranged, by, F.col("__range"), order, name).drop("__range")


#: values of a bracket that are counted one by one on the driver, and the parts that a larger bracket is cut into
FEW, PARTS = 10_000, 256


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks, from 0, among df's non-null values of a numeric column. Exact.

    A bracket of values is cut at some of its quantiles, as a mergeable sketch estimates them, the rows of each part are
    counted exactly, and the part or the cut that holds the rank is the next bracket: whatever the values, each pass
    leaves a small share of their number, and a value however often repeated ends the search. What has at most FEW distinct
    values is counted value by value. All that reaches the driver are counts.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    found: dict[int, float] = {}
    # (low, high, rows at or below low, wanted ranks): values between low and high, both excluded
    todo: list[tuple[float | None, float | None, int, list[int]]] = [(None, None, 0, sorted(set(ranks)))]
    while todo:
        low, high, below, wanted = todo.pop()
        if not wanted:
            continue
        inside = values if low is None else values.where(F.col("v") > F.lit(low))
        inside = inside if high is None else inside.where(F.col("v") < F.lit(high))
        few = inside.groupBy("v").count().limit(FEW + 1).collect()
        if len(few) <= FEW:
            counts = sorted((r["v"], r["count"]) for r in few)
            at, rest = below, list(wanted)
            for v, n in counts:
                while rest and rest[0] < at + n:
                    found[rest.pop(0)] = v
                at += n
            continue
        shares = [(i + 1) / PARTS for i in range(PARTS - 1)]
        cuts = sorted(set(inside.agg(F.percentile_approx("v", shares, 100 * PARTS).alias("q")).first()["q"]))
        literal = F.array(*[F.lit(c) for c in cuts])
        part = F.size(F.filter(literal, lambda c: c < F.col("v")))
        rows = inside.groupBy(part.alias("part"), F.array_contains(literal, F.col("v")).alias("cut")).count().collect()
        counts = {(r["part"], r["cut"]): r["count"] for r in rows}
        at, rest = below, list(wanted)
        for i in range(len(cuts) + 1):
            # values between two cuts, then those that equal the upper one
            n = counts.get((i, False), 0)
            own = [r for r in rest if r < at + n]
            todo.append((cuts[i - 1] if i else low, cuts[i] if i < len(cuts) else high, at, own))
            rest, at = rest[len(own) :], at + n
            n = counts.get((i, True), 0)
            while rest and rest[0] < at + n:
                found[rest.pop(0)] = cuts[i]
            at += n
    return found


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation; None where there are no values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    spots = [(n - 1) * p for p in probabilities]
    values = order_statistics(df, column, [r for s in spots for r in (int(s), min(int(s) + 1, n - 1))])
    return [values[int(s)] + (values[min(int(s) + 1, n - 1)] - values[int(s)]) * (s - int(s)) for s in spots]


def smallest(df: DataFrame, digest: Column, n: int, key: str) -> DataFrame:
    """The n rows of df that come first by (digest, key), a hexadecimal digest: found by counting prefixes of digests, so what
    is left to do for the rows is a filter. df is read once a prefix of three digits, twice in all as a rule."""
    marked = df.withColumn("__digest", digest)
    prefix, before = "", 0
    while True:
        inside = marked.where(F.col("__digest").startswith(prefix))
        counts = inside.groupBy(F.substring("__digest", len(prefix) + 1, 3).alias("p")).count().orderBy("p").collect()  # 4096 rows at most
        for row in counts:
            if before + row["count"] >= n:
                break
            before += row["count"]
        else:
            return df
        prefix += row["p"]
        if row["count"] <= FEW or len(prefix) >= 32:
            last = marked.where(F.col("__digest").startswith(prefix)).select("__digest", key).orderBy("__digest", key).limit(n - before).tail(1)[0]
            cut = (F.col("__digest") < last["__digest"]) | ((F.col("__digest") == last["__digest"]) & (F.col(key) <= last[key]))
            return marked.where(cut).drop("__digest")
