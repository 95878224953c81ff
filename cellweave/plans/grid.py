"""Spatial joins as equi-joins over a grid of buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.lineage import cached, checkpointed


def bucketed(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})


def _spread(points: DataFrame, reach: int) -> DataFrame:
    """points once for each bucket within reach."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    return points.withColumn("__s", F.explode(steps)).withColumns({"gx": F.col("gx") + F.col("__s.i"), "gy": F.col("gy") + F.col("__s.j")}).drop("__s")


def _distance2(a: str, b: str):
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return dx * dx + dy * dy


def radius_pairs(points: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, a, b, d2) with a < b and distance <= radius. points(cell_id, x, y, *keys); pairs share the keys.

    Buckets have the radius as their side, so a pair is at most one bucket apart; every pair is found once.
    """
    base = bucketed(points.select("cell_id", "x", "y", *keys), radius)
    on = [*keys, "gx", "gy"]
    joined = _spread(base, 1).alias("l").join(base.alias("r"), on)
    d2 = _distance2("l", "r")
    return joined.where(F.col("l.cell_id") < F.col("r.cell_id")).where(d2 <= radius * radius).select(*keys, F.col("l.cell_id").alias("a"), F.col("r.cell_id").alias("b"), d2.alias("d2"))


def nearest(points: DataFrame, k: int, keys: tuple[str, ...] = (), crowd: int = 4) -> DataFrame:
    """(*keys, a, b, d2, rn): the k nearest other points b of each a; ties by id. Exact.

    The first buckets are so fine that the densest has some `crowd * (k + 1)` points, however the points cluster. A
    point is settled once its k-th distance lies within a bucket's side of it; the rest searches buckets of twice the
    side, so points in thin regions take more rounds and no round searches more than nine buckets a point.
    """
    groups = F.count_distinct(*keys) if keys else F.lit(1)
    stats = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)], groups.alias("groups")).first()
    n = stats["n"] / max(stats["groups"], 1)
    width, height = ((stats[f"max_{c}"] or 0.0) - (stats[f"min_{c}"] or 0.0) for c in "xy")
    extent = max(width, height)
    least = extent * 1e-6
    size = max(math.sqrt(max(width, extent * 1e-3) * max(height, extent * 1e-3) * (k + 1) / max(n, 1.0)), least) or 1.0
    plain = points.select("cell_id", "x", "y", *keys)
    on = [*keys, "gx", "gy"]
    while size > least:
        densest = bucketed(plain, size).groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        if densest <= crowd * (k + 1):
            break
        size = max(size / 4 if densest > 8 * crowd * (k + 1) else size / 2, least)
    order = Window.partitionBy(*keys, "a").orderBy("d2", "b")
    todo, found = plain, None
    while True:
        d2 = _distance2("l", "r")
        pairs = _spread(bucketed(todo, size), 1).alias("l").join(bucketed(plain, size).alias("r"), on).where(F.col("l.cell_id") != F.col("r.cell_id"))
        top = pairs.select(*keys, F.col("l.cell_id").alias("a"), F.col("r.cell_id").alias("b"), d2.alias("d2")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
        last = size > 2 * extent
        if last:
            return top if found is None else found.unionByName(top)
        top = cached(top)
        settled = top.where((F.col("rn") == k) & (F.col("d2") <= size**2)).select(*keys, "a")
        done = top.join(settled, [*keys, "a"], "left_semi")
        found = done if found is None else found.unionByName(done)
        # the rest is cut off from its lineage: a plan doesn't grow with the number of rounds
        todo = checkpointed(todo.join(settled.withColumnRenamed("a", "cell_id"), [*keys, "cell_id"], "left_anti"))
        if todo.isEmpty():
            return found
        size *= 2
