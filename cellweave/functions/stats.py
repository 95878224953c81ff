"""Statistical functions over columns: multiple-testing correction and the tails Spark SQL has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellweave.plans.lineage import checkpointed

#: floors for divisions: the distance from 1 to the next double, and its root
EPS = 2.220446049250313e-16
ROOT_EPS = 1.4901161193847656e-08


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|); exact in the far tail, where 2 * (1 - cdf) would be 0."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v and v is not None else None)


@F.pandas_udf(DoubleType())
def chi2_upper_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) of the chi-square distribution with a whole number of degrees of freedom."""

    def tail(value: float, k: int) -> float:
        half = value / 2
        if k % 2 == 0:
            term = total = math.exp(-half)
            for i in range(1, k // 2):
                term *= half / i
                total += term
            return min(total, 1.0)
        total = math.erfc(math.sqrt(half))
        term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5) if k > 1 else 0.0
        for i in range(1, (k - 1) // 2 + 1):
            total += term
            term *= half / (i + 0.5)
        return min(total, 1.0)

    return pd.Series([tail(v, int(k)) if v == v else None for v, k in zip(x, df)])


def _decade_lane(p: Column) -> Column:
    """A lane that doesn't decrease with p in [0, 1]: its decade and its first three digits there."""
    decade = F.floor(F.log10(F.greatest(p, F.lit(1e-300))))
    digits = F.floor(F.greatest(p, F.lit(1e-300)) / F.pow(F.lit(10.0), decade) * 100)
    return (decade * 1000 + F.least(F.greatest(digits, F.lit(0)), F.lit(999))).cast("int")


def with_bh(df: DataFrame, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with Benjamini-Hochberg adjusted p-values, within the groups of `by` or over all rows. Nulls stay null.

    A group is sorted in one task: groups are the tests of one motif. Over all rows, df is written to the checkpoint
    folder first and ranks are taken in lanes.
    """
    return _bh_in_lanes(df, p, out) if not by else _bh_in_groups(df, p, out, by)


def _bh_in_groups(df: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    down = Window.partitionBy(*by).orderBy(F.desc("__bh_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(Window.partitionBy(*by)) / F.col("__bh_rank"))
    stepped = df.withColumn("__bh_rank", F.row_number().over(ranked)).withColumn("__bh_step", step)
    return stepped.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__bh_step").over(down)))).drop("__bh_rank", "__bh_step")


def _bh_in_lanes(df: DataFrame, p: str, out: str) -> DataFrame:
    """Equal p-values have equal adjusted ones, so ranks are sums of counts of distinct values. Those are ranked and
    minimised within lanes of p, then with the counts of the lanes before and the minima of those behind."""
    df = checkpointed(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__bh_p")).agg(F.count(F.lit(1)).alias("__bh_n")).withColumn("__bh_lane", _decade_lane(F.col("__bh_p")))
    own, every = Window.partitionBy("__bh_lane"), Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("__bh_rank", F.sum("__bh_n").over(own.orderBy("__bh_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a row per lane, of which there are at most 900 a decade
    ahead = every.orderBy("__bh_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = counts.groupBy("__bh_lane").agg(F.sum("__bh_n").alias("__bh_own"))
    lanes = lanes.withColumns({"__bh_at": F.coalesce(F.sum("__bh_own").over(ahead), F.lit(0)), "__bh_m": F.sum("__bh_own").over(every)}).drop("__bh_own")
    stepped = ranked.join(lanes, "__bh_lane").withColumn("__bh_step", F.col("__bh_p") * F.col("__bh_m") / (F.col("__bh_at") + F.col("__bh_rank")))
    stepped = stepped.withColumn("__bh_low", F.min("__bh_step").over(own.orderBy(F.desc("__bh_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    behind = every.orderBy(F.desc("__bh_lane")).rowsBetween(Window.unboundedPreceding, -1)
    minima = stepped.groupBy("__bh_lane").agg(F.min("__bh_step").alias("__bh_least")).withColumn("__bh_later", F.min("__bh_least").over(behind)).drop("__bh_least")
    adjusted = stepped.join(minima, "__bh_lane").select("__bh_p", F.least(F.lit(1.0), "__bh_low", "__bh_later").alias(out))
    return df.drop(out).join(adjusted, F.col(p) == F.col("__bh_p"), "left").drop("__bh_p")


def floored(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(floor))
