"""Exact medians of groups of any size: value ranges are counted, and only the range that holds the middle is counted anew.

No task sees more of a group than `limit` of its rows: a round sends counts per range, combined map-side, and a group is read out only once
its middle lies in a range that small, or in a range of one value.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS, LIMIT = 1024, 4096


def _find(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows within the range of their group's state; null keys are a group of their own."""
    s = state.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "which", "rank", "lo", "hi", "n")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(s, same).where(F.col("_v").between(F.col("lo"), F.col("hi"))).drop(*(f"_k_{k}" for k in keys))


def exact_median(df: DataFrame, value: Column | str, keys: Sequence[str] = (), name: str = "median", bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """Keys and the median of the non-null values of each group; of an even number the mean of the two in the middle.

    Two ranks are sought for each group. A round deals the values in a rank's range into `bins` of equal width and goes on with the least and
    largest value of the bin that holds the rank. Groups without values are not in the result.
    """
    keys = list(keys) or ["_all"]
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*(F.lit(0).alias(k) if k == "_all" else F.col(k) for k in keys), v.cast("double").alias("_v")).where("_v IS NOT NULL")
    first = rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    ranks = F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank")))
    state = cut(first.withColumn("r", F.explode(ranks)).select(*keys, "r.which", "r.rank", "lo", "hi", "n"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > limit)
    group = [*keys, "which"]
    while not state.where(wide).isEmpty():
        at = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = _find(rows, state.where(wide), keys).groupBy(*group, "rank", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))        # as many rows as there are bins
        held = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = cut(held.select(*group, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi", "n").unionByName(state.where(~wide)))
    one = state.where("lo = hi").select(*group, F.col("lo").alias("x"))
    few = _find(rows, state.where("lo < hi"), keys).groupBy(*group, "rank").agg(F.sort_array(F.collect_list("_v")).alias("a")).select(*group, F.get("a", F.col("rank").cast("int")).alias("x"))
    out = one.unionByName(few).groupBy(*keys).agg((F.sum("x") / 2).alias(name))
    return out.drop("_all")
