"""Bet-set statistics, bootstrap intervals, calibration and model score tables."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import score as S
from .draws import replicate_sums

# Cumulative Poisson(1) probabilities, P(N <= 0) .. P(N <= 12); beyond lies less than one draw of 32 bits.
POISSON1_CDF = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(13))


def unit_pnl() -> Column:
    """Profit of a unit stake."""
    return F.when(F.col("won"), F.col("odds") - 1.0).otherwise(-1.0)


def roi_stats(df: DataFrame, keys: Sequence[str] = (), clv: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(unit_pnl()).alias("roi"),
            F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("odds").alias("mean_odds")]
    if clv:
        aggs.append(F.avg("clv").alias("mean_clv"))
    return df.groupBy(*keys).agg(*aggs)


def bet_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of a staked bet set: stake, profit, ROI, hit rate, odds, CLV and its positive share."""
    pnl = F.when(F.col("won"), F.col("stake") * (F.col("odds") - 1)).otherwise(-F.col("stake"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("stake").alias("total_stake"), F.sum(pnl).alias("profit"),
        (F.sum(pnl) / F.sum("stake")).alias("roi"), F.avg(F.col("won").cast("double")).alias("hit_rate"),
        F.avg("odds").alias("mean_odds"), F.avg("clv").alias("mean_clv"),
        F.avg((F.col("clv") > 0).cast("double")).alias("clv_positive"))


def bootstrap_roi(df: DataFrame, keys: Sequence[str], row_id: Column, replicates: int = 1000,
                  stake: Column | None = None, pnl: Column | None = None, block: Column | None = None) -> DataFrame:
    """Percentile interval of ROI and share of replicates at or below zero.

    Poisson bootstrap: every row (or block) draws its own Poisson(1) count per replicate from an
    md5 digest, four replicates of 32 bits per digest, so tasks need no shared random state and re-runs after
    a lost executor repeat the same draws. Digests and draws are computed for many rows at once and replicate sums in each task: what is shuffled
    is tasks x keys x replicates, never rows x replicates. With `block`, rows are first summed per
    block and blocks are resampled whole.
    """
    stake = F.lit(1.0) if stake is None else stake
    pnl = unit_pnl() if pnl is None else pnl
    if block is None:
        base = df.select(*keys, row_id.cast("string").alias("_id"), stake.alias("_s"), pnl.alias("_g"))
    else:
        base = (df.groupBy(*keys, block.alias("_b")).agg(F.sum(stake).alias("_s"), F.sum(pnl).alias("_g"))
                .select(*keys, F.col("_b").cast("string").alias("_id"), "_s", "_g"))
    # few small rows become many draws: deal them out, or adaptive execution puts all into one task
    base = base.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id")
    base = base.select(*keys, "_id", F.col("_s").cast("double").alias("_s"), F.col("_g").cast("double").alias("_g"))
    sums = StructType([*[base.schema[k] for k in keys], StructField("_rep", IntegerType()), StructField("_g", DoubleType()), StructField("_s", DoubleType())])
    out, names = to_arrow_schema(sums), list(keys)
    drawn = base.mapInArrow(lambda batches: replicate_sums(batches, names, POISSON1_CDF, replicates, out), sums)
    reps = drawn.groupBy(*keys, "_rep").agg((F.sum("_g") / F.sum("_s")).alias("_roi"))
    return reps.groupBy(*keys).agg(F.percentile("_roi", F.lit(0.025)).alias("roi_low"),
                                   F.percentile("_roi", F.lit(0.975)).alias("roi_high"),
                                   F.avg((F.col("_roi") <= 0).cast("double")).alias("p_roi_le0"))


def score_table(df: DataFrame, models: dict[str, list[str]], y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Mean RPS, log-loss, Brier and accuracy per model over the rows every model has scored."""
    every = F.lit(True)
    for cols in models.values():
        for c in cols:
            every = every & F.col(c).isNotNull()
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(cols)])
                     for m, cols in models.items()])
    k = len(next(iter(models.values())))
    p = [f"p{i}" for i in range(k)]
    long = df.where(every).select(*keys, y, F.explode(rows).alias("m")).select(*keys, y, "m.*")
    return long.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.rps(p, y)).alias("rps"), F.avg(S.log_loss(p, y)).alias("log_loss"),
        F.avg(S.brier(p, y)).alias("brier"), F.avg(S.hit(p, y)).alias("accuracy"))


def calibration(df: DataFrame, p: Column, y: Column, bin_col: Column, keys: Sequence[str] = ()) -> DataFrame:
    return (df.select(*keys, bin_col.alias("bin"), p.alias("_p"), y.cast("double").alias("_y")).where("bin is not null")
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("predicted"),
                                       F.avg("_y").alias("observed")))


def bias_map(df: DataFrame, books: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """ROI and standard error of backing every outcome blindly, by book, outcome and odds band."""
    rows = F.array(*[F.struct(F.lit(b).alias("book"), F.lit(o.upper()).alias("outcome"),
                              F.col(f"{b}{o}").cast("double").alias("odds"), F.col(f"won_{o}").alias("won"))
                     for b in books for o in "hda"])
    long = df.select(F.explode(rows).alias("r")).select("r.*").where("odds is not null")
    long = long.withColumn("band", S.band("odds", list(edges))).where("band is not null")
    return long.groupBy("book", "outcome", "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(unit_pnl()).alias("roi"),
        (F.stddev_pop(unit_pnl()) / F.sqrt(F.count(F.lit(1)))).alias("std_error"))
