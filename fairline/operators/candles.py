"""Candles of a price series: open, high, low and close per time bucket, buckets without a trade carried on from the last close."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candles(ticks: DataFrame, keys: Sequence[str], seconds: int, price: str = "odds", ts: str = "ts", tie: str = "tick_id") -> DataFrame:
    """keys, bucket (start), open, high, low, close, mean, n: each bucket from a key's first to its last.

    Ticks are aggregated map-side, so what meets in a key's window is its buckets, as many as its time span holds, never its ticks. A bucket
    without ticks has the last close as all of its prices, and n = 0.
    """
    keys = list(keys)
    bucket = (F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds).cast("bigint")
    order = F.struct(ts, tie)
    full = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull()).groupBy(*keys, bucket.alias("_t")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.avg(price).alias("mean"), F.count(F.lit(1)).alias("n"))
    following = F.lead("_t").over(Window.partitionBy(*keys).orderBy("_t"))
    upto = F.coalesce("_next", F.col("_t") + seconds) - seconds
    long = full.withColumn("_next", following).withColumn("_s", F.explode(F.sequence("_t", upto, F.lit(seconds).cast("bigint"))))
    traded = F.col("_s") == F.col("_t")
    return long.select(*keys, F.timestamp_seconds("_s").alias("bucket"), *(F.when(traded, F.col(c)).otherwise(F.col("close")).alias(c) for c in ("open", "high", "low")), "close",
                       F.when(traded, F.col("mean")).otherwise(F.col("close")).alias("mean"), F.when(traded, F.col("n")).otherwise(0).cast("bigint").alias("n"))
