"""Group totals attached to rows, and per-group shares, without collecting a group in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STEP = 300.0


def attach_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregate per key (combined map-side) and join the result back.

    The join leaves skewed keys to adaptive execution, which splits the row side; a window would
    buffer the whole group in one task.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, list(keys))


def softmax_share(df: DataFrame, keys: Sequence[str], eta: Column, out: str = "share") -> DataFrame:
    """exp(eta) over its group total, for predictors of any size.

    Sums are taken per (key, level of eta) from the level's foot, and what counts is the highest level and the one below: anything
    lower is less than exp(-STEP) of the total. So one shuffle of partial sums does, and no exponent overflows.
    """
    tmp = df.withColumn("_eta", eta).withColumn("_level", F.floor(F.col("_eta") / STEP))
    levels = tmp.groupBy(*keys, "_level").agg(F.sum(F.exp(F.col("_eta") - STEP * F.col("_level"))).alias("_s"))
    two = levels.groupBy(*keys).agg(F.max(F.struct("_level", "_s")).alias("_top"), F.collect_list(F.struct("_level", "_s")).alias("_all"))
    below = F.aggregate(F.filter("_all", lambda x: x["_level"] == F.col("_top._level") - 1), F.lit(0.0), lambda a, x: a + x["_s"])
    z = two.select(*keys, F.col("_top._level").alias("_foot"), (F.col("_top._s") + F.exp(F.lit(-STEP)) * below).alias("_z"))
    return tmp.join(z, list(keys)).withColumn(out, F.exp(F.col("_eta") - STEP * F.col("_foot")) / F.col("_z")).drop("_eta", "_level", "_foot", "_z")


def proportional_share(df: DataFrame, keys: Sequence[str], weight: Column, out: str = "share") -> DataFrame:
    """Shares proportional to a positive column (baselines: uniform, minutes, naive product)."""
    return softmax_share(df, keys, F.log(F.greatest(weight.cast("double"), F.lit(1e-9))), out)


def long_devig_multiplicative(df: DataFrame, market: Sequence[str], odds: str, out: str = "fair_prob") -> DataFrame:
    """Margin removal of long odds rows, per market key."""
    inv = 1.0 / F.col(odds)
    return attach_totals(df, market, _book=F.sum(inv)).withColumns(
        {out: inv / F.col("_book"), "margin": F.col("_book") - 1.0}).drop("_book")


def long_devig(df: DataFrame, market: Sequence[str], outcome: Sequence[str], odds: str,
               method: str = "power") -> DataFrame:
    """Devig of long odds rows: one array per market, solved once, exploded again.

    A market is a bounded set of outcomes (`outcome` identifies one), so duplicates are reduced to
    the best price per outcome before the array is built.
    """
    from ..functions.odds import devig
    best = df.groupBy(*market, *outcome).agg(F.max(odds).alias(odds))
    arr = best.groupBy(*market).agg(F.sort_array(F.collect_list(F.struct(*outcome, odds))).alias("_o"))
    arr = arr.where(F.size("_o") >= 2)
    arr = arr.withColumn("_p", devig(F.transform("_o", lambda x: x[odds]), method))
    book = F.aggregate("_o", F.lit(0.0), lambda a, x: a + 1.0 / x[odds])
    return (arr.select(*market, (book - 1.0).alias("margin"), F.explode(F.arrays_zip("_o", "_p")).alias("z"))
            .select(*market, *[F.col(f"z._o.{c}").alias(c) for c in outcome],
                    F.col(f"z._o.{odds}").alias(odds), F.col("z._p").alias("fair_prob"), "margin"))


def devig_markets(df: DataFrame, market: Sequence[str], rows: str, outcome: str, odds: str, method: str = "power", out: str = "fair_prob",
                  margin: str = "margin") -> DataFrame:
    """long_devig's probabilities on the rows of markets that each come with an array of them; fields of the array become columns.

    Markets of two outcomes or more, each with a price, are kept. A null outcome counts in its market, but its row goes. A market that comes once
    is solved from its own array; arrays of one that comes again are laid out in rows and met by windows, which spill. One sort order serves all steps, and markets
    that lie by a part of their key are not shuffled.
    """
    from ..functions.odds import devig
    fields = df.schema[rows].dataType.elementType.names
    each = lambda a, f: F.transform(a, lambda x: x[f])      # noqa: E731
    best = lambda s, v: F.struct(s.alias("s"), v.alias("v"))      # noqa: E731
    whole = Window.partitionBy(*market)
    d = df.withColumn("_n", F.count(F.lit(1)).over(whole))
    again = F.col("_n") > 1
    d = d.withColumn("_r", F.explode(F.when(again, F.col(rows)).otherwise(F.array(F.get(F.col(rows), F.lit(-1))))))
    d = d.withColumn("_s", F.col(f"_r.{outcome}")).withColumn("_b", F.max(f"_r.{odds}").over(Window.partitionBy(*market, "_s")))
    d = d.withColumn("_o", F.collect_set(F.when(again, best(F.col("_s"), F.col("_b")))).over(whole))
    names = each(rows, outcome)
    own = F.when(F.size(F.array_distinct(names)) == F.size(names), F.transform(rows, lambda x: best(x[outcome], x[odds]))).otherwise(
        F.transform(F.array_distinct(names), lambda s: best(s, F.array_max(each(F.filter(rows, lambda x: x[outcome].eqNullSafe(s)), odds)))))
    d = d.withColumn("_o", F.sort_array(F.when(again, F.col("_o")).otherwise(own)))
    d = d.withColumn("_v", each("_o", "v"))
    d = d.withColumns({"_p": devig(F.col("_v"), method), margin: F.aggregate("_v", F.lit(0.0), lambda a, v: a + 1.0 / v) - 1.0, "_s": each("_o", "s")})
    d = d.withColumn("_r", F.when((F.size("_v") >= 2) & F.col("_p").isNotNull(), F.when(again, F.array("_r")).otherwise(F.col(rows))))
    # an outer explode: for an inner one Spark would work the array out once more, to filter empty ones
    d = d.withColumn("_r", F.explode_outer("_r")).where(F.col(f"_r.{outcome}").isNotNull())
    keep = [c for c in df.columns if c != rows]
    return d.select(*keep, *[F.col(f"_r.{c}").alias(c) for c in fields], F.get("_p", F.array_position("_s", F.col(f"_r.{outcome}")).cast("int") - 1).alias(out), margin)
