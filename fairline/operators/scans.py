"""Running and decayed history per key, split by time slices.

A plain window ordered inside one key puts the whole key in one task. Here rows are scanned per
(key, slice), slices are carried forward on a small summary table, and the carry is joined back:
a key holding a third of all rows is spread over as many tasks as it has slices. All results use
rows strictly before the current one.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024          # rows per re-based block: d^-1024 stays finite for every half-life >= 1.1
NEGLIGIBLE_HALVINGS = 60.0


def halflife_factor(halflife: float) -> float:
    return 0.5 ** (1.0 / halflife)


def span_factor(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, inclusive: bool = False) -> DataFrame:
    """Add running sums, maxima and last non-null values of the earlier rows of the same key.

    `inclusive` lets the current row count as well.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    own = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    pos = F.struct(*order)
    totals = df.groupBy(*keys, slice_col).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"_t_{n}") for n, v in maxes.items()],
        *[F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"_t_{n}") for n, v in lasts.items()])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, slice_col,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])
    local = df.withColumns({
        **{f"_l_{n}": F.sum(v).over(own) for n, v in sums.items()},
        **{f"_l_{n}": F.max(v).over(own) for n, v in maxes.items()},
        **{f"_l_{n}": F.last(v, ignorenulls=True).over(own) for n, v in lasts.items()}})
    out = local.join(carry, [*keys, slice_col])
    names = [*sums, *maxes, *lasts]
    out = out.withColumns({
        **{n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in sums},
        **{n: F.greatest(f"_l_{n}", f"_c_{n}") for n in maxes},
        **{n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}})
    return out.drop(*[f"_l_{n}" for n in names], *[f"_c_{n}" for n in names])


def decayed_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
                 series: dict[str, tuple[Column, float]], index_col: str | None = None,
                 sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add sum over earlier rows j < i of value_j * d^(i-1-j), per key, for several (value, d) at once.

    Exact to double precision at any history length: exponents are re-based every BLOCK rows,
    blocks are combined by a few lags (older ones weigh below 2^-60) and slices by a fold over the
    key's slice list, whose length is the number of time slices. Plain running `sums` and `lasts`
    (as in `running`) ride along in the same pass.
    """
    sums, lasts = sums or {}, lasts or {}
    in_slice = Window.partitionBy(*keys, slice_col).orderBy(*order)
    rows = df.withColumn("_rn", F.row_number().over(in_slice) - 1)
    rows = rows.withColumns({"_blk": F.floor(F.col("_rn") / BLOCK), "_pos": (F.col("_rn") % BLOCK).cast("double")})

    def scaled(v: Column, d: float) -> Column:
        return F.coalesce(v.cast("double"), F.lit(0.0)) * F.exp(-(F.col("_pos") + 1) * math.log(d))

    prior = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, slice_col, "_blk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v).alias(f"_q_{n}") for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), F.col("_rn"))).alias(f"_q_{n}") for n, v in lasts.items()],
        *[F.sum(scaled(v, d)).alias(f"_raw_{n}") for n, (v, d) in series.items()])
    blocks = blocks.withColumns({f"_t_{n}": F.col(f"_raw_{n}") * F.exp(F.col("_n") * math.log(d))
                                 for n, (_, d) in series.items()})
    by_block = Window.partitionBy(*keys, slice_col).orderBy("_blk")

    def block_carry(n: str, d: float) -> Column:
        depth = 2 + int(NEGLIGIBLE_HALVINGS / max(-math.log2(d), 1e-9) / BLOCK)
        total = F.lit(0.0)
        for j in range(1, depth + 1):
            total = total + F.coalesce(F.lag(f"_t_{n}", j).over(by_block), F.lit(0.0)) * d ** (BLOCK * (j - 1))
        return total

    blocks = blocks.withColumns({f"_b_{n}": block_carry(n, d) for n, (_, d) in series.items()})
    end = F.struct(*[(F.col(f"_t_{n}") + F.exp(F.col("_n") * math.log(d)) * F.col(f"_b_{n}")).alias(n)
                     for n, (_, d) in series.items()])
    slices = blocks.groupBy(*keys, slice_col).agg(
        F.sum("_n").alias("_sn"), F.max_by(end, "_blk").alias("_end"),
        *[F.sum(f"_q_{n}").alias(f"_q_{n}") for n in sums],
        *[F.max_by(f"_q_{n}", F.when(F.col(f"_q_{n}").isNotNull(), F.col("_blk"))).alias(f"_q_{n}") for n in lasts])
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    past = F.collect_list(F.struct(F.col("_sn").alias("n"), F.col("_end").alias("t"))).over(earlier)
    carry = slices.select(
        *keys, slice_col, F.coalesce(F.sum("_sn").over(earlier), F.lit(0)).alias("_n0"), past.alias("_past"),
        *[F.coalesce(F.sum(f"_q_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_q_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts])
    extra = [f"_c_{n}" for n in (*sums, *lasts)]

    def fold(n: str, d: float) -> Column:
        return F.aggregate("_past", F.lit(0.0), lambda a, x: a * F.exp(x["n"] * math.log(d)) + x["t"][n])

    carry = carry.select(*keys, slice_col, "_n0", *extra, *[fold(n, d).alias(f"_s_{n}") for n, (_, d) in series.items()])
    block_in = (blocks.join(carry, [*keys, slice_col]).select(
        *keys, slice_col, "_blk", "_n0", *extra,
        *[(F.col(f"_b_{n}") + F.col(f"_s_{n}") * F.exp(F.col("_blk") * BLOCK * math.log(d))).alias(f"_in_{n}")
          for n, (_, d) in series.items()]))
    in_block = (Window.partitionBy(*keys, slice_col, "_blk").orderBy("_rn")
                .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({**{f"_l_{n}": F.sum(v).over(prior) for n, v in sums.items()},
                             **{f"_l_{n}": F.last(v, ignorenulls=True).over(prior) for n, v in lasts.items()}})
    local = rows.withColumns({f"_w_{n}": F.coalesce(F.sum(scaled(v, d)).over(in_block), F.lit(0.0))
                              for n, (v, d) in series.items()})
    out = local.join(block_in, [*keys, slice_col, "_blk"])
    out = out.withColumns({n: (F.col(f"_w_{n}") + F.col(f"_in_{n}")) * F.exp(F.col("_pos") * math.log(d))
                           for n, (_, d) in series.items()})
    out = out.withColumns({**{n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in sums},
                           **{n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}})
    out = out.drop(*extra, *[f"_l_{n}" for n in (*sums, *lasts)])
    if index_col:
        out = out.withColumn(index_col, (F.col("_rn") + F.col("_n0")).cast("long"))
    return out.drop("_rn", "_blk", "_pos", "_n0", *[f"_w_{n}" for n in series], *[f"_in_{n}" for n in series])


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str, equity: str,
                 initial: float) -> DataFrame:
    """Largest relative fall of an equity curve from its running peak, the initial bankroll included."""
    peaks = running(df, keys, order, slice_col, maxes={"_peak": F.col(equity)}, inclusive=True)
    peak = F.greatest(F.col("_peak"), F.lit(float(initial)))
    return peaks.groupBy(*keys).agg(F.greatest(F.max((peak - F.col(equity)) / peak), F.lit(0.0)).alias("max_drawdown"))
