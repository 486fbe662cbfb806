"""SQL functions: the scalar odds mathematics under names usable in spark.sql, inlined by Catalyst."""
from __future__ import annotations

from pyspark.sql import SparkSession

# Every body is a plain SQL expression, so calls are optimised like hand-written SQL.
FUNCTIONS = {
    "ev(p double, odds double) returns double": "p * odds - 1",
    "clv(odds double, fair double) returns double": "odds / fair - 1",
    "kelly(p double, odds double) returns double": "greatest(0d, (p * odds - 1) / (odds - 1))",
    "american_to_decimal(x double) returns double": "case when abs(x) >= 100 then case when x > 0 then 1 + x / 100 else 1 + 100 / abs(x) end end",
    "rps3(ph double, pd double, y int) returns double": "(power(ph - if(y <= 0, 1, 0), 2) + power(ph + pd - if(y <= 1, 1, 0), 2)) / 2",
    "devig_multiplicative(odds array<double>) returns array<double>":
        "transform(odds, o -> (1 / o) / aggregate(odds, 0d, (s, v) -> s + 1 / v))",
    "devig_power(odds array<double>) returns array<double>":
        "transform(odds, o -> power(1 / o, aggregate(sequence(1, 10), 1d, (k, i) -> greatest(0.2d, least(5d, k - "
        "(aggregate(odds, -1d, (s, v) -> s + power(1 / v, k))) / aggregate(odds, 0d, (s, v) -> s + power(1 / v, k) * -ln(v)))))))",
    "p_score(lam double, share double) returns double": "1 - exp(-lam * share)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    names = []
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
        names.append(head.split("(")[0])
    return names


GRID_SQL = """select {keys}, h, a, exp(-lh - la + h * ln(lh) + a * ln(la)) / (factorial(h) * factorial(a)) as w
from {rates} lateral view explode(sequence(0, 10)) x as h lateral view explode(sequence(0, 10)) y as a"""


def score_cells(rates, keys: list[str]):
    """Table-function form of the score grid: (keys, lh, la) to (keys, h, a, w) in SQL."""
    return rates.sparkSession.sql(GRID_SQL.replace("{keys}", ", ".join(keys)), rates=rates)
