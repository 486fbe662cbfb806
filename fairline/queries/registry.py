"""Query registry: a name, a Spark callable over (spark, sf_dir) and, where expressible, twin SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return fn
    return register


def r(col, digits: int = 6):
    """Round for comparison: sums of doubles differ in the last bits between engines."""
    from pyspark.sql import functions as F
    from ..functions.odds import col as as_col
    return F.round(as_col(col), digits)


# ---- SQL text helpers for the twins

def sql_power(odds: list[str], k: str = "k") -> str:
    """Exponent of the power method by the same Newton steps."""
    from ..functions.odds import NEWTON_STEPS
    f = " + ".join(f"exp(-{k}*ln({o}))" for o in odds)
    g = " + ".join(f"exp(-{k}*ln({o}))*(-ln({o}))" for o in odds)
    steps = f"list_transform(range(1,{NEWTON_STEPS + 1}), lambda i: cast(i as double))"
    return f"list_reduce({steps}, lambda {k}, i: greatest(0.2, least(5.0, {k} - ({f} - 1)/({g}))), 1.0::double)"


def sql_power_probs(odds: list[str], k: str) -> list[str]:
    total = " + ".join(f"exp(-{k}*ln({o}))" for o in odds)
    return [f"exp(-{k}*ln({o}))/({total})" for o in odds]


def sql_bisect(lo: float, hi: float, above: str, n: int | None = None) -> str:
    """Midpoint of a bisection; `above` is a condition on {m} that is true while the root is higher."""
    from ..functions.odds import BISECTION_STEPS
    n = n or BISECTION_STEPS
    mid = "((acc.lo+acc.hi)/2)"
    cond = above.replace("{m}", mid)
    steps = f"list_transform(range(0,{n}), lambda i: {{'lo': 0.0::double, 'hi': 0.0::double}})"
    acc = (f"list_reduce({steps}, lambda acc, i: case when {cond} then {{'lo': {mid}, 'hi': acc.hi}} "
           f"else {{'lo': acc.lo, 'hi': {mid}}} end, {{'lo': {lo}::double, 'hi': {hi}::double}})")
    return f"(({acc}).lo + ({acc}).hi)/2"
