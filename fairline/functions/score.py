"""Scoring rules, goal arithmetic and Poisson helpers."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .odds import col

# Overtime constants of the hockey markets.
P_OT_GOAL = 0.672
OT_GOAL_SHARE = 0.0246
TIE_MAX_GOALS = 25


def outcome_label(home_goals: Column | str, away_goals: Column | str) -> Column:
    """0 home, 1 draw, 2 away."""
    d = col(home_goals) - col(away_goals)
    return F.when(d > 0, 0).when(d == 0, 1).when(d < 0, 2)


def rps(p: list[Column | str], y: Column | str) -> Column:
    """Ranked probability score for ordered outcomes."""
    p, y = [col(x) for x in p], col(y)
    total, cum = F.lit(0.0), F.lit(0.0)
    for i in range(len(p) - 1):
        cum = cum + p[i]
        total = total + F.pow(cum - F.when(y <= i, 1.0).otherwise(0.0), F.lit(2.0))
    return total / (len(p) - 1)


def _at(p: list[Column], y: Column) -> Column:
    c = F.when(y == 0, p[0])
    for i in range(1, len(p)):
        c = c.when(y == i, p[i])
    return c


def log_loss(p: list[Column | str], y: Column | str, eps: float = 1e-15) -> Column:
    q = _at([col(x) for x in p], col(y))
    return -F.log(F.least(F.lit(1.0), F.greatest(F.lit(eps), q)))


def brier(p: list[Column | str], y: Column | str) -> Column:
    y = col(y)
    out = F.lit(0.0)
    for i, x in enumerate(p):
        out = out + F.pow(col(x) - F.when(y == i, 1.0).otherwise(0.0), F.lit(2.0))
    return out


def hit(p: list[Column | str], y: Column | str) -> Column:
    """1 when the most likely outcome (first one on ties) happened."""
    p = [col(x) for x in p]
    best = F.greatest(*p)
    pick = F.when(p[0] == best, 0)
    for i in range(1, len(p)):
        pick = pick.when(p[i] == best, i)
    return F.when(pick == col(y), 1.0).otherwise(0.0)


def binary_log_loss(p: Column | str, y: Column | str, eps: float = 1e-9) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), col(p)))
    y = col(y).cast("double")
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def goal_multiplier(goal_difference: Column | str) -> Column:
    d = F.abs(col(goal_difference))
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((11.0 + d) / 8.0)


def p_score(lam: Column | str, share: Column | str) -> Column:
    return 1 - F.exp(-col(lam) * col(share))


def p_score_given_goals(goals: Column | str, share: Column | str) -> Column:
    return 1 - F.pow(1 - col(share), col(goals).cast("double"))


def poisson_pmf(k: Column | int, lam: Column) -> Column:
    if isinstance(k, int):
        return F.exp(-lam) * F.pow(lam, F.lit(float(k))) / math.factorial(k)
    return F.exp(-lam + k * F.log(lam)) / F.factorial(k.cast("int"))


def poisson_cdf(k: Column, lam: Column) -> Column:
    """P(N <= k); terms are built by recurrence so k is not limited by factorial range."""
    start = F.struct(F.exp(-lam).alias("t"), F.exp(-lam).alias("s"))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int"))), start,
        lambda a, i: F.struct(F.when(i <= k, a["t"] * lam / i).otherwise(0.0).alias("t"),
                              (a["s"] + F.when(i <= k, a["t"] * lam / i).otherwise(0.0)).alias("s")),
        lambda a: a["s"]))


def p_more_than(p_at_least_one: Column | str, line: Column | str) -> Column:
    """P(goals > line) for a Poisson count whose P(>= 1) is given."""
    p = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), col(p_at_least_one)))
    mu = -F.log1p(-p)
    return 1 - poisson_cdf(F.floor(col(line)).cast("int"), mu)


def regulation_ratio(lam_home: Column | str, lam_away: Column | str) -> Column:
    """Share of a hockey team's expected goals scored in regulation time."""
    h, a = col(lam_home), col(lam_away)
    start = F.struct((F.exp(-h) * F.exp(-a)).alias("t"), (F.exp(-h) * F.exp(-a)).alias("s"))
    tie = F.aggregate(F.sequence(F.lit(1), F.lit(TIE_MAX_GOALS - 1)), start,
                      lambda c, k: F.struct((c["t"] * h * a / (k * k)).alias("t"),
                                            (c["s"] + c["t"] * h * a / (k * k)).alias("s")),
                      lambda c: c["s"])
    ok = h.isNotNull() & a.isNotNull() & (h + a > 0)
    return F.when(ok, 1 - P_OT_GOAL * tie / (h + a)).otherwise(F.lit(1 - OT_GOAL_SHARE))


def to_regulation(p_full: Column | str, ratio: Column | str) -> Column:
    return 1 - F.pow(1 - col(p_full), col(ratio))


def band(x: Column | str, edges: list[float]) -> Column:
    """Right-closed band label '(a, b]'; null outside the edges."""
    x = col(x)
    out = None
    for a, b in zip(edges[:-1], edges[1:]):
        cond, label = (x > a) & (x <= b), F.lit(f"({a}, {b}]")
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def equal_width_bin(p: Column | str, bins: int = 10) -> Column:
    """Left-closed equal-width bin of [0, 1], the last one closed on both sides."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(col(p) * bins))).cast("int")
