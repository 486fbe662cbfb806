"""Stake sizing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .odds import col


def kelly_fraction(p: Column | str, odds: Column | str) -> Column:
    p, odds = col(p), col(odds)
    return F.greatest(F.lit(0.0), (p * odds - 1.0) / (odds - 1.0))


def stake_fraction(p: Column | str, odds: Column | str, method: str = "kelly", fraction: float = 0.25,
                   cap: float = 0.05, flat: float = 0.01) -> Column:
    """Stake as a share of the bankroll: flat, fractional Kelly or proportional to the edge."""
    p, odds = col(p), col(odds)
    if method == "flat":
        return F.when(p.isNotNull(), F.lit(flat))
    if method == "kelly":
        return F.least(fraction * kelly_fraction(p, odds), F.lit(cap))
    if method == "prop":
        return F.least(F.greatest(F.lit(0.0), p * odds - 1) * fraction, F.lit(cap))
    raise ValueError(f"unknown staking method {method!r}")


def stake_percent(p: Column | str, odds: Column | str, kelly_frac: float = 0.25, kelly_cap: float = 0.02) -> Column:
    """Published stake in percent of the bankroll, two decimals."""
    return F.round(100 * F.least(kelly_fraction(p, odds) * kelly_frac, F.lit(kelly_cap)), 2)


def stake_money(percent: Column | str, bankroll: float, max_stake: Column | None = None) -> Column:
    """Stake in money, limited by the operator's maximum stake where one is stated."""
    money = F.round(col(percent) / 100 * bankroll, 2)
    return money if max_stake is None else F.least(money, max_stake)     # least skips nulls
