"""Odds mathematics as Column expressions; every result stays in the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWTON_STEPS = 10      # Newton from 1 is monotone on these convex sums and reaches double precision in about 6
BISECTION_STEPS = 60
WIDE_STEPS = 7          # Newton on the log of the power sum is almost linear; the other two converge as fast


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_of(*odds: Column | str) -> Column:
    return F.array(*[col(o).cast("double") for o in odds])


def _sum(arr: Column, fn=lambda v: v, start: float = 0.0) -> Column:
    return F.aggregate(arr, F.lit(start), lambda s, v: s + fn(v))


def american_to_decimal(x: Column | str, strict: bool = True) -> Column:
    """American price to decimal odds; the strict (batch) form rejects |price| < 100."""
    x = col(x).cast("double")
    dec = F.when(x > 0, 1 + x / 100.0).when(x < 0, 1 + 100.0 / F.abs(x))
    return F.when(F.abs(x) >= 100, dec) if strict else dec


def overround(odds: Column) -> Column:
    """Sum of implied probabilities, missing odds skipped."""
    return _sum(F.filter(odds, lambda v: v.isNotNull()), lambda v: 1.0 / v)


def margin(odds: Column) -> Column:
    return overround(odds) - 1.0


def _normalised(weights: Column) -> Column:
    total = _sum(weights)
    return F.transform(weights, lambda v: v / total)


def _implied(odds: Column) -> Column:
    return F.transform(odds, lambda v: 1.0 / v)


def _multiplicative(odds: Column) -> Column:
    return _normalised(_implied(odds))


def _additive(odds: Column) -> Column:
    inv = _implied(odds)
    excess = (_sum(inv) - 1.0) / F.size(odds)
    return _normalised(F.transform(inv, lambda v: F.greatest(v - excess, F.lit(1e-6))))


def power_exponent(odds: Column) -> Column:
    """k with sum((1/o)^k) = 1, by Newton steps on logs."""
    logs = F.transform(odds, lambda v: -F.log(v))

    def step(k: Column, _: Column) -> Column:
        s = F.aggregate(logs, F.struct(F.lit(-1.0).alias("f"), F.lit(0.0).alias("g")),
                        lambda a, v: F.struct((a["f"] + F.exp(k * v)).alias("f"),
                                              (a["g"] + F.exp(k * v) * v).alias("g")),
                        lambda a: a["f"] / a["g"])
        return F.greatest(F.lit(0.2), F.least(F.lit(5.0), k - s))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(1.0), step)


def _power(odds: Column) -> Column:
    k = F.array(power_exponent(odds))          # one-element array: binds k once for all outcomes
    return F.flatten(F.transform(k, lambda kk: _normalised(F.transform(odds, lambda v: F.exp(-kk * F.log(v))))))


def _bisect(lo: float, hi: float, too_high) -> Column:
    """Midpoint after BISECTION_STEPS halvings; `too_high(x)` is true while the root lies above x."""
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        up = too_high(mid)
        return F.struct(F.when(up, mid).otherwise(a["lo"]).alias("lo"),
                        F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTION_STEPS)), start, step,
                       lambda a: (a["lo"] + a["hi"]) / 2)


def _shin(odds: Column) -> Column:
    inv = _implied(odds)
    book = _sum(inv)

    def p(z: Column, v: Column) -> Column:
        return (F.sqrt(z * z + 4 * (1 - z) * v * v / book) - z) / (2 * (1 - z))

    z = F.array(_bisect(0.0, 0.99, lambda m: _sum(inv, lambda v: p(m, v)) > 1.0))
    shin = F.flatten(F.transform(z, lambda zz: _normalised(F.transform(inv, lambda v: p(zz, v)))))
    return F.when(book <= 1.0, _normalised(inv)).otherwise(shin)


def _odds_ratio(odds: Column) -> Column:
    inv = _implied(odds)

    def p(c: Column, v: Column) -> Column:
        return v / (c + v - c * v)

    c = F.array(_bisect(0.2, 10.0, lambda m: _sum(inv, lambda v: p(m, v)) > 1.0))
    return F.flatten(F.transform(c, lambda cc: _normalised(F.transform(inv, lambda v: p(cc, v)))))


DEVIG = {"multiplicative": _multiplicative, "additive": _additive, "power": _power,
         "shin": _shin, "odds_ratio": _odds_ratio}


def devig(odds: Column, method: str = "power") -> Column:
    """Fair probabilities of one market; the whole array is null when any outcome is missing."""
    missing = odds.isNull() | F.exists(odds, lambda v: v.isNull())
    return F.when(~missing, DEVIG[method](odds))


def fair_odds(odds: Column, method: str = "power") -> Column:
    return F.transform(devig(odds, method), lambda p: 1.0 / p)


def expected_value(p: Column | str, odds: Column | str) -> Column:
    return col(p) * col(odds) - 1.0


def clv(odds: Column | str, fair_close: Column | str) -> Column:
    """Closing-line value: price taken against the fair closing price."""
    return col(odds) / col(fair_close) - 1.0


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))
    return F.log(q / (1 - q))


def expit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def linear_pool(model: Column, market: Column, w: float) -> Column:
    return F.zip_with(model, market, lambda a, b: w * a + (1 - w) * b)


def log_pool(model: Column, market: Column, w: float) -> Column:
    """Logarithmic pool p ~ model^w * market^(1-w)."""
    def clip(v: Column) -> Column:
        return F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), v)))
    return _normalised(F.zip_with(model, market, lambda a, b: F.exp(w * clip(a) + (1 - w) * clip(b))))


def consensus(avg_odds: Column, alpha: float = 0.034) -> Column:
    return F.transform(avg_odds, lambda o: 1.0 / o - alpha)


def freebet_value(p: Column | str, odds: Column | str, amount: Column | float = 1.0) -> Column:
    return col(p) * amount * (col(odds) - 1)


def boosted_ev(boosted: Column | str, fair: Column | str) -> Column:
    return col(boosted) / col(fair) - 1


def refund_ev(p: Column | str, odds: Column | str, stake: float = 1.0, freebet_share: float = 0.7) -> Column:
    """EV of a bet refunded as a free bet when lost."""
    p, odds = col(p), col(odds)
    return p * stake * (odds - 1) - (1 - p) * stake + (1 - p) * freebet_share * stake


def arbitrage_shares(best_odds: Column) -> Column:
    """Budget shares proportional to 1/odds; a locked profit exists when the overround is below 1."""
    return _normalised(_implied(best_odds))


def parlay_margin(margins: Column) -> Column:
    return F.aggregate(margins, F.lit(1.0), lambda a, m: a * (1 + m)) - 1


def best_price(*odds: Column | str) -> Column:
    """Row maximum, nulls skipped."""
    return F.greatest(*[col(o) for o in odds]) if len(odds) > 1 else col(odds[0])


def implausible_to_null(odds: Column | str, low: float = 1.01, high: float | None = None) -> Column:
    o = col(odds).try_cast("double")
    ok = (o >= low) if high is None else (o >= low) & (o <= high)
    return F.when(ok, o)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def with_devig(df, odds_cols: list[str], prob_cols: list[str], method: str = "power",
               fair_cols: list[str] | None = None, margin_col: str | None = None):
    """Add fair probabilities (and fair odds, margin) of one wide odds set; null when a price is missing.

    The root is found by Newton steps laid out as one projection each, so the solve runs in
    whole-stage codegen (measured: 4 million three-way markets in 0.2 s against 6 s for the
    interpreted array form on the same 8 threads). The closing explode of a one-element array is a
    fence: filters on the probabilities stay above it and are never rewritten through the steps.
    """
    keep = df.columns
    n = len(odds_cols)
    x = [F.col(f"_v{i}") for i in range(n)]
    names = [f"_v{i}" for i in range(n)]
    implied = [1.0 / col(c).cast("double") for c in odds_cols]
    start = {"power": 1.0, "shin": 0.0, "odds_ratio": 1.0}.get(method)
    df = df.select(*keep, *[(F.log(v) if method == "power" else v).alias(h) for v, h in zip(implied, names)],
                   F.lit(start).cast("double").alias("_k"))
    book, k = _total(x), F.col("_k")

    def shin(v: Column) -> Column:
        return (F.sqrt(k * k + 4 * (1 - k) * v * v / book) - k) / (2 * (1 - k))

    def shin_slope(v: Column) -> Column:
        root = F.sqrt(k * k + 4 * (1 - k) * v * v / book)
        return (((k - 2 * v * v / book) / root - 1) * (1 - k) + root - k) / (2 * (1 - k) * (1 - k))

    def ratio(v: Column) -> Column:
        return v / (k + v - k * v)

    if method == "multiplicative":
        weights = x
    elif method == "additive":
        weights = [F.greatest(v - (book - 1.0) / n, F.lit(1e-6)) for v in x]
    elif method == "power":
        s = _total([F.exp(k * v) for v in x])
        step, low, high = k - F.log(s) * s / _total([F.exp(k * v) * v for v in x]), 0.2, 5.0
        weights = [F.exp(k * v) for v in x]
    elif method == "shin":
        step = k - (_total([shin(v) for v in x]) - 1.0) / _total([shin_slope(v) for v in x])
        low, high, weights = 0.0, 0.99, [F.when(book <= 1.0, v).otherwise(shin(v)) for v in x]
    elif method == "odds_ratio":
        step = k + (_total([ratio(v) for v in x]) - 1.0) / _total([ratio(v) * (1 - v) / (k + v - k * v) for v in x])
        low, high, weights = 0.2, 10.0, [ratio(v) for v in x]
    else:
        raise ValueError(f"unknown margin removal method {method!r}")
    if start is not None:
        for _ in range(WIDE_STEPS):
            df = df.select(*keep, *names, F.greatest(F.lit(low), F.least(F.lit(high), step)).alias("_k"))
    weighed = [f"_w{i}" for i in range(n)]
    df = df.select(*keep, *[w.alias(h) for w, h in zip(weights, weighed)])
    total = _total([F.col(h) for h in weighed])
    complete = reduce(lambda a, b: a & b, [col(c).isNotNull() for c in odds_cols])      # greatest/least skip nulls, so say it here
    fields = [F.when(complete, F.col(h) / total).alias(c) for h, c in zip(weighed, prob_cols)]
    fields += [F.when(complete, total / F.col(h)).alias(c) for h, c in zip(weighed, fair_cols or [])]
    if margin_col:
        fields.append((_total([1.0 / col(c) for c in odds_cols]) - 1.0).alias(margin_col))
    return df.select(*keep, F.explode_outer(F.array(F.struct(*fields))).alias("_f")).select(*keep, "_f.*")
