"""Row-level reshaping: labels, unpivots, filters and per-key picks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import col

OUTCOMES = ("H", "D", "A")


def country_of(league: Column | str) -> Column:
    """Country part of a league code; the fifth English tier counts as England."""
    league = col(league)
    return F.when(league == "EC", F.lit("E")).otherwise(F.regexp_replace(league, r"\d+$", ""))


def add_labels(df: DataFrame, home_goals: str = "fthg", away_goals: str = "ftag") -> DataFrame:
    h, a = F.col(home_goals), F.col(away_goals)
    y = F.when(h > a, 0).when(h == a, 1).otherwise(2)
    over = F.when(h + a > 2.5, 1).otherwise(0)
    return df.withColumns({"y": y, "over25": over, "btts": F.when((h > 0) & (a > 0), 1).otherwise(0),
                           "won_h": y == 0, "won_d": y == 1, "won_a": y == 2,
                           "won_o": over == 1, "won_u": over == 0})


def candidate_bets(df: DataFrame, legs: Sequence[dict], keep: Sequence[str]) -> DataFrame:
    """Wide match rows to one row per priced outcome.

    Each leg names its `selection` and gives Columns for `p`, `odds`, `won` and, optionally,
    `close_fair_odds`. One explode over a fixed-length array: no shuffle.
    """
    with_close = any("close_fair_odds" in leg for leg in legs)

    def entry(leg: dict) -> Column:
        fields = [F.lit(leg["selection"]).alias("selection"), col(leg["p"]).cast("double").alias("p"),
                  col(leg["odds"]).cast("double").alias("odds"), col(leg["won"]).cast("boolean").alias("won")]
        if with_close:
            close = leg.get("close_fair_odds")
            fields.append((F.lit(None) if close is None else col(close)).cast("double").alias("close_fair_odds"))
        return F.struct(*fields)

    out = (df.select(*keep, F.explode(F.array(*[entry(leg) for leg in legs])).alias("leg"))
           .select(*keep, "leg.*").where("p is not null and odds is not null")
           .withColumn("ev", F.col("p") * F.col("odds") - 1.0))
    return out.withColumn("clv", F.col("odds") / F.col("close_fair_odds") - 1.0) if with_close else out


def three_way_legs(prob: str, book: str, close: str | None = None) -> list[dict]:
    """Leg specs for columns named <prob>_ph/_pd/_pa, <book>h/d/a and fair_<close>_h/d/a."""
    legs = []
    for o in "hda":
        leg = {"selection": o.upper(), "p": f"{prob}_p{o}", "odds": f"{book}{o}", "won": f"won_{o}"}
        if close:
            leg["close_fair_odds"] = f"fair_{close}_{o}"
        legs.append(leg)
    return legs


def over_under_legs(p_over: Column | str, over: str, under: str, close: tuple[str, str] | None = None) -> list[dict]:
    p = col(p_over)
    legs = [{"selection": "Over2.5", "p": p, "odds": over, "won": "won_o"},
            {"selection": "Under2.5", "p": 1 - p, "odds": under, "won": "won_u"}]
    if close:
        for leg, c in zip(legs, close):
            leg["close_fair_odds"] = c
    return legs


def two_way_legs(p_home: Column | str, home: str, away: str, won: str = "home_win") -> list[dict]:
    p = col(p_home)
    return [{"selection": "home", "p": p, "odds": home, "won": F.col(won)},
            {"selection": "away", "p": 1 - p, "odds": away, "won": ~F.col(won)}]


def select_value(df: DataFrame, min_ev: float = 0.03, max_ev: float = 1.0, min_odds: float = 1.01,
                 max_odds: float = 100.0, selections: Sequence[str] | None = None,
                 strict_min: bool = False) -> DataFrame:
    """EV / odds window; callers differ on whether the lower EV bound is inclusive."""
    ev, o = F.col("ev"), F.col("odds")
    cond = ((ev > min_ev) if strict_min else (ev >= min_ev)) & (ev <= max_ev) & (o >= min_odds) & (o <= max_odds)
    return df.where(cond & F.col("selection").isin(list(selections)) if selections else cond)


def best_bet(df: DataFrame, legs: Sequence[dict], keep: Sequence[str], min_ev: float, max_ev: float,
             max_odds: float = 100.0, strict_min: bool = False, match_key: Sequence[str] | None = None) -> DataFrame:
    """Best qualifying outcome of each match row, ties to the first selection name.

    For match tables with one row per match the pick is a row-level maximum, so "one bet per match"
    needs neither an unpivot nor a shuffle. Where a match may be listed more than once, `match_key`
    reduces the row-level picks further, to one per match.
    """
    with_close = any("close_fair_odds" in leg for leg in legs)
    names = sorted((leg["selection"] for leg in legs), reverse=True)

    def entry(leg: dict) -> Column:
        p, o = col(leg["p"]).cast("double"), col(leg["odds"]).cast("double")
        ev = p * o - 1.0
        f = [ev.alias("ev"), F.lit(names.index(leg["selection"])).alias("_pref"), F.lit(leg["selection"]).alias("selection"),
             p.alias("p"), o.alias("odds"), col(leg["won"]).cast("boolean").alias("won")]
        if with_close:
            f.append(col(leg["close_fair_odds"]).cast("double").alias("close_fair_odds"))
        ok = ((ev > min_ev) if strict_min else (ev >= min_ev)) & (ev <= max_ev) & (o <= max_odds)
        return F.when(ok, F.struct(*f))

    best = F.explode_outer(F.array(F.greatest(*[entry(leg) for leg in legs])))     # fence against filter pushdown
    out = (df.select(*keep, best.alias("_b")).where("_b is not null")
           .select(*keep, "_b.selection", "_b.p", "_b.odds", "_b.won", *(["_b.close_fair_odds"] if with_close else []), "_b.ev"))
    if match_key:
        out = top_by(out, list(match_key), "ev", "selection")
    return out.withColumn("clv", F.col("odds") / F.col("close_fair_odds") - 1.0) if with_close else out


def top_by(df: DataFrame, keys: Sequence[str], by: str, tie: str, largest: bool = True) -> DataFrame:
    """One row per key: the largest (smallest) `by`, the smallest `tie` among equals.

    A max_by/min_by aggregate keeps one candidate per task before the shuffle, so a key with a
    third of all rows never lands whole in one task, unlike row_number over a window.
    """
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(*rest)
    rank = F.struct((-F.col(by) if largest else F.col(by)).alias("a"), F.col(tie).alias("b"))
    return (df.groupBy(*keys).agg(F.min_by(whole, rank).alias("row")).select(*keys, "row.*")
            .select(*df.columns))


def top_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """First n rows per key; the rank filter lets Spark keep n rows per task before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def team_rows(df: DataFrame, shared: Sequence[str], mirrored: dict[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """Match row to two team rows; `mirrored` maps a name to its (home view, away view)."""
    def view(i: int) -> Column:
        return F.struct(F.lit(i == 0).alias("is_home"), *[col(v[i]).alias(k) for k, v in mirrored.items()])
    return df.select(*shared, F.explode(F.array(view(0), view(1))).alias("t")).select(*shared, "t.*")


def to_symmetric(df: DataFrame, winner: str, loser: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Winner/loser rows to alphabetical player 1 / player 2 rows; paired columns follow the swap."""
    swap = F.col(winner) > F.col(loser)
    cols = {"p1": F.least(F.col(winner), F.col(loser)), "p2": F.greatest(F.col(winner), F.col(loser)),
            "p1_won": ~swap}
    for name, (w, l) in pairs.items():
        cols[f"{name}_1"] = F.when(swap, F.col(l)).otherwise(F.col(w))
        cols[f"{name}_2"] = F.when(swap, F.col(w)).otherwise(F.col(l))
    used = {winner, loser} | {c for p in pairs.values() for c in p}
    return df.withColumns(cols).drop(*used)


def importance_k(tournament: Column | str) -> Column:
    """Elo K factor by competition importance."""
    # Tournament name patterns and K factors.
    t = F.lower(col(tournament))
    major = t.rlike("euro|copa am|african cup of nations|asian cup|gold cup|confederations")
    qualif = t.contains("qualification")
    return (F.when(t == "fifa world cup", 60.0).when(major & ~qualif, 50.0)
            .when(qualif | t.contains("nations league"), 40.0).when(t == "friendly", 20.0).otherwise(30.0))


SLICES = 100_000


def pair_consecutive(df: DataFrame, order: str, keep: Sequence[str], slice_col: str) -> DataFrame:
    """Rows listed visitor then home, two by two, to one row per game.

    The running row number is taken per slice first and shifted by the totals of earlier slices; these are summed per group of
    SLICES slices and then over groups, so no task sorts the table or all its slices. `slice_col` is a whole number that grows with `order`.
    """
    from pyspark.sql import Window
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(slice_col).orderBy(order)) - 1)
    totals = df.groupBy(slice_col).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    totals = totals.withColumn("_g", F.floor(F.col(slice_col) / SLICES))
    heads = totals.groupBy("_g").agg(F.sum("_n").alias("_m"))
    heads = heads.select("_g", F.coalesce(F.sum("_m").over(Window.orderBy("_g").rowsBetween(*before)), F.lit(0)).alias("_base"))
    inside = totals.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy(slice_col).rowsBetween(*before)), F.lit(0)))
    shift = inside.join(heads, "_g").select(slice_col, (F.col("_base") + F.col("_in")).alias("_off"))
    numbered = local.join(shift, slice_col).withColumn("_rn", F.col("_rn") + F.col("_off"))
    row = F.struct(*keep)
    return (numbered.groupBy(F.floor(F.col("_rn") / 2).alias("game_no"))
            .agg(F.max(F.when(F.col("_rn") % 2 == 0, row)).alias("v"),
                 F.max(F.when(F.col("_rn") % 2 == 1, row)).alias("h"))
            .select("game_no", *[F.col(f"v.{c}").alias(f"{c}_v") for c in keep],
                    *[F.col(f"h.{c}").alias(f"{c}_h") for c in keep]))
