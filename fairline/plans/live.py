"""Live comparison: value against a sharp feed, feed guards, pick ledger, settlement."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions.odds import clv
from ..functions.stake import stake_money, stake_percent
from ..functions.text import norm_name
from ..operators import fuzzy
from ..operators.groups import attach_totals
from ..operators.reshape import top_by

# Published thresholds.
MIN_EV, MAX_EV, MIN_ODDS, MAX_ODDS, MAX_MARGIN = 0.03, 0.30, 1.15, 10.0, 0.08
MODEL_MIN_EV = 0.10
SCORER_MIN_EV = 0.12
PUBLISH_P_START = 0.85


def upcoming(df: DataFrame, now: Column, hours: float = 36.0, start: str = "start") -> DataFrame:
    return df.where((F.col(start) > now) & (F.unix_timestamp(start) < F.unix_timestamp(now) + 3600 * hours))


def find_value(fixtures: DataFrame, probs: Sequence[str], books: dict[str, Sequence[str]], keep: Sequence[str], min_ev: float = MIN_EV,
               max_ev: float = MAX_EV, max_odds: float = MAX_ODDS, bankroll: float = 1000.0) -> DataFrame:
    """Best EV over outcomes and books per fixture row, with the fractional Kelly stake; no shuffle."""
    labels = ("H", "D", "A")
    order = {x: i for i, x in enumerate(sorted([(o, b) for o in labels for b in books], reverse=True))}
    cells = []
    for b, cols in books.items():
        for i, o in enumerate(labels):
            ev = F.col(probs[i]) * F.col(cols[i]) - 1
            ok = ev.between(min_ev, max_ev) & (F.col(cols[i]) <= max_odds)
            cells.append(F.when(ok, F.struct(ev.alias("ev"), F.lit(order[(o, b)]).alias("pref"), F.lit(o).alias("selection"), F.lit(b).alias("book"),
                                             F.col(cols[i]).alias("odds"), F.col(probs[i]).alias("p"))))
    v = fixtures.select(*keep, F.explode_outer(F.array(F.greatest(*cells))).alias("b")).where("b is not null").select(*keep, "b.selection", "b.book", "b.odds", "b.p", "b.ev")
    v = v.withColumn("stake_pct", stake_percent("p", "odds"))
    return v.withColumn("stake_money", stake_money("stake_pct", bankroll))


def compare_with_sharp(sharp: DataFrame, soft: DataFrame, matched: DataFrame) -> DataFrame:
    """Soft prices against sharp fair probabilities: moneyline and equal-line totals, best price per selection.

    A book that quotes a draw is compared only with a sharp market that has one, and the reverse.
    sharp(event_id, market, selection, line, fair_prob, home, away, ...), soft(event_id, book, market, selection, line, odds, home, away),
    matched(left_id soft event, right_id sharp event, swapped).
    """
    f = soft.join(matched.select(F.col("left_id").alias("event_id"), F.col("right_id").alias("sharp_id"), "swapped"), "event_id")
    names = sharp.groupBy(F.col("event_id").alias("sharp_id")).agg(F.min("home").alias("_sh"), F.min("away").alias("_sa"),
                                                                 F.max(F.when((F.col("market") == "moneyline") & (F.col("selection") == "Nul"), 1).otherwise(0)).alias("_three"))
    f = f.join(names, "sharp_id")
    own = F.when(F.col("selection") == F.col("home"), F.when(F.col("swapped"), F.col("_sa")).otherwise(F.col("_sh"))).when(
        F.col("selection") == F.col("away"), F.when(F.col("swapped"), F.col("_sh")).otherwise(F.col("_sa"))).when(
        F.col("selection") == "Over", "Plus").when(F.col("selection") == "Under", "Moins").otherwise(F.col("selection"))
    f = f.withColumn("sharp_selection", own)
    f = attach_totals(f, ["event_id", "book"], _draw=F.max(F.when((F.col("market") == "moneyline") & (F.col("selection") == "Nul"), 1).otherwise(0)))
    f = f.where((F.col("market") == "total") | ((F.col("market") == "moneyline") & (F.col("_draw") == F.col("_three"))))
    # player props are another market, and totals of different units (goals, corners, games, sets) never meet
    both = [c for c in ("unit",) if c in soft.columns and c in sharp.columns]
    if "is_prop" in soft.columns:
        f = f.where(~F.coalesce("is_prop", F.lit(False)))
    if "is_prop" in sharp.columns:
        sharp = sharp.where(~F.coalesce("is_prop", F.lit(False)))
    f = f.withColumn("line", F.when(F.col("market") == "total", F.col("line")).otherwise(F.lit(-1.0)))
    best = f.groupBy("sharp_id", "market", "sharp_selection", "line", *both).agg(F.max_by(F.struct("book", "odds"), F.struct(F.col("odds"), F.col("book"))).alias("b"))
    s = sharp.withColumn("line", F.when(F.col("market") == "total", F.col("line")).otherwise(F.lit(-1.0))).groupBy(
        F.col("event_id").alias("sharp_id"), "market", F.col("selection").alias("sharp_selection"), "line", *both).agg(F.max("fair_prob").alias("fair_prob"))
    return best.join(s, ["sharp_id", "market", "sharp_selection", "line", *both]).select(
        "sharp_id", "market", "sharp_selection", "line", "b.*", "fair_prob", (F.col("fair_prob") * F.col("b.odds") - 1).alias("ev"))


def drop_mixed_markets(rows: DataFrame, player: str = "player") -> DataFrame:
    """Identical duplicates removed; a book's event with two prices for one player and line is dropped whole."""
    k = rows.withColumn("_k", norm_name(player)).dropDuplicates(["book", "ub_event_id", "_k", "stat", "line", "odds"])
    bad = k.groupBy("book", "ub_event_id", "_k", "stat", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("book", "ub_event_id").distinct()
    return k.join(bad, ["book", "ub_event_id"], "left_anti").drop("_k")


def drop_implausible(cmp: DataFrame, max_median_ev: float = 0.05, min_rows: int = 5) -> DataFrame:
    """A book's event priced above fair in the median (at least min_rows prices) was misread: dropped."""
    bad = cmp.groupBy("book", "ub_event_id").agg(F.count(F.lit(1)).alias("n"), F.median("ev").alias("m")).where((F.col("n") >= min_rows) & (F.col("m") > max_median_ev))
    return cmp.join(bad.select("book", "ub_event_id"), ["book", "ub_event_id"], "left_anti")


def compare_props(books: DataFrame, sharp: DataFrame, model: DataFrame, links: DataFrame, ratios: DataFrame) -> DataFrame:
    """Player prices against the sharp price of the same player and line, else the model for 'scores'.

    books(book, ub_event_id, player, stat, line, odds, reg_only), sharp(event, player, stat, line, pin_prob),
    model(event, player, model_prob), links(ub_event_id, event), ratios(event, ratio).
    """
    x = books.withColumn("k", norm_name("player")).join(links, "ub_event_id")
    s = sharp.withColumn("k", norm_name("player")).groupBy("event", "k", "stat", "line").agg(F.max("pin_prob").alias("pin_prob"))
    m = model.withColumn("k", norm_name("player")).groupBy("event", "k").agg(F.max("model_prob").alias("model_prob"))
    x = x.join(s, ["event", "k", "stat", "line"], "left").join(m, ["event", "k"], "left").join(ratios, "event", "left")
    use_model = F.col("pin_prob").isNull() & (F.col("stat") == "Buts") & (F.col("line") == 0.5)
    x = x.withColumns({"ref": F.when(F.col("pin_prob").isNotNull(), "sharp").when(use_model & F.col("model_prob").isNotNull(), "model"),
                       "fair_prob": F.coalesce("pin_prob", F.when(use_model, F.col("model_prob")))}).where("fair_prob is not null")
    ratio = F.coalesce("ratio", F.lit(1 - S.OT_GOAL_SHARE))
    x = x.withColumn("fair_prob", F.when(F.col("reg_only"), S.to_regulation("fair_prob", ratio)).otherwise(F.col("fair_prob")))
    return x.withColumns({"ev": F.col("fair_prob") * F.col("odds") - 1, "threshold": F.when(F.col("ref") == "sharp", MIN_EV).otherwise(MODEL_MIN_EV)}).drop("k")


def compare_scorers(pred: DataFrame, books: DataFrame, links: DataFrame) -> DataFrame:
    """Scorer prices by line against the 'if starting' model probability."""
    x = books.withColumn("k", norm_name("player")).join(links, "ub_event_id").join(pred.withColumn("k", norm_name("player")).drop("player"), ["event", "k"])
    x = x.withColumn("fair_prob", S.p_more_than("model_prob", "line"))
    return x.withColumns({"ev": F.col("fair_prob") * F.col("odds") - 1, "threshold": F.lit(SCORER_MIN_EV)}).drop("k")


def publishable(cmp: DataFrame, need_start: bool = False) -> DataFrame:
    v = cmp.where((F.col("ev") >= F.col("threshold")) & F.col("ev").between(-1, MAX_EV) & F.col("odds").between(MIN_ODDS, MAX_ODDS))
    return v.where(F.col("p_start") >= PUBLISH_P_START) if need_start else v


def merge_value_bets(frames: Sequence[DataFrame], bankroll: float = 1000.0) -> DataFrame:
    """All value sources together: global guards, top EV per (event, market), stakes."""
    v = frames[0]
    for f in frames[1:]:
        v = v.unionByName(f, allowMissingColumns=True)
    v = v.where(F.col("ev").between(MIN_EV, MAX_EV) & F.col("odds").between(MIN_ODDS, MAX_ODDS) & ~(F.coalesce("pin_margin", F.lit(0.0)) > MAX_MARGIN))
    v = top_by(v, ["event", "market"], "ev", "selection")
    v = v.withColumn("stake_pct", stake_percent("fair_prob", "odds"))
    return v.withColumn("stake_money", stake_money("stake_pct", bankroll, F.col("max_stake") if "max_stake" in v.columns else None))


def watchlist(sharp: DataFrame, min_ev: float = MIN_EV, max_margin: float = MAX_MARGIN) -> DataFrame:
    """Minimum odds to take for every main outcome of the sharp feed."""
    w = sharp.where((F.col("pin_margin") <= max_margin) & (F.col("fair_odds") >= 1.05) & F.col("market").isin("moneyline", "total"))
    return w.withColumns({"min_odds": F.round(F.col("fair_odds") * (1 + min_ev), 2),
                          "market_label": F.when(F.col("market") == "moneyline", "Vainqueur / 1N2").otherwise("Total (plus/moins)")})


# Suffixes of sharp player markets and their statistic.
PROP_SUFFIXES = [("Total Shots On Goal", "Tirs cadrés"), ("Total Goals", "Buts"), ("Total Points", "Points"), ("Total Assists", "Passes décisives"),
                 ("Total Saves", "Arrêts"), ("Total Rebounds", "Rebonds"), ("Total Threes", "Paniers à 3 points"), ("Total 3 Point FG", "Paniers à 3 points"),
                 ("Pts+Rebs+Asts", "Points + rebonds + passes"), ("Total Steals", "Interceptions"), ("Total Blocks", "Contres"),
                 ("Total Hits", "Mises en échec"), ("Total Strikeouts", "Retraits au bâton")]


def props_table(sharp: DataFrame) -> DataFrame:
    """Player markets: suffix to player and statistic; of a scorer market only the 'yes' side is kept."""
    d = F.regexp_replace("market", "^Player Props: ", "")
    w = sharp.where(F.col("is_prop") & F.col("market").startswith("Player Props:")).withColumn("_d", d)
    stat = player = None
    for suffix, name in PROP_SUFFIXES:
        hit, cut_ = F.col("_d").endswith(suffix), F.trim(F.expr(f"left(_d, length(_d) - {len(suffix)})"))
        stat = F.when(hit, name) if stat is None else stat.when(hit, name)
        player = F.when(hit, cut_) if player is None else player.when(hit, cut_)
    w = w.withColumns({"stat": stat.otherwise(""), "player": player.otherwise(F.col("_d"))}).drop("_d")
    return w.where(~((F.col("stat") == "Buts") & (F.col("line") == 0.5) & (F.col("selection") == "Under")))


# ------------------------------------------------------------------ ledger and settlement

PICK = ["event", "selection", "book"]


def upsert_picks(history: DataFrame, picks: DataFrame, fair_ticks: DataFrame, now: Column) -> DataFrame:
    """Insert unseen picks, refresh the last fair price of those not started, freeze CLV at the start.

    history/picks: PICK, start, odds, detected_at, fair_odds_at_pick, market_key; fair_ticks: market_key, selection, ts, fair_odds.
    The latest fair price per pick is a max_by over ticks strictly before the start and after detection.
    """
    # of several picks of one key the first counts
    rest = [c for c in picks.columns if c not in PICK]
    first = picks.groupBy(*PICK).agg(F.min_by(F.struct(*rest), F.struct("detected_at", "odds")).alias("r")).select(*PICK, "r.*")
    fresh = first.join(history.select(*PICK), PICK, "left_anti")
    led = history.unionByName(fresh, allowMissingColumns=True)
    t = led.select(*PICK, "start", "detected_at", "market_key").join(fair_ticks, ["market_key", "selection"])
    t = t.where((F.col("ts") < F.col("start")) & (F.col("ts") > F.col("detected_at")) & (F.col("ts") <= now))
    last = t.groupBy(*PICK).agg(F.max_by("fair_odds", F.struct("ts", "fair_odds")).alias("fair_odds_last"), F.max("ts").alias("last_seen"))
    out = led.join(last, PICK, "left")
    if "fair_odds_at_pick" in out.columns:                      # before the first tick the pick's own fair price holds
        out = out.withColumn("fair_odds_last", F.coalesce("fair_odds_last", "fair_odds_at_pick"))
    return out.withColumns({"clv": F.round(clv("odds", "fair_odds_last"), 4), "status": F.when(F.col("start") <= now, "started").otherwise("open")})


def last_snapshot(ticks: DataFrame, keys: Sequence[str], ts: str = "ts", start: str = "start", tie: str | None = None) -> DataFrame:
    """As-of: the last row strictly before the start per key; snapshots after the start are ignored."""
    rest = [c for c in ticks.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    return ticks.where(F.col(ts) < F.col(start)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _profit(won: Column, odds: str = "odds") -> Column:
    return F.when(won, F.round(F.col(odds) - 1, 3)).when(~won, -1.0)


def settle_exact(picks: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settlement on an exact key with the closing fair price: results(keys, outcome, fair_h, fair_d, fair_a)."""
    j = picks.join(results, list(keys), "left")
    won = F.col("outcome") == F.col("selection")
    close = F.when(F.col("selection") == "H", F.col("fair_h")).when(F.col("selection") == "D", F.col("fair_d")).otherwise(F.col("fair_a"))
    return j.withColumns({"status": F.when(F.col("outcome").isNull(), "pending").when(won, "won").otherwise("lost"),
                          "profit": F.round(F.when(won, F.col("stake") * (F.col("odds") - 1)).when(~won, -F.col("stake")), 2),
                          "clv": F.round(F.col("odds") / close - 1, 4)})


def settle_main(picks: DataFrame, scores: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Winner and totals settlement through matched events: refunds on an equal total, expiry after three days.

    picks(pick_id, event_id, start, market, side, line, odds), scores(score_id, completed, home_score, away_score),
    links(event_id, score_id, swapped).
    """
    j = picks.join(links, "event_id", "left").join(scores, "score_id", "left")
    total, diff = F.col("home_score") + F.col("away_score"), F.col("home_score") - F.col("away_score")
    side = F.when(F.col("swapped") & (F.col("side") == "home"), "away").when(F.col("swapped") & (F.col("side") == "away"), "home").otherwise(F.col("side"))
    outcome = F.when(diff > 0, "home").when(diff < 0, "away").otherwise("draw")
    won = F.when(F.col("market") == "total", F.when(F.col("side") == "over", total > F.col("line")).otherwise(total < F.col("line"))).otherwise(outcome == side)
    push = (F.col("market") == "total") & (total == F.col("line"))
    expired = F.unix_timestamp(now) > F.unix_timestamp("start") + 3 * 86400
    done = F.coalesce("completed", F.lit(False))
    return j.withColumns({"result": F.when(done & push, "refunded").when(done & won, "won").when(done, "lost").when(expired & F.col("score_id").isNull(), "expired").otherwise("open"),
                          "profit_units": F.when(done & push, 0.0).when(done, _profit(won))})


def settle_props(picks: DataFrame, games: DataFrame, now: Column, days: int = 1, starter_rule: bool = False) -> DataFrame:
    """Player bets against box scores within +-days of the game day.

    picks(pick_id, player_id, day, stat, line, odds, reg_only), games(player_id, day, goals, assists, ot_goals[, starter]).
    Overtime goals are excluded for regulation bets; a player without a row is refunded after three days; with
    `starter_rule`, substitutes void the bet. More than one candidate row leaves the bet open.
    """
    g = games.withColumn("_d", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days)))).withColumnsRenamed({"day": "game_day"})
    j = picks.join(g.withColumnRenamed("_d", "day"), ["player_id", "day"], "left")
    one = j.groupBy(*[F.col(c) for c in picks.columns]).agg(F.count("game_day").alias("_n"), F.min(F.struct("goals", "assists", "ot_goals", *(["starter"] if starter_rule else []))).alias("g"))
    goals = F.col("g.goals") - F.when(F.col("reg_only"), F.col("g.ot_goals")).otherwise(0)
    val = F.when(F.col("stat") == "Buts", goals).when(F.col("stat") == "Points", goals + F.col("g.assists")).otherwise(F.col("g.assists"))
    won = val > F.col("line")
    late = F.datediff(now, "day") > 3
    sub = (~F.col("g.starter")) if starter_rule else F.lit(False)
    return one.withColumns({"result": F.when((F.col("_n") == 1) & sub, "void").when((F.col("_n") == 1) & won, "won").when(F.col("_n") == 1, "lost").when((F.col("_n") == 0) & late, "refunded").otherwise("open"),
                            "profit_units": F.when((F.col("_n") == 1) & sub, 0.0).when(F.col("_n") == 1, _profit(won)).when((F.col("_n") == 0) & late, 0.0)}).drop("g", "_n")


def leg_result(leg: Column, h: Column, a: Column, goals: Column) -> Column:
    """Did a leg win? Null while a named player has no row. `goals` maps player id to goals."""
    k, mine, other = leg["kind"], F.when(leg["side"] == "h", h).otherwise(a), F.when(leg["side"] == "h", a).otherwise(h)
    need = F.coalesce(leg["k"], F.lit(1))
    return (F.when(k == "btts", (h > 0) & (a > 0)).when(k == "draw", h == a)
            .when(k.isin("over", "atleast"), h + a > F.coalesce(leg["line"], need - 0.5)).when(k == "under", h + a < leg["line"])
            .when(leg["player_id"].isNotNull(), goals[leg["player_id"]] >= need)
            .when(k == "win", mine > other).when(k == "not_lose", mine >= other).when(k == "win_nil", (mine > other) & (other == 0))
            .when(k == "margin", mine - other >= need).when(k.isin("goals_k", "scores"), mine >= need))


def settle_combined(picks: DataFrame, now: Column) -> DataFrame:
    """Combined bets (legs, home_score, away_score, goals map): every leg must win; a missing player refunds after three days."""
    done = F.col("home_score").isNotNull()
    r = picks.withColumn("_ok", F.transform("legs", lambda x: leg_result(x, F.col("home_score"), F.col("away_score"), F.col("goals"))))
    missing = F.exists("_ok", lambda x: x.isNull())
    won = F.forall("_ok", lambda x: x)
    late = F.unix_timestamp(now) > F.unix_timestamp("start") + 3 * 86400
    return r.withColumns({"result": F.when(done & missing & late, "refunded").when(done & ~missing & won, "won").when(done & ~missing, "lost").otherwise("open"),
                          "profit_units": F.when(done & missing & late, 0.0).when(done & ~missing, _profit(won))}).drop("_ok")


def price_labels(boosts: DataFrame, direct: Column, combo: Column, grid: Column) -> DataFrame:
    """Fair probability by the pricing order direct, combined market, score grid; verdict by the method's threshold."""
    p = F.coalesce(direct, combo, grid)
    sharp = F.coalesce(direct, combo).isNotNull()
    ev = p * F.col("odds") - 1
    return boosts.withColumns({"fair_prob": p, "method": F.when(sharp, "sharp").when(p.isNotNull(), "grid"), "ev": ev,
                               "verdict": F.when(p.isNull(), "not evaluable").when(ev >= F.when(sharp, 0.03).otherwise(0.08), "play").when(ev >= 0, "marginal").otherwise("avoid")})
