"""Joins of sides that grow with the input send neither through the driver."""
from pyspark.sql import functions as F

from fairline.operators import fuzzy
from fairline.plans import backtest, labels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark):
    e = spark.range(40).withColumn("start", F.timestamp_seconds(F.col("id") * 3600))
    name = lambda p: F.concat(F.lit(p), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 7), "0123456789", "ghijklmnop"))
    return e.withColumns({"home": name("h"), "away": name("a")})


def test_nearest_date_link(spark):
    e = events(spark).withColumnRenamed("id", "event_id").withColumn("league", F.lit(1))
    got = fuzzy.match_nearest(e, e, ["league"])
    assert "BroadcastExchange" not in plan(got)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == {(i, i) for i in range(40)}


def test_events_of_labels(spark):
    e = events(spark).withColumnRenamed("id", "event")
    b = e.select(F.col("event").alias("boost_id"), "start", F.concat_ws(" - ", "home", "away").alias("label"))
    got = labels.find_events(b, e)
    assert "BroadcastExchange" not in plan(got)
    assert {(r["boost_id"], r["event"]) for r in got.collect()} == {(i, i) for i in range(40)}


def test_verdicts(spark):
    e = events(spark).withColumnRenamed("id", "event").withColumns({"lam_h": F.lit(1.2), "lam_a": F.lit(1.1)})
    b = e.select(F.col("event").alias("boost_id"), "start", F.concat_ws(" - ", "home", "away").alias("label"), F.concat(F.lit("Victoire de "), "home").alias("text"), F.lit(2.0).alias("odds"))
    prices = e.select("event", F.lit("moneyline").alias("market"), F.lit(None).cast("double").alias("line"), F.col("home").alias("selection"), F.lit(0.6).alias("prob"))
    players = e.select("event", F.col("event").alias("player_id"), F.lit("Jean Zzz").alias("player"), F.lit(0.2).alias("prob"))
    got = labels.evaluate_labels(b, e, prices, players)
    assert "BroadcastExchange" not in plan(got)
    assert {(r["event"], r["key"], r["verdict"]) for r in got.collect()} == {(i, "win:h", "play") for i in range(40)}


def test_picks_of_a_grid_are_not_shuffled(spark):
    odds = spark.createDataFrame([(1, 2000, 0.5, 2.2, True), (2, 2000, 0.4, 2.2, False), (2, 2000, 0.5, 3.0, True), (None, 2001, 0.5, 2.1, None)],
                                 "match_id int, season int, p double, o double, won boolean")
    df = odds.select("match_id", "season", "p", (1 - F.col("p")).alias("q"), "o", F.lit(1.5).alias("u"), "won", (~F.col("won")).alias("lost"))
    configs = [dict(family="f", prob="m", book="b", min_ev=e, max_odds=t) for e in (0.02, 0.08) for t in (2.5, 10.0)]
    bets, table = backtest.strategy_grid(df, configs, {"m": ["p", "q"]}, {"b": ["o", "u"]}, ["won", "lost"], ["H", "A"], ["match_id", "season"], max_ev=0.6)
    assert "hashpartitioning" not in plan(bets)
    got = sorted((r["config_id"], r["match_id"] or 0, round(r["ev"], 6), r["won"]) for r in bets.collect())
    assert got == [(0, 0, 0.05, None), (0, 1, 0.1, True), (1, 0, 0.05, None), (1, 1, 0.1, True), (1, 2, 0.5, True), (2, 1, 0.1, True), (3, 1, 0.1, True), (3, 2, 0.5, True)]
    assert table.count() == 4
