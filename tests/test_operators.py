import datetime as dt

from pyspark.sql import functions as F

from fairline.operators import fuzzy
from fairline.plans import backtest as B
from fairline.plans import live as L


def ts(h, d=1):
    return dt.datetime(2026, 10, d, h)


def test_match_events_is_strict_and_abstains(spark):
    s = "event_id string, start timestamp, home string, away string"
    left = spark.createDataFrame([("l1", ts(15), "Paris SG", "RC Lens"), ("l2", ts(15), "Sunderland", "Leeds"), ("l3", ts(18), "Lyon", "Nice")], s)
    right = spark.createDataFrame([("r1", ts(16), "Paris Saint-Germain", "Lens"), ("r2", ts(15), "Salernitana", "Leeds"),
                                   ("r3", ts(18), "Lyon", "Nice"), ("r4", ts(19), "Lyon", "Nice"), ("r5", ts(15, 5), "Sunderland", "Leeds")], s)
    got = {r.left_id: r.right_id for r in fuzzy.match_events(left, right).collect()}
    assert got == {"l1": "r1"}
    swapped = fuzzy.match_events(left.where("event_id = 'l1'"), spark.createDataFrame([("x", ts(15), "Lens", "PSG")], s), swap_ok=True).collect()
    assert swapped[0].right_id == "x" and swapped[0].swapped


def test_ledger_flat_and_compounding(spark):
    d = dt.date(2024, 1, 1)
    bets = spark.createDataFrame([(d, .6, 2.0, True), (d, .6, 2.0, False), (d + dt.timedelta(1), .6, 2.0, True)], "match_date date, p double, odds double, won boolean")
    led = {(r.policy, r.match_date): r.bankroll for r in B.ledger(bets).collect()}
    last = d + dt.timedelta(1)
    assert abs(led[("flat_1pct", last)] - 1010) < 1e-9
    assert abs(led[("kelly_1_4", last)] - 1000 * 1.05) < 1e-9
    rep = {r.policy: r for r in B.staking_report(B.ledger(bets)).collect()}
    assert rep["flat_1pct"].n_bets == 3 and rep["flat_1pct"].max_drawdown == 0


def test_three_way_books_are_not_compared_with_two_way_markets(spark):
    sharp = spark.createDataFrame([("s", "moneyline", "A", None, .6, "A", "B"), ("s", "moneyline", "B", None, .4, "A", "B")],
                                  "event_id string, market string, selection string, line double, fair_prob double, home string, away string")
    soft = spark.createDataFrame([("f", "two", "moneyline", "A", None, 1.8, "A", "B"), ("f", "three", "moneyline", "A", None, 2.4, "A", "B"), ("f", "three", "moneyline", "Nul", None, 4.0, "A", "B")],
                                 "event_id string, book string, market string, selection string, line double, odds double, home string, away string")
    link = spark.createDataFrame([("f", "s", False)], "left_id string, right_id string, swapped boolean")
    got = L.compare_with_sharp(sharp, soft, link).collect()
    assert [(r.book, round(r.ev, 6)) for r in got] == [("two", .08)]


def test_combined_settlement_waits_for_missing_players_then_refunds(spark):
    leg = "array<struct<kind: string, side: string, line: double, k: int, player_id: long>>"
    rows = [(1, ts(1), 3.0, 2, 1, [("win", "h", None, None, None), ("scores", "h", None, None, 7)], {7: 1}), (2, ts(1), 3.0, 2, 1, [("scores", "h", None, None, 8)], {7: 1})]
    df = spark.createDataFrame(rows, f"id int, start timestamp, odds double, home_score int, away_score int, legs {leg}, goals map<bigint, int>")
    early = {r.id: r.result for r in L.settle_combined(df, F.lit("2026-10-02").cast("timestamp")).collect()}
    late = {r.id: r.result for r in L.settle_combined(df, F.lit("2026-10-09").cast("timestamp")).collect()}
    assert early == {1: "won", 2: "open"} and late == {1: "won", 2: "refunded"}


def test_mixed_and_implausible_prices_drop_the_whole_book_event(spark):
    rows = [("b", "e", "X", "Buts", .5, 2.0), ("b", "e", "X", "Buts", .5, 50.0), ("b", "e", "Y", "Buts", .5, 3.0), ("c", "e", "X", "Buts", .5, 2.0), ("c", "e", "X", "Buts", .5, 2.0)]
    df = spark.createDataFrame(rows, "book string, ub_event_id string, player string, stat string, line double, odds double")
    assert [r.book for r in L.drop_mixed_markets(df).collect()] == ["c"]
