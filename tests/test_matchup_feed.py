"""The matchup feed on odd rows: repeated markets and matchups, equal names, specials, missing prices; and how often its rows are dealt."""
import datetime as dt
from decimal import Decimal

import pytest

from fairline.sources import feeds

MATCHUPS = "id {0}, parent_id {0}, type string, is_live boolean, start timestamp, home string, away string, category string, description string"
MARKETS = ("matchup_id {0}, key string, market_type string, period int, status string, is_alternate boolean, "
           "prices array<struct<designation: string, participant: string, points: double, price: double>>")
DAY = dt.datetime(2024, 1, 1)


def feed(spark, kind, make):
    game = lambda i, home="A", away="B", live=False: (make(i), None, "matchup", live, DAY, home, away, None, None)      # noqa: E731
    matchups = [game(1), game(2, "X (Games)", "Y (Games)"), game(3), game(3), game(4, "S", "S"), game(5, live=True), game(6, "Q (x)"),
                (make(7), make(1), "special", False, DAY, None, None, "Cat", "Desc"), (make(8), make(99), "special", False, DAY, None, None, "Cat", "none"),
                (make(9), make(5), "special", False, DAY, None, None, None, "Live"), game(10), game(11), game(None)]
    three = [("home", None, None, 100.0), ("draw", None, None, 150.0), ("away", None, None, -110.0)]
    props = [("x", "P", None, -120.0), ("x", "R", None, 105.0), ("x", None, None, 300.0)]
    line = lambda i, prices, key="m", **k: (make(i), key, k.get("type", "moneyline"), k.get("period", 0), k.get("status", "open"), k.get("alt", False), prices)      # noqa: E731
    markets = [line(1, three), line(2, three[:2], status=None), line(3, three), line(4, three), line(5, three), line(6, three), line(7, props, alt=None, type="special"), line(8, props), line(9, props),
               line(1, three, period=1), line(1, three, status="closed"), line(1, three[:1]), line(1, three, alt=True), line(1, three[::2], key=None),
               line(10, three), line(10, [("home", None, None, 130.0), ("draw", None, None, 120.0), ("home", None, None, None)]), line(10, three[:2], key="n"),
               line(11, [("home", None, None, 100.0), ("away", None, None, None)]), line(11, [("over", None, 2.5, 100.0), ("over", None, 2.5, 110.0)], key="t", type="total"), line(None, three)]
    return spark.createDataFrame(matchups, MATCHUPS.format(kind)), spark.createDataFrame(markets, MARKETS.format(kind))


def power(odds):
    low, high = 0.2, 5.0
    for _ in range(80):
        k = (low + high) / 2
        low, high = (k, high) if sum(o ** -k for o in odds) > 1 else (low, k)
    w = [o ** -low for o in odds]
    return [x / sum(w) for x in w]


HOME, DRAW, AWAY = 2.0, 2.5, 1 + 100 / 110
WANT = {"1|m": {"A": (1, HOME), "Nul": (1, DRAW), "B": (1, AWAY)}, "1": {"A": (1, HOME), "B": (1, AWAY)}, "2|m": {"X": (1, HOME), "Nul": (1, DRAW)},
        "3|m": {"A": (2, HOME), "Nul": (2, DRAW), "B": (2, AWAY)}, "4|m": {"S": (2, HOME), "Nul": (1, DRAW)},
        "7|m": {None: (0, 4.0), "P": (1, 1 + 100 / 120), "R": (1, 2.05)}, "9|m": {None: (0, 4.0), "P": (1, 1 + 100 / 120), "R": (1, 2.05)},
        "10|m": {"A": (3, 2.3), "Nul": (2, DRAW), "B": (1, AWAY)}, "10|n": {"A": (1, HOME), "Nul": (1, DRAW)}}
# an outcome without any price takes its market out, as one outcome alone does


@pytest.mark.parametrize("kind,make", [("bigint", lambda i: i), ("decimal(38,0)", lambda i: None if i is None else Decimal(i)), ("string", lambda i: None if i is None else str(i))])
def test_rows(spark, kind, make):
    got = {}
    for r in feeds.matchup_odds(*feed(spark, kind, make)).collect():
        got.setdefault((r["market_key"], r["selection"]), []).append(r)
    want = {}
    for key, best in WANT.items():
        odds = [o for _, o in best.values()]
        want |= {(key, s): (n, p) for (s, (n, _)), p in zip(best.items(), power(odds)) if n}
    assert {k: len(v) for k, v in got.items()} == {k: n for k, (n, _) in want.items()}
    for k, rows in got.items():
        for r in rows:
            assert r["fair_prob"] == pytest.approx(want[k][1], abs=1e-9), k
    assert sorted(r["pin_odds"] is None for r in got["10|m", "A"]) == [False, False, True]
    special = got["7|m", "P"][0]
    assert (special["event_id"], special["event"], special["market"], special["is_prop"]) == (make(1), "A - B", "Cat: Desc", True)
    assert got["2|m", "X"][0]["unit"] == "jeux" and got["9|m", "P"][0]["event_id"] == make(5)


def test_markets_and_matchups_are_dealt_once(spark):
    out = feeds.matchup_odds(*feed(spark, "bigint", lambda i: i))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # markets, matchups, and specials with their parents
    assert plan.count("Exchange hashpartitioning") <= 4, plan
