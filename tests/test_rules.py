"""Cases that must hold off the fixtures: no cut on a part of a sum, no clip, no lost letter, one pick a key."""
import datetime as dt

from pyspark.sql import functions as F

from fairline.functions import text as X
from fairline.models.boosting import season_boosting
from fairline.operators import fuzzy, groups
from fairline.plans import live


def test_match_keys_do_not_collide(spark):
    import re
    from fairline.queries.views import VIEWS
    expr = re.search(r"select (.*?) as match_id", VIEWS["match_base"], re.S)[1]
    rows = [(600_000_000_000, 20_000_000_000, 1_000_000_000, 7), (1, 100_000, 1, 1), (2, 0, 1, 1), (1, 1, 10_000, 1), (1, 2, 0, 1), (1, 1, 1, 1), (1, 1, 1, 2)]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    assert d.selectExpr(f"{expr} as k").distinct().count() == len(rows)


def test_shares_of_large_predictors(spark):
    d = spark.createDataFrame([(1, 700.0), (1, 610.0), (2, -5000.0), (2, -5000.0), (3, 0.0), (3, 299.9), (3, 300.1)], "g int, eta double")
    got = {(r["g"], r["eta"]): r["share"] for r in groups.softmax_share(d, ["g"], F.col("eta")).collect()}
    assert got[1, 700.0] > 0.999999 and got[1, 610.0] < 1e-30 and got[2, -5000.0] == 0.5
    assert abs(got[3, 300.1] - 1 / (1 + 2.718281828459045 ** -0.2)) < 1e-9 and abs(sum(v for (g, _), v in got.items() if g == 3) - 1) < 1e-12


def test_characters_that_fold_to_several(spark):
    d = spark.createDataFrame([("ﬁorentina",), ("Ⅳ sport",), ("№5",), ("𝐂lub é",), ("日本 fc",)], "t string")
    assert [r[0] for r in d.select(X.fold_accents("t")).collect()] == ["fiorentina", "IV sport", "No5", "Club e", " fc"]


def test_alias_by_the_sum_of_both_names(spark):
    day, kind = dt.date(2024, 1, 1), "id int, league string, day date, home string, away string"
    left = spark.createDataFrame([(1, "L", day, "alpha", "omega town")], kind)
    right = spark.createDataFrame([(9, "L", day, "alphonso k", "omega town"), (8, "L", day, "beta", "gamma")], kind)
    assert [tuple(r) for r in fuzzy.alias_votes(left, right, 1.3).collect()] == [("L", "alpha", "alphonso k")]


def test_one_pick_a_key(spark):
    t = dt.datetime(2024, 1, 1)
    kind = "event string, selection string, book string, start timestamp, odds double, detected_at timestamp, fair_odds_at_pick double, market_key string"
    picks = spark.createDataFrame([("e", "s", "b", t + dt.timedelta(days=2), 2.1, t + dt.timedelta(hours=1), 2.0, "m"), ("e", "s", "b", t + dt.timedelta(days=2), 2.0, t, 1.9, "m")], kind)
    ticks = spark.createDataFrame([], "market_key string, selection string, ts timestamp, fair_odds double")
    led = live.upsert_picks(picks.where("odds < 0"), picks, ticks, F.lit(t + dt.timedelta(days=1))).collect()
    assert len(led) == 1 and led[0]["odds"] == 2.0 and led[0]["fair_odds_last"] == 1.9


def test_units_and_props_do_not_meet(spark):
    kind = "event_id string, market string, selection string, line double, home string, away string, unit string, is_prop boolean"
    rows = [("s", "total", "Plus", 2.5, "a", "b", "goals", False), ("s", "total", "Plus", 2.5, "a", "b", "corners", False), ("s", "total", "Plus", 2.5, "a", "b", "goals", True)]
    sharp = spark.createDataFrame([(*r, p) for r, p in zip(rows, (0.5, 0.9, 0.95))], kind + ", fair_prob double")
    soft = spark.createDataFrame([("e", "total", "Over", 2.5, "a", "b", "goals", False, "bk", 2.1)], kind + ", book string, odds double")
    matched = spark.createDataFrame([("e", "s", False)], "left_id string, right_id string, swapped boolean")
    got = live.compare_with_sharp(sharp, soft, matched).collect()
    assert [(r["fair_prob"], round(r["ev"], 6)) for r in got] == [(0.5, 0.05)]


def test_pairs_over_many_slices(spark):
    from fairline.operators import reshape
    d = spark.range(0, 4000).select(F.col("id").alias("o"), (F.col("id") * 977).alias("s"), F.concat(F.lit("t"), "id").alias("t"))
    got = reshape.pair_consecutive(d, "o", ["t"], "s").collect()
    assert sorted((r["game_no"], r["t_v"], r["t_h"]) for r in got) == [(k, f"t{2 * k}", f"t{2 * k + 1}") for k in range(2000)]


def test_boosting_keeps_every_row(spark):
    d = spark.createDataFrame([(s, float(i % 7) if i % 5 else None, i % 2) for s in (2000, 2001, 2002) for i in range(60)], "season int, x double, y int")
    out = season_boosting(d, ["x"], "y", 2, "gb", [2000, 2002], trees=2, min_rows=50)
    assert out.groupBy("season").count().orderBy("season").collect() == [(2000, 60), (2002, 60)]
    assert out.where("season = 2002 AND x IS NOT NULL AND gb_p IS NULL").count() == 0 and out.where("x IS NULL AND gb_p IS NOT NULL").count() == 0
