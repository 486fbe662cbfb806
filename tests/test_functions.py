import math

import pytest
from pyspark.sql import functions as F

from fairline.functions import labels as Y
from fairline.functions import odds as O
from fairline.functions import score as S
from fairline.functions import stake as K
from fairline.functions import text as X
from fairline.models import goals

TRIPLES = [(1.5, 4.2, 7.0), (2.6, 3.3, 2.9), (1.9, 3.6, 4.5)]


@pytest.mark.parametrize("method", list(O.DEVIG))
def test_devig_sums_to_one_keeps_order_and_both_layouts_agree(spark, method):
    df = spark.createDataFrame([(*t,) for t in TRIPLES] + [(1.8, None, 2.0)], "a double, b double, c double")
    out = O.with_devig(df, ["a", "b", "c"], ["x", "y", "z"], method).withColumn("arr", O.devig(O.array_of("a", "b", "c"), method)).collect()
    for row in out[:3]:
        p = [row.x, row.y, row.z]
        assert abs(sum(p) - 1) < 1e-9
        assert sorted(range(3), key=lambda i: -p[i]) == sorted(range(3), key=lambda i: row[i])
        assert max(abs(a - b) for a, b in zip(p, row.arr)) < 1e-9
    assert out[3].x is None and out[3].arr is None


def test_known_values(spark):
    row = spark.range(1).select(
        O.power_exponent(O.array_of(F.lit(1.5), F.lit(4.2), F.lit(7.0))).alias("k"), O.overround(O.array_of(F.lit(2.0), F.lit(2.0))).alias("o"),
        K.kelly_fraction(F.lit(.5), F.lit(2.0)).alias("k0"), K.kelly_fraction(F.lit(.6), F.lit(2.0)).alias("k1"), K.kelly_fraction(F.lit(.3), F.lit(2.0)).alias("k2"),
        S.rps([F.lit(1 / 3)] * 3, F.lit(0)).alias("rps"), S.log_loss([F.lit(.5), F.lit(.25), F.lit(.25)], F.lit(0)).alias("ll"),
        S.p_score_given_goals(F.lit(2), F.lit(.5)).alias("pg"), S.p_more_than(F.lit(.4), F.lit(1.5)).alias("p2")).first()
    mu = -math.log(.6)
    assert abs(row.k - 1.0554179287751273) < 1e-12 and row.o == 1.0
    assert (row.k0, round(row.k1, 12), row.k2) == (0.0, 0.2, 0.0)
    assert abs(row.rps - 0.2777777777777778) < 1e-12 and abs(row.ll - math.log(2)) < 1e-12
    assert row.pg == .75 and abs(row.p2 - (1 - math.exp(-mu) * (1 + mu))) < 1e-12


def test_names_and_legs(spark):
    df = spark.createDataFrame([("Paris SG", "Paris Saint-Germain"), ("Sunderland", "Salernitana")], "a string, b string")
    n = df.select(X.norm_name("a").alias("a"), X.norm_name("b").alias("b"))
    sims = [x[0] for x in n.select(X.similarity(F.col("a"), F.col("b"))).collect()]
    assert sims[0] >= .95 and sims[1] < .8
    t = spark.createDataFrame([("Le PSG gagne et Dembélé marque",), ("Plus de 2,5 buts",), ("Quelque chose d'autre",)], "t string")
    legs = [x[0] for x in t.select(Y.parse_legs("t")).collect()]
    assert [(g.kind, g.who) for g in legs[0]] == [("win", "psg"), ("scores", "dembele")]
    assert legs[1][0].kind == "over" and legs[1][0].line == 2.5 and legs[2] is None


def test_market_goals_and_grid_round_trip(spark):
    import numpy as np
    from fairline.models.goals import _home_share, _over, fit_grids, implied_goals
    lam, mu, line = np.array([3.4, 2.1]), np.array([2.6, 3.0]), np.array([5.5, 6.0])
    back = implied_goals(_home_share(lam, mu, 21, True), _over(lam + mu, line), line, True)
    assert np.abs(back - np.column_stack([lam, mu])).max() < 1e-3
    g = fit_grids(np.array([.55]), np.array([.24]), np.array([[2.5]]), np.array([[.55]]))
    assert g[0, 3] < 1e-4
    df = spark.createDataFrame([(1, .55, .24, [2.5], [.55])], "id int, h double, d double, l array<double>, o array<double>")
    df = df.withColumn("g", goals.score_grid("h", "d", "l", "o")).select("id", "g.*")
    ev = goals.event_probabilities(df, ["id"], "lam_h", "lam_a", "rho", {"h": goals.indicator(lambda h, a: h > a), "d": goals.indicator(lambda h, a: h == a), "o": goals.indicator(lambda h, a: h + a > 2.5)}).first()
    assert abs(ev.h - .55) < 1e-4 and abs(ev.d - .24) < 1e-4 and abs(ev.o - .55) < 1e-4


def test_score_cells_are_summed_for_many_rows(spark, monkeypatch):
    """Events of the score alone need no row per cell, with the sums of the cells; fits that are met leave the others."""
    import numpy as np
    from pyspark.sql import functions as F

    from fairline.models import goals
    df = spark.createDataFrame([(1, 1.4, 1.1, -0.05, 0.3), (2, 0.4, 2.2, 0.1, 0.3), (2, 0.4, 2.2, 0.1, 0.3), (3, 2.0, float("nan"), 0.0, 0.3)], "id int, x double, y double, rho double, share double")
    ev = {"h": goals.indicator(lambda h, a: h > a), "two": lambda h, a: goals.players_factor(h, [F.lit(0.3), F.lit(0.2)])}
    alone = goals.event_probabilities(df, ["id"], "x", "y", "rho", ev)
    assert "explode" not in alone._jdf.queryExecution().optimizedPlan().toString()
    of_rows = {**ev, "one": lambda h, a: goals.players_factor(h, [F.col("share")])}
    monkeypatch.setattr(goals, "_cell_weights", lambda *a: None)
    want = goals.event_probabilities(df, ["id"], "x", "y", "rho", ev)
    got, want = sorted(map(tuple, alone.collect())), sorted(map(tuple, want.collect()))
    assert [x[0] for x in got] == [1, 2, 3] and np.allclose([x[1:] for x in got], [x[1:] for x in want], atol=1e-12, equal_nan=True)
    monkeypatch.undo()
    assert goals._cell_weights(spark, of_rows) is None

    seen, grid = [], goals._grid
    monkeypatch.setattr(goals, "_grid", lambda x: seen.append(len(x)) or grid(x))
    p = goals._grid(np.log(np.column_stack([np.linspace(0.8, 2, 50), np.linspace(1.5, 0.7, 50), np.full(50, np.exp(-0.05))])))
    h, a = np.indices((11, 11))
    seen.clear()
    fit = goals.fit_grids(p[:, h > a].sum(1), p[:, h == a].sum(1), np.full((50, 1), 2.5), p[:, h + a > 2.5].sum(1)[:, None])
    assert fit[:, 3].max() < 1e-9 and np.allclose(fit[:, 0], np.linspace(0.8, 2, 50), atol=1e-6) and sum(seen) < 50 * 60
