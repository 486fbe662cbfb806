"""Folds and fits that run many jobs work out their input once, not once per job."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairline.models import fits, ratings
from fairline.queries import model_queries


@pytest.fixture
def counted(spark):
    """A column passed through, and how often its values were asked for."""
    seen = spark.sparkContext.accumulator(0)

    def through(c, kind):
        def f(x):
            seen.add(1)
            return x
        return F.udf(f, kind).asNondeterministic()(c)
    return through, seen


def test_slices_share_one_reading(spark, counted):
    through, seen = counted
    m = spark.range(400).select(F.col("id").alias("match_id"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("match_date"), F.lit(2001).alias("season"),
                                F.lit("C").alias("country"), F.concat(F.lit("T"), F.col("id") % 5).alias("home"), F.concat(F.lit("T"), (F.col("id") + 1 + F.col("id") % 3) % 5).alias("away"), (F.col("id") % 4).cast("int").alias("fthg"), F.lit(1).alias("ftag"))
    whole = {r["match_id"]: r["elo_diff"] for r in ratings.run_fold(m, ratings.football_elo(), ["country"], "match_id", "match_date")[0].collect()}
    got = ratings.run_fold(m.withColumn("fthg", through("fthg", "int")), ratings.football_elo(), ["country"], "match_id", "match_date", slice_rows=50)[0]
    assert {r["match_id"]: r["elo_diff"] for r in got.collect()} == whole and len(whole) == 400
    assert seen.value <= 800


def test_fit_shares_one_reading(spark, counted):
    through, seen = counted
    rng = np.random.default_rng(3)
    rows = [(2000 + i % 4, float(rng.normal()), int(rng.integers(0, 3)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "season int, d double, y int, match_id long").withColumn("d", through("d", "double"))
    assert model_queries.season_ordered(df, "d", "p").where("p_ph is not null").count() == 150
    assert seen.value <= 900


@pytest.mark.parametrize("whole", [1000, 2])
def test_conditional_logit(spark, counted, whole, monkeypatch):
    monkeypatch.setattr(fits, "WHOLE", whole)
    through, seen = counted
    rng = np.random.default_rng(4)
    rows = [(i % 2, i // 8, float(rng.normal()), float(rng.normal()), float(rng.integers(0, 5) == 0)) for i in range(800)] + [(0, 1000, None, 1.0, 1.0), (0, 1000, 1.0, 0.0, 0.0), (0, None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, grp int, a double, b double, goals double")
    got = fits.fit_conditional_logit(df.withColumn("a", through("a", "double")), ["grp"], ["a", "b"], "goals", [0.0, 0.0])
    if whole == 1000:
        assert seen.value <= 5 * len(rows)
    for f in (0, 1):
        groups = {}
        for fold, g, a, b, y in rows:
            if fold == f and g is not None and g < 1000:
                groups.setdefault(g, []).append((a, b, y))
        beta = np.array(got[f])
        grad = 2 * beta
        for r in groups.values():
            x, y = np.array([(a, b) for a, b, _ in r]), np.array([v for *_, v in r])
            e = np.exp(x @ beta)
            grad = grad + y.sum() * (e / e.sum()) @ x - y @ x
        if f == 1:
            assert np.abs(grad).max() < 1e-6
        else:
            assert np.abs(grad).max() < 1.5      # the group with a null adds its own part


def test_groups_of_a_conditional_fit_are_met_once(spark, counted, monkeypatch):
    """Rows are read once to be brought together, and groups too large to be held, or with missing values, give the same fit; null keys are no group."""
    through, seen = counted
    rng = np.random.default_rng(4)
    rows = [(1 + i % 2, i // 12, float(rng.normal()), int(rng.integers(0, 3))) for i in range(480)] + [(1, None, 0.1, 1), (1, 900, 0.4, 0), (1, 900, 0.2, 0)]
    df = spark.createDataFrame(rows, "fold int, game int, a double, goals int")
    want = fits.fit_conditional_logit(df, ["game"], ["a"], "goals", [0.0])
    got = fits.fit_conditional_logit(df.withColumn("goals", through("goals", "int")), ["game"], ["a"], "goals", [0.0])
    assert seen.value <= len(rows) and all(np.allclose(got[f], want[f]) for f in (1, 2))
    monkeypatch.setattr(fits, "WHOLE", 5)
    large = fits.fit_conditional_logit(df, ["game"], ["a"], "goals", [0.0])
    assert all(np.allclose(large[f], want[f], atol=1e-7) for f in (1, 2))
