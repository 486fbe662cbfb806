"""Exact medians against numpy, whatever the sizes of groups and ranges."""
import numpy as np
import pytest

from fairline.operators.median import exact_median


@pytest.mark.parametrize("bins, limit", [(1024, 4096), (4, 3)])
def test_median_of_groups(spark, bins, limit):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501), "b": rng.normal(size=300) * 1e9, "c": np.array([0.0] * 50 + [1.0] * 50), "d": np.array([7.0]), "e": np.array([-1e308, 1e308]), None: np.round(rng.exponential(size=200), 1), "g": np.array([3.0] * 40)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r["k"]: r["median"] for r in exact_median(df, "x", ["k"], bins=bins, limit=limit).collect()}
    assert got == {k: float(np.median(x)) if k != "e" else 0.0 for k, x in groups.items()}
    every = np.concatenate(list(groups.values()))
    assert exact_median(df, "x", bins=bins, limit=limit).collect()[0][0] == float(np.median(every))
    assert exact_median(df.where("x > 1e308"), "x").count() == 0
