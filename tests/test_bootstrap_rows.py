"""Every bet of a bootstrap draws for itself."""
from pyspark.sql import functions as F

from fairline.operators import evaluate


def test_every_row_draws(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0, 2.0) for i in range(200)], "k int, id int, won boolean, odds double")
    plan = evaluate.bootstrap_roi(df, ["k"], F.col("id"), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in plan
    row = evaluate.bootstrap_roi(df, ["k"], F.col("id"), 400).first()
    assert -0.2 < row["roi_low"] < -0.08 and 0.08 < row["roi_high"] < 0.2


def test_draws_are_those_of_the_digests(spark):
    """Ids of all lengths, none at all, null and infinite profits: the sums are those of digests taken one by one, and rows are no draws in the plan."""
    import hashlib
    import math

    import numpy as np
    rows = [(i % 3 if i % 10 else None, None if i == 5 else ("x" * (i % 70)) + str(i), 1.0, None if i == 9 else float("inf") if i == 11 else 0.1 * i - 2) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, id string, s double, g double")
    boot = evaluate.bootstrap_roi(df, ["k"], F.col("id"), 50, stake=F.col("s"), pnl=F.col("g"))
    assert "explode" not in boot._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["roi_low"], r["roi_high"], r["p_roi_le0"]) for r in boot.collect()}
    want = {}
    for k in (None, 0, 1, 2):
        rois = []
        for rep in range(50):
            sg = ss = n = 0
            for kk, i, s, g in rows:
                if kk != k:
                    continue
                h = hashlib.md5((f"{i}|" if i is not None else "").encode() + str(rep // 4).encode()).hexdigest()
                w = sum(int(h[8 * (rep % 4):8 * (rep % 4) + 8], 16) / 2 ** 32 >= c for c in evaluate.POISSON1_CDF)
                n += w
                ss += w * s
                if w and g is not None:
                    sg += w * g
            if n:
                rois.append(sg / ss)
        want[k] = (*np.percentile(rois, [2.5, 97.5]), float(np.mean([x <= 0 for x in rois])))
    assert set(got) == set(want)
    for k in want:
        assert all(math.isclose(a, b, rel_tol=1e-9) or a == b or (math.isnan(a) or math.isnan(b)) and k == 2 for a, b in zip(got[k], want[k])), (k, got[k], want[k])
