"""Ratings of a stream are the same whether results come in one trigger or in many."""
import os

from pyspark.sql import functions as F

from fairline.streaming import live


def test_elo_in_slices_is_that_of_one_trigger(spark, tmp_path):
    m = spark.range(300).select((F.col("id") % 3).cast("int").alias("country"), F.col("id").cast("decimal(38,0)").alias("match_id"),
                                F.when(F.col("id") < 295, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") * 37 % 100).cast("int"))).alias("match_date"),
                                F.concat(F.lit("T"), F.col("id") % 5).alias("home"), F.concat(F.lit("T"), (F.col("id") + 1 + F.col("id") % 3) % 5).alias("away"), (F.col("id") % 4 - 1).cast("int").alias("gd"))
    m.write.parquet(f"{tmp_path}/rows")
    whole = live.run_available(live.elo_stream(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/rows")), "whole", str(tmp_path))
    got = live.run_in_order(m, live.elo_stream, "sliced", str(tmp_path), "country", slice_rows=30)
    rows = lambda df: {r["match_id"]: tuple(r) for r in df.collect()}      # noqa: E731
    assert rows(got) == rows(whole) and got.count() == 300
    base = next(p for p in tmp_path.iterdir() if p.name.startswith("sliced-"))
    assert sum(not f.startswith(".") for f in os.listdir(base / "ckpt" / "commits")) >= 4


def test_replay_sends_rows_as_it_goes():
    import pandas as pd

    class Kept:
        def __init__(self):
            self.rows = {}

        def iterator(self):
            return iter(self.rows.items())

        def updateValue(self, key, value):
            self.rows[key] = value
    state = live.EloState()
    state.ratings = Kept()
    n = 2 * live.OUT_ROWS + 5
    pdf = pd.DataFrame({"match_id": range(n), "match_date": pd.Timestamp("2001-01-01").date(), "home": "A", "away": "B", "gd": 1})
    sizes = [len(x) for x in state.handleInputRows(("C",), iter([pdf.iloc[:n // 2], pdf.iloc[n // 2:]]), None)]
    assert sizes == [live.OUT_ROWS, live.OUT_ROWS, 5] and set(state.ratings.rows) == {("A",), ("B",)}
