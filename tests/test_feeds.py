"""Feeds side by side: a broken one stops alone, restarts add nothing twice, leftovers of a broken attempt are replaced."""
from pyspark.sql import functions as F

from fairline.streaming import feeds


def test_feeds_are_isolated_and_restart(spark, tmp_path):
    schema = "k long, v double"
    folder, into = str(tmp_path / "out"), {x: str(tmp_path / x) for x in ("a", "b", "c")}
    for n, path in enumerate(into.values()):
        spark.createDataFrame([(i, float(i)) for i in range(10 * n, 10 * n + 10)], schema).repartition(3).write.parquet(path)
    stream = lambda x: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(into[x])
    down = stream("b").withColumn("v", F.when(F.col("k") == 15, F.raise_error(F.lit("b is down")).cast("double")).otherwise(F.col("v")))
    # what an attempt at the first epoch left behind before it broke off
    spark.createDataFrame([(99, 9.0)], schema).write.parquet(f"{folder}/rows/source=a/epoch=0")
    first = {r["source"]: r for r in feeds.run_feeds({"b": down, "a": stream("a"), "c": stream("c")}, folder).collect()}
    assert (first["a"]["status"], first["b"]["status"], first["c"]["status"]) == ("complete", "failed", "complete")
    assert "b is down" in first["b"]["error"] and first["a"]["error"] is None and first["a"]["input_rows"] == 10
    held = lambda: sorted((r["source"], r["k"]) for r in feeds.feed_rows(spark, folder, stream("a").schema).collect())
    assert [x for x in held() if x[0] != "b"] == [("a", k) for k in range(10)] + [("c", k) for k in range(20, 30)]
    second = {r["source"]: r for r in feeds.run_feeds({x: stream(x) for x in "abc"}, folder).collect()}
    assert {r["status"] for r in second.values()} == {"complete"} and second["a"]["input_rows"] == 0
    assert held() == [(x, k) for n, x in enumerate("abc") for k in range(10 * n, 10 * n + 10)]
    spark.createDataFrame([(50, 1.0)], schema).write.mode("append").parquet(into["a"])
    feeds.run_feeds({x: stream(x) for x in "abc"}, folder)
    assert len(held()) == 31
    assert feeds.feed_rows(spark, str(tmp_path / "none"), stream("a").schema).count() == 0
