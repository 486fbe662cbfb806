"""Stream queries on data later than the supplied tables."""
from pyspark.sql import functions as F

from fairline.queries.stream_queries import l16


def test_windows_of_later_data(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("ts", (F.col("ts").cast("timestamp") + F.expr("interval 40 days")).cast("timestamp_ntz"))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    # a table is one file, as supplied
    one = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    folder = tmp_path / "later"
    folder.mkdir()
    (folder / "events.parquet").write_bytes(one.read_bytes())
    got = l16(spark, str(folder)).agg(F.count(F.lit(1)).alias("k"), F.max("window_start").alias("w")).first()
    assert got["k"] > 0 and got["w"] > "2024-02-10"
