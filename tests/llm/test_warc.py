"""Archives round trip: splits inside records, magic inside payloads, ties, nulls."""
import hashlib

import pytest
from pyspark.sql import functions as F

from fairline.llm import op2_warc as W

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", INNER * 40), (6, "u", "ends in WARC/1.1\r\n"), (7, "u", "WARC/1.1\r\n" * 30),
            (8, "é", "größe\r\n\r\n" * 200), (2, None, big), (None, "u", "small"), (9, "u", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"), (10, "u", INNER * 40)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit(-1)).repartition(2)


def expected(rows):
    best = {}
    for r in rows:
        t = (r["html"] or "").encode()
        if len(t) >= 1000 and r["page_id"] is not None:
            best[t] = max(best.get(t, -1), r["page_id"])
    out = []
    for r in rows:
        t = (r["html"] or "").encode()
        again = t in best and best[t] != r["page_id"]
        out.append((r["page_id"], len(t), hashlib.sha1(t).hexdigest(), "revisit" if again else "response", best[t] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["333", "134217728"])
def test_round_trip_over_any_split(spark, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    p = pages(spark).cache()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((tuple(r) for r in W.round_trip(spark, p).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected(p.collect())


def test_empty_table(spark):
    assert W.round_trip(spark, pages(spark).where("page_id < 0")).count() == 0
