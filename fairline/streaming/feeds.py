"""Feeds side by side: a source that fails stops its own query and no other.

Each source is a streaming query with a checkpoint of its own. A batch is written to the folder of its (source, epoch), in place of what
an attempt that broke off may have left there, so a restart from the checkpoint adds no row twice. Tables of all sources lie below one
folder and are read as one table; a source that was never written is simply not there yet.
"""
from __future__ import annotations

import re
import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

STATUS = "source string, status string, epochs long, input_rows long, error string"


class FeedLog(StreamingQueryListener):
    """What became of each query: progress by epoch, and the error of a query that ended with one."""

    def __init__(self) -> None:
        self.rows: dict[str, dict[int, int]] = {}
        self.errors: dict[str, str | None] = {}
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._news:
            self.rows.setdefault(str(event.progress.runId), {})[event.progress.batchId] = event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self.errors[str(event.runId)] = event.exception
            self._news.notify_all()

    def ended(self, run: str, seconds: float) -> bool:
        """Events come after the query's end; wait for the last one."""
        with self._news:
            return self._news.wait_for(lambda: run in self.errors, seconds)


def _reason(error: str | None) -> str | None:
    """The innermost message that carries an error class, else the first line."""
    if not error:
        return None
    named = re.findall(r"\[[A-Z][A-Z0-9_.]*\][^\n]*", error)
    return named[-1] if named else error.strip().split("\n")[0]


def _writer(folder: str, source: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/source={source}/epoch={epoch}")
    return write


def run_feeds(sources: Mapping[str, DataFrame], folder: str, patience: float = 30.0) -> DataFrame:
    """Take in all that the sources hold now, each on its own; returns a row per source with what became of it.

    Source names are folder names. Call it again with the same folder to go on where each source stopped.
    """
    spark = next(iter(sources.values())).sparkSession
    log = FeedLog()
    spark.streams.addListener(log)
    rows = []
    try:
        running, refused = {}, {}
        for name, df in sources.items():
            try:
                running[name] = (df.writeStream.foreachBatch(_writer(folder, name)).option("checkpointLocation", f"{folder}/state/{name}")
                                 .trigger(availableNow=True).start())
            except Exception as e:                                        # a source may fail before it starts, as on a changed schema
                refused[name] = e
        for name, q in running.items():
            try:
                q.awaitTermination()
                error = None
            except Exception as e:                                        # recorded below; the others go on
                error = str(e)
            if log.ended(str(q.runId), patience):
                error = log.errors[str(q.runId)]
            epochs = log.rows.get(str(q.runId), {})
            rows.append((name, "failed" if error else "complete", sum(1 for n in epochs.values() if n), sum(epochs.values()), _reason(error)))
        rows += [(name, "failed", 0, 0, _reason(str(e)) or type(e).__name__) for name, e in refused.items()]
    finally:
        spark.streams.removeListener(log)
    return spark.createDataFrame(rows, STATUS)


def feed_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of all sources taken in so far, with their source and epoch."""
    full = T.StructType([*schema.fields, T.StructField("source", T.StringType()), T.StructField("epoch", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def feed_report(status: DataFrame, rows: DataFrame) -> DataFrame:
    """Status per source with the number of rows that its table holds."""
    held = rows.groupBy("source").agg(F.count(F.lit(1)).alias("held"))
    return status.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
