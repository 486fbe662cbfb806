"""Session helpers: local session for tests, and lineage cutting through the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "fairline", driver_memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session and settings."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.driver.memory", driver_memory)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             # HotSpot never compiles methods above 8000 bytes: let Spark split such stages instead
             .config("spark.sql.codegen.hugeMethodLimit", "8000")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names, a fresh local one only where none is set."""
    # the setting is read from the session, so one program runs unchanged on a cluster and in tests
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named and current is None:
        spark.sparkContext.setCheckpointDir(named)
    elif current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fairline-ckpt-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, by columns and compressed: for narrow inputs that many jobs read."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled and merged.

    Spark estimates sizes from compressed files and leaves exploded arrays out, so such a side may look small enough to be sent through the
    driver to every executor when it is not.
    """
    return df.hint("merge")
