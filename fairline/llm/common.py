"""What the operators share: reading tables, the shared scratch folder, and row-wise passes over Arrow batches."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, where the driver and every executor can reach it."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """Rows of a batch as tuples, converted `size` at a time: a batch may hold 10,000 long texts."""
    for at in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def rows_pass(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per input row.

    `make` runs once in each task and returns the row function, so that tables and caches are built once a task. Batches leave
    as they come; nothing is held but one batch.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = [fn(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                cols = list(zip(*values)) if values else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, target)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose `column` passes, with all their columns; no shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            mask = pa.array([bool(fn(x)) for (x,) in rows_of(batch.select([at]))], pa.bool_())
            yield batch.filter(mask)

    return df.mapInArrow(run, df.schema)


_HELD: dict = {}


def once(key, make):
    """What `make` gives, kept in this Python worker for later tasks with the same key; another key takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Give up what `once` keeps, and hand freed memory back to the system: the worker now serves another operator."""
    import ctypes
    import gc
    _HELD.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)              # only some C libraries have it
    if trim is not None:
        trim(0)
    pa.default_memory_pool().release_unused()


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def remainder(doc_id: str, n: int):
    """crc32(doc_id as text) mod n, as a column; -1 for a null id, which is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))
