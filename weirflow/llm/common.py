"""What the operators share: the shared folder, written tables and worker-side caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirflow.sources import saved_by, shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``written``, dealt by ``key`` into as many buckets as a shuffle has partitions: joins on it move the other side only."""
    return saved_by(df, key, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, as texts may be long; a lower setting of the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_cache: dict[Any, Any] = {}


def once(key: Any, make: Callable[[], Any]) -> Any:
    """A value that a Python worker builds once and keeps for its next tasks, until another one is asked for."""
    if key not in _cache:
        _cache.clear()
        pa.default_memory_pool().release_unused()
        _cache[key] = make()
    return _cache[key]


def byte_batches(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of ``texts`` holding about ``limit`` characters each, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
