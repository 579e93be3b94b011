"""Sources and sinks: literal collections, singletons, tables, cluster members, profile files, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def source_iter(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal collection."""
    return spark.createDataFrame(list(rows), schema)


def singleton(spark: SparkSession, **values: Any) -> DataFrame:
    """One row of constants."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def singleton_per_tick(ticks: DataFrame, tick: str, first_tick_only: bool = False, **values: Any) -> DataFrame:
    """The constants on each tick, or on the first tick only."""
    out = ticks.select(tick).distinct()
    if first_tick_only:
        out = out.agg(F.min(tick).alias(tick)).where(F.col(tick).isNotNull())
    return out.select(tick, *[F.lit(v).alias(k) for k, v in values.items()])


def source_interval(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A timer as a stream of (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def source_stream(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def cluster_members(members: DataFrame, partitions: int, member_col: str = "member_id") -> DataFrame:
    """Logical members of a location split into ``partitions``: every multiple of it, divided by it."""
    m = F.col(member_col)
    return members.where(m % partitions == 0).withColumn(member_col, F.floor(m / partitions).cast("long"))


def profile_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def profile_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def for_each_batch(flow: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A side effect on every micro-batch; exactly once if ``act`` is idempotent in the batch id."""
    return flow.writeStream.option("checkpointLocation", checkpoint).foreachBatch(act)


def write_table(flow: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    flow.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, one under the
    warehouse, which on a cluster must not be a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_weirflow_shared"
    if not named and base.startswith(("file:", "/")) and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like ``saved``, dealt by ``key`` into buckets: windows, groups and joins on it need no shuffle of these rows."""
    spark, name = df.sparkSession, f"saved_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    own = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan has its files, which stay; the catalog needn't know them
    return own


def flag(predicate: Column) -> Column:
    """A predicate in two values: null counts as false."""
    return F.coalesce(predicate, F.lit(False))
