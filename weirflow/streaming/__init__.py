"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.sources import shared_dir


def reduce_keyed_watermark(flow: DataFrame, keys: list[str], event_time: str, delay: str, window: str, **aggs: Column) -> DataFrame:
    """Per key and window an aggregate whose state the watermark retires; late rows beyond it are dropped."""
    w = F.window(event_time, window)
    return flow.withWatermark(event_time, delay).groupBy(*keys, w.alias("window")).agg(*[e.alias(k) for k, e in aggs.items()])


def unique_within(flow: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    return flow.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def join_within(a: DataFrame, b: DataFrame, on: str, a_time: str, b_time: str, delay: str, within: str) -> DataFrame:
    """Stream-stream inner join on a key with both times at most ``within`` apart; both states are bounded."""
    left, right = a.withWatermark(a_time, delay), b.withWatermark(b_time, delay).withColumnRenamed(on, f"_{on}")
    near = F.col(b_time).between(F.col(a_time) - F.expr(f"INTERVAL {within}"), F.col(a_time) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(on) == F.col(f"_{on}")) & near).drop(f"_{on}")


def last_writer(flow: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The key-value store as a stream: run in update mode."""
    return flow.groupBy(key).agg(F.max_by(value, order).alias(value))


def run_to_end(flow: DataFrame) -> DataFrame:
    """Run a stream over what its source holds now, and return the rows of its updates with the number of their batch.

    Batches and the checkpoint lie in the shared folder; a batch that is run again replaces its rows.
    """
    spark = flow.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    run = flow.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    return spark.read.schema(flow.schema.add("batch", "long")).parquet(f"{path}/rows")
