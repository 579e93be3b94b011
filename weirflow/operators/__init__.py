"""The dataflow algebra: one function an operator, DataFrames in and out; Catalyst picks the physical plan.

Order-sensitive operators name their order; ties are broken by the order itself, so results don't depend on
partitioning. Null keys compare as equal (null-safe) in differences and anti-joins, as options do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce as fold_left
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weirflow.sources import flag, saved_by

# Projection


def map_rows(flow: DataFrame, **exprs: Column) -> DataFrame:
    return flow.select(*[e.alias(k) for k, e in exprs.items()])


def filter_rows(flow: DataFrame, predicate: Column) -> DataFrame:
    return flow.where(predicate)


def filter_map(flow: DataFrame, name: str, expr: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Map to an option and keep what is not null."""
    return flow.select(*keep, expr.alias(name)).where(F.col(name).isNotNull())


def flat_map(flow: DataFrame, name: str, array: Column, keep: Sequence[str] = ()) -> DataFrame:
    return flow.select(*keep, F.explode(array).alias(name))


def inspect(flow: DataFrame, name: str, *aggs: Column) -> tuple[DataFrame, Observation]:
    """Pass rows through and observe aggregates on the way; read them after an action."""
    seen = Observation(name)
    return flow.observe(seen, *aggs), seen


def resolve_async(flow: DataFrame, column: str, out: str, call: Callable, kind: str, concurrency: int = 8) -> DataFrame:
    """Await a call for each row, ``concurrency`` at a time in a task; rows keep their order (1: one by one)."""
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in flow.schema if f.name != out], f"`{out}` {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                yield b.assign(**{out: pd.Series(list(pool.map(call, b[column])), index=b.index)})

    return flow.mapInPandas(run, fields)


# Sharing and combining


def partition(flow: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The true and the false branch; a null predicate is false."""
    return flow.where(flag(predicate)), flow.where(~flag(predicate))


def chain(*flows: DataFrame) -> DataFrame:
    return fold_left(DataFrame.unionByName, flows)


def chain_ordered(first: DataFrame, second: DataFrame, ordinal: str = "branch") -> DataFrame:
    """Concatenation that records which side comes first."""
    return chain(first.withColumn(ordinal, F.lit(0)), second.withColumn(ordinal, F.lit(1)))


def chain_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first flow if it has a row, else the second: the emptiness is one aggregated row."""
    empty = first.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return first.unionByName(second.join(F.broadcast(empty.where("_empty")), how="cross").drop("_empty"))


def filter_if(flow: DataFrame, condition: DataFrame) -> DataFrame:
    """All rows if the one-row, one-column condition is true, else none."""
    name = condition.columns[0]
    return flow.join(F.broadcast(condition.where(flag(F.col(name))).select(F.lit(1).alias("_on"))), how="cross").drop("_on")


def zip_singletons(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row flows side by side."""
    return a.join(F.broadcast(b), how="cross")


def is_empty(flow: DataFrame, name: str = "is_empty") -> DataFrame:
    return flow.limit(1).agg((F.count(F.lit(1)) == 0).alias(name))


# Joins and sets


def join(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on)


def lookup(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep every left row; what the right side lacks is null."""
    return a.join(b, on, "left")


def cross_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs; the operator itself asks for them."""
    return a.join(b, how="cross")


def cross_singleton(a: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row with the single row; a second one is an error, so that no table is broadcast by mistake."""
    checked = one_row.limit(2).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in one_row.columns])
    checked = checked.where(F.col("_n") > 0).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("the singleton has several rows")).cast("boolean"))).drop("_n")
    return a.join(F.broadcast(checked), how="cross")


def _equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return other, fold_left(lambda x, y: x & y, [a[k].eqNullSafe(other[f"_{k}"]) for k in keys])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that don't occur in ``b``, duplicates kept, null equal to null."""
    other, same = _equal(a, b, a.columns)
    return a.join(other, same, "left_anti")


def anti_join(a: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    other, same = _equal(a, keys, on)
    return a.join(other, same, "left_anti")


def semi_join(a: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    other, same = _equal(a, keys, on)
    return a.join(other, same, "left_semi")


def unique(flow: DataFrame) -> DataFrame:
    return flow.distinct()


# Aggregation and order


def fold(flow: DataFrame, init: dict[str, object], **aggs: Column) -> DataFrame:
    """One row, also for no input: nulls become the initial values."""
    return flow.agg(*[F.coalesce(e, F.lit(init[k])).alias(k) if k in init else e.alias(k) for k, e in aggs.items()])


def fold_keyed(flow: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return flow.groupBy(*keys).agg(*[e.alias(k) for k, e in aggs.items()])


def reduce(flow: DataFrame, **aggs: Column) -> DataFrame:
    """One row, or none for no input."""
    return flow.agg(F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in aggs.items()]).where("_n > 0").drop("_n")


reduce_keyed = fold_keyed


def value_counts(flow: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return flow.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def first_by(flow: DataFrame, keys: Sequence[str], order: Column, *values: str) -> DataFrame:
    return flow.groupBy(*keys).agg(*[F.min_by(v, order).alias(v) for v in values])


def last_by(flow: DataFrame, keys: Sequence[str], order: Column, *values: str) -> DataFrame:
    return flow.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def scan_keyed(flow: DataFrame, keys: Sequence[str], order_by: Sequence[Column], **aggs: Column) -> DataFrame:
    """A running aggregate: the value after each row, in order within a key."""
    w = W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    return flow.withColumns({k: e.over(w) for k, e in aggs.items()})


def _ranges(flow: DataFrame, order_by: Sequence[str], blocks: int | None) -> DataFrame:
    """Rows in ranges of the order, with the number of their range, written once: the bounds are drawn from a sample,
    so a plan that evaluates them twice would cut twice. The table is dealt by range: windows over one need no shuffle."""
    n = blocks or int(flow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved_by(flow.repartitionByRange(n, *order_by).withColumn("_part", F.spark_partition_id()), "_part", n)


def scan(flow: DataFrame, order_by: Sequence[str], value: str, name: str, blocks: int | None = None) -> DataFrame:
    """A running sum over all rows in order, without bringing them to one task.

    Rows are cut into ranges of the order; each range is summed, the sums of the ranges before, one row a range, are
    added. The order should be total: rows that tie in it may be numbered in any order.
    """
    own = _ranges(flow, order_by, blocks)
    sums = own.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum(value).over(W.partitionBy("_part").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("_run", run).join(F.broadcast(before), "_part").withColumn(name, (F.col("_run") + F.col("_before")).cast(flow.schema[value].dataType)).drop("_part", "_before", "_run")


def enumerate_rows(flow: DataFrame, order_by: Sequence[str], name: str = "index", blocks: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in order, by ranges as in ``scan``."""
    return scan(flow.withColumn("_one", F.lit(1).cast("long")), order_by, "_one", name, blocks).withColumn(name, F.col(name) - 1).drop("_one")


def lag_ranged(flow: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, name: str, blocks: int | None = None) -> DataFrame:
    """The value of the row before within a key, by ranges as in ``scan``: a range's first row of a key takes the last
    one of the key in the ranges before."""
    own = _ranges(flow, [*keys, *order_by], blocks)
    lasts = own.groupBy(*keys, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order_by)).alias("_end"))
    before = lasts.select(*keys, "_part", F.lag("_end").over(W.partitionBy(*keys).orderBy("_part")).alias("_end"))
    w = W.partitionBy("_part", *keys).orderBy(*order_by)
    rows = own.withColumns({"_before": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    here = fold_left(lambda x, y: x & y, [rows[k].eqNullSafe(before[k]) for k in keys], rows["_part"] == before["_part"])
    joined = rows.join(before, here, "left").select(*[rows[c] for c in flow.columns], F.when(rows["_first"], F.col("_end.v")).otherwise(rows["_before"]).alias(name))
    return joined


def scan_until(flow: DataFrame, keys: Sequence[str], order_by: Sequence[str], init: Any, step: Callable[[Any, dict[str, Any]], tuple[Any, Any] | None], out: str, kind: str) -> DataFrame:
    """A general scan: ``step`` takes the key's state and a row and returns the new state and the row's ``out``; with
    None the key ends, and its later rows give nothing. ``init`` is the state before a key's first row.

    Rows stream in order through the task of their key with one state in memory, so a long key takes time but no room.
    Aggregates that compose belong to ``scan`` or ``scan_keyed``.
    """
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in flow.schema], f"`{out}` {kind}"])
    names, arrow_kind = flow.columns, to_arrow_schema(StructType.fromDDL(f"x {kind}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = run  # no key equals it
        state, ended = init, False
        for b in batches:
            kept, values = [], []
            for k, row in enumerate(b.to_pylist()):
                own = [row[c] for c in keys]
                if own != key:
                    key, state, ended = own, init, False
                if not ended:
                    got = step(state, row)
                    ended = got is None
                    if got is not None:
                        state, value = got
                        kept.append(k)
                        values.append(value)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(kept, pa.int64())).columns, pa.array(values, arrow_kind)], names=[*names, out])

    return flow.repartition(*keys).sortWithinPartitions(*keys, *order_by).mapInArrow(run, fields)


def top_k(flow: DataFrame, k: int, *order_by: Column) -> DataFrame:
    return flow.orderBy(*order_by).limit(k)


def quorum(votes: DataFrame, keys: Sequence[str], needed: int, ballot: Column, state: str) -> DataFrame:
    """Keys with at least ``needed`` votes: their number, whether all agree, and the state of the greatest ballot."""
    counted = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), (F.min(state).eqNullSafe(F.max(state))).alias("agree"), F.max_by(state, ballot).alias("winner"))
    return counted.where(F.col("votes") >= needed)
