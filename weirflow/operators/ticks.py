"""Logical time in batch form: a tick column marks the atomic batch that a row belongs to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.operators import chain, enumerate_rows


def batch(flow: DataFrame, tick: Column, name: str = "tick") -> DataFrame:
    return flow.withColumn(name, tick)


def all_ticks(flow: DataFrame, name: str = "tick") -> DataFrame:
    """The per-tick outputs one after another: the tick is forgotten."""
    return flow.drop(name)


def snapshot(flow: DataFrame, keys: Sequence[str], tick: str, again: Callable[[str], Column] = F.sum, **aggs: Column) -> DataFrame:
    """Per tick the aggregate of all rows up to it. Ticks are aggregated before the running window.

    ``again`` combines the ticks' aggregates: sum for sums and counts, min or max for those.
    """
    per_tick = flow.groupBy(*keys, tick).agg(*[e.alias(k) for k, e in aggs.items()])
    w = W.partitionBy(*keys).orderBy(tick).rowsBetween(W.unboundedPreceding, 0)
    return per_tick.select(*keys, tick, *[again(k).over(w).alias(k) for k in aggs])


def defer(per_tick: DataFrame, keys: Sequence[str], tick: str, *values: str) -> DataFrame:
    """The values of the tick before."""
    w = W.partitionBy(*keys).orderBy(tick)
    return per_tick.withColumns({v: F.lag(v).over(w) for v in values})


def persist(flow: DataFrame, ticks: DataFrame, tick: str) -> DataFrame:
    """At each tick everything that has come so far; its size is the operator's own.

    Ticks are numbered, a row meets the numbers from its own on by equality, so no table need fit in a broadcast. Null
    ticks come at no tick.
    """
    asked = ticks.select(F.col(tick).alias("_at")).where("_at is not null").distinct()
    every = flow.select(F.col(tick).alias("_at")).where("_at is not null").distinct().withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)))
    numbers = enumerate_rows(every.groupBy("_at").agg(F.max("_asked").alias("_asked")), ["_at"], "_i")
    last = numbers.agg(F.max("_i")).first()[0] or 0
    begun = flow.join(numbers.select("_at", "_i"), F.col(tick) == F.col("_at")).drop(tick, "_at")
    each = begun.withColumn("_i", F.explode(F.sequence(F.col("_i"), F.lit(last).cast("long"))))
    return each.join(numbers.where("_asked = 1").select("_i", F.col("_at").alias(tick)), "_i").drop("_i")


def delta(flow: DataFrame, keys: Sequence[str], tick: str) -> DataFrame:
    """The elements that are new at a tick: each at its first tick."""
    return flow.groupBy(*keys).agg(F.min(tick).alias(tick))


def changes(per_tick: DataFrame, keys: Sequence[str], tick: str, value: str) -> DataFrame:
    """Rows whose value differs from the tick before."""
    w = W.partitionBy(*keys).orderBy(tick)
    return per_tick.withColumn("_last", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_last")) | F.col("_last").isNull()).drop("_last")


def cycle(start: DataFrame, step: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feedback to a fixpoint over sets: ``step`` maps the new rows to candidates; rows already known stop.

    ``save`` cuts the lineage of a round (a checkpoint or a written table).
    """
    new = save(start.distinct())
    parts = [new]
    while not new.isEmpty():
        found, known = step(new).distinct(), chain(*parts)
        other = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
        same = None
        for c in known.columns:
            e = found[c].eqNullSafe(other[f"_{c}"])
            same = e if same is None else same & e
        new = save(found.join(other, same, "left_anti"))
        parts.append(new)
        if len(parts) > 16:  # so that the plan stays small; a row is written again once in so many rounds
            parts = [save(chain(*parts))]
    return chain(*parts)
