"""Placement and pushdown questions answered over tables, and lineage of fields through named columns."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lineage:
    """Which input fields each output field equals: name -> {(input, field)}; an empty set is no lineage.

    inputs are all that the flow derives from, also where no field still shows it.
    """

    fields: dict[str, frozenset[tuple[str, str]]] = field(default_factory=dict)
    inputs: frozenset[str] = frozenset()

    @classmethod
    def source(cls, name: str, columns: Sequence[str]) -> Lineage:
        return cls({c: frozenset({(name, c)}) for c in columns}, frozenset({name}))

    def map(self, **renamed: str | None) -> Lineage:
        """New fields from old ones; None is a computed value without lineage."""
        return Lineage({k: self.fields.get(v, frozenset()) if v else frozenset() for k, v in renamed.items()}, self.inputs)

    def chain(self, other: Lineage) -> Lineage:
        """Of a shared input only what both branches say; of other inputs what either says."""
        shared, out = self.inputs & other.inputs, {}
        for k in self.fields.keys() & other.fields.keys():
            a, b = self.fields[k], other.fields[k]
            out[k] = frozenset(x for x in a | b if x[0] not in shared or (x in a and x in b))
        return Lineage(out, self.inputs | other.inputs)

    def join(self, other: Lineage, on: str) -> Lineage:
        rest = {k: v for k, v in other.fields.items() if k != on}
        return Lineage({**self.fields, **rest, on: self.fields.get(on, frozenset()) | other.fields.get(on, frozenset())}, self.inputs | other.inputs)


@dataclass(frozen=True)
class Constraint:
    """Operators that need rows together: each is a set of alternatives input -> field; none if it can't be split."""

    alternatives: tuple[dict[str, str], ...]

    @classmethod
    def key(cls, *sides: tuple[Lineage, str]) -> Constraint:
        """Every side's key must trace to a field of its inputs; a side without inputs asks for nothing."""
        options: list[dict[str, str]] = [{}]
        for lineage, name in sides:
            if not lineage.inputs:
                continue
            options = [o | {i: f} for o in options for i, f in lineage.fields.get(name, ()) if o.get(i, f) == f]
        return cls(tuple(options))

    @classmethod
    def impossible(cls, *sides: Lineage) -> Constraint:
        """Global operators: fine only while some side comes from no input."""
        return cls(() if all(s.inputs for s in sides) else ({},))


def copartition(constraints: Sequence[Constraint]) -> list[dict[str, str]]:
    """Choices input -> field that satisfy every operator; empty if there is none."""
    found: list[dict[str, str]] = [{}]
    for c in constraints:
        found = [o | a for o in found for a in c.alternatives if all(o.get(i, f) == f for i, f in a.items())]
    return [dict(t) for t in dict.fromkeys(tuple(sorted(o.items())) for o in found)]


def two_phase_max(flow: DataFrame, keys: Sequence[str], value: str, salt: int = 16) -> DataFrame:
    """A commutative reduction pushed before the exchange by key: per salt first, then per key."""
    part = flow.withColumn("_salt", F.pmod(F.xxhash64(*flow.columns), F.lit(salt))).groupBy(*keys, "_salt").agg(F.max(value).alias(value))
    return part.groupBy(*keys).agg(F.max(value).alias(value))


def placements(spark: SparkSession, ops: Sequence[str], budget: int) -> DataFrame:
    """Every assignment of ops to at most ``budget`` locations up to renaming: one string of digits a row.

    Each op extends the assignments before it by a location in use or the next new one, so no two rows are
    renamings of one another.
    """
    out = spark.range(1).select(F.lit("").alias("placement"), F.lit(0).alias("used"))
    for _ in ops:
        out = out.select("placement", "used", F.explode(F.sequence(F.lit(0), F.least(F.col("used"), F.lit(budget - 1)))).alias("at"))
        out = out.select(F.concat("placement", F.col("at").cast("string")).alias("placement"), F.greatest("used", F.col("at") + 1).alias("used"))
    return out


def cheapest(ops: Sequence[str], cost: dict[str, float], edges: Sequence[tuple[str, str, float]], budget: int) -> tuple[float, dict[str, int]]:
    """The placement with the least load of the busiest location, each cut edge charged to both its ends.

    For the few operators of one pipeline; assignments are taken up to renaming.
    """
    best: tuple[float, dict[str, int]] = (float("inf"), {})
    for choice in itertools.product(range(budget), repeat=len(ops)):
        if any(at > max(choice[:k], default=-1) + 1 for k, at in enumerate(choice)):
            continue
        at = dict(zip(ops, choice, strict=True))
        load = [0.0] * budget
        for o in ops:
            load[at[o]] += cost[o]
        for a, b, c in edges:
            if at[a] != at[b]:
                load[at[a]] += c
                load[at[b]] += c
        if max(load) < best[0]:
            best = (max(load), at)
    return best
