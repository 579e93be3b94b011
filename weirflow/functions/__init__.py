"""Column functions that more than one operator or query uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Doubles as exact cents, so that sums don't depend on the order of rows."""
    return x.cast("decimal(18,2)")


def route(key: Column, partitions: int, origin: Column | None = None) -> Column:
    """Partition of a key: origin * P + key mod P; stable across engines."""
    own = F.pmod(key, F.lit(partitions)).cast("long")
    return own if origin is None else origin * partitions + own


def departition(member: Column, partitions: int) -> Column:
    """The logical member behind a partitioned one."""
    return F.floor(member / partitions).cast("long")


def api_key(name: Column, secret: str) -> Column:
    return F.sha2(F.concat(name, F.lit(secret)), 256)


def epoch_second(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def upper_median_rank(n: Column) -> Column:
    """Place, from 1, of the upper median among n sorted values."""
    return F.floor(n / 2).cast("long") + 1


def tagged_number(line: Column, tag: str, group: int) -> Column:
    """Number in ``tag(id): n`` lines: group 1 is the id, 2 the number; null if the line has none."""
    got = F.regexp_extract(line, rf"{tag}\((\d+)\): (\d+)", group)
    return F.when(got != "", got.cast("long"))
