"""Profiling analytics: run logs as tables, averages, percentiles, saturation, costs.

In the registered queries a second is the epoch second of an event, an op its type, a run user_id mod 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.functions import epoch_second, tagged_number, upper_median_rank
from weirflow.model import table
from weirflow.operators import enumerate_rows, lag_ranged
from weirflow.registry import query

#: The measurement window in seconds, and the threshold of an unstable run.
WINDOW, UNSTABLE = (30, 59), 0.3
#: Capacities by which a machine counts as saturated.
NETWORK_BYTES, IO_TPS = 1.25e9, 12_000


def throughput(line: Column) -> Column:
    """Requests a second of a log line, cut to an integer; null if the line has none."""
    got = F.regexp_extract(line, r"(\d+\.?\d*)\s*requests/s", 1)
    return F.when(got != "", F.floor(got.cast("double")).cast("long"))


def latency(line: Column) -> Column:
    """struct(p50, p99, p999, samples) of a latency line; null fields if the line has none."""
    pattern = r"p50: (\d+\.?\d*) \| p99 (\d+\.?\d*) \| p999 (\d+\.?\d*) ms \((\d+) samples\)"
    part = [F.regexp_extract(line, pattern, k) for k in range(1, 5)]
    return F.struct(*[F.when(p != "", p.cast("double" if k < 3 else "long")).alias(n) for k, (p, n) in enumerate(zip(part, ("p50", "p99", "p999", "samples"), strict=True))])


def counter_deltas(samples: DataFrame, op: str, at: str, count: str) -> DataFrame:
    """Growth of cumulative counters, never negative; an op's first sample is dropped. Samples are cut into ranges."""
    out = lag_ranged(samples, [op], [at], count, "_last")
    return out.where(F.col("_last").isNotNull()).withColumn("delta", F.greatest(F.col(count) - F.col("_last"), F.lit(0))).drop("_last")


def upper_median(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The upper median of each key: all rows are numbered in ranges, and a key's middle number is picked."""
    own = enumerate_rows(df.select(*keys, value, tie), [*keys, value, tie], "_i")
    middle = own.groupBy(*keys).agg((F.min("_i") + upper_median_rank(F.count(F.lit(1))) - 1).alias("_i")).select("_i")
    return own.join(middle, "_i", "left_semi").select(*keys, F.col(value).alias("median"))


def unstable(df: DataFrame, keys: list[str], second: str, value: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Whether (second highest - least in the window) / second highest is over UNSTABLE.

    Each task keeps the two highest of a key only.
    """
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), second))).where("_r <= 2")
    top = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 2, F.col(value))).alias("_top"))
    low = df.groupBy(*keys).agg(F.min(F.when(F.col(second).between(*window), F.col(value))).alias("_low"))
    share = (F.col("_top") - F.col("_low")) / F.col("_top")
    return top.join(low, keys).select(*keys, F.coalesce(F.when(F.col("_top") > 0, share > UNSTABLE), F.lit(False)).alias("unstable"))


def histogram_percentiles(df: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """Percentiles of a histogram with buckets of a thousandth, and the number of samples; a key's buckets are few."""
    counts = df.groupBy(*keys, F.col(value).cast("decimal(18,3)").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys)
    so_far = counts.withColumns({"_to": F.sum("_n").over(w.orderBy("_bucket")), "_all": F.sum("_n").over(w)})
    return so_far.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") >= q * F.col("_all"), F.col("_bucket"))).cast("double").alias(n) for n, q in shares.items()], F.max("_all").alias("samples"))


def saturation(df: DataFrame, keys: list[str], cpu: Column, memory: Column, network: Column, io: Column) -> DataFrame:
    """Per key the highest share of any capacity; cpu and memory come as percentages."""
    share = F.greatest(cpu / 100, memory / 100, network / NETWORK_BYTES, io / IO_TPS)
    return df.groupBy(*keys).agg(F.max(share).alias("saturation"))


def best_runs(df: DataFrame, keys: list[str], run: str, throughput: str) -> DataFrame:
    """The rows of each key's run with the highest average throughput, the smaller run on ties."""
    runs = df.groupBy(*keys, run).agg(F.avg(throughput).alias("_t"))
    best = runs.groupBy(*keys).agg(F.max_by(run, F.struct("_t", -F.col(run))).alias(run))
    return df.join(best, [*keys, run], "left_semi")


def base_name(cluster: Column) -> Column:
    """A cluster's name without the location of its part."""
    return F.substring_index(cluster, "_loc", 1)


def cost_of_size(ops: DataFrame, costs: DataFrame, size: str = "size", bytes_col: str = "bytes", cost: str = "cost") -> DataFrame:
    """Each op with the cost of the first calibrated size strictly above its message size, else of the last.

    The calibration table has a row a message size; it is broadcast, and a step-up join stays linear in the ops.
    """
    steps = costs.agg(F.array_sort(F.collect_list(F.struct(size, cost))).alias("_steps"))
    above = F.filter("_steps", lambda s: s[size] > F.col(bytes_col))
    found = F.coalesce(F.try_element_at(above, F.lit(1))[cost], F.element_at("_steps", -1)[cost])
    zero = F.coalesce(F.col(bytes_col), F.lit(0)) == 0
    return ops.join(F.broadcast(steps), how="cross").withColumn(cost, F.when(zero, 0.0).otherwise(found)).drop("_steps")


def perf_fractions(stacks: DataFrame, stack: str = "stack", samples: str = "samples") -> DataFrame:
    """Share of samples by the last op frame of folded stacks; I/O roots count neither above nor below the line."""
    frames = F.filter(F.split(stack, ";"), lambda f: f.rlike(r"^op_\d") & ~f.contains("pull"))
    own = stacks.where(~F.col(stack).startswith("io-")).select(F.try_element_at(frames, F.lit(-1)).alias("frame"), samples)
    total = own.agg(F.sum(samples).alias("_total"))
    return own.where("frame is not null").groupBy("frame").agg(F.sum(samples).alias("_s")).join(F.broadcast(total), how="cross").select("frame", (F.col("_s") / F.col("_total")).alias("fraction"))


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("op"), epoch_second(F.col("ts")).alias("second"), F.pmod("user_id", F.lit(5)).alias("run"), "value", "user_id")


SEC = "cast(floor(epoch(ts)) AS BIGINT)"


@query("SELECT event_id, op, delta FROM (SELECT event_id, event_type AS op, greatest(user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS delta, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL")
def prof_counter_delta(spark, d):
    return counter_deltas(_events(spark, d), "op", "event_id", "user_id").select("event_id", "op", "delta")


@query("SELECT op, value AS median FROM (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2 + 1")
def prof_median(spark, d):
    return upper_median(_events(spark, d), ["op"], "value", "event_id")


@query("SELECT event_type AS op, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999, count(*) AS samples FROM events GROUP BY 1")
def prof_percentiles(spark, d):
    return histogram_percentiles(_events(spark, d), ["op"], "value", p50=0.5, p99=0.99, p999=0.999)


@query(f"SELECT event_type AS op, cast(floor(avg(user_id)) AS BIGINT) AS throughput FROM events WHERE {SEC} % 90 BETWEEN 30 AND 59 GROUP BY 1")
def prof_window_avg(spark, d):
    return _events(spark, d).where((F.col("second") % 90).between(*WINDOW)).groupBy("op").agg(F.floor(F.avg("user_id")).cast("long").alias("throughput"))


@query("SELECT op, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY n DESC, run) AS r FROM (SELECT event_type AS op, user_id % 5 AS run, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 3 GROUP BY op")
def prof_top3_runs(spark, d):
    runs = _events(spark, d).groupBy("op", "run").agg(F.count(F.lit(1)).alias("n"))
    best = runs.withColumn("_r", F.row_number().over(W.partitionBy("op").orderBy(F.desc("n"), "run"))).where("_r <= 3")
    return best.groupBy("op").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("std"))


_SATURATION = """
SELECT workload, cluster, max(greatest(value / 100, (user_id % 100) / 100, value * 1e6 / 1.25e9, user_id / 12000)) AS saturation
FROM (SELECT *, event_type AS workload, event_id % 3 AS run, 'c' || user_id % 5 || CASE WHEN user_id % 2 = 0 THEN '_loc' || user_id % 3 ELSE '' END AS cluster FROM events)
JOIN (SELECT workload, run, row_number() OVER (PARTITION BY workload ORDER BY t DESC, run) AS r FROM (SELECT event_type AS workload, event_id % 3 AS run, avg(cast(user_id AS DOUBLE)) AS t FROM events GROUP BY 1, 2)) b USING (workload, run)
WHERE r = 1 GROUP BY ALL"""


def _saturation(spark, d):
    """Clusters and their parts, a workload a type, runs of which the one with the most users counts."""
    k = F.col("user_id")
    cluster = F.concat(F.lit("c"), k % 5, F.when(k % 2 == 0, F.concat(F.lit("_loc"), k % 3)).otherwise(""))
    e = _events(spark, d).select(F.col("op").alias("workload"), (F.col("event_id") % 3).alias("run"), cluster.alias("cluster"), "value", "user_id")
    best = best_runs(e, ["workload"], "run", "user_id")
    return saturation(best, ["workload", "cluster"], F.col("value"), k % 100, F.col("value") * 1e6, k)


@query(_SATURATION)
def prof_saturation(spark, d):
    return _saturation(spark, d)


@query(f"SELECT arg_max(cluster, (saturation, cluster)) AS cluster, max(saturation) AS saturation FROM (SELECT cluster, max(saturation) AS saturation FROM ({_SATURATION}) GROUP BY cluster) WHERE string_split(cluster, '_loc')[1] NOT IN ('c0', 'c4')")
def prof_bottleneck(spark, d):
    """The most saturated cluster over all workloads, parts of the excluded ones left out."""
    top = _saturation(spark, d).groupBy("cluster").agg(F.max("saturation").alias("saturation"))
    s = top.where(~base_name(F.col("cluster")).isin("c0", "c4"))
    return s.agg(F.max_by("cluster", F.struct("saturation", "cluster")).alias("cluster"), F.max("saturation").alias("saturation"))


@query("WITH c(size, cost) AS (VALUES (64, 1.0), (128, 1.5), (256, 2.25), (512, 3.0), (1024, 5.0)) SELECT o.doc_id AS doc_id, n_chars, CASE WHEN n_chars = 0 THEN 0.0 ELSE coalesce((SELECT arg_min(cost, size) FROM c WHERE size > n_chars), 5.0) END::DOUBLE AS cost FROM documents o")
def prof_cost_lookup(spark, d):
    rows = [F.struct(F.lit(s).alias("size"), F.lit(c).alias("cost")) for s, c in ((64, 1.0), (128, 1.5), (256, 2.25), (512, 3.0), (1024, 5.0))]
    return cost_of_size(table(spark, d, "documents").select("doc_id", "n_chars"), spark.range(1).select(F.inline(F.array(*rows))), bytes_col="n_chars")


@query(f"SELECT op, coalesce(CASE WHEN top > 0 THEN (top - low) / top > 0.3 END, false) AS unstable FROM (SELECT op, max(CASE WHEN r = 2 THEN value END) AS top, min(CASE WHEN s BETWEEN 30 AND 59 THEN value END) AS low FROM (SELECT event_type AS op, {SEC} % 90 AS s, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, {SEC} % 90, event_id) AS r FROM events) GROUP BY op)")
def prof_stability(spark, d):
    return unstable(_events(spark, d).withColumn("second", F.col("second") % 90), ["op"], "second", "value")


@query("SELECT frame, s / (SELECT sum(user_id) FROM events WHERE event_type <> 'error') AS fraction FROM (SELECT 'op_' || (event_id % 7) AS frame, sum(user_id) AS s FROM events WHERE event_type <> 'error' GROUP BY 1)")
def prof_perf_fraction(spark, d):
    root = F.when(F.col("op") == "error", "io-").otherwise("main;")
    stacks = _events(spark, d).select(F.concat(root, F.lit("op_99;op_"), F.col("event_id") % 7, F.lit(";alloc")).alias("stack"), F.col("user_id").alias("samples"))
    return perf_fractions(stacks)


@query("SELECT coalesce(c.op, m.op) AS op, coalesce(cpu, 0) AS cpu, coalesce(io, 0) AS io FROM (SELECT event_type AS op, max(value) AS cpu FROM events WHERE value > 50 GROUP BY 1) c FULL JOIN (SELECT event_type AS op, count(*) AS io FROM events WHERE user_id < 50 GROUP BY 1) m ON c.op = m.op")
def prof_op_load(spark, d):
    e = _events(spark, d)
    cpu = e.where("value > 50").groupBy("op").agg(F.max("value").alias("cpu"))
    io = e.where("user_id < 50").groupBy("op").agg(F.count(F.lit(1)).alias("io"))
    return cpu.join(io, "op", "full").select("op", F.coalesce("cpu", F.lit(0.0)).alias("cpu"), F.coalesce("io", F.lit(0)).alias("io"))


@query("SELECT event_id, cast(floor(value) AS BIGINT) AS throughput, user_id AS node, event_id AS total, cast(user_id AS DOUBLE) AS p50, event_id AS samples FROM events")
def prof_parse_lines(spark, d):
    """Log lines made of every event, and read back."""
    e = table(spark, d, "events")
    lines = e.select("event_id", F.concat(F.lit("THR: "), F.col("value").cast("decimal(18,6)").cast("string"), F.lit(" requests/s")).alias("a"), F.concat(F.lit("counter("), "user_id", F.lit("): "), "event_id").alias("b"), F.concat(F.lit("LAT: p50: "), "user_id", F.lit(".0 | p99 1.5 | p999 2.5 ms ("), "event_id", F.lit(" samples)")).alias("c"))
    lat = latency(F.col("c"))
    return lines.select("event_id", throughput(F.col("a")).alias("throughput"), tagged_number(F.col("b"), "counter", 1).alias("node"), tagged_number(F.col("b"), "counter", 2).alias("total"), lat["p50"].alias("p50"), lat["samples"].alias("samples"))


@query(f"SELECT event_type AS op, {SEC} AS second, max(value) AS value FROM events GROUP BY ALL")
def prof_max_merge(spark, d):
    return _events(spark, d).groupBy("op", "second").agg(F.max("value").alias("value"))


@query("SELECT size, round(avg(ratio) * 0.5, 9) AS cost FROM (SELECT 64 * cast(2 ** (event_id % 8) AS BIGINT) AS size, user_id % 5 AS run, avg(value) / avg(user_id + 1) AS ratio FROM events GROUP BY ALL) GROUP BY size")
def prof_network_calibration(spark, d):
    e = _events(spark, d).withColumn("size", (F.pow(F.lit(2), F.col("event_id") % 8) * 64).cast("long"))
    runs = e.groupBy("size", "run").agg((F.avg("value") / F.avg(F.col("user_id") + 1)).alias("ratio"))
    return runs.groupBy("size").agg(F.round(F.avg("ratio") * 0.5, 9).alias("cost"))
