"""Measurements of runs: machine statistics, element sizes, load of operators, names of runs.

The registered queries make logs, stacks and names of the rows of the tables and read them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow import operators as op
from weirflow.apps.profiling import perf_fractions
from weirflow.model import table
from weirflow.registry import query
from weirflow.sources import saved

#: Columns of the sar reports, and the least free memory in kB of a line that counts.
N, I = r"(\d+\.?\d*)", r"(\d+)"
TIME = r"\d+:\d+:\d+"
CPU = rf"\s(\d{{1,3}})\s+{N}\s+{N}\s+{N}\s+{N}\s+{N}\s+{N}$"
NET = rf"([a-zA-Z]\S*)\s+{N}\s+{N}\s+{N}\s+{N}"
MEMORY = rf"{TIME}\s+{I}\s+{I}\s+{N}\s+{N}\s+{I}\s+{I}"
IO7, IO5 = rf"{TIME}\s+" + r"\s+".join([N] * 7) + r"\s*$", rf"{TIME}\s+" + r"\s+".join([N] * 5) + r"\s*$"
SKIPPED, LEAST_FREE = ("lo", "docker0", "IFACE"), 10_000
#: Memory and io of a location count from here on.
MEMORY_FROM, IO_FROM = 5.0, 10.0


def sar_seconds(lines: DataFrame, log: str, order: str, line: str) -> DataFrame:
    """log, second, cpu, cpu_user, network, memory, io of every second of sar logs: a line of core 0 opens a second, the
    lines behind it fill it, the last of a kind counts, and what has none is 0. Lines before the first second go."""
    text = F.col(line)
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("double")
    is_cpu, is_net = text.rlike(CPU), text.rlike(NET)
    is_memory = ~text.contains("kbmemfree") & text.rlike(MEMORY)
    rest = ~text.contains("tps")
    kind = F.when(is_cpu, "cpu").when(is_net, "net").when(is_memory, "memory").when(rest & text.rlike(IO7), "io7").when(rest & text.rlike(IO5), "io5")
    core = is_cpu & (F.regexp_extract(text, CPU, 1) == "0")
    own = lines.select(log, order, text, kind.alias("kind"), F.coalesce(core, F.lit(False)).alias("opens"))
    second = F.sum(F.col("opens").cast("long")).over(op.W.partitionBy(log).orderBy(order).rowsBetween(op.W.unboundedPreceding, 0))
    own = own.withColumn("second", second).where("second > 0")
    last = lambda value, when: F.coalesce(F.max_by(F.when(when, value), F.when(when, F.col(order))), F.lit(0.0))
    net = (F.col("kind") == "net") & ~F.regexp_extract(text, NET, 1).isin(*SKIPPED)
    memory = (F.col("kind") == "memory") & (part(MEMORY, 1) >= LEAST_FREE)
    io = F.when(F.col("kind") == "io7", part(IO7, 2) + part(IO7, 3)).otherwise(part(IO5, 2) + part(IO5, 3))
    return own.groupBy(log, "second").agg(
        last(part(CPU, 2) + part(CPU, 4), F.col("opens")).alias("cpu"), last(part(CPU, 2), F.col("opens")).alias("cpu_user"),
        last((part(NET, 4) + part(NET, 5)) * 1024, net).alias("network"), last(part(MEMORY, 4), memory).alias("memory"), last(io, F.col("kind").startswith("io")).alias("io"))


def element_bytes(flow: DataFrame, name: str = "bytes") -> DataFrame:
    """Each element with the bytes of its JSON form."""
    return flow.withColumn(name, F.octet_length(F.to_json(F.struct(*flow.columns))))


def blow_up(stats: DataFrame, ops: str, memory: str, io: str) -> DataFrame:
    """op, memory, io: what locations took, given to their first operator; small amounts don't count."""
    first = stats.select(F.try_element_at(ops, F.lit(1)).alias("op"), F.when(F.col(memory) > MEMORY_FROM, F.col(memory)).otherwise(0.0).alias("m"), F.when(F.col(io) > IO_FROM, F.col(io)).otherwise(0.0).alias("i"))
    return first.where("op is not null").groupBy("op").agg(F.sum("m").alias("memory"), F.sum("i").alias("io"))


def op_load(fractions: DataFrame, network_ops: DataFrame, blown: DataFrame) -> DataFrame:
    """op, cpu, memory, io: shares of the processor in percent of all but network operators, with what ``blow_up`` says."""
    cpu = op.anti_join(fractions, network_ops, ["op"]).select("op", (F.col("fraction") * 100).alias("cpu"))
    return cpu.join(blown, "op", "full").select("op", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cpu", "memory", "io")])


def inferred_counts(ops: DataFrame) -> DataFrame:
    """op, count of ``ops`` (op, parents, inherits, count): an operator that inherits takes its first parent's count, if it has one.

    Parents come before their operators, so a chain of heirs is followed from its head: a round for each link.
    """
    own = ops.select("op", "count", F.when(F.col("inherits"), F.try_element_at("parents", F.lit(1))).alias("heir_of"))
    known = own.select(F.col("op").alias("heir_of"))
    waits = own.join(known, "heir_of", "left_semi").select("op", "count", "heir_of")
    new = saved(own.join(waits.select("op"), "op", "left_anti").select("op", "count"))
    done = [new]
    waits = saved(waits)
    while not new.isEmpty() and not waits.isEmpty():
        heads = new.select(F.col("op").alias("heir_of"), F.col("count").alias("given"))
        new = saved(waits.join(heads, "heir_of").select("op", F.coalesce("given", "count").alias("count")))
        waits = saved(waits.join(new.select("op"), "op", "left_anti"))
        done.append(new)
    return op.chain(*done)


def run_order(name: Column) -> Column:
    """Sort key of configurations: default, opt1 to optN by number, then the others by name."""
    number = F.regexp_extract(name, r"^opt(\d+)$", 1).try_cast("long")
    return F.struct(F.when(name == "default", 0).when(number.isNotNull(), 1).otherwise(2).alias("rank"), F.coalesce(number, F.lit(0)).alias("number"), name.alias("name"))


def workload_runs(folders: DataFrame, folder: str, name: str, label: str) -> DataFrame:
    """Folders ``{name}_..._{label}`` whose middle doesn't begin with opt or lat and a number."""
    middle = F.regexp_extract(folder, rf"^\Q{name}_\E(.*)\Q_{label}\E$", 1)
    return folders.where(F.col(folder).rlike(rf"^\Q{name}_\E.*\Q_{label}\E$") & ~middle.rlike(r"^(opt|lat)\d+(_|$)"))


def latest_iteration(folders: DataFrame, folder: str, has_csv: Column, base: str, opt: str, label: str = "none") -> DataFrame:
    """iteration: the greatest N of the folders ``{opt}_optN_..._{label}`` with CSV files, 0 with a base run only, else no row."""
    n = F.regexp_extract(folder, rf"^\Q{opt}_opt\E(\d+)(?:_.*)?\Q_{label}\E$", 1).try_cast("long")
    base_run = F.col(folder).rlike(rf"^\Q{base}_\E.*\Q_{label}\E$") & ~F.regexp_extract(folder, rf"^\Q{base}_\E(.*)$", 1).rlike(r"^(opt|lat)\d+(_|$)")
    got = folders.agg(F.max(F.when(has_csv, n)).alias("n"), F.max(base_run.cast("int")).alias("any"))
    return got.where(F.col("any") == 1).select(F.coalesce("n", F.lit(0)).alias("iteration"))


@query("""
SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS second, value + event_id % 50 AS cpu, value AS cpu_user, (event_id % 1000 + 0.5) * 1024 AS network,
  CASE WHEN event_id % 20000 >= 10000 OR event_id % 3 = 0 THEN value / 2 ELSE 0 END AS memory, cast(event_id % 100 + 1 AS DOUBLE) AS io
FROM (SELECT event_id, user_id, floor(value) AS value FROM events)""")
def prof_sar(spark, d):
    """A second of a machine's log for each event: core 0, another core, two interfaces, memory and io in either layout."""
    e = table(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("v"))
    at, free = "12:00:01", F.when(F.col("event_id") % 3 == 0, F.lit(20_000)).otherwise(F.col("event_id") % 20_000)
    io = F.when(F.col("event_id") % 2 == 0, F.lit(" 0.00 1.00 2.00 0.00")).otherwise(F.lit(" 1.00 2.00"))
    lines = F.array(
        F.format_string(f"{at}     0  %d.00 0.00 %d.00 0.00 0.00 1.00", "v", F.col("event_id") % 50), F.lit(f"{at}     3  99.00 0.00 1.00 0.00 0.00 0.00"),
        F.format_string(f"{at}  eth0  1.00 2.00 %d.50 0.00", F.col("event_id") % 1000), F.lit(f"{at}  lo  9.00 9.00 9.00 9.00"), F.lit(f"{at}  kbmemfree kbavail %memused"),
        F.concat(F.lit(f"{at}  "), free.cast("string"), F.lit("  5000 100.00 "), (F.col("v") / 2).cast("string"), F.lit(" 7 8")),
        F.concat(F.lit(f"{at}  3.00 "), (F.col("event_id") % 100).cast("string"), F.lit(".00 1.00"), io))
    each = e.select(F.col("user_id").alias("log"), "event_id", F.posexplode(lines).alias("k", "line")).withColumn("no", F.col("event_id") * 10 + F.col("k"))
    return sar_seconds(each, "log", "no", "line")


@query("""SELECT event_id, length('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') AS bytes FROM events""")
def element_sizes(spark, d):
    return element_bytes(table(spark, d, "events").select("event_id", "user_id", "event_type")).select("event_id", "bytes")


@query("SELECT event_type AS op, arg_min(size, r) AS median FROM (SELECT event_type, length(props) AS size, row_number() OVER (PARTITION BY event_type ORDER BY length(props), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2 + 1 GROUP BY event_type")
def prof_size_median(spark, d):
    from weirflow.apps.profiling import upper_median

    e = table(spark, d, "events").select(F.col("event_type").alias("op"), F.octet_length("props").alias("size"), "event_id")
    return upper_median(e, ["op"], "size", "event_id")


_BLOWN = "SELECT user_id % 7 AS op, sum(CASE WHEN value > 5 THEN cast(value AS DECIMAL(18, 2)) ELSE 0 END)::DOUBLE AS memory, sum(CASE WHEN event_id % 23 > 10 THEN event_id % 23 ELSE 0 END)::DOUBLE AS io FROM events WHERE event_id % 11 <> 0 GROUP BY 1"


def _blown(spark, d):
    e = table(spark, d, "events")
    ops = F.when(F.col("event_id") % 11 != 0, F.array(F.col("user_id") % 7, F.lit(99).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return blow_up(e.select(ops.alias("ops"), F.col("value").cast("decimal(18,2)").alias("memory"), (F.col("event_id") % 23).alias("io")), "ops", "memory", "io").select("op", *[F.col(c).cast("double").alias(c) for c in ("memory", "io")])


@query(_BLOWN)
def prof_blow_up(spark, d):
    return _blown(spark, d)


@query(f"SELECT coalesce(c.op, b.op) AS op, coalesce(cpu, 0) AS cpu, coalesce(memory, 0) AS memory, coalesce(io, 0) AS io FROM (SELECT event_id % 9 AS op, sum(user_id) / (SELECT sum(user_id) FROM events) * 100 AS cpu FROM events WHERE event_id % 9 <> 3 GROUP BY 1) c FULL JOIN ({_BLOWN}) b ON c.op = b.op")
def prof_op_load_full(spark, d):
    """Processor shares of all operators but network operator 3, with memory and io."""
    e = table(spark, d, "events")
    stacks = e.select(F.concat(F.lit("main;op_"), F.col("event_id") % 9).alias("stack"), F.col("user_id").alias("samples"))
    fractions = perf_fractions(stacks).select(F.substring_index("frame", "_", -1).cast("long").alias("op"), "fraction")
    return op_load(fractions, spark.range(3, 4).select(F.col("id").alias("op")), _blown(spark, d))


@query("""
WITH RECURSIVE o AS (SELECT s_suppkey AS op, s_suppkey // 2 AS parent, s_suppkey % 3 <> 0 AS inherits, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 10 END AS n FROM supplier),
h AS (SELECT o.*, inherits AND parent IN (SELECT op FROM o) AS heir FROM o),
run(op, n) AS (SELECT op, n FROM h WHERE NOT heir UNION ALL SELECT h.op, coalesce(run.n, h.n) FROM run JOIN h ON h.parent = run.op AND heir)
SELECT op, n AS count FROM run""")
def prof_inferred_counts(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("op"))
    return inferred_counts(s.select("op", F.array(F.floor(F.col("op") / 2).cast("long")).alias("parents"), (F.col("op") % 3 != 0).alias("inherits"), F.when(F.col("op") % 4 != 0, F.col("op") * 10).alias("count")))


_NAMES = "CASE s_suppkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'opt' || s_suppkey WHEN 2 THEN 'other' || s_suppkey ELSE 'optx' || s_suppkey END"


def _configs(spark, d):
    k, s = F.col("s_suppkey"), table(spark, d, "supplier").select("s_suppkey")
    return s.select("s_suppkey", F.when(k % 4 == 0, "default").when(k % 4 == 1, F.concat(F.lit("opt"), k)).when(k % 4 == 2, F.concat(F.lit("other"), k)).otherwise(F.concat(F.lit("optx"), k)).alias("config"))


@query(f"SELECT s_suppkey, config, row_number() OVER (ORDER BY CASE WHEN config = 'default' THEN 0 WHEN regexp_matches(config, '^opt[0-9]+$') THEN 1 ELSE 2 END, CASE WHEN regexp_matches(config, '^opt[0-9]+$') THEN cast(config[4:] AS BIGINT) ELSE 0 END, config, s_suppkey) - 1 AS place FROM (SELECT s_suppkey, {_NAMES} AS config FROM supplier)")
def prof_config_order(spark, d):
    c = _configs(spark, d).withColumn("key", run_order(F.col("config")))
    return op.enumerate_rows(c, ["key", "s_suppkey"], "place").drop("key")


@query(f"SELECT folder FROM (SELECT 'CAS_' || {_NAMES} || CASE WHEN s_suppkey % 5 = 0 THEN '_size' ELSE '_none' END AS folder FROM supplier) WHERE folder LIKE '%\\_none' ESCAPE '\\' AND NOT regexp_matches(folder, '^CAS_(opt|lat)[0-9]+_')")
def prof_run_folders(spark, d):
    c = _configs(spark, d).select(F.concat(F.lit("CAS_"), "config", F.when(F.col("s_suppkey") % 5 == 0, "_size").otherwise("_none")).alias("folder"))
    return workload_runs(c, "folder", "CAS", "none")


@query("SELECT coalesce(max(CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_suppkey END), 0) AS iteration FROM supplier")
def prof_latest_iteration(spark, d):
    c = _configs(spark, d).select(F.concat(F.lit("CAS_"), "config", F.when(F.col("s_suppkey") % 5 == 0, "_size").otherwise("_none")).alias("folder"), (F.col("s_suppkey") % 3 == 0).alias("has_csv"))
    return latest_iteration(c, "folder", F.col("has_csv"), "CAS", "CAS")
