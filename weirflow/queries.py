"""The library's own queries: each operator over whole tables, with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow import operators as op
from weirflow import plans, sources, streaming
from weirflow.apps import measurements, profiling, programs  # noqa: F401  their queries register themselves
from weirflow.functions import departition, money, route
from weirflow.model import table
from weirflow.operators import ticks
from weirflow.registry import ORACLES, QUERIES, Query, query

SQL_DAY = "cast(ts AS DATE)"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# Sources


@query("SELECT event_id, user_id, event_type, value FROM events")
def source_scan(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT * FROM (VALUES (1, 2), (3, 4)) t(a, b)")
def source_iter(spark, d):
    return sources.source_iter(spark, [(1, 2), (3, 4)], "a int, b int")


@query(f"SELECT min({SQL_DAY}) AS day, 42 AS state FROM events")
def singleton_source(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day"))
    return sources.singleton_per_tick(days, "day", first_tick_only=True, state=42)


@query("SELECT s_suppkey // 4 AS member_id, s_name FROM supplier WHERE s_suppkey % 4 = 0")
def cluster_members(spark, d):
    return sources.cluster_members(table(spark, d, "supplier").select(F.col("s_suppkey").alias("member_id"), "s_name"), 4)


# Projection


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_fields(spark, d):
    li = table(spark, d, "lineitem")
    return op.map_rows(li, **{c: F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}, revenue=F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_pred(spark, d):
    return op.filter_rows(table(spark, d, "lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT event_id, k FROM (SELECT event_id, cast(props->>'k' AS BIGINT) AS k FROM events) WHERE k % 2 = 0")
def filter_map_opt(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return op.filter_map(table(spark, d, "events"), "k", F.when(k % 2 == 0, k), keep=("event_id",))


@query("SELECT event_id, unnest([0, 1, 2]) AS copy FROM events")
def flat_map_copies(spark, d):
    return op.flat_map(table(spark, d, "events"), "copy", F.sequence(F.lit(0), F.lit(2)), keep=("event_id",))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def flat_map_words(spark, d):
    words = op.flat_map(table(spark, d, "documents"), "word", F.split("text", "[ \t\n\r]+"))
    return op.value_counts(words.where("word <> ''"), ["word"])


@query("SELECT user_id, event_id, value * 2 AS value FROM events")
def map_with_key(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.col("value") * 2).alias("value"))


@query("SELECT event_id, user_id, length(event_type) AS answer FROM events")
def resolve_futures(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return op.resolve_async(e, "event_type", "answer", len, "bigint").drop("event_type")


@query("SELECT DISTINCT user_id FROM events")
def keys_view(spark, d):
    return op.unique(table(spark, d, "events").select("user_id"))


@query("SELECT value FROM events")
def values_view(spark, d):
    return table(spark, d, "events").select("value")


@query("SELECT user_id, event_type, value FROM events")
def entries_view(spark, d):
    """Keyed entries back as rows of a stream."""
    keyed = table(spark, d, "events").select("user_id", F.struct("event_type", "value").alias("entry"))
    return keyed.select("user_id", "entry.*")


@query("SELECT a AND b AS both, a OR b AS either, NOT a AS no_a FROM (SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 AS a, (SELECT count(*) FROM orders) = 0 AS b)")
def flag_algebra(spark, d):
    o = table(spark, d, "orders")
    both = op.zip_singletons(op.is_empty(o.where("o_totalprice < 0"), "a"), op.is_empty(o, "b"))
    return both.select((F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("no_a"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def inspect_rows(spark, d):
    seen, _ = op.inspect(table(spark, d, "events"), "events_seen", F.count(F.lit(1)).alias("rows"))
    return op.value_counts(seen, ["event_type"])


# Sharing and combining


@query("SELECT event_id, value FROM events WHERE event_id % 100 < 30")
def partition_true(spark, d):
    return op.partition(table(spark, d, "events").select("event_id", "value"), F.pmod("event_id", F.lit(100)) < 30)[0]


@query("SELECT event_id, value FROM events WHERE NOT event_id % 100 < 30")
def partition_false(spark, d):
    return op.partition(table(spark, d, "events").select("event_id", "value"), F.pmod("event_id", F.lit(100)) < 30)[1]


@query("SELECT a.event_type AS event_type, n, top FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) a JOIN (SELECT event_type, max(value) AS top FROM events GROUP BY 1) b USING (event_type)")
def tee_reuse(spark, d):
    e = table(spark, d, "events")
    return op.join(op.value_counts(e, ["event_type"]), op.fold_keyed(e, ["event_type"], top=F.max("value")), "event_type")


_PEOPLE = "SELECT c_custkey AS id, c_name AS name FROM customer {} SELECT s_suppkey, s_name FROM supplier"


def _people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("SELECT c_custkey AS id, c_name AS name, 0 AS branch FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier")
def chain_all(spark, d):
    return op.chain_ordered(*_people(spark, d))


@query(_PEOPLE.format("UNION ALL"))
def merge_unordered(spark, d):
    return op.chain(*_people(spark, d))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal < -1e9 UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < -1e9)")
def chain_first(spark, d):
    none = table(spark, d, "supplier").where("s_acctbal < -1e9").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return op.chain_first(none, _people(spark, d)[0])


@query("SELECT id, name, row_number() OVER (ORDER BY id, name) - 1 AS place FROM (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier)")
def merge_ordered(spark, d):
    return op.enumerate_rows(op.chain(*_people(spark, d)), ["id", "name"], "place")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers")
def zip_singletons(spark, d):
    return op.zip_singletons(*[table(spark, d, t).agg(F.count(F.lit(1)).alias(f"{t}s")) for t in ("customer", "supplier")])


@query("SELECT n_nationkey, n_name FROM nation WHERE (SELECT count(*) FROM orders) > 10")
def filter_if(spark, d):
    return op.filter_if(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "orders").agg((F.count(F.lit(1)) > 10).alias("enough")))


@query("SELECT count(*) = 0 AS is_empty FROM orders WHERE o_totalprice < 0")
def is_empty_flag(spark, d):
    return op.is_empty(table(spark, d, "orders").where("o_totalprice < 0"))


# Joins and sets


@query("SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return op.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), c, "o_custkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_half(spark, d):
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = op.join(table(spark, d, "nation"), r, "n_regionkey").withColumnRenamed("n_nationkey", "s_nationkey")
    return op.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), places, "s_nationkey").select("s_suppkey", "n_name", "r_name")


@query("SELECT event_id, e.user_id AS user_id, top FROM events e JOIN (SELECT user_id, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id)")
def join_keyed_singleton(spark, d):
    e = table(spark, d, "events")
    return op.join(e.select("event_id", "user_id"), op.reduce_keyed(e.where("event_type = 'purchase'"), ["user_id"], top=F.max("value")), "user_id")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_keyed_singleton(spark, d):
    return op.lookup(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT r_name, n_name FROM region, nation")
def cross_product(spark, d):
    return op.cross_product(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"))


@query("SELECT event_id, value, top FROM events, (SELECT max(value) AS top FROM events)")
def cross_singleton(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return op.cross_singleton(e, e.agg(F.max("value").alias("top")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def difference_rows(spark, d):
    return op.difference(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_key(spark, d):
    return op.anti_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, d):
    return op.semi_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT DISTINCT text FROM documents")
def unique_rows(spark, d):
    return op.unique(table(spark, d, "documents").select("text"))


# Aggregation and order


@query("SELECT cast(coalesce(sum(cast(o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS total, count(*) AS n FROM orders WHERE o_totalprice < 0")
def fold_global(spark, d):
    return op.fold(table(spark, d, "orders").where("o_totalprice < 0"), {"total": 0.0}, total=F.sum(money(F.col("o_totalprice"))).cast("double"), n=F.count(F.lit(1)))


@query("SELECT o_custkey, cast(sum(cast(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY o_custkey")
def fold_keyed(spark, d):
    return op.fold_keyed(table(spark, d, "orders"), ["o_custkey"], total=F.sum(money(F.col("o_totalprice"))).cast("double"), n=F.count(F.lit(1)))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY user_id")
def fold_idempotent(spark, d):
    return op.fold_keyed(table(spark, d, "events"), ["user_id"], types=F.array_sort(F.collect_set("event_type")))


@query("SELECT max(value) AS top, arg_max(event_id, (value, event_id)) AS event_id FROM events HAVING count(*) > 0")
def reduce_global(spark, d):
    return op.reduce(table(spark, d, "events"), top=F.max("value"), event_id=F.max_by("event_id", F.struct("value", "event_id")))


@query("SELECT user_id, max(value) AS value FROM events GROUP BY user_id")
def reduce_keyed(spark, d):
    return op.reduce_keyed(table(spark, d, "events"), ["user_id"], value=F.max("value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return op.value_counts(table(spark, d, "events"), ["event_type"])


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, d):
    return op.fold(table(spark, d, "lineitem"), {}, n=F.count(F.lit(1)))


@query("SELECT event_id, cast(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS running FROM events")
def scan_running(spark, d):
    return op.scan(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id", "running").select("event_id", "running")


@query("SELECT event_id, user_id, total FROM (SELECT event_id, user_id, event_id % 50 AS step, cast(100 + sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events) WHERE total - step < 400")
def scan_terminating(spark, d):
    """A total from 100 on that ends for a user once it has reached 400."""
    e = table(spark, d, "events").select("event_id", "user_id")

    def step(total, row):
        return None if total >= 400 else (total + row["event_id"] % 50,) * 2

    return op.scan_until(e, ["user_id"], ["event_id"], 100, step, "total", "bigint")


@query("SELECT event_id, user_id, cast(sum(cast(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS running FROM events")
def scan_keyed(spark, d):
    out = op.scan_keyed(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], running=F.sum(money(F.col("value"))))
    return out.select("event_id", "user_id", F.col("running").cast("double").alias("running"))


@query('SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS "index" FROM events')
def enumerate_rows(spark, d):
    return op.enumerate_rows(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "index")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def first_per_key(spark, d):
    return op.first_by(table(spark, d, "events"), ["user_id"], F.col("event_id"), "event_type", "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_per_key(spark, d):
    return op.last_by(table(spark, d, "events"), ["user_id"], F.col("event_id"), "event_type", "value")


@query("SELECT event_type, max((value, user_id)).value AS num, max((value, user_id)).user_id AS node FROM (SELECT event_type, value, user_id FROM events) GROUP BY event_type".replace("max((value, user_id)).value", "max(value)").replace("max((value, user_id)).user_id", "arg_max(user_id, (value, user_id))"))
def max_struct(spark, d):
    best = F.max(F.struct(F.col("value").alias("num"), F.col("user_id").alias("node")))
    return op.reduce_keyed(table(spark, d, "events"), ["event_type"], best=best).select("event_type", "best.num", "best.node")


@query("SELECT user_id, event_type, count(*) AS votes, min(value) = max(value) AS agree, arg_max(value, event_id) AS winner FROM events GROUP BY ALL HAVING count(*) >= 3")
def quorum(spark, d):
    return op.quorum(table(spark, d, "events"), ["user_id", "event_type"], 3, F.col("event_id"), "value")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_20(spark, d):
    return op.top_k(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 20, F.desc("o_orderdate"), F.col("o_orderkey"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def sort_rank(spark, d):
    return op.enumerate_rows(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


# Ticks


@query(f"SELECT {SQL_DAY} AS tick, user_id, count(*) AS n FROM events GROUP BY ALL")
def tick_batch(spark, d):
    return op.value_counts(ticks.batch(table(spark, d, "events"), F.to_date("ts")), ["tick", "user_id"])


@query(f"SELECT user_id, tick, cast(sum(n) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) AS total FROM (SELECT user_id, {SQL_DAY} AS tick, count(*) AS n FROM events GROUP BY ALL)")
def tick_snapshot(spark, d):
    return ticks.snapshot(ticks.batch(table(spark, d, "events"), F.to_date("ts")), ["user_id"], "tick", total=F.count(F.lit(1)))


@query("SELECT event_id, user_id FROM events")
def all_ticks(spark, d):
    return ticks.all_ticks(ticks.batch(table(spark, d, "events").select("event_id", "user_id", "ts"), F.to_date("ts"))).drop("ts")


@query(f"SELECT user_id, tick, lag(n) OVER (PARTITION BY user_id ORDER BY tick) AS n FROM (SELECT user_id, {SQL_DAY} AS tick, count(*) AS n FROM events GROUP BY ALL)")
def defer_tick(spark, d):
    per = op.value_counts(ticks.batch(table(spark, d, "events"), F.to_date("ts")), ["user_id", "tick"])
    return ticks.defer(per, ["user_id"], "tick", "n")


@query(f"SELECT t.tick AS tick, e.user_id AS user_id FROM (SELECT DISTINCT user_id, {SQL_DAY} AS tick FROM events) e JOIN (SELECT DISTINCT {SQL_DAY} AS tick FROM events) t ON e.tick <= t.tick")
def persist(spark, d):
    own = ticks.batch(table(spark, d, "events"), F.to_date("ts")).select("user_id", "tick").distinct()
    return ticks.persist(own, own, "tick")


@query(f"SELECT user_id, min({SQL_DAY}) AS tick FROM events GROUP BY user_id")
def delta(spark, d):
    return ticks.delta(ticks.batch(table(spark, d, "events"), F.to_date("ts")), ["user_id"], "tick")


@query(f"SELECT user_id, tick, top FROM (SELECT *, lag(top) OVER (PARTITION BY user_id ORDER BY tick) AS p FROM (SELECT user_id, {SQL_DAY} AS tick, arg_max(event_type, event_id) AS top FROM events GROUP BY ALL)) WHERE p IS NULL OR p <> top")
def optional_changes(spark, d):
    per = op.last_by(ticks.batch(table(spark, d, "events"), F.to_date("ts")).withColumnRenamed("event_type", "top"), ["user_id", "tick"], F.col("event_id"), "top")
    return ticks.changes(per, ["user_id"], "tick", "top")


@query(f"SELECT event_id, base + row_number() OVER (PARTITION BY tick ORDER BY event_id) - 1 AS id FROM (SELECT event_id, {SQL_DAY} AS tick FROM events) JOIN (SELECT tick, coalesce(sum(n) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT {SQL_DAY} AS tick, count(*) AS n FROM events GROUP BY 1)) USING (tick)")
def state_carry(spark, d):
    e = ticks.batch(table(spark, d, "events").select("ts", "event_id"), F.to_date("ts"))
    return op.enumerate_rows(e, ["tick", "event_id"], "id").select("event_id", "id")


@query("WITH RECURSIVE up(id, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT id, root // 2 FROM up WHERE root > 0) SELECT id, root FROM up")
def cycle_closure(spark, d):
    start = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("root"))
    return ticks.cycle(start, lambda new: new.where("root > 0").select("id", F.floor(F.col("root") / 2).cast("long").alias("root")), sources.saved)


@query(f"SELECT user_id, {SQL_DAY} AS day, max(value) AS top FROM events GROUP BY ALL")
def reduce_keyed_watermark(spark, d):
    """As a stream over the table's files until they are read; the watermark retires keys of days gone by."""
    e = sources.source_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    days = streaming.reduce_keyed_watermark(e.withColumn("at", F.col("ts").cast("timestamp")), ["user_id"], "at", "400 days", "1 day", top=F.max("value"))
    done = streaming.run_to_end(days)
    return done.groupBy("user_id", F.to_date("window.start").alias("day")).agg(F.max_by("top", "batch").alias("top"))


@query(f"SELECT user_id, {SQL_DAY} AS tick, arg_max(value, event_id) AS sampled FROM events GROUP BY ALL")
def sample_eager(spark, d):
    """A changing value sampled once a tick: its last state."""
    return op.last_by(ticks.batch(table(spark, d, "events"), F.to_date("ts")), ["user_id", "tick"], F.col("event_id"), "value").withColumnRenamed("value", "sampled")


# Network


@query("SELECT event_id, user_id % 4 AS dest FROM events")
def route_hash(spark, d):
    return table(spark, d, "events").select("event_id", route(F.col("user_id"), 4).alias("dest"))


@query("SELECT event_id, event_id % 3 AS sender, user_id % 4 AS member FROM events")
def demux(spark, d):
    """Rows sent to the member that they name, each with the sender's id; a member's rows lie together."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("sender"), (F.col("user_id") % 4).alias("member"))
    return e.repartition("member", "sender")


@query("SELECT DISTINCT user_id, user_id // 4 AS member FROM events")
def departition_ids(spark, d):
    return table(spark, d, "events").select("user_id", departition(F.col("user_id"), 4).alias("member")).distinct()


@query("SELECT n_nationkey, unnest([0, 1, 2, 3]) AS dest FROM nation")
def broadcast_partitions(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dest"))


# Plans


@query("SELECT l_orderkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def lineage_copartition(spark, d):
    """Joined and counted on one exchange per input: the lineage says that the join's key partitions both."""
    li = plans.Lineage.source("lineitem", ["l_orderkey"]).map(key="l_orderkey")
    orders = plans.Lineage.source("orders", ["o_orderkey", "o_custkey"]).map(key="o_orderkey", o_custkey="o_custkey")
    [choice] = plans.copartition([plans.Constraint.key((li, "key"), (orders, "key"))])
    a = table(spark, d, "lineitem").select("l_orderkey").repartition(choice["lineitem"])
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return a.join(b, "l_orderkey").groupBy("l_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, max(value) AS value FROM events GROUP BY event_type")
def pushdown_two_phase(spark, d):
    return plans.two_phase_max(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


@query("SELECT a || b || c || e AS placement, greatest(a, b, c, e)::INTEGER + 1 AS used FROM (SELECT '0' AS a), (VALUES ('0'), ('1')) t1(b), (VALUES ('0'), ('1'), ('2')) t2(c), (VALUES ('0'), ('1'), ('2')) t3(e) WHERE c <= chr(ascii(greatest(a, b)) + 1) AND e <= chr(ascii(greatest(a, b, c)) + 1)")
def placement_enumerate(spark, d):
    return plans.placements(spark, ["decrypt", "copy", "count", "encrypt"], 3)
