"""Programs over event logs: key-value store, locks, registers, an encrypting pipeline, a course and a forum app."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow import operators as op
from weirflow import sources
from weirflow.functions import api_key
from weirflow.model import table
from weirflow.registry import query

SECRET = "weir"


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def kv_lww(spark, d):
    """Last writer wins."""
    return op.last_by(table(spark, d, "events"), ["user_id"], F.col("event_id"), "value")


def lock_transitions(keys: list, clients: list, acquires: list) -> Iterator[tuple]:
    """(lock, start, end) of a stretch of the logs, sorted by lock and order: the holder at its end for the holder at its start.

    None is no holder; a start that isn't listed ends as it began. Starts that meet in one state go on as one.
    """
    parent: list[int] = []
    starts: dict = {}
    at: dict = {}

    def top(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    def put(state, node: int) -> None:
        """The node's starts are in ``state`` now, with all others that are."""
        if state in at:
            parent[node] = at[state]
        else:
            at[state] = node

    def new(start) -> None:
        parent.append(len(parent))
        starts[start] = parent[-1]
        put(start, parent[-1])

    def ends(lock) -> Iterator[tuple]:
        state = {top(node): holder for holder, node in at.items()}
        return ((lock, start, state[top(node)]) for start, node in starts.items())

    last = keys[0] if keys else None
    new(None)
    for lock, client, acquire in zip(keys, clients, acquires, strict=True):
        if lock != last:
            yield from ends(last)
            last = lock
            parent.clear(), starts.clear(), at.clear()
            new(None)
        if not acquire and client not in starts:
            new(client)
        old, state = (None, client) if acquire else (client, None)
        if old in at:
            put(state, at.pop(old))
    if keys:
        yield from ends(last)


def lock_holders(log: DataFrame, lock: str, client: str, acquire: str, order: str, blocks: int | None = None) -> DataFrame:
    """Holder of each lock after its log in arrival order: a free lock is taken, only its holder frees it.

    The logs are cut into ranges of lock and order, each range becomes a table of transitions, and the tables of a
    lock's ranges are composed in pairs, so that the log of one lock is never a group: as many rounds as the logarithm of
    the ranges. A task holds one range.
    """
    n = blocks or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = log.schema[lock].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if own is not None:
            rows = list(lock_transitions(*(own.column(k).to_pylist() for k in range(3))))
            columns = [pa.array([r[0] for r in rows], own.schema.field(0).type), pa.array([part] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["lock", "part", "start", "end"])

    cut = log.repartitionByRange(n, lock, order).sortWithinPartitions(lock, order).select(lock, F.col(client).cast("long"), acquire)
    moves = sources.saved(cut.mapInArrow(run, f"lock {kind}, part bigint, start bigint, end bigint"))
    first = moves.groupBy(F.col("lock").alias("l")).agg(F.min("part").alias("least"))
    moves = moves.join(first, F.col("lock").eqNullSafe(F.col("l"))).select("lock", (F.col("part") - F.col("least")).alias("part"), "start", "end")
    while (moves.agg(F.max("part")).first()[0] or 0) > 0:
        pair = F.floor(F.col("part") / 2).cast("long")
        left = moves.where("part % 2 = 0").select("lock", pair.alias("part"), "start", "end")
        right = moves.where("part % 2 = 1").select(F.col("lock").alias("l"), pair.alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), F.lit(True).alias("moves"))
        here = F.col("lock").eqNullSafe(F.col("l")) & (F.col("part") == F.col("p"))
        through = left.join(right, here & F.col("end").eqNullSafe(F.col("s")), "left").select("lock", "part", "start", F.when(F.col("moves"), F.col("e")).otherwise(F.col("end")).alias("end"))
        fresh = right.join(left, here & F.col("start").eqNullSafe(F.col("s")), "left_anti").select(F.col("l").alias("lock"), F.col("p").alias("part"), F.col("s").alias("start"), F.col("e").alias("end"))
        moves = sources.saved(through.unionByName(fresh))
    return moves.where("start is null").select(F.col("lock").alias(lock), F.col("end").alias("holder"))


def lock_ticks(log: DataFrame) -> DataFrame:
    """lock, tick, client, event_id, granted of every acquire in a log of lock, tick, client, event_id, acquire.

    A tick applies its releases first; then a lock that is free goes to the first acquire, and is held in later ticks
    until one with a release. So of the ticks from one release to the next only the first with an acquire grants.
    As in the reference any release frees the lock: only holders release, and a client has one message under way.
    """
    ticks = log.groupBy("lock", "tick").agg(F.max((~F.col("acquire")).cast("int")).alias("_freed"), F.min(F.when(F.col("acquire"), F.col("event_id"))).alias("_first"))
    ticks = ticks.withColumn("_held", F.sum("_freed").over(W.partitionBy("lock").orderBy("tick")))
    wins = op.first_by(ticks.where(F.col("_first").isNotNull()), ["lock", "_held"], F.col("tick"), "_first").select("lock", F.col("_first").alias("event_id"), F.lit(True).alias("_won"))
    asks = log.where("acquire").select("lock", "tick", "client", "event_id")
    return asks.join(wins, ["lock", "event_id"], "left").select("lock", "tick", "client", "event_id", F.coalesce("_won", F.lit(False)).alias("granted"))


def _lock_log(spark, d, *more):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 100).alias("lock"), (F.col("event_id") % 3).alias("client"), F.col("event_type").isin("click", "view", "purchase").alias("acquire"), "event_id", *more)


@query("""
WITH RECURSIVE log AS (SELECT user_id % 100 AS lock, event_id % 3 AS client, event_type IN ('click', 'view', 'purchase') AS acquire, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) AS n FROM events),
run(lock, n, holder) AS (
  SELECT DISTINCT lock, 0::BIGINT, NULL::BIGINT FROM log
  UNION ALL
  SELECT log.lock, log.n, CASE WHEN acquire AND holder IS NULL THEN client WHEN NOT acquire AND holder = client THEN NULL ELSE holder END
  FROM run JOIN log ON log.lock = run.lock AND log.n = run.n + 1)
SELECT lock, arg_max_null(holder, n) AS holder FROM run GROUP BY lock""")
def lock_fold(spark, d):
    return lock_holders(_lock_log(spark, d), "lock", "client", "acquire", "event_id")


@query("""
WITH RECURSIVE log AS (SELECT user_id % 100 AS lock, cast(ts AS DATE) AS tick, event_id % 3 AS client, event_id, event_type IN ('click', 'view', 'purchase') AS acquire FROM events),
ticks AS (SELECT lock, row_number() OVER (PARTITION BY lock ORDER BY tick) AS n, bool_or(NOT acquire) AS freed, min(event_id) FILTER (WHERE acquire) AS asks FROM log GROUP BY lock, tick),
run(lock, n, held, winner) AS (
  SELECT DISTINCT lock, 0::BIGINT, false, NULL::BIGINT FROM log
  UNION ALL
  SELECT t.lock, t.n, (held AND NOT freed) OR asks IS NOT NULL, CASE WHEN NOT held OR freed THEN asks END FROM run JOIN ticks t ON t.lock = run.lock AND t.n = run.n + 1)
SELECT lock, tick, client, event_id, event_id IN (SELECT winner FROM run WHERE winner IS NOT NULL) AS granted FROM log WHERE acquire""")
def lock_tick(spark, d):
    """Requests of a lock server that works in ticks of a day and carries holders from tick to tick."""
    return lock_ticks(_lock_log(spark, d, F.to_date("ts").alias("tick")))


def cas_register(log: DataFrame, register: str, order: str) -> DataFrame:
    """Register after a log of (version, state, writer): the first write is taken, then the next version, or the same by the same writer.

    A write is taken or not by what was taken before it, so a register's log streams through one task, in order, with the
    register as the only state in memory.
    """

    def step(now, w):
        if now is not None and w["version"] != now[0] + 1 and (w["version"], w["writer"]) != (now[0], now[2]):
            return now, None
        now = (w["version"], w["state"], w["writer"], 1 if now is None else now[3] + 1)
        return now, dict(zip(("version", "state", "writer", "taken"), now, strict=True))

    own = log.select(register, order, F.col("version").cast("long"), F.col("state").cast("double"), F.col("writer").cast("long"))
    taken = op.scan_until(own, [register], [order], None, step, "_now", "struct<version:bigint,state:double,writer:bigint,taken:bigint>").where("_now is not null")
    return taken.groupBy(register).agg(F.max_by("_now", "_now.taken").alias("_now")).select(register, "_now.*")


@query("""
WITH RECURSIVE log AS (SELECT user_id AS register, event_id % 4 AS version, value AS state, event_id % 2 AS writer, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
run(register, n, version, state, writer, taken) AS (
  SELECT register, n, version, state, writer, 1::BIGINT FROM log WHERE n = 1
  UNION ALL
  SELECT log.register, log.n, CASE WHEN ok THEN log.version ELSE run.version END, CASE WHEN ok THEN log.state ELSE run.state END, CASE WHEN ok THEN log.writer ELSE run.writer END, run.taken + CASE WHEN ok THEN 1 ELSE 0 END
  FROM run JOIN log ON log.register = run.register AND log.n = run.n + 1, LATERAL (SELECT log.version = run.version + 1 OR (log.version = run.version AND log.writer = run.writer) AS ok) o)
SELECT register, arg_max(version, n) AS version, arg_max(state, n) AS state, arg_max(writer, n) AS writer, arg_max(taken, n) AS taken FROM run GROUP BY register""")
def cas_fold(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("register"), (F.col("event_id") % 4).alias("version"), F.col("value").alias("state"), (F.col("event_id") % 2).alias("writer"), "event_id")
    return cas_register(log, "register", "event_id")


@query("SELECT user_id AS register, cast(ts AS DATE) AS tick, arg_max(value, event_id) AS state FROM events WHERE event_type <> 'view' GROUP BY ALL")
def cas_reads(spark, d):
    """What a read in a tick returns: the last write that the tick attempted, taken or not; none without a write."""
    writes = table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("register"), F.to_date("ts").alias("tick"), "event_id", F.col("value").alias("state"))
    return op.last_by(writes, ["register", "tick"], F.col("event_id"), "state")


@query("SELECT event_id, user_id AS client_id, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 3 - 2 AS counter FROM events")
def encrypt_pipeline(spark, d):
    """Decrypt, copy, count the copies of a client, keep copy 0, encrypt; compared decrypted."""
    key = F.lit("0123456789abcdef")
    code = lambda f, x: F.call_function(f, x, key, F.lit("ECB"))
    sent = table(spark, d, "events").select("event_id", F.col("user_id").alias("client_id"), code("aes_encrypt", F.col("props")).alias("payload"))
    plain = sent.withColumn("payload", code("aes_decrypt", F.col("payload")))
    copies = op.flat_map(plain, "copy", F.sequence(F.lit(0), F.lit(2)), keep=("event_id", "client_id", "payload"))
    counted = op.scan_keyed(copies, ["client_id"], [F.col("event_id"), F.col("copy")], counter=F.count(F.lit(1)))
    out = counted.where("copy = 0").withColumn("payload", code("aes_encrypt", F.col("payload")))
    return out.select("event_id", "client_id", code("aes_decrypt", F.col("payload")).cast("string").alias("payload"), "counter")


@query("SELECT event_id, event_id % 100 < 30 AS is_write FROM events")
def bench_workload(spark, d):
    return table(spark, d, "events").select("event_id", (F.pmod("event_id", F.lit(100)) < 30).alias("is_write"))


@query(f"SELECT c_custkey, sha256(c_name || '{SECRET}') AS api_key FROM customer")
def api_key_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", api_key(F.col("c_name"), SECRET).alias("api_key"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def auth_join(spark, d):
    """Requests whose api key belongs to an admin."""
    c = table(spark, d, "customer")
    users = c.select(api_key(F.col("c_custkey").cast("string"), SECRET).alias("key"), "c_name", (F.col("c_mktsegment") == "BUILDING").alias("is_admin"))
    asks = table(spark, d, "orders").select("o_orderkey", api_key(F.col("o_custkey").cast("string"), SECRET).alias("key"))
    return op.join(asks, users.where("is_admin"), "key").select("o_orderkey", "c_name")


@query("SELECT doc_id, quality AS answer FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def questions_no_answer(spark, d):
    """Questions with their answers, chained with the questions that have none."""
    q, a = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("answer"))
    none = op.anti_join(q, a, ["doc_id"]).withColumn("answer", F.lit(None).cast("int"))
    return op.chain(op.join(q, a, "doc_id"), none)


@query("SELECT o_custkey, count(*) AS n, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
def list_per_user(spark, d):
    return op.fold_keyed(table(spark, d, "orders"), ["o_custkey"], n=F.count(F.lit(1)), orders=F.array_sort(F.collect_list("o_orderkey")))


@query("SELECT name, min(id) AS id FROM (SELECT n_name || '-' || (s_suppkey % 7) AS name, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY name")
def first_user_wins(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    asks = op.join(table(spark, d, "supplier"), n, "s_nationkey").select(F.concat("n_name", F.lit("-"), F.col("s_suppkey") % 7).alias("name"), F.col("s_suppkey").alias("id"))
    return op.first_by(asks, ["name"], F.col("id"), "id")


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events WHERE event_type = 'purchase') WHERE rank <= 20")
def stories_top20(spark, d):
    """The twenty first stories in time order, numbered."""
    few = op.top_k(table(spark, d, "events").where("event_type = 'purchase'"), 20, F.col("ts"), F.col("event_id"))
    return few.select("event_id", "user_id", F.row_number().over(W.orderBy("ts", "event_id")).cast("long").alias("rank"))
