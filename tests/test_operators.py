"""Cases that the tables don't have: nulls, duplicates, empty flows, lineage and streams."""

import time

from pyspark.sql import functions as F

from weirflow import operators as op
from weirflow import plans, sources, streaming
from weirflow.apps import profiling, programs
from weirflow.operators import ticks


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_difference_is_null_safe_and_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], "a int, b string")
    assert got(op.difference(a, spark.createDataFrame([(1, None)], "a int, b string"))) == [(2, "x"), (2, "x")]
    assert got(op.anti_join(a, spark.createDataFrame([(None,)], "b string"), ["b"])) == [(2, "x"), (2, "x")]
    assert got(op.semi_join(a, spark.createDataFrame([(None,)], "b string"), ["b"])) == [(1, None), (1, None)]


def test_partition_puts_null_into_false(spark):
    yes, no = op.partition(spark.createDataFrame([(1,), (None,), (3,)], "a int"), F.col("a") > 2)
    assert got(yes) == [(3,)] and got(no) == [(1,), (None,)]


def test_fold_and_reduce_of_nothing(spark):
    none = spark.createDataFrame([], "a int")
    assert got(op.fold(none, {"s": 7}, s=F.sum("a"))) == [(7,)]
    assert got(op.reduce(none, s=F.sum("a"))) == []


def test_chain_first_and_filter_if(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    assert got(op.chain_first(a, b)) == [(1,)]
    assert got(op.chain_first(a.where("false"), b)) == [(2,)]
    assert got(op.filter_if(a, spark.range(1).select(F.lit(None).cast("boolean")))) == []


def test_enumerate_and_scan_cross_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).cast("long").alias("v"))
    out = op.scan(op.enumerate_rows(df, ["k"]), ["k"], "v", "run")
    assert out.where((F.col("index") != F.col("k")) | (F.col("run") != 2 * (F.col("k") + 1))).count() == 0


def test_enumerate_of_many_rows_with_other_columns(spark):
    """The bounds of the ranges are drawn once, whatever columns are read afterwards."""
    n = 3_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = op.enumerate_rows(df, ["k"], blocks=8)
    assert str(out._jdf.queryExecution().executedPlan()).count("Exchange rangepartitioning") == 0
    for own in (out.select("index", "payload"), out.select("index")):
        assert own.agg(F.count_distinct("index"), F.min("index"), F.max("index")).first() == (n, 0, n - 1)
    w = op.W.orderBy("index")
    assert out.where("index < 1000").withColumn("last", F.lag("k").over(w)).where("last >= k").count() == 0


def test_scan_until_ends_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), (None, 9), ("a", 4)], "k string, v int")
    step = lambda s, r: None if r["v"] == 3 else (s + r["v"], str(s + r["v"]))
    assert got(op.scan_until(df, ["k"], ["v"], 0, step, "s", "string")) == sorted([("a", 1, "1"), ("a", 2, "3"), ("b", 5, "5"), (None, 9, "9")], key=repr)
    assert got(op.scan_until(df.limit(0), ["k"], ["v"], 0, step, "s", "string")) == []


def test_cycle_reaches_a_fixpoint_with_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "a int, b int")
    start = spark.createDataFrame([(1,)], "n int")
    step = lambda new: new.join(edges, new["n"] == edges["a"]).select(F.col("b").alias("n"))
    assert got(ticks.cycle(start, step, sources.saved)) == [(1,), (2,), (3,)]


def test_snapshot_of_minima(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 1)], "k string, tick int, v int")
    assert got(ticks.snapshot(df, ["k"], "tick", again=F.min, low=F.min("v"))) == [("a", 1, 5), ("a", 2, 5), ("a", 3, 1)]


def test_locks_and_registers(spark):
    log = spark.createDataFrame([(1, 1, True, 1), (1, 2, True, 2), (1, 2, False, 3), (1, 1, False, 4), (1, 2, True, 5)], "lock long, client long, acquire boolean, at long")
    assert got(programs.lock_holders(log, "lock", "client", "acquire", "at")) == [(1, 2)]
    writes = spark.createDataFrame([(1, 5, 1.0, 1, 1), (1, 5, 2.0, 2, 2), (1, 6, 3.0, 2, 3), (1, 6, 4.0, 2, 4)], "r long, version long, state double, writer long, at long")
    assert got(programs.cas_register(writes, "r", "at")) == [(1, 6, 4.0, 2, 3)]


def test_lock_ranges_compose(spark):
    """One hot lock over many ranges, against a plain fold."""
    import random

    rnd, rows, want = random.Random(2), [], {}
    for at in range(3000):
        lock, client = rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(6)
        acquire = rnd.random() < 0.5
        rows.append((lock, client, acquire, at))
        held = want.setdefault(lock, None)
        if acquire and held is None:
            want[lock] = client
        elif not acquire and held == client:
            want[lock] = None
    log = spark.createDataFrame(rows, "lock long, client long, acquire boolean, at long")
    for blocks in (1, 2, 13):
        assert got(programs.lock_holders(log, "lock", "client", "acquire", "at", blocks)) == sorted(want.items(), key=repr)
    assert got(programs.lock_holders(log.limit(0), "lock", "client", "acquire", "at")) == []


def test_profiling_lines_and_stacks(spark):
    df = spark.createDataFrame([("THR: 1234.9 requests/s",), ("none",), (None,)], "line string")
    assert [r[0] for r in df.select(profiling.throughput(F.col("line"))).collect()] == [1234, None, None]
    lat = spark.createDataFrame([("p50: 1.234 | p99 2.345 | p999 3.456 ms (100 samples)",)], "line string").select(profiling.latency(F.col("line")).alias("l")).select("l.*")
    assert got(lat) == [(1.234, 2.345, 3.456, 100)]
    stacks = spark.createDataFrame([("main;op_1;op_2", 30), ("main;op_1;pull", 10), ("io-net;op_1", 99), ("main;idle", 60)], "stack string, samples long")
    assert got(profiling.perf_fractions(stacks)) == [("op_1", 0.1), ("op_2", 0.3)]


def test_lineage_and_copartition():
    a, b = plans.Lineage.source("x", ["a", "b"]), plans.Lineage.source("y", ["a", "b"])
    both = a.map(k="a", v="b").chain(a.map(k="b", v="a"))
    assert plans.copartition([plans.Constraint.key((both, "k"))]) == []
    assert plans.copartition([plans.Constraint.key((a, "b"), (b, "b"))]) == [{"x": "b", "y": "b"}]
    assert plans.copartition([plans.Constraint.impossible(a, b)]) == []
    assert plans.copartition([plans.Constraint.impossible(a, plans.Lineage())]) == [{}]


def test_cheapest_placement_avoids_dear_cuts():
    load, at = plans.cheapest(["a", "b", "c"], {"a": 5.0, "b": 5.0, "c": 1.0}, [("a", "b", 0.5), ("b", "c", 9.0)], 2)
    assert at["b"] == at["c"] != at["a"] and load == 6.5


def test_streams_end_like_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    data = spark.createDataFrame([(k % 3, k, k) for k in range(30)], "k long, v long, o long").withColumn("ts", F.timestamp_seconds("o"))
    data.write.parquet(src)
    stream = sources.source_stream(spark, src, data.schema)
    q = streaming.last_writer(stream, "k", "v", "o").writeStream.outputMode("complete").format("memory").queryName("lww").start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("lww")) == [(0, 27), (1, 28), (2, 29)]
    w = streaming.reduce_keyed_watermark(stream, ["k"], "ts", "1 second", "10 seconds", top=F.max("v")).writeStream.outputMode("append").format("memory").queryName("wm").start()
    w.processAllAvailable()
    time.sleep(0)
    w.stop()
    assert {(r["k"], r["top"]) for r in spark.table("wm").collect()} <= {(k, t) for k in range(3) for t in range(30) if t % 3 == k}


def test_lock_tick_carries_holders_across_ticks(spark):
    from collections import defaultdict

    from weirflow import queries as core

    sf = "/root/testdata/sf0.001"
    days, want, held = defaultdict(list), {}, set()
    for e in spark.read.parquet(f"{sf}/events.parquet").collect():
        days[e.ts.date()].append((e.event_id, e.user_id % 100, e.event_type in ("click", "view", "purchase")))
    for day in sorted(days):
        held -= {lock for _, lock, acquire in days[day] if not acquire}
        before = set(held)
        for event, lock, acquire in sorted(days[day]):
            if acquire:
                want[event] = lock not in before and lock not in held
                held.add(lock)
    got = {r.event_id: r.granted for r in core.queries()["lock_tick"](spark, sf).collect()}
    assert got == want and not all(want.values())
