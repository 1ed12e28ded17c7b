"""The keyed store and the event-time timeline: late rows, ends of life, restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import history, store
from tessera.streaming import jobs

T0 = datetime(2026, 1, 1)
LOG = "key string, op string, value string, at timestamp, seq long, ttl long"


def at(seconds: int) -> datetime:
    return T0 + timedelta(seconds=seconds)


def plain(log: list[tuple], now: datetime) -> dict:
    last: dict = {}
    for key, op, value, when, seq, ttl in log:
        if key is not None and when <= now and (key not in last or (when, seq) > last[key][:2]):
            last[key] = (when, seq, op, value, ttl)
    return {k: v[3] for k, v in last.items() if v[2] == "put" and (v[4] is None or v[0] + timedelta(seconds=v[4]) > now)}


def test_store_against_a_plain_one(spark):
    rng = random.Random(4)
    log = [(rng.choice(["a:1", "a:2", "a:20", "b:1", "b:2", None]), rng.choice(["put", "put", "delete"]), f"v{k}", at(rng.randint(0, 50)), k, rng.choice([None, 5, 20])) for k in range(300)]
    df = spark.createDataFrame(log, LOG).withColumn("extra", F.lit(1))
    for now in (-1, 0, 10, 25, 60, 100):
        state = store.compacted(df, F.lit(at(now)))
        assert {r["key"]: r["value"] for r in state.collect()} == plain(log, at(now)), now
    then = store.compacted(df, F.lit(at(30)))
    later = store.merged(then, df.where(F.col("at") > F.lit(at(30))).repartition(3), F.lit(at(60)))
    assert {r["key"]: r["value"] for r in later.collect()} == plain(log, at(60))
    assert store.compacted(df.limit(0), F.lit(at(9))).count() == 0


def test_keys_expire_at_the_second(spark):
    df = spark.createDataFrame([("k", "put", "v", at(0), 1, 10)], LOG)
    assert [store.compacted(df, F.lit(at(s))).count() for s in (9, 10)] == [1, 0]


def test_lists_and_prefixes(spark, tmp_path):
    state = spark.createDataFrame([(f"{p}:{k:04d}", f"v{k}") for p in "abc" for k in range(500)], "key string, value string")
    pages, after = [], None
    while True:
        page = store.listed(state, "b:", 200, after).orderBy("key").collect()
        pages.append([r["key"] for r in page])
        after = page[-1]["cursor"]
        if page[0]["complete"]:
            break
    assert [len(p) for p in pages] == [200, 200, 100] and sum(pages, []) == [f"b:{k:04d}" for k in range(500)] and after is None
    assert store.listed(state, "z:").count() == 0
    store.write_sorted(state.repartition(5), f"{tmp_path}/s")
    found = store.prefixed(spark, f"{tmp_path}/s", "c:01")
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,c:01)" in plan and "GreaterThanOrEqual(key,c:01)" in plan


def test_verify(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None), ("more", "x")], "key string, value string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "1"), ("n", None)], "key string, v string").select("key", F.sha2(F.col("v").cast("binary"), 256).alias("sha256"))
    assert sorted(tuple(r) for r in store.verified(manifest, state).collect()) == [("b", "bytes-differ"), ("c", "missing-live")]
    assert sorted(tuple(r) for r in store.got(state, spark.createDataFrame([("a",), ("zz",)], "key string")).collect()) == [("a", "1"), ("zz", None)]


def test_late_rows_and_a_restart_give_the_batch_timeline(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(3)}", at(rng.randrange(100_000)), k, None if k % 7 == 0 else k % 100) for k in range(400)]
    rng.shuffle(rows)
    schema = "domain string, ts timestamp, scan_id long, score int"
    source, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.timelines(stream, 20).writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:150], rows[150:250]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    run()
    # a new run over the same state, with rows older than what it holds, some of them again
    spark.createDataFrame(rows[240:], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = jobs.newest_timelines(spark.read.schema(jobs.TIMELINES).parquet(out))
    want = history.timeline(spark.createDataFrame(rows, schema), 20)
    columns = ["domain", "ord", "scan_id", "score"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == 60


def test_breaker_over_a_restart(spark, tmp_path):
    """Failures are counted over micro-batches and runs; what is off stays off."""
    rng = random.Random(9)
    rows = [(f"d{k % 4}", at(k), k, rng.random() < (0.5 if k % 4 else 0.1)) for k in range(300)]
    schema = "domain string, ts timestamp, scan_id long, ok boolean"
    source, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    for part in (rows[:3], rows[3:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.breakers(stream).writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("domain string, disabled_at timestamp").parquet(out)
    want = history.circuit_breaker(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 1
