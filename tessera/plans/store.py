"""Queries of the keyed store: a log of changes read off the scans, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.sources.tables import SCANS_SQL, scans, table

#: Seconds before the end at which results expire, so that some have: a hundredth of what they live for.
SHORT = store.RESULT_TTL // 100


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Every scan puts its result, its domain's latest, and a watch; errors delete the watch."""
    s = scans(spark, d)
    change = lambda key, op, value, ttl: F.struct(key.alias("key"), F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), value.cast("string").alias("value"), ttl.cast("long").alias("ttl"))
    watch = F.when(F.col("environment") == "error", "delete").otherwise("put")
    each = F.array(
        change(F.concat(F.lit("r:"), F.col("scan_id")), "put", F.concat_ws("|", "domain", "score", "tier"), F.lit(SHORT)),
        change(F.concat(F.lit("d:"), F.col("domain")), "put", F.col("scan_id"), F.lit(SHORT)),
        change(F.concat(F.lit("w:"), F.col("domain")), watch, F.col("score"), F.lit(None)),
    )
    return s.select(F.col("ts").cast("timestamp").alias("at"), F.col("scan_id").alias("seq"), F.explode(each).alias("c")).select("c.*", "at", "seq")


def _now(spark: SparkSession, d: str, back: int = 0) -> Column:
    """The time of the last event, or some seconds before."""
    last = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t"))
    return F.lit(last.first()["t"]).cast("timestamp") - F.make_dt_interval(secs=F.lit(back))


def store_state(spark: SparkSession, d: str) -> DataFrame:
    return store.compacted(_log(spark, d), _now(spark, d)).select("key", "value", "seq")


def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """The state of a week before, and the changes since."""
    then, now, log = _now(spark, d, 7 * 86_400), _now(spark, d), _log(spark, d)
    return store.merged(store.compacted(log, then), log.where(F.col("at") > then), now).select("key", "value", "seq")


def store_list(spark: SparkSession, d: str) -> DataFrame:
    return store.listed(store.compacted(_log(spark, d), _now(spark, d)), "w:", 20, "w:site2")


def store_get(spark: SparkSession, d: str) -> DataFrame:
    keys = scans(spark, d).select(F.concat(F.lit("r:"), F.col("scan_id")).alias("key"))
    return store.got(store.compacted(_log(spark, d), _now(spark, d)), keys)


def store_verify(spark: SparkSession, d: str) -> DataFrame:
    """A backup of a week before against what there is now."""
    log = _log(spark, d)
    backup = store.compacted(log, _now(spark, d, 7 * 86_400)).select("key", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    return store.verified(backup, store.compacted(log, _now(spark, d)))


_LOG = f"""{SCANS_SQL}, lg AS (
  SELECT 'r:' || scan_id AS key, 'put' AS op, concat_ws('|', domain, score, tier) AS value, {SHORT} AS ttl, ts AS tt, scan_id AS seq FROM scans
  UNION ALL SELECT 'd:' || domain, 'put', scan_id::VARCHAR, {SHORT}, ts, scan_id FROM scans
  UNION ALL SELECT 'w:' || domain, CASE WHEN environment = 'error' THEN 'delete' ELSE 'put' END, score::VARCHAR, NULL, ts, scan_id FROM scans),
nw AS (SELECT max(ts) AS t FROM events)"""
_STATE = lambda name, back: f"""{name} AS (SELECT key, value, seq FROM (SELECT lg.*, t - INTERVAL {back} SECOND AS z FROM lg, nw WHERE tt <= t - INTERVAL {back} SECOND
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY tt DESC, seq DESC) = 1) WHERE op = 'put' AND (ttl IS NULL OR tt + to_seconds(ttl) > z))"""  # noqa: E731
QUERIES = {f.__name__: f for f in (store_state, store_merge, store_list, store_get, store_verify)}
ORACLES = {
    "store_state": f"WITH {_LOG}, {_STATE('s', 0)} SELECT * FROM s",
    "store_merge": f"WITH {_LOG}, {_STATE('s', 0)} SELECT * FROM s",
    "store_list": f"""WITH {_LOG}, {_STATE('s', 0)}, p AS (SELECT key, value, row_number() OVER (ORDER BY key) AS n, count(*) OVER () AS m FROM s WHERE key LIKE 'w:%' AND key > 'w:site2'),
q AS (SELECT *, m <= 20 AS complete FROM p WHERE n <= 20) SELECT key, value, complete, CASE WHEN NOT complete THEN max(key) OVER () END AS cursor FROM q""",
    "store_get": f"WITH {_LOG}, {_STATE('s', 0)} SELECT 'r:' || scan_id AS key, s.value FROM scans LEFT JOIN s ON s.key = 'r:' || scan_id",
    "store_verify": f"""WITH {_LOG}, {_STATE('s', 0)}, {_STATE('o', 7 * 86400)}
SELECT o.key, CASE WHEN s.key IS NULL THEN 'missing-live' ELSE 'bytes-differ' END AS reason FROM o LEFT JOIN s USING (key) WHERE s.key IS NULL OR s.value <> o.value""",
}
