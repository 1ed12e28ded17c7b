"""Queries of boards, directories, subscriptions and the keyed store, over sites and scans read off the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sql_rank, sql_rounded
from tessera.operators import board as b
from tessera.operators import history as h
from tessera.plans.history import _SYSTEM, FIRST
from tessera.sources.tables import SCANS_SQL, scans, table

#: The time that a restore is planned for, in epoch seconds.
NOW = 1_700_000_000


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """First contributions; those of every ninth scan wait for a score."""
    return h.first_by_domain(scans(spark, d)).select("domain", F.when(F.col("scan_id") % 9 != 0, F.col("score")).alias("score"), "scan_id", "ts")


_SITES = f"{SCANS_SQL}, {FIRST}, sites AS (SELECT domain, CASE WHEN scan_id % 9 <> 0 THEN score END AS score, scan_id, ts FROM first)"


def _store(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a keyed store: every seventh value is missing, every third expires around ``NOW``."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("c:"), key).alias("key"), F.when(key % 7 != 0, F.encode("c_name", "UTF-8")).alias("value"), F.when(key % 3 == 0, NOW - 100 + key % 400).cast("long").alias("expires")
    )


_STORE = f"""store AS (SELECT 'c:' || c_custkey AS key, CASE WHEN c_custkey % 7 <> 0 THEN encode(c_name) END AS value,
  CASE WHEN c_custkey % 3 = 0 THEN ({NOW} - 100 + c_custkey % 400)::BIGINT END AS expires FROM customer)"""


def score_tenths(spark: SparkSession, d: str) -> DataFrame:
    return b.tenths(_sites(spark, d))


def score_own_tenth(spark: SparkSession, d: str) -> DataFrame:
    return b.own_tenth(_sites(spark, d))


def peer_place(spark: SparkSession, d: str) -> DataFrame:
    return b.places(scans(spark, d))


def history_points(spark: SparkSession, d: str) -> DataFrame:
    return b.points(scans(spark, d))


def dashboard_sites(spark: SparkSession, d: str) -> DataFrame:
    return b.dashboard(scans(spark, d))


def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return b.dashboard_counts(dashboard_sites(spark, d))


def directory_clean(spark: SparkSession, d: str) -> DataFrame:
    return b.directory(_sites(spark, d)).select("domain", "score")


def directory_slop(spark: SparkSession, d: str) -> DataFrame:
    return b.directory(_sites(spark, d), worst_first=True, asked=2000).select("domain", "score")


def watch_sweep(spark: SparkSession, d: str) -> DataFrame:
    return b.sweep(_sites(spark, d).withColumnRenamed("ts", "checked_at")).select("domain")


def verified_listings(spark: SparkSession, d: str) -> DataFrame:
    watches = scans(spark, d).select("domain", (F.col("k") % 5 == 0).alias("confirmed"))
    return b.verified(_sites(spark, d), watches).select("domain", "score")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    flags = {n: F.when(F.col("scan_id") % m != 1, F.col("scan_id") % m == 0) for n, m in (("removed", 5), ("unsubscribed", 7), ("disabled", 11))}
    return b.deliverable(scans(spark, d).withColumns(flags)).select("scan_id", "domain")


def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return b.snapshot(_store(spark, d))


def store_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a manifest in which every 13th checksum was spoiled and one key comes twice."""
    m = b.snapshot(_store(spark, d))
    spoiled = F.substring("key", 3, 20).cast("long") % 13 == 0
    return b.faults(m.withColumn("sha256", F.when(spoiled, "0").otherwise(F.col("sha256"))).union(m.where("key = 'c:1'")))


def store_restore(spark: SparkSession, d: str) -> DataFrame:
    return b.restore_plan(b.snapshot(_store(spark, d)), NOW)


QUERIES = {f.__name__: f for f in (
    score_tenths, score_own_tenth, peer_place, history_points, dashboard_sites, dashboard_counts, directory_clean, directory_slop, watch_sweep, verified_listings, deliveries,
    store_snapshot, store_faults, store_restore,
)}
_TENTH = "least(9, floor(score / 10))::INT"
_BOARD = f"""{SCANS_SQL}, {FIRST}, last AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, scan_id DESC) = 1),
board AS (SELECT l.domain, l.score, l.tier, {_SYSTEM('l.system_score')} AS system_tier, ({sql_rank('l.tier')}) > ({sql_rank('f.tier')}) OR l.score - f.score >= 8 AS regressed,
  l.system_score < 80 AND (f.system_score >= 80 OR f.system_score - l.system_score >= 15) AS system_regressed FROM last l JOIN first f USING (domain))"""
ORACLES = {
    "score_tenths": f"WITH {_SITES} SELECT {_TENTH} AS bucket, count(*) AS sites FROM sites WHERE score IS NOT NULL GROUP BY 1",
    "score_own_tenth": f"WITH {_SITES} SELECT domain, score, {_TENTH} AS bucket, count(*) OVER (PARTITION BY {_TENTH}) AS sites FROM sites WHERE score IS NOT NULL",
    "peer_place": f"""WITH {SCANS_SQL}, w AS (SELECT scan_id, domain, count(*) OVER () AS n, {sql_rounded('100.0::DOUBLE * (count(*) OVER () - count(*) OVER (ORDER BY score)) / count(*) OVER ()')} AS pct FROM scans)
SELECT scan_id, domain, greatest(1, least(n, n - {sql_rounded('n * pct / 100')}))::BIGINT AS place, n AS "of" FROM w""",
    "history_points": f"""WITH {SCANS_SQL}, t AS (SELECT domain, scan_id, score, ts FROM scans QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, scan_id DESC) <= 30)
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts, scan_id) AS point, scan_id, score FROM t""",
    "dashboard_sites": f"WITH {_BOARD} SELECT *, regressed OR system_regressed AS drifted FROM board",
    "dashboard_counts": f"""WITH {_BOARD} SELECT count(*) AS watches, count(*) FILTER (regressed OR system_regressed) AS drifted, count(*) FILTER (tier = 'Clean') AS clean,
  count(*) FILTER (system_tier = 'Aligned') AS aligned FROM board""",
    "directory_clean": f"WITH {_SITES} SELECT domain, score FROM sites ORDER BY score ASC NULLS LAST, domain LIMIT 500",
    "directory_slop": f"WITH {_SITES} SELECT domain, score FROM sites ORDER BY score DESC NULLS LAST, domain LIMIT 1000",
    "watch_sweep": f"WITH {_SITES} SELECT domain FROM sites ORDER BY ts, domain LIMIT 50",
    "verified_listings": f"WITH {_SITES} SELECT domain, score FROM sites WHERE domain IN (SELECT domain FROM scans WHERE k % 5 = 0)",
    "deliveries": f"WITH {SCANS_SQL} SELECT scan_id, domain FROM scans WHERE scan_id % 5 <> 0 AND scan_id % 7 <> 0 AND scan_id % 11 <> 0",
    "store_snapshot": f"WITH {_STORE} SELECT key, expires, sha256(value) AS sha256, base64(value) AS base64, value IS NULL AS missing FROM store",
    "store_faults": f"""WITH {_STORE} SELECT key, CASE WHEN value IS NULL THEN 'no value' WHEN key = 'c:1' THEN 'repeated key' ELSE 'checksum' END AS fault
FROM (SELECT * FROM store UNION ALL SELECT * FROM store WHERE key = 'c:1') s WHERE value IS NULL OR key = 'c:1' OR substr(key, 3)::BIGINT % 13 = 0""",
    "store_restore": f"""WITH {_STORE}, v AS (SELECT octet_length(value) AS n, coalesce(expires - {NOW} < 60, false) AS short FROM store WHERE value IS NOT NULL)
SELECT count(*) FILTER (NOT short) AS writes, count(*) FILTER (short) AS skipped, coalesce(sum(n) FILTER (NOT short), 0)::BIGINT AS bytes FROM v""",
}
