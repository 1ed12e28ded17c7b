"""Queries over scan history and request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.text import sql_rank, sql_rounded, sql_tier
from tessera.operators import history as h
from tessera.sources.tables import SCANS_SQL, SQL_FLAGGED, flagged, scans, table

RULES = flagged
KNOWN, FLOWS, AEO_COST = ["view", "click", "purchase"], ["signup", "click", "purchase"], 3


def rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in catalog.DESIGN_RULES], "id string, category string, weight int")


SQL_RULE_DIM = "dim(id, category, weight) AS (VALUES " + ", ".join(f"('{i}', '{c}', {w})" for i, c, w, _ in catalog.DESIGN_RULES) + ")"
FIRST = "first AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts, scan_id) = 1)"


def score_hist(spark: SparkSession, d: str) -> DataFrame:
    return h.histogram(h.first_by_domain(scans(spark, d)))


def headline_stats(spark: SparkSession, d: str) -> DataFrame:
    return h.headline(h.histogram(scans(spark, d)))


def peer_percentile(spark: SparkSession, d: str) -> DataFrame:
    return h.percentiles(scans(spark, d))


def domain_first(spark: SparkSession, d: str) -> DataFrame:
    return h.first_by_domain(scans(spark, d)).select("domain", "scan_id", "score", "tier")


def timeline_cap(spark: SparkSession, d: str) -> DataFrame:
    return h.timeline(scans(spark, d), 50).select("domain", "ord", "scan_id", "score")


def regression_flags(spark: SparkSession, d: str) -> DataFrame:
    return h.regressions(scans(spark, d)).select("scan_id", "domain", "score", "base_score", "delta", "regressed")


def drift_flags(spark: SparkSession, d: str) -> DataFrame:
    return h.system_drift(scans(spark, d)).select("scan_id", "domain", "system_score", "base_system", "system_tier", "drifted")


def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    return h.alerts(scans(spark, d)).select("domain", "scan_id", "score", "base_score")


def webhook_breaker(spark: SparkSession, d: str) -> DataFrame:
    return h.circuit_breaker(scans(spark, d).select("domain", "ts", "scan_id", (F.col("k") % 2 == 0).alias("ok")))


def run_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return h.run_aggregate(scans(spark, d), "domain", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def compare_scans(spark: SparkSession, d: str) -> DataFrame:
    return h.compared(scans(spark, d), flagged(F.col("k")))


def leaderboard_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return h.leaderboard(h.first_by_domain(scans(spark, d)))


def leaderboard_places(spark: SparkSession, d: str) -> DataFrame:
    return h.ranked_sites(h.first_by_domain(scans(spark, d))).select("place", "domain", "score", "tier")


def peer_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return h.neighbours(h.first_by_domain(scans(spark, d)))


def rule_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return h.prevalence(scans(spark, d), flagged(F.col("k")))


def prevalence_bands(spark: SparkSession, d: str) -> DataFrame:
    return h.flag_bands(scans(spark, d), flagged(F.col("k")))


def category_clean_fractions(spark: SparkSession, d: str) -> DataFrame:
    return h.category_clean(scans(spark, d), flagged(F.col("k")), rule_dim(spark))


def ops_daily(spark: SparkSession, d: str) -> DataFrame:
    return h.ops_daily(table(spark, d, "events"), KNOWN)


def flow_daily(spark: SparkSession, d: str) -> DataFrame:
    return h.flow_daily(table(spark, d, "events"), FLOWS)


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    return h.rolling_rate(table(spark, d, "events"), 3600, 6)


def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    return h.daily_budget(table(spark, d, "events"), F.when(F.col("event_type") == "purchase", AEO_COST).otherwise(1), 5)


def directory_page(spark: SparkSession, d: str) -> DataFrame:
    return h.next_page(h.first_by_domain(scans(spark, d)), "site2", 25).select("domain", "score", "tier")


QUERIES = {f.__name__: f for f in (
    score_hist, headline_stats, peer_percentile, domain_first, timeline_cap, regression_flags, drift_flags, watch_alerts, webhook_breaker, run_aggregates,
    compare_scans, leaderboard_grouping_sets, leaderboard_places, peer_neighbours, rule_prevalence, prevalence_bands, category_clean_fractions, ops_daily,
    flow_daily, rate_windows, daily_budget, directory_page,
)}
_REGRESSED = f"""{FIRST}, r AS (SELECT s.*, f.score AS base_score, s.score - f.score AS delta,
  ({sql_rank('s.tier')}) > ({sql_rank('f.tier')}) OR s.score - f.score >= 8 AS regressed FROM scans s JOIN first f USING (domain))"""
_SYSTEM = lambda s: f"CASE WHEN {s} >= 80 THEN 'Aligned' WHEN {s} >= 50 THEN 'Drifting' ELSE 'Off-system' END"
ORACLES = {
    "score_hist": f"WITH {SCANS_SQL}, {FIRST} SELECT score AS bucket, count(*) AS n FROM first GROUP BY score",
    "headline_stats": f"""WITH {SCANS_SQL} SELECT count(*) AS scans, {sql_rounded('avg(score)', 1)} AS average, {sql_rounded("100 * (1 - count(*) FILTER (tier = 'Clean') / count(*))")} AS above_clean,
  count(*) FILTER (tier = 'Clean') AS clean, count(*) FILTER (tier = 'Mild') AS mild, count(*) FILTER (tier = 'Heavy') AS heavy FROM scans""",
    "peer_percentile": f"""WITH {SCANS_SQL}, w AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) - count(*) AS worse, sum(count(*)) OVER () AS n FROM scans GROUP BY score)
SELECT scan_id, domain, score, {sql_rounded('100.0::DOUBLE * worse / n')}::INT AS percentile FROM scans JOIN w USING (score)""",
    "domain_first": f"WITH {SCANS_SQL}, {FIRST} SELECT domain, scan_id, score, tier FROM first",
    "timeline_cap": f"WITH {SCANS_SQL} SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, scan_id DESC) AS ord, scan_id, score FROM scans QUALIFY ord <= 50",
    "regression_flags": f"WITH {SCANS_SQL}, {_REGRESSED} SELECT scan_id, domain, score, base_score, delta, regressed FROM r",
    "drift_flags": f"""WITH {SCANS_SQL}, {FIRST}, s AS (SELECT s.scan_id, domain, s.system_score, f.system_score AS base_system FROM scans s JOIN first f USING (domain))
SELECT scan_id, domain, system_score, base_system, {_SYSTEM('system_score')} AS system_tier, system_score < 80 AND (base_system >= 80 OR base_system - system_score >= 15) AS drifted FROM s""",
    "watch_alerts": f"""WITH {SCANS_SQL}, {_REGRESSED}, a AS (SELECT *, lag(regressed, 1, false) OVER (PARTITION BY domain ORDER BY ts, scan_id) AS before FROM r)
SELECT domain, scan_id, score, base_score FROM a WHERE regressed AND NOT before""",
    "webhook_breaker": f"""WITH {SCANS_SQL}, r AS (SELECT domain, ts, scan_id, k % 2 = 0 AS ok, sum((k % 2 = 0)::INT) OVER (PARTITION BY domain ORDER BY ts, scan_id) AS run FROM scans),
n AS (SELECT domain, ts, row_number() OVER (PARTITION BY domain, run ORDER BY ts, scan_id) AS failures FROM r WHERE NOT ok)
SELECT domain, min(ts) AS disabled_at FROM n WHERE failures = 5 GROUP BY domain""",
    "run_aggregates": f"""WITH {SCANS_SQL}, g AS (SELECT domain, strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(DISTINCT environment) AS environments, count(DISTINCT version) = 1 AS accepted,
  floor(quantile_cont(score, 0.5) + 0.5)::INT AS m, max(score) AS x, min(score) AS n FROM scans GROUP BY ALL)
SELECT domain, day, runs, environments, accepted, CASE WHEN accepted THEN m END AS median_score, CASE WHEN accepted THEN x END AS max_score, CASE WHEN accepted THEN x - n END AS spread,
  CASE WHEN accepted THEN {sql_tier('m')} END AS tier FROM g""",
    "compare_scans": f"""WITH {SCANS_SQL}, n AS (SELECT *, {SQL_FLAGGED} AS rules FROM scans),
p AS (SELECT *, lag(scan_id) OVER w AS before_id, lag(score) OVER w AS ps, lag(tier) OVER w AS pt, lag(version) OVER w AS pv, lag(rules) OVER w AS pr FROM n WINDOW w AS (PARTITION BY domain ORDER BY ts, scan_id)),
q AS (SELECT *, list_sort(list_filter(rules, lambda x: NOT list_contains(pr, x))) AS a, list_sort(list_filter(pr, lambda x: NOT list_contains(rules, x))) AS r FROM p WHERE before_id IS NOT NULL)
SELECT domain, scan_id, before_id, version = pv AS comparable, score - ps AS delta, array_to_string(a, ',') AS added, array_to_string(r, ',') AS resolved,
  version = pv AND (score > ps OR len(a) > 0) AS regression,
  CASE WHEN version <> pv THEN 'rescored' WHEN tier <> pt THEN 'tier_change' WHEN score > ps THEN 'regression' ELSE 'unchanged' END AS event FROM q""",
    "leaderboard_grouping_sets": f"""WITH {SCANS_SQL}, {FIRST} SELECT builder, category, count(*) AS sites, count(score) AS scored, sum(score)::BIGINT AS points,
  count(*) FILTER (tier = 'Clean') AS clean, count(*) FILTER (tier = 'Mild') AS mild, count(*) FILTER (tier = 'Heavy') AS heavy FROM first GROUP BY GROUPING SETS ((builder), (category), ())""",
    "leaderboard_places": f"WITH {SCANS_SQL}, {FIRST} SELECT row_number() OVER (ORDER BY score, domain) AS place, domain, score, tier FROM first",
    "peer_neighbours": f"""WITH {SCANS_SQL}, {FIRST}, g AS (SELECT category, count(*) AS peers, {sql_rounded('avg(score)', 1)} AS peer_average, count(*) FILTER (tier = 'Heavy') AS heavy_peers FROM first GROUP BY category),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score, domain) AS place FROM first)
SELECT category, place, domain, score, peers, peer_average, heavy_peers FROM n JOIN g USING (category) WHERE place <= 6 AND peers >= 2""",
    "rule_prevalence": f"""WITH {SCANS_SQL}, e AS (SELECT unnest({SQL_FLAGGED}) AS rule_id FROM scans)
SELECT rule_id, count(*) AS n, {sql_rounded('100.0::DOUBLE * count(*) / (SELECT count(*) FROM scans)', 1)} AS percent FROM e GROUP BY rule_id""",
    "prevalence_bands": f"""WITH {SCANS_SQL}, e AS (SELECT len({SQL_FLAGGED}) AS n FROM scans)
SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS band, count(*) AS scans, sum(n)::BIGINT AS flags FROM e GROUP BY band""",
    "category_clean_fractions": f"""WITH {SCANS_SQL}, {SQL_RULE_DIM}, e AS (SELECT unnest({SQL_FLAGGED}) AS id FROM scans),
l AS (SELECT category, sum(weight) AS lost FROM e JOIN dim USING (id) GROUP BY category), m AS (SELECT category, sum(weight) AS most FROM dim WHERE weight > 0 GROUP BY category)
SELECT category, {sql_rounded('1 - coalesce(lost, 0)::DOUBLE / most / (SELECT count(*) FROM scans)', 4)} AS clean_fraction FROM m LEFT JOIN l USING (category)""",
    "ops_daily": """SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'other' END AS route,
  CASE WHEN value <= 1 THEN '<=1' WHEN value <= 3 THEN '<=3' WHEN value <= 8 THEN '<=8' WHEN value <= 15 THEN '<=15' ELSE '>15' END AS latency,
  count(*) AS requests, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""",
    "flow_daily": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'click') AS click,
  count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('signup', 'click', 'purchase') GROUP BY day""",
    "rate_windows": """WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)
SELECT event_id, user_id, recent, recent > 6 AS limited FROM r""",
    "daily_budget": """WITH b AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END)
  OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events)
SELECT event_id, user_id, day, spent, spent <= 5 AS allowed FROM b""",
    "directory_page": f"WITH {SCANS_SQL}, {FIRST} SELECT domain, score, tier FROM first WHERE domain > 'site2' ORDER BY domain LIMIT 25",
}
