"""Streams run over the events there are, to be compared with the batch queries that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tier, tier_rank
from tessera.plans import history
from tessera.streaming import jobs


def stream_watch(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.lit(100), F.floor("value")).cast("int")
    rows = jobs.event_stream(spark, d).select(
        F.concat(F.lit("site"), "user_id").alias("domain"), "ts", F.col("event_id").alias("scan_id"), score.alias("score"), tier_rank(tier(score)).cast("int").alias("rank")
    )
    return jobs.finished(jobs.alerts(rows))


def stream_rate(spark: SparkSession, d: str) -> DataFrame:
    return jobs.finished(jobs.limited(jobs.event_stream(spark, d).select("user_id", "ts", "event_id"), 3600, 3))


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has closed: all but the last two."""
    return jobs.finished(jobs.daily(jobs.event_stream(spark, d)))


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    return jobs.finished(jobs.first_contributions(jobs.event_stream(spark, d))).select("user_id")


def stream_timeline(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.lit(100), F.floor("value")).cast("int")
    rows = jobs.event_stream(spark, d).select(F.concat(F.lit("site"), "user_id").alias("domain"), "ts", F.col("event_id").alias("scan_id"), score.alias("score"))
    return jobs.newest_timelines(jobs.finished(jobs.timelines(rows, 50)))


def stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    ok = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    rows = jobs.event_stream(spark, d).select(F.concat(F.lit("site"), "user_id").alias("domain"), "ts", F.col("event_id").alias("scan_id"), ok.alias("ok"))
    return jobs.finished(jobs.breakers(rows))


QUERIES = {f.__name__: f for f in (stream_watch, stream_rate, stream_daily, stream_first, stream_timeline, stream_breaker)}
ORACLES = {
    "stream_watch": history.ORACLES["watch_alerts"],
    "stream_breaker": history.ORACLES["webhook_breaker"],
    "stream_timeline": history.ORACLES["timeline_cap"],
    "stream_first": "SELECT DISTINCT user_id FROM events",
    "stream_daily": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS route, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""",
}
