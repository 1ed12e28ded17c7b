"""Boards and subscriptions: places, distributions, dashboards, directories, deliveries, and copies of a keyed store.

Sites and scans as in ``history``; a null score is a site that waits to be scored: it has no
place and no bucket, and comes last in every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import rounded, tier_rank
from tessera.operators.history import DRIFT, REGRESSION, first_by_domain, percentiles, system_tier, timeline

#: The fewest scores that make a place worth showing; the longest directory; the most watches of a sweep.
PEERS, LISTED, SWEPT = 5, 1000, 200
#: A key that would live shorter than this, in seconds, is not restored.
LEAST_LIFE = 60


def tenth(score: Column) -> Column:
    return F.least(F.lit(9), F.floor(score / 10)).cast("int")


def tenths(sites: DataFrame) -> DataFrame:
    """bucket 0 to 9 and how many scored sites fall in it."""
    return sites.where("score IS NOT NULL").groupBy(tenth(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("sites"))


def own_tenth(sites: DataFrame) -> DataFrame:
    """Each scored site's bucket, and how many share it. Ten rows are broadcast."""
    some = sites.where("score IS NOT NULL").select("domain", "score", tenth(F.col("score")).alias("bucket"))
    return some.join(F.broadcast(tenths(sites)), "bucket")


def places(scans: DataFrame, least: int = PEERS) -> DataFrame:
    """scan_id, domain, place, of: a scan's place among all scored ones, from the percentage that is worse; null where fewer than ``least`` are scored."""
    total = scans.agg(F.count("score").alias("of"))
    worse = rounded(F.col("of") * F.col("percentile") / 100)
    place = F.greatest(F.lit(1), F.least(F.col("of"), F.col("of") - worse)).cast("long")
    ranked = percentiles(scans).where("score IS NOT NULL").join(F.broadcast(total))
    return ranked.select("scan_id", "domain", F.when(F.col("of") >= least, place).alias("place"), "of")


def points(scans: DataFrame, most: int = 30) -> DataFrame:
    """The last scored scans of each domain, oldest first, as a chart draws them."""
    newest = timeline(scans.where("score IS NOT NULL"), most)
    return newest.withColumn("point", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("ord")))).select("domain", "point", "scan_id", "score")


def dashboard(scans: DataFrame) -> DataFrame:
    """Each domain's last scored scan against its first: regressed, system_regressed and drifted, which is either. Both ends are aggregates."""
    base = first_by_domain(scans).select("domain", F.col("score").alias("s0"), F.col("tier").alias("t0"), F.col("system_score").alias("y0"))
    last = scans.where("score IS NOT NULL").groupBy("domain").agg(F.max(F.struct("ts", "scan_id", "score", "tier", "system_score")).alias("l")).select("domain", "l.*")
    both = last.join(base, "domain").withColumn("system_tier", system_tier(F.col("system_score")))
    worse = (tier_rank(F.col("tier")) > tier_rank(F.col("t0"))) | (F.col("score") - F.col("s0") >= REGRESSION)
    off = (F.col("system_tier") != "Aligned") & ((system_tier(F.col("y0")) == "Aligned") | (F.col("y0") - F.col("system_score") >= DRIFT))
    return both.select("domain", "score", "tier", "system_tier", worse.alias("regressed"), F.coalesce(off, F.lit(False)).alias("system_regressed")).withColumn(
        "drifted", F.col("regressed") | F.col("system_regressed")
    )


def dashboard_counts(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count(F.lit(1)).alias("watches"), F.count_if("drifted").alias("drifted"), F.count_if(F.col("tier") == "Clean").alias("clean"), F.count_if(F.col("system_tier") == "Aligned").alias("aligned")
    )


def directory(sites: DataFrame, worst_first: bool = False, asked: int = 500) -> DataFrame:
    """The first sites by score, either way round; those that wait come last in both. A limit after a sort: tasks keep only their first."""
    by = F.col("score").desc_nulls_last() if worst_first else F.col("score").asc_nulls_last()
    return sites.orderBy(by, "domain").limit(min(LISTED, max(1, asked or 500)))


def sweep(watches: DataFrame, asked: int = 50) -> DataFrame:
    """The watches checked longest ago, 50 unless asked for another number up to 200."""
    return watches.orderBy(F.col("checked_at").asc_nulls_first(), "domain").limit(min(SWEPT, max(1, asked)))


def verified(listings: DataFrame, watches: DataFrame) -> DataFrame:
    """Listings whose domain has a watch that was confirmed. Without one a listing stays hidden."""
    return listings.join(watches.where("confirmed").select("domain").distinct(), "domain", "left_semi")


def deliverable(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions that are neither removed, nor unsubscribed, nor switched off; unknown flags count as not set."""
    off = F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in ("removed", "unsubscribed", "disabled")])
    return subscriptions.where(~off)


def snapshot(store: DataFrame) -> DataFrame:
    """store(key, value binary, expires in epoch seconds) as a manifest: checksum and base64 of each value; a null value is missing."""
    return store.select("key", "expires", F.sha2("value", 256).alias("sha256"), F.base64("value").alias("base64"), F.col("value").isNull().alias("missing"))


def faults(manifest: DataFrame) -> DataFrame:
    """Entries of a manifest that must not be restored: no key, no value, a key that repeats, or a checksum that isn't the value's. Restore only if there are none."""
    times = manifest.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_again", F.lit(True))
    bad = (
        F.when(F.coalesce("key", F.lit("")) == "", "no key").when(F.col("base64").isNull(), "no value").when(F.col("_again"), "repeated key")
        .when(~F.col("sha256").eqNullSafe(F.sha2(F.unbase64("base64"), 256)), "checksum")
    )
    return manifest.join(times.select("key", "_again"), "key", "left").select("key", bad.alias("fault")).where("fault IS NOT NULL")


def restore_plan(manifest: DataFrame, now: int, least_life: int = LEAST_LIFE) -> DataFrame:
    """One row: entries to write, their bytes, and those left out because they would live shorter than ``least_life`` seconds."""
    there = manifest.where("base64 IS NOT NULL")
    short = F.coalesce(F.col("expires") - now < least_life, F.lit(False))
    size = F.octet_length(F.unbase64("base64")).cast("long")
    return there.agg(F.count_if(~short).alias("writes"), F.count_if(short).alias("skipped"), F.coalesce(F.sum(F.when(~short, size)), F.lit(0)).alias("bytes"))
