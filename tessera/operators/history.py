"""Scan history: distributions, timelines, baselines, regressions, comparisons, rollups.

Input columns: scan_id, ts, domain, score, tier, version and, where named, more. A null
score is an unscored scan: it never counts as Clean, and it leaves every denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import rounded, tier, tier_rank

TIMELINE, REGRESSION, DRIFT = 50, 8, 15
LATENCY = (1.0, 3.0, 8.0, 15.0)


def histogram(scans: DataFrame) -> DataFrame:
    """bucket 0 to 100 and how many scans fall in it."""
    bucket = F.least(F.greatest(F.floor(F.col("score") + 0.5), F.lit(0)), F.lit(100)).cast("int")
    return scans.where("score IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def headline(hist: DataFrame) -> DataFrame:
    """One row: count, average, share above Clean in percent, counts by tier; from a histogram of 101 rows."""
    t = tier(F.col("bucket"))
    n = F.sum("n")
    part = lambda name: F.coalesce(F.sum(F.when(t == name, F.col("n"))), F.lit(0)).cast("long")
    return hist.agg(
        n.cast("long").alias("scans"), rounded(F.sum(F.col("bucket") * F.col("n")) / n, 1).alias("average"),
        rounded(100 * (1 - part("Clean") / n)).alias("above_clean"), part("Clean").alias("clean"), part("Mild").alias("mild"), part("Heavy").alias("heavy"),
    )


def percentiles(scans: DataFrame) -> DataFrame:
    """For every scan the percentage of scored scans strictly worse. The distribution has at most 101 rows."""
    hist = histogram(scans)
    worse = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = hist.select("bucket", rounded(100.0 * F.coalesce(F.sum("n").over(worse), F.lit(0)) / F.sum("n").over(all_)).cast("int").alias("percentile"))
    bucket = F.least(F.greatest(F.floor(F.col("score") + 0.5), F.lit(0)), F.lit(100)).cast("int")
    return scans.withColumn("bucket", bucket).join(F.broadcast(share), "bucket", "left").select("scan_id", "domain", "score", "percentile")


def first_by_domain(scans: DataFrame) -> DataFrame:
    """The first scored scan of each domain: what counts in global figures. An aggregate, so a busy domain is combined before it moves."""
    cols = [c for c in scans.columns if c not in ("domain", "ts", "scan_id")]
    first = F.min(F.struct("ts", "scan_id", *cols)).alias("f")
    return scans.where("score IS NOT NULL").groupBy("domain").agg(first).select("domain", "f.*")


def timeline(scans: DataFrame, most: int = TIMELINE) -> DataFrame:
    """The last scans of each domain, newest first. Days are cut to ``most`` first, so that no task gathers a busy domain."""
    newest = [F.desc("ts"), F.desc("scan_id")]
    single = scans.dropDuplicates(["domain", "scan_id"])
    by_day = W.partitionBy("domain", F.to_date("ts")).orderBy(*newest)
    some = single.withColumn("_n", F.row_number().over(by_day)).where(F.col("_n") <= most)
    return some.withColumn("ord", F.row_number().over(W.partitionBy("domain").orderBy(*newest))).where(F.col("ord") <= most).drop("_n")


def regressions(scans: DataFrame) -> DataFrame:
    """Each scored scan against the first of its domain: a worse tier, or 8 points more. The baseline is joined, not windowed."""
    base = first_by_domain(scans).select("domain", F.col("score").alias("base_score"), F.col("tier").alias("base_tier"))
    both = scans.where("score IS NOT NULL").join(base, "domain")
    worse = (tier_rank(F.col("tier")) > tier_rank(F.col("base_tier"))) | (F.col("score") - F.col("base_score") >= REGRESSION)
    return both.withColumn("delta", F.col("score") - F.col("base_score")).withColumn("regressed", worse)


def system_tier(score: Column) -> Column:
    return F.when(score >= 80, "Aligned").when(score >= 50, "Drifting").otherwise("Off-system")


def system_drift(scans: DataFrame) -> DataFrame:
    base = first_by_domain(scans).select("domain", F.col("system_score").alias("base_system"))
    both = scans.where("score IS NOT NULL").join(base, "domain").withColumn("system_tier", system_tier(F.col("system_score")))
    off = F.col("system_tier") != "Aligned"
    return both.withColumn("drifted", off & ((system_tier(F.col("base_system")) == "Aligned") | (F.col("base_system") - F.col("system_score") >= DRIFT)))


def alerts(scans: DataFrame) -> DataFrame:
    """The scans at which a domain turns regressed: one alert an event, again only after a recovery."""
    before = F.lag("regressed", 1, False).over(W.partitionBy("domain").orderBy("ts", "scan_id"))
    return regressions(scans).withColumn("before", before).where("regressed AND NOT before").drop("before")


def circuit_breaker(deliveries: DataFrame, most: int = 5) -> DataFrame:
    """deliveries(domain, ts, scan_id, ok): domain and when the fifth failure in a row switched it off."""
    order = W.partitionBy("domain").orderBy("ts", "scan_id")
    run = deliveries.withColumn("run", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    nth = run.where("NOT ok").withColumn("failures", F.row_number().over(W.partitionBy("domain", "run").orderBy("ts", "scan_id")))
    return nth.where(F.col("failures") == most).groupBy("domain").agg(F.min("ts").alias("disabled_at"))


def run_aggregate(scans: DataFrame, *keys: Column | str) -> DataFrame:
    """Repeated runs as one: median, most, spread. Mixed versions or unscored runs are refused: their figures are null."""
    some = scans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("version").alias("versions"), F.count_if(F.col("score").isNull()).alias("unscored"),
        F.median("score").alias("m"), F.max("score").alias("x"), F.min("score").alias("n"), F.count_distinct("environment").alias("environments"),
    )
    fine = (F.col("versions") == 1) & (F.col("unscored") == 0)
    names = [c for c in some.columns if c not in ("m", "x", "n", "versions", "unscored")]
    return some.select(
        *names, fine.alias("accepted"), F.when(fine, F.floor(F.col("m") + 0.5).cast("int")).alias("median_score"), F.when(fine, F.col("x")).alias("max_score"),
        F.when(fine, F.col("x") - F.col("n")).alias("spread"), F.when(fine, tier(F.floor(F.col("m") + 0.5))).alias("tier"),
    )


def compared(scans: DataFrame, rules: Column, most_delta: int = 0) -> DataFrame:
    """Each scan against the domain's one before: rules added and resolved, delta, regression, and what kind of event it is."""
    order = W.partitionBy("domain").orderBy("ts", "scan_id")
    now = scans.withColumn("rules", rules)
    pairs = now.withColumn("was", F.lag(F.struct("scan_id", "score", "tier", "version", "rules")).over(order)).where("was IS NOT NULL")
    same = F.col("version") == F.col("was.version")
    added, resolved = F.array_except("rules", "was.rules"), F.array_except("was.rules", "rules")
    delta = F.col("score") - F.col("was.score")
    return pairs.select(
        "domain", "scan_id", F.col("was.scan_id").alias("before_id"), same.alias("comparable"), delta.alias("delta"),
        F.array_join(F.array_sort(added), ",").alias("added"), F.array_join(F.array_sort(resolved), ",").alias("resolved"),
        (same & ((delta > most_delta) | (F.size(added) > 0))).alias("regression"),
        F.when(~same, "rescored").when(F.col("tier") != F.col("was.tier"), "tier_change").when(delta > 0, "regression").otherwise("unchanged").alias("event"),
    )


def leaderboard(sites: DataFrame) -> DataFrame:
    """Averages and tier counts by builder, by category and over all, in one pass."""
    return sites.sparkSession.sql("""
        SELECT builder, category, count(*) AS sites, count(score) AS scored, sum(score) AS points, count_if(tier = 'Clean') AS clean,
               count_if(tier = 'Mild') AS mild, count_if(tier = 'Heavy') AS heavy
        FROM {sites} GROUP BY GROUPING SETS ((builder), (category), ())""", sites=sites)


def ranked_sites(sites: DataFrame) -> DataFrame:
    """Place by score, then tier; unscored sites last. Places are numbered from counts by score, so no task sorts all sites."""
    key = F.coalesce(F.col("score"), F.lit(101))
    counts = sites.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("key", F.coalesce(F.sum("n").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("key").orderBy("domain"))
    return sites.withColumn("key", key).join(F.broadcast(before), "key").withColumn("place", (F.col("before") + within).cast("long")).drop("key", "before")


def neighbours(sites: DataFrame, top: int = 6) -> DataFrame:
    """The best sites of each category with two sites or more, and the category's average and tier counts."""
    best = W.partitionBy("category").orderBy(F.col("score").asc_nulls_last(), "domain")
    stats = sites.groupBy("category").agg(
        F.count(F.lit(1)).alias("peers"), rounded(F.avg("score"), 1).alias("peer_average"), F.count_if(F.col("tier") == "Heavy").alias("heavy_peers")
    )
    few = sites.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return few.join(stats, "category").where("peers >= 2").select("category", "place", "domain", "score", "peers", "peer_average", "heavy_peers")


def prevalence(scans: DataFrame, rules: Column) -> DataFrame:
    total = scans.agg(F.count(F.lit(1)).alias("scans"))
    by = scans.select(F.explode(rules).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(total)).select("rule_id", "n", rounded(100.0 * F.col("n") / F.col("scans"), 1).alias("percent"))


def flag_bands(scans: DataFrame, rules: Column) -> DataFrame:
    n = F.size(rules)
    band = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+")
    return scans.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("scans"), F.sum(n).cast("long").alias("flags"))


def category_clean(scans: DataFrame, rules: Column, rule_dim: DataFrame) -> DataFrame:
    """By category of rules: the mean share of its weight that scans leave unflagged. Rules are a table of a few dozen rows."""
    most = rule_dim.where("weight > 0").groupBy("category").agg(F.sum("weight").alias("most"))
    total = scans.agg(F.count(F.lit(1)).alias("scans"))
    by = scans.select(F.explode(rules).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    lost = by.join(F.broadcast(rule_dim), "id").groupBy("category").agg(F.sum(F.col("weight") * F.col("n")).alias("lost"))
    out = most.join(lost, "category", "left").join(F.broadcast(total))
    return out.select("category", rounded(1 - F.coalesce("lost", F.lit(0)) / F.col("most") / F.col("scans"), 4).alias("clean_fraction"))


def ops_daily(events: DataFrame, known: list[str]) -> DataFrame:
    """Requests by day, route and latency bucket; routes that aren't known are one route."""
    route = F.when(F.col("event_type").isin(known), F.col("event_type")).otherwise("other")
    bucket = F.lit(f">{LATENCY[-1]:g}")
    for s in reversed(LATENCY):
        bucket = F.when(F.col("value") <= s, f"<={s:g}").otherwise(bucket)
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), route.alias("route"), bucket.alias("latency")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("users")
    )


def flow_daily(events: DataFrame, allowed: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(allowed)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", allowed).count().na.fill(0)


def rolling_rate(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """How many requests a key has made in the ``seconds`` up to each, and whether it was over the limit."""
    span = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(span)).select("event_id", "user_id", "recent", (F.col("recent") > most).alias("limited"))


def daily_budget(events: DataFrame, cost: Column, most: int) -> DataFrame:
    """Units spent by key and UTC day so far, and whether the request was still within the budget."""
    day = F.date_format("ts", "yyyy-MM-dd")
    so_far = F.sum("units").over(W.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumns({"day": day, "units": cost}).withColumn("spent", so_far).select(
        "event_id", "user_id", "day", "spent", (F.col("spent") <= most).alias("allowed")
    )


def next_page(sites: DataFrame, after: str, size: int) -> DataFrame:
    """Keyset pagination: the next ``size`` domains past a cursor."""
    return sites.where(F.col("domain") > after).orderBy("domain").limit(size)
