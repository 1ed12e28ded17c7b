"""A keyed store as tables: a log of changes, the state it amounts to at a time, and reads of it.

A change is a row: key, op (put or delete), value, at (timestamp), seq (breaks ties of at)
and ttl (seconds, null for ever). The state holds the last value of every key that is
neither deleted nor expired. It is compacted by an aggregate, so that a key written a
million times is combined before it moves, and written in order of keys, so that a read of
a prefix skips the files and row groups of other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How long results, a domain's latest result and watches live, in seconds.
RESULT_TTL, DOMAIN_TTL, WATCH_TTL = 90 * 86_400, 90 * 86_400, 365 * 86_400
#: Keys of a page of a list.
LIMIT = 200


def compacted(log: DataFrame, now: Column) -> DataFrame:
    """key, value, at, seq, expires: what there is at ``now``. Later changes don't count yet; at the second it expires a key is gone. Null keys are no keys."""
    last = F.max(F.struct("at", "seq", F.col("op").alias("op"), "value", "ttl")).alias("c")
    latest = log.where(F.col("key").isNotNull() & (F.col("at") <= now)).groupBy("key").agg(last)
    expires = F.col("c.at") + F.make_dt_interval(secs=F.col("c.ttl"))
    there = latest.where("c.op = 'put'").select("key", "c.value", "c.at", "c.seq", expires.alias("expires"))
    return there.where(F.col("expires").isNull() | (F.col("expires") > now))


def merged(state: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """The state after more changes, in whatever order they arrive, without the changes that made it.

    A deletion or an end of life that the state no longer shows can't be told from a key
    that never was: changes older than the state's own time are to be given with it.
    """
    old = state.select("key", F.lit("put").alias("op"), "value", "at", "seq", (F.unix_seconds("expires") - F.unix_seconds("at")).alias("ttl"))
    return compacted(old.unionByName(log.select(*old.columns)), now)


def got(state: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key) with their values; null for those that aren't there."""
    return keys.select("key").join(state.select("key", "value"), "key", "left")


def write_sorted(state: DataFrame, path: str) -> None:
    """The state as files of key ranges, in order within each."""
    state.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def prefixed(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The keys of a written state that begin with ``prefix``. Bounds reach the scan: files and row groups of other keys are skipped."""
    rows = spark.read.parquet(path)
    return rows.where(F.startswith(F.col("key"), F.lit(prefix)) & (F.col("key") >= prefix))


def listed(state: DataFrame, prefix: str, limit: int = LIMIT, after: str | None = None) -> DataFrame:
    """One page of the keys that begin with ``prefix``, in order, past the cursor ``after``: key, value, and on each row whether the list is complete, and else the cursor to go on from."""
    some = state.where(F.startswith(F.col("key"), F.lit(prefix)))
    if after is not None:
        some = some.where(F.col("key") > after)
    # one row more than is wanted tells whether there is more; rows of one task at last, limit + 1 at most
    page = some.orderBy("key").limit(limit + 1).withColumn("_n", F.row_number().over(W.orderBy("key")))
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    page = page.withColumns({"complete": F.max("_n").over(all_) <= limit, "cursor": F.max(F.when(F.col("_n") <= limit, F.col("key"))).over(all_)})
    return page.where(F.col("_n") <= limit).select("key", "value", "complete", F.when(~F.col("complete"), F.col("cursor")).alias("cursor"))


def verified(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Entries of a manifest (key, sha256) that the live state (key, value) doesn't hold, or holds with other bytes: key, reason. Live keys beyond the manifest are fine."""
    both = manifest.select("key", "sha256").join(live.select("key", F.sha2(F.col("value").cast("binary"), 256).alias("_now"), F.lit(True).alias("_live")), "key", "left")
    reason = F.when(F.col("_live").isNull(), "missing-live").when(~F.col("sha256").eqNullSafe(F.col("_now")), "bytes-differ")
    return both.select("key", reason.alias("reason")).where("reason IS NOT NULL")
