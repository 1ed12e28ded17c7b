"""Streams of scans and requests: once-per-event alerts, rate windows, daily rollups, first contributions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType, TimestampType

from tessera.operators.history import REGRESSION

ALERT = "domain string, scan_id long, score int, base_score int"
TIMELINES = "domain string, version long, ord int, scan_id long, score int"
LIMITED = "user_id long, event_id long, count long, limited boolean"
#: Rows of one key that are handed on at once.
SLICE = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_dir(spark: SparkSession) -> str:
    """A new folder for a stream's state, under the one that executors share. Only a session on one machine gets one of its own where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tessera-stream-")
    return f"{base.rstrip('/')}/tessera-stream/{uuid.uuid4().hex}"


def in_order(rows: Iterator[pd.DataFrame], *cols: str) -> pd.DataFrame:
    """One key's rows of a micro-batch by their first two columns. A micro-batch has a bounded size (``event_stream``), and so has a key's part of it."""
    return pd.concat([b[list(cols)] for b in rows]).sort_values(list(cols[:2]), kind="stable")


class Watch(StatefulProcessor):
    """Of each domain the baseline and whether its regression has been reported; recovery arms the alert again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("base_score", IntegerType()), StructField("base_rank", IntegerType()), StructField("notified", BooleanType())]
        self.state = handle.getValueState("watch", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = in_order(rows, "ts", "scan_id", "score", "rank")
        got = self.state.get() if self.state.exists() else None
        out = []
        for scan_id, score, rank in zip(now["scan_id"], now["score"], now["rank"]):
            if pd.isna(score):
                continue
            if got is None:
                got = (int(score), int(rank), False)
            base, base_rank, notified = got
            bad = rank > base_rank or score - base >= REGRESSION
            if bad and not notified:
                out.append((key[0], int(scan_id), int(score), base))
            got = (base, base_rank, bool(bad))
        if got is not None:
            self.state.update(got)
        yield pd.DataFrame(out, columns=["domain", "scan_id", "score", "base_score"])

    def close(self) -> None:
        pass


class Window(StatefulProcessor):
    """A counter for each key that starts with its first request and ends a fixed time later."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("start", TimestampType()), StructField("count", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = in_order(rows, "ts", "event_id")
        start, count = self.state.get() if self.state.exists() else (None, 0)
        for low in range(0, len(now), SLICE):
            some, out = now.iloc[low : low + SLICE], []
            for event_id, ts in zip(some["event_id"], some["ts"]):
                if start is None or (ts - pd.Timestamp(start)).total_seconds() >= self.seconds:
                    start, count = ts.to_pydatetime(), 0
                count += 1
                out.append((key[0], event_id, count, count > self.most))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "count", "limited"])
        self.state.update((start, count))

    def close(self) -> None:
        pass


class Timeline(StatefulProcessor):
    """Of each domain the last entries by event time, however late they arrive.

    The list is kept in order and cut to ``most``: an entry older than all of a full list
    is out, as it would be if all had come in order. Each micro-batch that changes a list
    gives it whole, with a number that grows: the highest is what holds.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", StructType([StructField("ts", TimestampType()), StructField("scan_id", LongType()), StructField("score", IntegerType())]))
        self.version = handle.getValueState("version", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {e[1]: (pd.Timestamp(e[0]), e[1], e[2]) for e in self.entries.get()} if self.entries.exists() else {}
        before = dict(held)
        for b in rows:
            for ts, scan_id, score in zip(b["ts"], b["scan_id"], b["score"]):
                entry = (pd.Timestamp(ts), int(scan_id), None if pd.isna(score) else int(score))
                held[entry[1]] = min(entry, held.get(entry[1], entry), key=lambda e: e[0])
            held = {e[1]: e for e in sorted(held.values(), key=lambda e: (e[0], e[1]), reverse=True)[: self.most]}
        if held == before:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.entries.put([(e[0].to_pydatetime(), e[1], e[2]) for e in held.values()])
        self.version.update((version,))
        out = [(key[0], version, n, e[1], e[2]) for n, e in enumerate(held.values(), 1)]
        yield pd.DataFrame(out, columns=["domain", "version", "ord", "scan_id", "score"]).astype({"score": "Int32"})

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """Failures in a row of each key; the one that makes ``most`` switches it off for good. A success begins again."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", StructType([StructField("failures", IntegerType()), StructField("off", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, off = self.state.get() if self.state.exists() else (0, False)
        if off:
            return
        now = in_order(rows, "ts", "scan_id", "ok")
        for ts, ok in zip(now["ts"], now["ok"]):
            failures = 0 if ok else failures + 1
            if failures == self.most:
                off = True
                yield pd.DataFrame({"domain": [key[0]], "disabled_at": [ts]})
                break
        self.state.update((failures, off))

    def close(self) -> None:
        pass


def breakers(deliveries: DataFrame, most: int = 5) -> DataFrame:
    """deliveries(domain, ts, scan_id, ok), a stream: each domain once, when the last of ``most`` failures in a row switches it off."""
    return deliveries.groupBy("domain").transformWithStateInPandas(Breaker(most), "domain string, disabled_at timestamp", "append", "None")


def timelines(scans: DataFrame, most: int) -> DataFrame:
    """scans(domain, ts, scan_id, score), a stream: the timeline of each domain that a micro-batch changed."""
    return scans.groupBy("domain").transformWithStateInPandas(Timeline(most), TIMELINES, "append", "None")


def newest_timelines(changes: DataFrame) -> DataFrame:
    """The timelines that hold: of each domain those of its highest version."""
    last = changes.groupBy("domain").agg(F.max("version").alias("version"))
    return changes.join(last, ["domain", "version"]).drop("version")


def alerts(scans: DataFrame) -> DataFrame:
    """scans(domain, ts, scan_id, score, rank), a stream: one row when a domain turns worse than its baseline."""
    return scans.groupBy("domain").transformWithStateInPandas(Watch(), ALERT, "append", "None")


def limited(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """events(user_id, ts, event_id), a stream: each request with its number in its key's window."""
    return events.groupBy("user_id").transformWithStateInPandas(Window(seconds, most), LIMITED, "append", "None")


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests by UTC day and route; days are closed once the watermark has passed them."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("route"))
    return by.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "route", "requests", "cents"
    )


def first_contributions(events: DataFrame, late: str = "365 days") -> DataFrame:
    """The first event of each key within the watermark: what counts once in global figures."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "event_id", "ts")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, to files in the shared folder, and read them."""
    spark = stream.sparkSession
    path = state_dir(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, folder: str, bytes_at_once: int = 256 << 20) -> DataFrame:
    """The events table as a stream of files, of at most ``bytes_at_once`` in a micro-batch (a larger file is one of its own): what one key can bring at once."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", bytes_at_once).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
