"""Tables of a folder of Parquet files."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tier


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a part that is dealt anew: so many that long ones and short ones even out.
DEALT = 4096


def _busiest(held: list[int], cores: int) -> int:
    """Rows of the core that has most of them, where each task goes to the one that has fewest."""
    loads = [0] * cores
    for n in sorted(held, reverse=True):
        heapq.heapreplace(loads, loads[0] + n)
    return max(loads)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if one core would read over half more than its share.

    For work that costs far more than moving rows. A row group is read by one task, however
    many tasks its file is cut into, so rows are counted by task (the files' footers tell
    them). A large table of many even row groups isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [n for _, n in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()]
    if held and 2 * cores * _busiest(held, cores) <= 3 * sum(held):
        return df
    # by place, which is the same whenever a file is read; dealing in turn would sort the rows first
    return df.repartition(max(cores, sum(held) // DEALT), F.monotonically_increasing_id())


#: Rules a scan may have flagged, by the bit of its number that says so.
SCAN_RULES = ["slop_fonts", "purple_accent", "gradient_text", "accent_stripe", "centered_hero", "icon_card_grid", "low_contrast_text"]
SCANS_SQL = """scans AS (SELECT event_id AS scan_id, ts, 'site' || user_id AS domain, least(100, floor(value))::INT AS score,
  CASE WHEN least(100, floor(value)) >= 28 THEN 'Heavy' WHEN least(100, floor(value)) >= 10 THEN 'Mild' ELSE 'Clean' END AS tier,
  CASE WHEN event_id % 5 = 0 THEN '2026.10' ELSE '2026.11' END AS version, event_type AS environment, ((event_id * 7) % 101)::INT AS system_score,
  'cat' || (user_id % 7) AS category, 'builder' || (user_id % 3) AS builder, (json_extract_string(props, '$.k'))::INT AS k FROM events)"""


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """A history of scans, read off the events: one scan an event, one site a user."""
    score = F.least(F.lit(100), F.floor("value")).cast("int")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("scan_id"), "ts", F.concat(F.lit("site"), "user_id").alias("domain"), score.alias("score"), tier(score).alias("tier"),
        F.when(F.col("event_id") % 5 == 0, "2026.10").otherwise("2026.11").alias("version"), F.col("event_type").alias("environment"),
        ((F.col("event_id") * 7) % 101).cast("int").alias("system_score"), F.concat(F.lit("cat"), F.col("user_id") % 7).alias("category"),
        F.concat(F.lit("builder"), F.col("user_id") % 3).alias("builder"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def flagged(k: Column) -> Column:
    """The rules a scan has flagged, from its number."""
    return F.array_compact(F.array(*[F.when(k.bitwiseAND(F.lit(1 << i)) != 0, r) for i, r in enumerate(SCAN_RULES)]))


SQL_FLAGGED = "list_filter([" + ", ".join(f"CASE WHEN (k & {1 << i}) <> 0 THEN '{r}' END" for i, r in enumerate(SCAN_RULES)) + "], lambda x: x IS NOT NULL)"
