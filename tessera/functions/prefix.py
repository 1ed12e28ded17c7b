"""Running sums over a whole table, without a task that holds it.

Values are cut into ranges; a range's rows are summed within it, and what the ranges
before it sum to is added. The cuts are numbers taken from the data once, so that every
part of the plan deals rows alike, however often it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of each group.
PARTS = 64


def running(rows: DataFrame, group: str, key: str, amount: str, name: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows of the same ``group`` whose ``key`` is at most the row's own, and ``<name>_of``: over all of them.

    Keys are numbers, null ones first; groups are few (a metric each, say): their cuts,
    ``parts`` numbers each, come to the driver. No group is null.
    """
    at = F.col(key).cast("double")
    cut = rows.groupBy(group).agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 1000).alias("c")).collect()
    kind = rows.schema[group].dataType.simpleString()
    cuts = rows.sparkSession.createDataFrame([(r[0], sorted(set(r[1] or []))) for r in cut], f"`{group}` {kind}, _cuts array<double>")
    # below or at a cut: of the ranges to its left
    dealt = rows.join(F.broadcast(cuts), group).withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(-1))).drop("_cuts")
    sums = dealt.groupBy(group, "_part").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(W.partitionBy(group)).alias(f"{name}_of"))
    # parts rows a group
    out = dealt.join(F.broadcast(bases), [group, "_part"])
    within = F.sum(amount).over(W.partitionBy(group, "_part").orderBy(F.col(key).asc_nulls_first()))
    return out.withColumn(name, F.col("_base") + within).drop("_part", "_base")
