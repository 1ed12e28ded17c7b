"""Mix sources to target weights by thresholds on a document hash.

Every document has a fixed hash; a source's budget takes the documents below a
threshold. Thresholds come from histograms of words by (source, hash bucket):
the bucket in which the budget runs out is the only one looked into further, so
no level sorts documents or holds more than ``2**BITS`` buckets a source. As
thresholds only grow with the budget, smaller mixes nest in larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, numbered, word_count, written

#: Hash bits in all, and of one histogram level.
HASH_BITS = 60
BITS = 12
#: A source gives each of its documents this often at most.
MOST = 3
#: Weights by the rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)


def hash_of(seed: str, text: Column) -> Column:
    """A hash of 60 bits, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), text)), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size in words, and the document's hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), hash_of(seed, key).alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, capped, the excess shared again.

    The fixed point is ``target = min(most * size, level * weight)``; the level is the
    largest of the levels that result when the k sources with the lowest caps for
    their weight are at their caps. One row per source goes through one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    each = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", each.cast("long")).withColumn("cap", most * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = lambda c, total: F.sum(total).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0))
    by = by.withColumn("level", left("cap", "source_size").cast("double") / left("weight", "weight"))
    by = by.withColumn("level", F.greatest(F.max("level").over(whole), F.lit(0.0)))
    return by.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target")
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Per source the whole passes, and the bucket in which the rest of the budget runs out.

    Refines the boundary bucket until it holds one document of each source at most,
    or the hash has no bits left (documents that share an id). Returns the bounds and
    how far to shift a hash for its bucket.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bounds = targets.withColumn("passes", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    bounds = bounds.withColumns({"bucket": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("source_size"), "docs": F.lit(0).cast("long")})
    bounds = written(bounds, "mix-bounds")
    shift = HASH_BITS
    filled = sizes.where("size > 0")
    while shift > 0:
        last, shift = shift, shift - BITS
        edge = bounds.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("below").alias("was"), F.col("rest").alias("r"))
        inside = filled.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", last) == F.col("b")))
        hist = inside.groupBy("s", "was", "r", F.shiftright("h", shift).alias("next")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
        )
        upto = F.sum("words").over(W.partitionBy("s").orderBy("next"))
        found = hist.withColumn("upto", F.col("was") + upto).where("upto > r").groupBy("s").agg(
            F.min(F.struct("next", (F.col("upto") - F.col("words")).alias("under"), "words", "n")).alias("e")
        )
        bounds = written(
            bounds.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "passes", "rest",
                F.coalesce("e.next", F.lit(-1).cast("long")).alias("bucket"),
                F.coalesce("e.under", F.lit(0).cast("long")).alias("below"),
                F.coalesce("e.words", F.lit(0).cast("long")).alias("inside"),
                F.coalesce("e.n", F.lit(0).cast("long")).alias("docs"),
            ),
            "mix-bounds",
        )
        if (bounds.agg(F.max("docs")).first()[0] or 0) <= 1:
            break
    return bounds, shift


def taken_words(rows: DataFrame, bounds: DataFrame, shift: int) -> DataFrame:
    """``rows`` (source, size, h and more) with source_size, target and taken."""
    bounds = bounds.withColumnRenamed("source", "s")
    both = rows.join(bounds, F.col("source").eqNullSafe(F.col("s")))
    bucket, room = F.shiftright("h", shift), F.col("rest") - F.col("below")
    at_edge = F.when(
        F.col("docs") == 1, F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(0)
    ).otherwise(F.floor(F.col("size") * room / F.greatest("inside", F.lit(1))))
    more = F.when(bucket < F.col("bucket"), F.col("size")).when(bucket == F.col("bucket"), at_edge).otherwise(0)
    names = [c for c in rows.columns if c != "h"]
    return both.select(*names, "source_size", "target", (F.col("passes") * F.col("size") + more).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words the mix takes of each row.

    Each source gives all its documents ``floor(target / source_size)`` times, and once
    more those below its threshold. The document at the threshold is taken when that
    comes nearer to the target; rows that share a doc_id there share what is left in
    proportion to their sizes, rounded down. Null texts and texts without words have
    size 0 and give 0; a null source is a source of its own, ranked last; rows that
    repeat count each. No documents, no rows. Other columns are not looked at.
    """
    sizes = written(sized(docs, seed, id_col), "mix-sizes")
    return taken_words(sizes, *thresholds(sizes, source_targets(sizes)))


def edge_copies(edge: DataFrame, seed: str) -> DataFrame:
    """row and copies for rows (source, size, passes, inside, room, row) that share the hash their source's budget runs out at.

    A second hash, of all that a row holds, divides the room as the first did. Rows equal
    in it are alike: as many are taken as fill what is left, by their rank from the
    counts of the files they stand in.
    """
    edge = edge.withColumn("h", hash_of(seed, F.to_json("row")))
    edge = numbered(written(edge, "mix-edge"), "at")
    of = edge.groupBy("source").agg(F.max("inside").alias("source_size"), F.max("room").alias("target"))
    bounds, shift = thresholds(edge, of)
    bounds = bounds.select(
        F.col("source").alias("s"), F.col("bucket").alias("edge"), "docs", (F.col("rest") - F.col("below")).alias("left")
    )
    both = edge.join(bounds, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", F.shiftright("h", shift))
    clear = both.where("bucket <> edge").select("row", (F.col("passes") + (F.col("bucket") < F.col("edge")).cast("long")).alias("copies"))
    alike = both.where("bucket = edge").select("source", "size", "passes", "left", "at", "row")
    counts = alike.groupBy("source", F.col("at.file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    ranks = alike.select("source", "at").withColumn("k", F.row_number().over(W.partitionBy("source", "at.file").orderBy("at.row")))
    ranks = ranks.select(F.col("source").alias("rs"), F.col("at").alias("rat"), "k")
    ranks = ranks.join(counts, F.col("rs").eqNullSafe(F.col("s")) & (F.col("rat.file") == F.col("f")))
    ranks = ranks.select("rat", (F.col("k") + F.col("n_before")).alias("rank"))
    taken = F.col("rank") <= F.round(F.col("left") / F.col("size"))
    return clear.unionByName(
        alike.join(ranks, F.col("at") == F.col("rat")).select("row", (F.col("passes") + taken.cast("long")).alias("copies"))
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The documents of the mix, with all their columns, whatever their names: each as often as it is taken whole.

    The choice hangs on the documents' ids, so that reruns agree; among rows that share
    the doc_id at the threshold (null ids are one) it hangs on all they hold, and among
    repeated rows there on how many are wanted. Null, empty and wordless texts weigh
    nothing and are not in the mix. A null source is a source of its own. No documents,
    no rows.
    """
    sizes = written(sized(docs, seed, id_col), "mix-sizes")
    bounds, shift = thresholds(sizes, source_targets(sizes))
    bounds = bounds.select(
        F.col("source").alias("s"), "bucket", "passes", "inside", "docs", (F.col("rest") - F.col("below")).alias("room")
    )
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.where(F.col("text").rlike(WORD)).select(
        "source", F.shiftright(hash_of(seed, key), shift).alias("at"), F.struct(*docs.columns).alias("row")
    )
    both = rows.join(bounds, F.col("source").eqNullSafe(F.col("s")))
    at_edge = F.col("at") == F.col("bucket")
    size = word_count(F.col("row.text"))  # counted again only at the edge
    once_more = F.when(F.col("at") < F.col("bucket"), 1).when(at_edge & (F.col("room") * 2 >= size), 1).otherwise(0)
    clear = both.where(~at_edge | (F.col("docs") <= 1)).select("row", (F.col("passes") + once_more).alias("copies"))
    if not bounds.where("docs > 1").isEmpty():
        edge = both.where(at_edge & (F.col("docs") > 1)).select("source", size.alias("size"), "passes", "inside", "room", "row")
        clear = clear.unionByName(edge_copies(edge, seed))
    return clear.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
