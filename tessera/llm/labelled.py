"""Bounded samples of labelled documents to fit classifiers on, and which rows are held out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Characters of all texts of a sample; of one piece of a text that is longer than its share of them, at least; most pieces of a text.
TOTAL, PIECE, PIECES = 16_000_000, 512, 64


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the row is kept from fitting. A null id is not held out, nor ever fitted on."""
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(False))


def level(lengths: np.ndarray, total: int) -> int:
    """The largest share such that texts cut to it have ``total`` characters at most; the longest length if all fit."""
    lengths = np.sort(np.asarray(lengths, np.int64))
    before = np.cumsum(lengths) - lengths
    over = before + lengths * np.arange(len(lengths), 0, -1) > total
    if not over.any():
        return int(lengths[-1]) if len(lengths) else 0
    k = int(over.argmax())
    return int((total - before[k]) // (len(lengths) - k))


def excerpt(text: Column, share: int, piece: int = PIECE) -> Column:
    """A text of at most ``share`` characters whole, of a longer one pieces spread from its beginning to its end."""
    piece = max(1, min(share, max(piece, share // PIECES)))
    n, last = F.length(text).cast("long"), max(1, share // piece - 1)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, share // piece - 1))),
        lambda i: text.substr((F.floor(i * (n - piece) / last) + 1).cast("int"), F.lit(piece)),
    )
    return F.when(n <= share, text).otherwise(F.concat_ws("\n", spread))


def fitted(pairs: DataFrame, parts: int, part: int) -> DataFrame:
    """The distinct doc_id and label of ``pairs`` that aren't held out; no nulls."""
    known = F.col("doc_id").isNotNull() & F.col("label").isNotNull()
    return pairs.where(known & ~held_out(F.col("doc_id"), parts, part)).select("doc_id", "label").distinct()


def sample(docs: DataFrame, ids: DataFrame, classes: list, rows: int, total: int = TOTAL) -> pd.DataFrame:
    """text, label (the index of its class) and weight of up to ``rows`` documents of each class, in a fixed order.

    Of ``ids`` (distinct doc_id and label, all with a text in ``docs``) those with the
    smallest hashes are taken, and one text for each; if ``docs`` has a label too, one of
    that label. Texts come whole, unless all together are longer than ``total``
    characters: then the longest give pieces from all over the text, of equal sums. The
    weights give the sample the shares the classes have among all ids.
    """
    there = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = ids.sparkSession.createDataFrame([(k, v, there.get(v, 0)) for k, v in enumerate(classes)], f"k int, label {ids.schema['label'].dataType.simpleString()}, n long")
    keyed = ids.join(F.broadcast(sizes), "label").withColumn("key", F.xxhash64("doc_id"))
    # the hashes are even: twice as many as are wanted, and some more, hold the smallest
    near = keyed.where((F.col("key") / 2.0**64 + 0.5) * F.col("n") < 2 * rows + 64)
    place = F.row_number().over(W.partitionBy("k").orderBy("key", "doc_id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= rows).select("doc_id", "label", "k", "key")
    # at most rows * len(classes) ids: a bounded broadcast
    on = ["doc_id", "label"] if "label" in docs.columns else ["doc_id"]
    got = docs.where(F.col("text").isNotNull()).select(*on, "text").join(F.broadcast(chosen), on)
    # an id that many rows share gives one text, so that no more come to the driver than were chosen
    got = written(got.groupBy("doc_id", "k", "key").agg(F.min("text").alias("text")), "sample")
    lengths = got.select(F.length("text").alias("n")).toPandas()["n"].to_numpy()
    found = got.withColumn("text", excerpt(F.col("text"), level(lengths, total))).toPandas()
    found = found.rename(columns={"k": "label"}).sort_values(["key", "doc_id", "label"], kind="stable").reset_index(drop=True)
    share = found["label"].map({k: there.get(v, 0) for k, v in enumerate(classes)}) / found.groupby("label")["label"].transform("size")
    return found.assign(weight=share.astype(float))[["text", "label", "weight"]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, classes: list, parts: int, part: int, rows: int) -> pd.DataFrame:
    """``sample`` of the documents with a text that a table of labels (doc_id and ``label``) names."""
    pairs = fitted(labels.where(F.col(label).isin(classes)).select("doc_id", F.col(label).alias("label")), parts, part)
    with_text = docs.where(F.col("text").isNotNull()).select("doc_id").distinct()
    return sample(docs.select("doc_id", "text"), written(pairs.join(with_text, "doc_id", "left_semi"), "labelled"), classes, rows)
