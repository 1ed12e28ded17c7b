"""Exact duplicate removal by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (after a sentence or line end, at least
``MIN_CHUNK`` characters on). Chunks become identifiers: a 64-bit hash, verified
by SHA-256, so two chunks share an identifier only when their digests agree.
Texts are equal when their ordered identifier lists are. Long texts are read
once and never shuffled; only digests and identifiers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, content, free_name, numbered, written

MIN_CHUNK = 512
MAX_CHUNK = 8192
ROW = "_tessera_row"


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined again they are the text."""
    rule = rf"(?s).{{{least},{most - 1}}}?(?:[.!?;,]\s|\n)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per document: its row key (``key`` if ``docs`` is numbered already), digest of the whole text, and its chunks' digests."""
    if key is None:
        key = free_name(docs, ROW)
        docs = numbered(docs, key)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(key).alias(ROW), F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    pieces = F.transform(
        chunks_of(F.col("norm")),
        lambda c: F.struct(F.xxhash64(c).alias("weak"), F.unhex(F.sha2(c, 256)).alias("strong")),
    )
    return rows.select(
        ROW, "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), pieces.alias("chunks")
    )


def recipes(chunked: DataFrame) -> DataFrame:
    """Ordered lists of verified chunk identifiers, one row per document.

    An identifier is the weak hash and the rank of the chunk's strong digest among
    all digests met under that weak hash: rank 0 unless the weak hash collides.
    """
    long = chunked.select(ROW, "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "c")).select(
        ROW, "doc_id", "text_sha256", "pos", F.col("c.weak").alias("weak"), F.col("c.strong").alias("strong")
    )
    distinct = chunked.select(F.explode("chunks").alias("c")).select("c.weak", "c.strong").distinct()
    ranked = distinct.withColumn("rank", F.row_number().over(W.partitionBy("weak").orderBy("strong")) - 1)
    collided = ranked.where("rank > 0")
    named = long.join(collided, ["weak", "strong"], "left").select(
        ROW, "doc_id", "text_sha256",
        F.struct("pos", "weak", F.coalesce("rank", F.lit(0)).alias("rank")).alias("piece"),
    )
    return named.groupBy(ROW, "doc_id", "text_sha256").agg(
        F.transform(
            F.sort_array(F.collect_list("piece")), lambda p: F.struct(p["weak"].alias("weak"), p["rank"].alias("rank"))
        ).alias("recipe")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """A row per row of ``docs``: row key, doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null texts count as empty, and all empty texts are equal. The row with the
    largest id of a group stays; a null id is smaller than any other; of rows that
    repeat the largest id one stays (that with the largest row key). No rows in, no rows out.
    Other columns, whatever their names, are not looked at. ``key`` is the row key of docs
    that are numbered already.
    """
    lists = written(recipes(written(chunk_table(docs, id_col, text_col, key), "chunks")), "recipes")
    # only what has copies is joined back; both sides are plain tables, so a large group's rows can be split among tasks
    copied = written(
        lists.groupBy("recipe").agg(F.max(F.struct("doc_id", ROW)).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "copied-recipes",
    )
    alone = F.col("group_size").isNull()
    return lists.join(copied, "recipe", "left").select(
        ROW,
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col(ROW) == F.col(f"keep.{ROW}"))).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the row with the largest id stays, a null id being smaller than any
    other; of rows that share that id one stays, chosen by what the rows hold, so that
    reruns agree. Null texts count as empty and all empty ones are equal: one stays. No
    rows in, no rows out.
    """
    key = free_name(docs, ROW)
    rows = numbered(docs, key, content(docs).alias("content"))
    # numbered once: what isn't read from files would get other keys the second time
    kept = exact_duplicates(rows, id_col, text_col, key).where("kept").select(F.col(ROW).alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
