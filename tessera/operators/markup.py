"""Rules over the tree of elements that a page's markup makes: tags, classes, nesting and text, no layout.

An element's interval tells what it lies in, so that nothing here walks the tree. Each
rule is an aggregate over elements or over those that share a parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags, classes and texts that rules look for.
CARD = r"(?:^|[\s_-])(?:card|tile|panel)(?:$|[\s_-])"
FAQ = r"(?i)\b(?:faq|frequently asked|common questions)\b"
SPARKLE = r"[\x{2728}\x{2B50}\x{1F4AB}\x{1F31F}]"
STEP = r"^0?([1-9])[.)]?\s"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def tree_digest(nodes: Column) -> Column:
    """Hash of each element's number, tag, parent, depth and number of elements inside."""
    lines = F.transform(nodes, lambda n: F.concat_ws(":", n["node"], n["tag"], F.coalesce(n["parent"], F.lit(-1)), n["depth"], n["inside"]))
    return F.sha2(F.concat_ws(",", lines), 256)


def shape(pages: DataFrame) -> DataFrame:
    """page_id, elements, deepest (level of the deepest, from 0), tree (hash), text_sha256, of pages with their tree."""
    n = F.col("nodes")
    return pages.select(
        "page_id", F.size(n).cast("long").alias("elements"), F.coalesce(F.array_max(F.transform(n, lambda x: x["depth"])), F.lit(-1)).cast("long").alias("deepest"),
        tree_digest(n).alias("tree"), F.sha2("page_text", 256).alias("text_sha256"),
    )


def structure(elements: DataFrame) -> DataFrame:
    """A row per page: what its elements and those of each parent add up to, and which rules that makes fire.

    Siblings are counted before pages are: a parent's children meet in one aggregate.
    """
    tag, text = F.col("tag"), F.trim(F.coalesce("text", F.lit("")))
    words = F.regexp_count(text, F.lit(r"\S+"))
    own = elements.withColumns({
        "_card": F.lower("class_name").rlike(CARD), "_step": F.regexp_extract(text, STEP, 1), "_bare": (tag == "a") & F.coalesce(F.trim("href"), F.lit("")).isin("", "#"),
        "_sparkle": text.rlike(SPARKLE) & (F.length(text) <= 40) & (F.col("inside") == 0), "_faq": tag.isin(HEADINGS) & text.rlike(FAQ),
        "_lead": tag.isin("b", "strong") & (words >= 1), "_words": words,
    })
    by = own.groupBy("page_id", "parent_id").agg(
        F.count_if(tag == "p").alias("paragraphs"), F.count_if(tag == "li").alias("items"), F.count_if(tag == "a").alias("anchors"), F.count_if(tag == "details").alias("details"),
        F.count_if(tag == "img").alias("images"), F.count_distinct(F.when(tag == "img", F.col("href"))).alias("sources"),
        F.size(F.array_intersect(F.collect_set(F.when(F.col("_step") != "", F.col("_step"))), F.array(*map(F.lit, "123")))).alias("steps"),
        F.count_if(F.col("_step") != "").alias("numbered"), F.count_if("_card").alias("cards"), F.count_if("_bare").alias("bare"), F.count_if("_sparkle").alias("sparkles"),
        F.count_if("_faq").alias("faqs"), F.count_if("_lead").alias("leads"), F.max(F.when(tag == "p", F.col("_words"))).alias("longest"),
        F.count_if(tag.isin(HEADINGS)).alias("headings"), F.count_if(tag == "h1").alias("h1"), F.count_if(tag == "section").alias("sections"),
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("children"), F.count_if(F.col("inside") == 0).alias("leaves"),
    )
    out = by.groupBy("page_id").agg(
        F.sum("children").alias("elements"), F.sum("leaves").alias("leaves"), F.max("children").alias("most_children"), F.max("paragraphs").alias("most_paragraphs"), F.max("items").alias("longest_list"), F.sum("anchors").alias("anchors"),
        F.sum("bare").alias("bare_links"), F.sum("sparkles").alias("sparkles"), F.sum("leads").alias("bold_leads"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest_paragraph"),
        F.sum("headings").alias("headings"), F.sum("h1").alias("h1"), F.sum("details").alias("details"), F.sum("faqs").alias("faqs"), F.max("cards").alias("cards"),
        F.count_if((F.col("steps") == 3) & (F.col("numbered") <= 6)).alias("step_rows"),
        F.count_if(F.col("images").between(4, 12) & (F.col("sources") < F.col("images"))).alias("logo_rows"),
    )
    return out.select(
        "*", ((F.col("details") >= 3) | (F.col("faqs") >= 1)).alias("faq_accordion"), (F.col("step_rows") >= 1).alias("numbered_steps"), (F.col("logo_rows") >= 1).alias("fake_logo_bar"),
        (F.col("sparkles") >= 1).alias("ai_sparkle_badges"), (F.col("cards") >= 3).alias("card_row"), (F.col("bare_links") >= 1).alias("dead_links"), (F.col("h1") != 1).alias("h1_not_single"),
    )
