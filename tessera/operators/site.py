"""Sites: which pages to sample, boilerplate that pages share, and one verdict over many pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.text import rounded, tier
from tessera.operators.copyrules import context, evidence
from tessera.operators.copyscore import gates, scored
from tessera.sources.html import canonical_url, copy_input, host

SAMPLE, MOST_SAMPLE, LEAST_WORDS, QUALIFY_WORDS, QUALIFY_PAGES = 5, 15, 50, 150, 5
LEAST_KEY, SHARED = 15, 0.5
#: Places that a site's pages are dealt to; entries of a list that is searched as it is.
DEALT, LONG = 16, 32
SOURCES = ("seed", "sitemap", "link")


def sample(frontier: DataFrame, most: int = SAMPLE) -> DataFrame:
    """frontier(site, source, ord, url): the pages of each site to read. Seeds come first, then site maps, then links.

    Pages off the site's origin are left out; of addresses that are the same once
    fragment and trailing slash are gone the first counts.
    """
    priority = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    rows = frontier.withColumns({"url": canonical_url(F.col("url")), "priority": priority})
    origin = F.regexp_extract("url", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)", 1)
    rows = rows.withColumn("origin", origin)
    seeds = rows.where("source = 'seed'").groupBy("site").agg(F.min("origin").alias("home"))
    mine = rows.join(seeds, "site").where("origin = home")
    first = mine.groupBy("site", "url").agg(F.min(F.struct("priority", "ord", "source")).alias("f"))
    order = W.partitionBy("site").orderBy("f.priority", "f.ord", "url")
    ranked = first.withColumn("place", F.row_number().over(order)).withColumn("capped", F.count(F.lit(1)).over(W.partitionBy("site")) > most)
    return ranked.where(F.col("place") <= most).select("site", "place", "url", F.col("f.source").alias("source"), "capped")


def eligibility(pages: DataFrame) -> DataFrame:
    """page_id, words, has_heading, eligible, reasons: whether a page may count for its site."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    structured = F.col("html").rlike(r"(?i)<(?:h1|main|section)\b")
    reasons = F.array_compact(F.array(F.when(n < LEAST_WORDS, f"fewer than {LEAST_WORDS} visible words"), F.when(~structured, "no h1, main, or section")))
    return pages.select("page_id", n.alias("words"), structured.alias("structured"), (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, "; ").alias("reasons"))


def chunks(text: Column) -> Column:
    # F.trim takes a second argument, which F.transform would fill with the place
    return F.filter(F.transform(F.split(text, r"\n{2,}|(?<=[.!?])\s+"), lambda c: F.trim(c)), lambda c: c != "")


def key(chunk: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(chunk), r"\s+", " "))


def _hashes(pages: DataFrame) -> Column:
    """The distinct hashes of a page's chunks that are long enough to be told apart."""
    all_ = F.flatten(F.concat(F.array(chunks(F.col("text"))), F.transform("headings", chunks), F.transform("paragraphs", chunks)))
    return F.array_distinct(F.transform(F.filter(F.transform(all_, key), lambda k: F.length(k) >= LEAST_KEY), lambda k: F.xxhash64(k)))


def shared_chunks(pages: DataFrame) -> DataFrame:
    """site, pages, shared: how many pages a site has, and the hashes of the chunks that are on more than half of its other pages.

    A chunk that is everywhere is counted by partial aggregates. As each of them is on half
    of the pages or more, a site's list holds at most some twice the chunks of its mean page.
    """
    size = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("site", F.explode(_hashes(pages)).alias("hash")).groupBy("site", "hash").agg(F.count(F.lit(1)).alias("on"))
    often = seen.join(size, "site").where((F.col("on") - 1) / F.greatest(F.lit(1), F.col("pages") - 1) > SHARED)
    return size.join(often.groupBy("site").agg(F.collect_list("hash").alias("shared")), "site", "left")


def stripped(pages: DataFrame) -> DataFrame:
    """``pages`` with boilerplate taken out of text, headings and paragraphs; ``stripped`` counts the text's lost chunks.

    Pages move once, those of a site to ``DEALT`` places, each with a copy of its list. A page
    without a site shares nothing.
    """
    place = F.pmod(F.xxhash64(*[c for c in ("url", "text") if c in pages.columns]), F.lit(DEALT))
    lists = shared_chunks(pages).select("site", F.col("pages").alias("_pages"), "shared", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALT - 1).cast("bigint"))).alias("_place"))
    both = pages.withColumn("_place", place).join(lists, ["site", "_place"], "left")
    # of a long list a page's chunks are looked for in what is its own
    own = F.when(F.size("shared") > LONG, F.array_intersect(_hashes(pages), F.col("shared"))).otherwise(F.coalesce("shared", F.array().cast("array<bigint>")))
    both = both.withColumn("_shared", own).withColumn("_chunks", chunks(F.col("text")))
    keep = lambda cs: F.when(F.size("_shared") == 0, cs).otherwise(F.filter(cs, lambda c: ~F.array_contains(F.col("_shared"), F.xxhash64(key(c)))))
    prose = lambda items: F.filter(F.transform(items, lambda x: F.array_join(keep(chunks(x)), "\n\n")), lambda x: x != "")
    one = F.coalesce("_pages", F.lit(0)) < 2
    out = both.withColumn("_kept", F.when(one, F.col("_chunks")).otherwise(keep(F.col("_chunks"))))
    return out.withColumns({
        "stripped": F.size("_chunks") - F.size("_kept"),
        "headings": F.when(one, F.col("headings")).otherwise(prose(F.col("headings"))),
        "paragraphs": F.when(one, F.col("paragraphs")).otherwise(prose(F.col("paragraphs"))),
        "text": F.when(one, F.col("text")).otherwise(F.array_join("_kept", "\n\n")),
    }).select(*pages.columns, "stripped")


def artifact_findings(pages: DataFrame) -> DataFrame:
    """site, url, rule_id: what the rules that need no statistics find on whole pages, before boilerplate is taken out."""
    rows = evidence(gates(context(pages), "lang"))
    fired = F.array_compact(F.array(*[F.when(F.col(f"{name}.triggered"), name) for name, statistical, *_ in catalog.COPY_RULES if not statistical]))
    return rows.select("site", "url", F.explode(fired).alias("rule_id"))


def html_sites(pages: DataFrame) -> DataFrame:
    """Pages of raw HTML as copy, with the site they belong to."""
    return copy_input(pages).withColumn("site", host(F.col("url"))).drop("html")


def multi_page(pages: DataFrame, least_pages: int = QUALIFY_PAGES) -> DataFrame:
    """A row per site: pages scored without boilerplate, percentiles of those that qualify; no score for too few."""
    each = scored(context(stripped(pages.where("site IS NOT NULL"))), "lang").withColumn("qualifies", (F.col("words") >= QUALIFY_WORDS) & F.col("english"))
    q = F.when(F.col("qualifies"), F.col("score"))
    by = each.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if("qualifies").alias("qualifying_pages"), F.sum("stripped").alias("stripped_chunks"),
        F.percentile(q, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count_if(F.col("qualifies") & (F.col("tier") != "Clean")).alias("dirty"),
    )
    fine = F.col("qualifying_pages") >= least_pages
    pick = lambda i: F.when(fine, rounded(F.col("p")[i], 2))
    score = F.when(fine, F.floor(pick(1) + 0.5).cast("int"))
    return by.select(
        "site", "total_pages", "qualifying_pages", "stripped_chunks", F.when(fine, "ok").otherwise("insufficient_pages").alias("status"),
        pick(0).alias("p10"), pick(1).alias("p50"), pick(2).alias("p90"), F.when(fine, rounded(F.col("dirty") / F.col("qualifying_pages"), 3)).alias("mild_or_above_share"),
        score.alias("score"), tier(score, "copy").alias("tier"),
    )


def rendered(pages: DataFrame) -> DataFrame:
    """pages(site, url, ord, score, tier, eligible): the site's median against its first page."""
    fit = F.col("eligible") & F.col("score").isNotNull()
    by = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(fit).alias("eligible_pages"), F.floor(F.median(F.when(fit, F.col("score"))) + 0.5).cast("int").alias("site_score"),
        F.min_by(F.struct("score", "tier"), "ord").alias("home"),
    )
    site_tier = tier(F.col("site_score"))
    home_tier = F.when(F.col("home.score").isNotNull(), F.coalesce("home.tier", tier(F.col("home.score"))))
    verdict = F.when(F.col("eligible_pages") == 0, "insufficient").when(home_tier.isNull(), "site-only").when(home_tier == site_tier, "aligned").otherwise("mixed")
    return by.select("site", "pages", "eligible_pages", F.col("home.score").alias("homepage_score"), home_tier.alias("homepage_tier"), "site_score", site_tier.alias("site_tier"), verdict.alias("verdict"))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """findings(site, page_url, ord, rule_id, dom_path): ``counted`` is false for a rule found again at the same path."""
    path = F.trim(F.coalesce("dom_path", F.lit("")))
    nth = F.row_number().over(W.partitionBy("site", "rule_id", path).orderBy("ord", "page_url"))
    return findings.withColumn("counted", (path == "") | (nth == 1))


def pattern_shares(findings: DataFrame, eligible: DataFrame) -> DataFrame:
    """By site and rule, on which share of eligible(site, page_url) pages it was found."""
    n = eligible.groupBy("site").agg(F.count_distinct("page_url").alias("of"))
    on = findings.join(eligible, ["site", "page_url"], "left_semi").groupBy("site", "rule_id").agg(F.count_distinct("page_url").alias("pages"))
    return on.join(n, "site").select("site", "rule_id", "pages", rounded(F.col("pages") / F.col("of"), 3).alias("share"))
