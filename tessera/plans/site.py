"""Queries over sites, made of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.regex import quoted
from tessera.functions.text import sql_rounded, sql_tier
from tessera.operators import site as s
from tessera.plans.copy import P_SQL
from tessera.sources.html import HEADING, PARAGRAPH, SQL_HOST, host, sql_strip_html, strip_html
from tessera.sources.tables import SQL_FLAGGED, flagged, spread, table

KEY = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
#: Splits after closing punctuation without looking behind.
CHUNKS = lambda t: (
    f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '\\n{{2,}}', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '')"
)
_PAGES = f"""{P_SQL}, c AS (SELECT page_id, {SQL_HOST} AS site, {sql_strip_html('bare')} AS text,
  list_filter(list_transform({HEADING.sql_all('bare', 1)}, lambda x: {sql_strip_html('x')}), lambda x: x <> '') AS headings,
  list_filter(list_transform({PARAGRAPH.sql_all('bare', 1)}, lambda x: {sql_strip_html('x')}), lambda x: x <> '') AS paragraphs FROM p),
k AS (SELECT *, {CHUNKS('text')} AS cs, count(*) OVER (PARTITION BY site) AS n FROM c),
e AS (SELECT site, page_id, n, unnest(list_distinct(list_filter(list_transform(flatten([cs, flatten(list_transform(headings, lambda h: {CHUNKS('h')})),
  flatten(list_transform(paragraphs, lambda h: {CHUNKS('h')}))]), lambda c: {KEY('c')}), lambda c: len(c) >= 15))) AS key FROM k),
o AS (SELECT site, key FROM e GROUP BY site, key, n HAVING (count(*) - 1)::DOUBLE / greatest(1, n - 1) > 0.5),
l AS (SELECT site, list(key) AS shared FROM o GROUP BY site),
b AS (SELECT k.page_id, k.site, len(cs) AS chunks, CASE WHEN n < 2 THEN cs ELSE list_filter(cs, lambda c: NOT list_contains(coalesce(shared, []), {KEY('c')})) END AS kept FROM k LEFT JOIN l USING (site))"""


def site_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    out = s.stripped(s.html_sites(spread(table(spark, d, "pages"))))
    return out.select("page_id", "site", "stripped", F.sha2("text", 256).alias("text_sha256"))


def site_multipage(spark: SparkSession, d: str) -> DataFrame:
    return s.multi_page(s.html_sites(spread(table(spark, d, "pages"))))


def site_eligibility(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return s.eligibility(p.select("page_id", "html", strip_html(F.col("html")).alias("text")))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    score = ((F.col("page_id") * 37) % 61).cast("int")
    return p.select(
        host(F.col("url")).alias("site"), F.col("url").alias("page_url"), F.col("page_id").alias("ord"), F.when(F.col("page_id") % 9 != 0, score).alias("score"),
        F.lit(None).cast("string").alias("tier"), (F.col("page_id") % 4 != 0).alias("eligible"), (F.col("page_id") % 128).cast("int").alias("k"),
    )


_SCORES = f"""sc AS (SELECT {SQL_HOST} AS site, url AS page_url, page_id AS ord, CASE WHEN page_id % 9 <> 0 THEN ((page_id * 37) % 61)::INT END AS score,
  page_id % 4 <> 0 AS eligible, (page_id % 128)::INT AS k FROM pages)"""


def site_median(spark: SparkSession, d: str) -> DataFrame:
    return s.rendered(_scores(spark, d))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).select("site", "page_url", "ord", F.explode(flagged(F.col("k"))).alias("rule_id"))
    return rows.withColumn("dom_path", F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("main > div:"), F.col("ord") % 5)))


_FINDINGS = f"fi AS (SELECT site, page_url, ord, unnest({SQL_FLAGGED}) AS rule_id, CASE WHEN ord % 3 = 0 THEN '' ELSE 'main > div:' || (ord % 5) END AS dom_path FROM sc)"


def template_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = s.dedupe_findings(_findings(spark, d))
    return out.groupBy("site", "rule_id").agg(F.count_if("counted").alias("counted"), F.count_if(~F.col("counted")).alias("suppressed"))


def pattern_shares(spark: SparkSession, d: str) -> DataFrame:
    fit = _scores(spark, d).where("eligible AND score IS NOT NULL").select("site", "page_url")
    return s.pattern_shares(s.dedupe_findings(_findings(spark, d)).where("counted"), fit)


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    source = F.when(F.col("page_id") % 10 == 0, "seed").when(F.col("page_id") % 3 == 0, "sitemap").otherwise("link")
    return p.select(F.concat(F.lit("group"), F.col("page_id") % 7).alias("site"), source.alias("source"), F.col("page_id").alias("ord"), F.regexp_replace("url", r"//[^/]+", "//h.example.com").alias("url"))


def site_sample_rank(spark: SparkSession, d: str) -> DataFrame:
    return s.sample(_frontier(spark, d), 5)


_CANON = "lower(regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) || substr({b}, len(regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) + 1)"

QUERIES = {f.__name__: f for f in (site_boilerplate, site_multipage, site_eligibility, site_median, template_dedup, pattern_shares, site_sample_rank)}
ORACLES = {
    "site_boilerplate": f"WITH {_PAGES} SELECT page_id, site, chunks - len(kept) AS stripped, sha256(CASE WHEN (SELECT count(*) FROM k z WHERE z.site = b.site) < 2 THEN (SELECT text FROM k y WHERE y.page_id = b.page_id) ELSE array_to_string(kept, chr(10) || chr(10)) END) AS text_sha256 FROM b",
    "site_eligibility": f"""WITH t AS (SELECT page_id, len(regexp_extract_all({sql_strip_html('html')}, '\\S+')) AS words, regexp_matches(html, '(?i)<(?:h1|main|section)\\b') AS structured FROM pages)
SELECT page_id, words, structured, words >= 50 AND structured AS eligible, array_to_string(list_filter([CASE WHEN words < 50 THEN {quoted('fewer than 50 visible words')} END,
  CASE WHEN NOT structured THEN 'no h1, main, or section' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM t""",
    "site_median": f"""WITH {_SCORES}, g AS (SELECT site, count(*) AS pages, count(*) FILTER (eligible AND score IS NOT NULL) AS eligible_pages,
  floor(quantile_cont(score, 0.5) FILTER (eligible AND score IS NOT NULL) + 0.5)::INT AS site_score FROM sc GROUP BY site),
h AS (SELECT site, score AS homepage_score FROM sc QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) = 1)
SELECT site, pages, eligible_pages, homepage_score, {sql_tier('homepage_score')} AS homepage_tier, site_score, {sql_tier('site_score')} AS site_tier,
  CASE WHEN eligible_pages = 0 THEN 'insufficient' WHEN homepage_score IS NULL THEN 'site-only' WHEN {sql_tier('homepage_score')} = {sql_tier('site_score')} THEN 'aligned' ELSE 'mixed' END AS verdict FROM g JOIN h USING (site)""",
    "template_dedup": f"""WITH {_SCORES}, {_FINDINGS}, n AS (SELECT site, rule_id, dom_path = '' OR row_number() OVER (PARTITION BY site, rule_id, dom_path ORDER BY ord, page_url) = 1 AS counted FROM fi)
SELECT site, rule_id, count(*) FILTER (counted) AS counted, count(*) FILTER (NOT counted) AS suppressed FROM n GROUP BY site, rule_id""",
    "pattern_shares": f"""WITH {_SCORES}, {_FINDINGS}, n AS (SELECT *, dom_path = '' OR row_number() OVER (PARTITION BY site, rule_id, dom_path ORDER BY ord, page_url) = 1 AS counted FROM fi),
f AS (SELECT DISTINCT site, page_url FROM sc WHERE eligible AND score IS NOT NULL), z AS (SELECT site, count(*) AS fit FROM f GROUP BY site)
SELECT site, rule_id, count(DISTINCT page_url) AS pages, {sql_rounded('count(DISTINCT page_url)::DOUBLE / any_value(fit)', 3)} AS share FROM n JOIN f USING (site, page_url) JOIN z USING (site) WHERE counted GROUP BY site, rule_id""",
    "site_sample_rank": f"""WITH f AS (SELECT 'group' || (page_id % 7) AS site, CASE WHEN page_id % 10 = 0 THEN 'seed' WHEN page_id % 3 = 0 THEN 'sitemap' ELSE 'link' END AS source, page_id AS ord,
  regexp_replace(regexp_replace(trim(regexp_replace(url, '//[^/]+', '//h.example.com')), '#.*$', ''), '/+$', '') AS b FROM pages),
c AS (SELECT site, source, ord, {_CANON.format(b='b')} AS url, CASE source WHEN 'seed' THEN 1 WHEN 'sitemap' THEN 2 ELSE 3 END AS priority FROM f),
q AS (SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)', 1) AS origin FROM c), h AS (SELECT site, min(origin) AS home FROM q WHERE source = 'seed' GROUP BY site),
u AS (SELECT q.site, url, priority, ord, source FROM q JOIN h USING (site) WHERE origin = home QUALIFY row_number() OVER (PARTITION BY q.site, url ORDER BY priority, ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, ord, url) AS place, count(*) OVER (PARTITION BY site) > 5 AS capped FROM u)
SELECT site, place, url, source, capped FROM r WHERE place <= 5""",
}
