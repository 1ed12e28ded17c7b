"""Queries over places in texts and addresses on pages, and their SQL.

Documents hold few of the letters and marks that these operators are for, so the queries
put them in by rules that both engines apply: zero-width letters, doubled blanks,
quotation marks, and relative links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog as c
from tessera.functions.regex import Pattern, quoted
from tessera.functions.spans import SAMPLES, merged, quotes, samples, without
from tessera.functions.text import sql_words, words
from tessera.plans.copy import P_SQL
from tessera.sources.html import LINK, NO_PAGE, SCHEME, page_links, resolve, sitemap_frontier
from tessera.sources.tables import spread, table

RULES: dict[str, Pattern] = {"nominalisation": c.NOMINALISATION, "abbreviation": c.ABBREVIATION, "tricolon": c.TRICOLON[0], "tricolon_end": c.TRICOLON[1]}


def _disguised(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("tion"), F.lit("ti​on")), F.lit(", "), F.lit(",   "))


_DISGUISE = lambda t: f"replace(replace({t}, 'tion', 'ti' || chr(8203) || 'on'), ', ', ',  ' || chr(160))"


def copy_samples(spark: SparkSession, d: str) -> DataFrame:
    found = spread(table(spark, d, "documents")).select("doc_id", F.explode(samples(_disguised(F.col("text")), RULES)).alias("s"))
    first = F.get("s.spans", F.lit(0))
    return found.select("doc_id", "s.rule", "s.total", F.array_join("s.samples", "|").alias("samples"), first["start"].alias("start"), first["stop"].alias("stop"))


def _quoting(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit('"'), F.lit("″")), F.lit(", "), F.lit(", “")), F.lit(". "), F.lit("”. "))


def quote_free(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select("doc_id", _quoting(F.col("text")).alias("text")).withColumn("q", quotes(F.col("text")))
    kept = rows.select("doc_id", F.size(merged(F.col("q"))).alias("quotes"), words(F.col("text")).alias("words"), without(F.col("text"), F.col("q")).alias("kept"))
    return kept.select("doc_id", "quotes", "words", words(F.col("kept")).alias("kept_words"), c.NOMINALISATION.count(F.col("kept")).alias("nominalisations"), F.sha2("kept", 256).alias("kept_sha256"))


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return page_links(spread(table(spark, d, "pages")))


def _relative(href: Column, k: Column) -> Column:
    """Links written in other ways, by their place on the page."""
    name = F.regexp_replace(href, "^/", "")
    return (
        F.when(k == 0, href).when(k == 1, F.concat(F.lit("../"), name)).when(k == 2, F.concat(F.lit("./a/../b/./"), name, F.lit("/.."))).when(k == 3, F.concat(F.lit("//CDN.example.com/"), name, F.lit("?q=1#top")))
        .when(k == 4, F.concat(F.lit("?page="), name)).when(k == 5, F.concat(F.lit("mailto:"), name)).when(k == 6, F.concat(F.lit("#"), name)).otherwise(F.concat(F.lit("https://Other.example.org"), F.lit("/../x y/"), name))
    )


def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = page_links(spread(table(spark, d, "pages"))).select("page_id", "ord", "href")
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("page"))
    written = rows.join(pages, "page_id").withColumn("href", _relative(F.col("href"), F.pmod(F.col("page_id") + F.col("ord"), F.lit(8))))
    return written.select("page_id", "ord", resolve(F.col("page"), F.col("href")).alias("url"))


def sitemap_levels(spark: SparkSession, d: str) -> DataFrame:
    """A root map for each of seven sites, which names pages and four maps of pages, two of which count."""
    p = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("site"), F.col("page_id") % 7).alias("site"), (F.floor(F.col("page_id") / 7) % 5).cast("int").alias("m"))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = p.groupBy("site", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda r: r["x"]), "").alias("xml"))
    address = F.concat(F.lit("https://"), F.col("site"), F.lit("/m"), F.col("m"), F.lit(".xml"))
    names = F.array_join(F.transform(F.sequence(F.lit(4), F.lit(1)), lambda k: F.concat(F.lit("<loc>https://"), F.col("site"), F.lit("/m"), k, F.lit(".xml</loc>"))), "")
    return sitemap_frontier(maps.select("site", address.alias("url"), (F.col("m") == 0).alias("root"), F.when(F.col("m") == 0, F.concat(names, F.col("xml"))).otherwise(F.col("xml")).alias("xml")))


def _sampled(rule: str, p: Pattern) -> str:
    source = p._plain(p.source)
    flags, bare = ("(?i)", source.removeprefix("(?i)")) if p.ignore_case else ("", source)
    return f"SELECT doc_id, '{rule}' AS rule, text, {p.sql_all('text')} AS ms, regexp_extract(text, {quoted(f'{flags}^([\\s\\S]*?)(?:{bare})')}, 1) AS before FROM documents"


_ENC = lambda u: f"list_reduce(list_concat([{u}], list_distinct(regexp_extract_all({u}, '[^\\x21-\\x7E]'))), lambda a, b: replace(a, b, replace(url_encode(b), '+', '%20')))"
_HEAD = r"'^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)'"
_RESOLVED = f"""w AS (SELECT page_id, ord, l, CASE WHEN regexp_matches(l, {quoted(SCHEME)}) THEN l WHEN l LIKE '//%' THEN regexp_extract(page, {quoted(SCHEME)}, 1) || ':' || l
    WHEN l LIKE '/%' THEN regexp_extract(page, {_HEAD}, 1) || l WHEN l LIKE '?%' THEN regexp_extract(page, '^([^?#]*)', 1) || l
    ELSE regexp_extract(page, {_HEAD}, 1) || regexp_extract(coalesce(nullif(regexp_extract(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/'), '^(.*/)', 1) || l END AS u
  FROM h WHERE l <> '' AND l NOT LIKE '#%' AND NOT regexp_matches(l, {quoted(NO_PAGE)})),
x AS (SELECT *, regexp_extract(u, {_HEAD}, 1) AS head, string_split(coalesce(nullif(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/'), '/') AS segs,
  regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1) AS tail FROM w),
y AS (SELECT *, list_reduce(list_transform(segs, lambda s: [s]), lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN a[: greatest(len(a) - 1, 1)] ELSE list_concat(a, b) END) AS kept FROM x),
z AS (SELECT page_id, ord, l, CASE WHEN head = '' THEN u ELSE lower(head) || array_to_string(CASE WHEN segs[len(segs)] IN ('.', '..') THEN list_append(kept, '') ELSE kept END, '/') || tail END AS full_url FROM y)"""
_LINKS = f"""{P_SQL}, l0 AS (SELECT page_id, {LINK.sql_all('bare', 1)} AS hs FROM p),
l1 AS (SELECT page_id, unnest(range(1, least(300, len(hs)) + 1)) AS i, hs FROM l0), l2 AS (SELECT l1.page_id, i - 1 AS ord, trim(hs[i]) AS href, url AS page FROM l1 JOIN pages USING (page_id) WHERE trim(hs[i]) <> '')"""

QUERIES = {f.__name__: f for f in (copy_samples, quote_free, link_targets, link_resolution, sitemap_levels)}
ORACLES = {
    "copy_samples": f"""WITH m AS ({' UNION ALL '.join(_sampled(k, p) for k, p in RULES.items())}),
u AS (SELECT doc_id, rule, ms, before, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
f AS (SELECT doc_id, rule, trim(ms[i], ' ' || chr(10)) AS s, i FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, rule, lower(trim(ms[i], ' ' || chr(10))) ORDER BY i) = 1),
g AS (SELECT doc_id, rule, s, i, row_number() OVER (PARTITION BY doc_id, rule ORDER BY i) AS nth FROM f),
t AS (SELECT doc_id, rule, string_agg({_DISGUISE('s')}, '|' ORDER BY i) AS samples FROM g WHERE nth <= {SAMPLES} GROUP BY doc_id, rule)
SELECT doc_id, rule, least(500, len(ms)) AS total, samples, length({_DISGUISE('before')}) AS start, length({_DISGUISE('before')}) + length({_DISGUISE('ms[1]')}) AS stop FROM m JOIN t USING (doc_id, rule)""",
    "quote_free": f"""WITH d AS (SELECT doc_id, replace(replace(replace(text, '"', '″'), ', ', ', “'), '. ', '”. ') AS text FROM documents),
k AS (SELECT doc_id, text, regexp_extract_all(text, '[“”\\n]') AS marks, string_split(regexp_replace(text, '[“”\\n]', chr(1), 'g'), chr(1)) AS pieces FROM d),
e AS (SELECT doc_id, unnest(range(0, len(pieces))) AS i, marks, pieces FROM k),
v AS (SELECT doc_id, i, CASE WHEN i > 0 THEN marks[i] END AS mark, pieces[i + 1] AS piece FROM e),
n AS (SELECT *, sum(CASE WHEN mark = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM v),
a AS (SELECT *, sum(CASE mark WHEN '“' THEN 1 WHEN '”' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY i) AS s FROM n),
b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, line ORDER BY i)) AS depth FROM a),
q AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id, line ORDER BY i), 0) AS was FROM b),
o AS (SELECT doc_id, count(*) FILTER (mark = '“' AND was = 0) AS quotes,
  string_agg(CASE WHEN mark = chr(10) OR (mark = '”' AND was = 0) THEN mark WHEN mark = '“' AND was = 0 THEN chr(2) ELSE '' END || CASE WHEN depth = 0 THEN piece ELSE '' END, '' ORDER BY i) AS body FROM q GROUP BY doc_id),
r AS (SELECT doc_id, quotes, array_to_string(list_filter(list_transform(string_split(body, chr(2)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS kept FROM o)
SELECT doc_id, quotes, {sql_words('text')} AS words, {sql_words('kept')} AS kept_words, {c.NOMINALISATION.sql_count('kept')} AS nominalisations, sha256(kept) AS kept_sha256 FROM r JOIN d USING (doc_id)""",
    "link_targets": f"WITH {_LINKS}, h AS (SELECT page_id, ord, page, href AS l FROM l2), {_RESOLVED} SELECT page_id, ord, l AS href, {_ENC('full_url')} AS url FROM z",
    "link_resolution": f"""WITH {_LINKS}, h0 AS (SELECT page_id, ord, page, (page_id + ord) % 8 AS k, href, regexp_replace(href, '^/', '') AS name FROM l2 WHERE href NOT LIKE '#%' AND NOT regexp_matches(href, {quoted(NO_PAGE)})),
h AS (SELECT page_id, ord, page, trim(CASE k WHEN 0 THEN href WHEN 1 THEN '../' || name WHEN 2 THEN './a/../b/./' || name || '/..' WHEN 3 THEN '//CDN.example.com/' || name || '?q=1#top' WHEN 4 THEN '?page=' || name
  WHEN 5 THEN 'mailto:' || name WHEN 6 THEN '#' || name ELSE 'https://Other.example.org/../x y/' || name END) AS l FROM h0), {_RESOLVED}
SELECT h0.page_id, h0.ord, {_ENC('full_url')} AS url FROM h0 LEFT JOIN z USING (page_id, ord)""",
    "sitemap_levels": """WITH p AS (SELECT page_id, url, 'site' || (page_id % 7) AS site, (page_id // 7) % 5 AS m FROM pages)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY CASE m WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE 2 END, page_id)::INT AS ord, url FROM p WHERE m IN (0, 4, 3)""",
}
