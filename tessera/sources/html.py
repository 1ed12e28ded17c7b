"""Raw HTML to the parts that copy rules read. Regular expressions, as pages are scored without a browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.regex import Pattern as P
from tessera.functions.regex import quoted

MOST_LINKS, MOST_ATTRIBUTES = 300, 300
#: Pages of a folder that are scanned at once.
MOST_FILES = 40
CODE = ["script", "style", "noscript"]
#: Entities that are resolved, in this order.
ENTITIES = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")]
#: How the parts of a page are told apart.
HEADING = P(r"<h[1-3][^>]*>([\s\S]*?)<\/h[1-3]>", True)
PARAGRAPH = P(r"<p[^>]*>([\s\S]*?)<\/p>", True)
LINK = P(r"""<a\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*>([\s\S]*?)<\/a>""", True)
LANGUAGE = P(r"""<html[^>]*\blang\s*=\s*["']?([a-zA-Z-]+)""", True)
TAG = P(r"<([a-zA-Z][\w:-]*)\b([^>]*)>")
PAIR = r"""([^\s"'=<>`]+)\s*=\s*["']([^"']*)["']"""
KEPT = "(?i)^(?:href|src|srcset|data-[a-z0-9_-]+)$"
SPACE = r"[\s\x{A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def without_code(html: Column) -> Column:
    for tag in CODE:
        html = F.regexp_replace(html, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    return html


def strip_html(html: Column) -> Column:
    """Text without markup, on one line."""
    out = F.regexp_replace(without_code(html), "<[^>]+>", " ")
    for entity, letter in ENTITIES:
        out = F.regexp_replace(out, entity, letter)
    return F.trim(F.regexp_replace(out, SPACE, " "))


def sql_without_code(html: str) -> str:
    for tag in CODE:
        html = rf"regexp_replace({html}, '(?i)<{tag}[\s\S]*?</{tag}>', ' ', 'g')"
    return html


def sql_strip_html(html: str) -> str:
    out = f"regexp_replace({sql_without_code(html)}, '<[^>]+>', ' ', 'g')"
    for entity, letter in ENTITIES:
        out = f"regexp_replace({out}, {quoted(entity)}, {quoted(letter)}, 'g')"
    return f"trim(regexp_replace({out}, {quoted(SPACE)}, ' ', 'g'))"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip_html), lambda x: x != "")


def attributes(html: Column) -> Column:
    """tag, attr, value of links, sources and data attributes, values of 4 to 500 characters; the first 300."""
    tags = F.arrays_zip(TAG.all(html, 1).alias("tag"), TAG.all(html, 2).alias("rest"))

    def of(t: Column) -> Column:
        rest = F.coalesce(t["rest"], F.lit(""))
        pairs = F.arrays_zip(
            F.regexp_extract_all(rest, F.lit(PAIR), F.lit(1)).alias("attr"), F.regexp_extract_all(rest, F.lit(PAIR), F.lit(2)).alias("value")
        )
        fit = F.filter(pairs, lambda p: p["attr"].rlike(KEPT) & F.length(p["value"]).between(4, 500))
        return F.transform(fit, lambda p: F.struct(F.lower(t["tag"]).alias("tag"), F.lower(p["attr"]).alias("attr"), p["value"].alias("value")))

    with_pairs = F.filter(tags, lambda t: t["rest"].rlike("="))
    return F.slice(F.flatten(F.transform(with_pairs, of)), 1, MOST_ATTRIBUTES)


def links(html: Column) -> Column:
    pairs = F.arrays_zip(LINK.all(html, 1).alias("href"), LINK.all(html, 2).alias("inner"))
    kept = F.filter(
        F.transform(pairs, lambda p: F.struct(F.trim(p["href"]).alias("href"), F.substring(strip_html(p["inner"]), 1, 100).alias("text"))),
        lambda p: p["href"] != "",
    )
    return F.slice(kept, 1, MOST_LINKS)


def copy_input(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text, headings, paragraphs, lang, links and attributes. A null page is an empty one."""
    bare = pages.withColumn("_bare", without_code(F.coalesce(F.col(html_col), F.lit(""))))
    bare_html = F.col("_bare")
    lang = F.regexp_extract(bare_html, LANGUAGE.java, 1)
    return bare.select(
        *pages.columns,
        strip_html(bare_html).alias("text"),
        _filled(HEADING.all(bare_html, 1)).alias("headings"),
        _filled(PARAGRAPH.all(bare_html, 1)).alias("paragraphs"),
        F.when(lang != "", lang).alias("lang"),
        links(bare_html).alias("links"),
        attributes(bare_html).alias("attributes"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url and html of every HTML file under a folder, whatever its depth; build folders are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").text(path)
    named = files.select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return named.where(~F.col("url").rlike(r"/(?:node_modules|\.git)/") & F.col("url").rlike(r"(?i)\.html?$"))


def scan_folder(spark: SparkSession, path: str, most: int = MOST_FILES) -> DataFrame:
    """url, html, truncated: the first ``most`` pages of a folder by their paths, and whether there are more.

    Paths are ordered without the pages; of those only the first are read.
    """
    pages = read_pages(spark, path)
    # one path more than is wanted tells whether there are more
    first = pages.select("url").orderBy("url").limit(most + 1).withColumn("_n", F.row_number().over(W.orderBy("url")))
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = first.withColumn("truncated", F.max("_n").over(all_) > most).where(F.col("_n") <= most).drop("_n")
    return pages.join(F.broadcast(kept), "url")


def sitemap_urls(xml: Column) -> Column:
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


SQL_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


def query_value(url: Column, key: str) -> Column:
    """A parameter of a URL's query, whole or relative; null without it."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    got = F.regexp_extract(query, rf"(?:^|&){key}=([^&]*)", 1)
    return F.when(got != "", got)


def canonical_url(url: Column) -> Column:
    """Without fragment and trailing slashes; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


SQL_CANONICAL = (
    "(SELECT lower(h) || substr(b, len(h) + 1) FROM (SELECT b, regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1) AS h FROM "
    "(SELECT regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') AS b)))"
)


#: Links of these schemes lead to no page.
NO_PAGE = r"(?i)^(?:mailto:|javascript:|tel:|data:)"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def _path(path: Column) -> Column:
    """A path without dot segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        # the first segment is what stands before the first slash: it stays
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _encoded(url: Column) -> Column:
    """Blanks and letters beyond ASCII percent-encoded."""
    strange = F.array_distinct(F.regexp_extract_all(url, F.lit(r"[^\x21-\x7E]"), F.lit(0)))
    return F.aggregate(strange, url, lambda u, c: F.replace(u, c, F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))


def resolve(base: Column, href: Column) -> Column:
    """An absolute address for a link on the page ``base`` (RFC 3986); null where the link leads to no page."""
    link = F.trim(href)
    scheme, origin = F.regexp_extract(base, SCHEME, 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), "^(.*/)", 1)
    whole = (
        F.when(link.rlike(SCHEME), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link)).otherwise(F.concat(origin, folder, link))
    )
    head, rest = F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$", 1)
    own = F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    full = F.concat(F.lower(head), _path(F.when(own == "", "/").otherwise(own)), rest)
    return F.when((link != "") & ~link.startswith("#") & ~link.rlike(NO_PAGE), _encoded(F.when(head == "", whole).otherwise(full)))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, ord, href, url: every link of every page, as written and as an absolute address; links to no page are left out."""
    rows = pages.select("page_id", F.col("url").alias("page"), F.posexplode(links(without_code(F.coalesce("html", F.lit(""))))).alias("ord", "l"))
    return rows.select("page_id", "ord", "l.href", resolve(F.col("page"), F.col("l.href")).alias("url")).where("url IS NOT NULL")


def sitemap_frontier(maps: DataFrame, most: int = 2) -> DataFrame:
    """maps(site, url, root, xml): site, ord, url of the pages that root maps and the first ``most`` maps that each names list.

    A map that is named, but isn't there, lists nothing. Maps meet by address: lists never move whole.
    """
    is_map = r"(?i)\.xml(?:$|\?)"
    listed = maps.select("site", "url", "root", F.posexplode(sitemap_urls(F.col("xml"))).alias("at", "loc")).withColumn("map", F.col("loc").rlike(is_map))
    named = F.row_number().over(W.partitionBy("site").orderBy("url", "at"))
    nested = listed.where(F.col("root") & F.col("map")).withColumn("nth", named).where(F.col("nth") <= most).select("site", F.col("loc").alias("url"), "nth")
    inner = listed.where(~F.col("root") & ~F.col("map")).join(nested.groupBy("site", "url").agg(F.min("nth").alias("nth")), ["site", "url"])
    both = listed.where(F.col("root") & ~F.col("map")).select("site", F.lit(0).alias("nth"), "at", "loc").unionByName(inner.select("site", "nth", "at", "loc"))
    return both.withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("nth", "at", "loc"))).select("site", "ord", F.col("loc").alias("url"))
