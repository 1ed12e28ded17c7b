"""Rules that raw HTML alone can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.regex import quoted

#: Fixed values.
VIEWPORT = r"""(?i)<meta\b[^>]*name\s*=\s*["']?viewport["']?[^>]*>"""
SCAFFOLD = [r"(?i)<title>\s*Create Next App\s*</title>", r"(?i)Generated by create next app", r"(?i)Web site created using create-react-app", r"(?i)Get started by editing"]
GENERIC = r"(?i)^(?:click here|here|read more|learn more|more|link|this|button|submit|go)$"
BAD_ALT = r"""(?i)<img\b[^>]*\balt\s*=\s*["'](?:image|photo|picture|img|logo|icon|untitled)?[0-9]*(?:\.(?:png|jpe?g|webp|svg))?["']"""
SPOTLIGHT = r"(?i)style\s*=\s*[\"'][^\"']*--(?:mouse|cursor)-?[xy]"
GENERATOR = r"""(?i)<meta\b[^>]*name\s*=\s*["']?generator["']?[^>]*content\s*=\s*["']([^"']*)["']"""
DEAD = r"(?i)^(?:#|#!|javascript:.*)?$"
ANCHOR = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>"""


def viewport(pages: DataFrame) -> DataFrame:
    """page_id and whether the viewport meta is missing, and whether it forbids zooming."""
    meta = F.lower(F.regexp_extract("html", VIEWPORT, 0))
    most = F.regexp_extract(meta, r"maximum-scale\s*=\s*([0-9.]+)", 1).try_cast("double")
    locked = meta.rlike(r"user-scalable\s*=\s*(?:no|0)") | F.coalesce(most < 2, F.lit(False))
    return pages.select("page_id", (~meta.contains("width=device-width")).alias("viewport_meta_missing"), locked.alias("zoom_disabled"))


def scaffold(pages: DataFrame) -> DataFrame:
    n = F.lit(0)
    for rx in SCAFFOLD:
        n = n + F.col("html").rlike(rx).cast("int")
    return pages.select("page_id", n.alias("hits"), (n >= 1).alias("scaffold_defaults"), F.col("html").rlike(SPOTLIGHT).alias("cursor_spotlight"), F.nullif(F.regexp_extract("html", GENERATOR, 1), F.lit("")).alias("generator"))


def controls(pages: DataFrame, links: Column) -> DataFrame:
    """page_id, generic names of links and how many targets they lead to, empty alternatives, dead links. ``links`` as from copy_input."""
    named = F.filter(links, lambda x: x["text"].rlike(GENERIC))
    targets = F.size(F.array_distinct(F.transform(named, lambda x: x["href"])))
    bad = F.regexp_count("html", F.lit(BAD_ALT))
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    dead = F.size(F.filter(hrefs, lambda h: F.trim(h).rlike(DEAD)))
    return pages.select(
        "page_id", F.size(named).alias("generic"), targets.alias("targets"), bad.alias("bad_alt"), ((F.size(named) >= 3) & (targets >= 2) | (bad >= 1)).alias("generic_control_labels"),
        F.size(hrefs).alias("anchors"), dead.alias("dead"), (dead >= 0.3 * F.greatest(F.size(hrefs), F.lit(1))).alias("dead_links"),
    )


SQL_VIEWPORT = f"lower(regexp_extract(html, {quoted(VIEWPORT)}, 0))"
