"""Design systems: declared tokens against what pages use. Scales match within a tolerance, colours by distance in Oklab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.color import contrast, difference, oklab, parse
from tessera.functions.text import rounded

MATCH, NEAR = 0.02, 0.05
HOPS = 8


def leaves(specs: DataFrame) -> DataFrame:
    """specs(site, tokens as JSON of up to three levels): path and value of every leaf."""
    rows = specs.select("site", F.from_json("tokens", "map<string,string>").alias("m")).select("site", F.explode("m").alias("path", "value"))
    out = None
    for _ in range(4):
        inner = F.from_json("value", "map<string,string>")
        deep = F.col("value").startswith("{") & ~F.col("value").rlike(r"^\{[A-Za-z0-9_.-]+\}$")
        flat = rows.where(~deep)
        out = flat if out is None else out.unionByName(flat)
        rows = rows.where(deep).select("site", F.col("path").alias("p"), F.explode(inner).alias("k", "value")).select("site", F.concat_ws(".", "p", "k").alias("path"), "value")
    return out


def resolved(tokens: DataFrame) -> DataFrame:
    """Aliases ``{a.b}`` replaced by what they name, up to eight hops; a cycle or a missing name gives null."""
    named = tokens.select("site", F.col("path").alias("to"), F.col("value").alias("next"))
    rows = tokens
    for _ in range(HOPS):
        to = F.regexp_extract("value", r"^\{([A-Za-z0-9_.-]+)\}$", 1)
        rows = rows.withColumn("to", F.when(to != "", to)).join(named, ["site", "to"], "left")
        rows = rows.select("site", "path", F.when(F.col("to").isNull(), F.col("value")).otherwise(F.col("next")).alias("value"))
    return rows.withColumn("value", F.when(~F.col("value").rlike(r"^\{[A-Za-z0-9_.-]+\}$"), F.col("value")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tokens added, removed or changed between two versions."""
    b = before.select("site", "path", F.col("value").alias("old"))
    a = after.select("site", "path", F.col("value").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, ["site", "path"], "full").select("site", "path", "old", "new", kind.alias("kind")).where("kind IS NOT NULL")


def nearest_colours(observed: DataFrame, palette: DataFrame) -> DataFrame:
    """observed(site, colour) against palette(site, path, value): nearest token, distance, match, near miss or off the palette.

    Joined by site; a site's palette has a few dozen colours, gathered into its row.
    """
    lab = oklab(parse(F.col("value")))
    colours = palette.where(parse(F.col("value")).isNotNull()).groupBy("site").agg(F.collect_list(F.struct("path", lab.alias("lab"))).alias("palette"))
    rows = observed.withColumn("lab", oklab(parse(F.col("colour")))).join(colours, "site", "left")
    best = F.array_min(F.transform("palette", lambda p: F.struct(difference(p["lab"], F.col("lab")).alias("d"), p["path"].alias("path"))))
    out = rows.withColumn("best", F.when(F.col("lab").isNotNull(), best))
    d = F.col("best.d")
    return out.select(*observed.columns, F.col("best.path").alias("token"), rounded(d, 4).alias("distance"), F.when(d <= MATCH, "match").when(d <= NEAR, "near").when(d.isNotNull(), "off").alias("verdict"))


def colour_checks(matches: DataFrame) -> DataFrame:
    """matches(site, class cta|surface|heading, verdict) of observed colours: site, rule_id, status, n, off.

    One call to action or surface off the palette fails, headings fail if more than half are; near
    misses pass. Unreadable colours and sites without a palette have no verdict, and no check.
    """
    rule = F.when(F.col("class") == "cta", "colors.cta").when(F.col("class") == "surface", "colors.surface").when(F.col("class") == "heading", "colors.headings")
    by = matches.where("verdict IS NOT NULL").groupBy("site", rule.alias("rule_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "off").alias("off"))
    fine = (F.col("off") == 0) | ((F.col("rule_id") == "colors.headings") & (2 * F.col("off") <= F.col("n")))
    return by.where("rule_id IS NOT NULL").select("site", "rule_id", F.when(fine, "pass").otherwise("fail").alias("status"), "n", "off")


def style_check(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """declared and observed(site, family, size, height, spacing): typography.styles by site, failed if over half the observed match no declared style.

    A field that either side leaves open matches; styles without a size don't count as declared,
    and a site without any is skipped. A site's declared styles, a few dozen, are gathered into its row.
    """
    known = declared.where("size IS NOT NULL").groupBy("site").agg(F.collect_list(F.struct("family", "size", "height", "spacing")).alias("declared"))
    near = lambda s, c, by: F.coalesce(F.abs(F.col(c) - s[c]) <= by, F.lit(True))
    same = lambda s: F.coalesce(F.lower(F.col("family")) == F.lower(s["family"]), F.lit(True)) & near(s, "size", 0.5) & near(s, "height", 0.05) & near(s, "spacing", 0.25)
    rows = observed.join(known, "site", "left").select("site", F.exists("declared", same).alias("fits"))
    by = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fits")).alias("off"), F.count("fits").alias("judged"))
    status = F.when(F.col("judged") == 0, "skip").when(2 * F.col("off") > F.col("n"), "fail").otherwise("pass")
    return by.select("site", F.lit("typography.styles").alias("rule_id"), status.alias("status"), "n", "off")


def waived(findings: DataFrame, palette: DataFrame, fonts: DataFrame) -> DataFrame:
    """findings(site, rule_id, weight, colour, family): the score before and after findings are waived whose colour or family the site's tokens declare.

    A colour counts as declared within a near miss of a token; families are compared without case.
    """
    declared = fonts.select("site", F.lower("value").alias("low")).distinct().withColumn("known", F.lit(True))
    rows = nearest_colours(findings, palette).withColumn("low", F.lower("family")).join(declared, ["site", "low"], "left")
    off = F.coalesce(F.col("verdict").isin("match", "near"), F.lit(False)) | F.coalesce("known", F.lit(False))
    return rows.withColumn("off", off).groupBy("site").agg(
        F.sum("weight").alias("before"), F.sum(F.when(F.col("off"), 0).otherwise(F.col("weight"))).alias("score"), F.count_if("off").alias("waived"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("off"), F.col("rule_id")))), ",").alias("rules"),
    )


def on_scale(observed: DataFrame, scale: DataFrame, tolerance: float) -> DataFrame:
    """observed(key, value) with whether scale(key, step) has a step within the tolerance: a band join on cells as wide as the band."""
    cell = lambda v: F.floor(v / (2 * tolerance))
    near = scale.select("key", "step", F.explode(F.array_distinct(F.array(cell(F.col("step") - tolerance), cell(F.col("step") + tolerance)))).alias("cell"))
    rows = observed.withColumn("cell", cell(F.col("value")))
    good = rows.join(near, ["key", "cell"]).where(F.abs(F.col("value") - F.col("step")) <= tolerance).select("key", "value").distinct().withColumn("fits", F.lit(True))
    return observed.join(good, ["key", "value"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def undeclared_fonts(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """observed(site, family, n): families no token declares, with their share of text."""
    family = lambda c: F.lower(F.trim(F.regexp_replace(F.split(c, ",")[0], "[\"']", "")))
    total = observed.groupBy("site").agg(F.sum("n").alias("all"))
    rows = observed.withColumn("family", family(F.col("family"))).groupBy("site", "family").agg(F.sum("n").alias("n")).join(total, "site")
    known = declared.select("site", family(F.col("value")).alias("family")).distinct()
    return rows.join(known, ["site", "family"], "left_anti").select("site", "family", rounded(F.col("n") / F.col("all"), 3).alias("share"))


def contrast_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(site, fg, bg, has_image): contrast and whether it needs a look; on images it is unknown."""
    ratio = contrast(parse(F.col("fg")), parse(F.col("bg")))
    state = F.when(F.col("has_image") | ratio.isNull(), "unknown").when(ratio < 4.5, "review").otherwise("pass")
    return pairs.select(*pairs.columns, rounded(ratio, 2).alias("contrast"), state.alias("status"))


def palette_distance(matches: DataFrame) -> DataFrame:
    """By site: mean distance to the palette and the share within a near miss."""
    return matches.where("distance IS NOT NULL").groupBy("site").agg(rounded(F.avg("distance"), 4).alias("mean_distance"), rounded(F.avg((F.col("distance") <= NEAR).cast("int")), 3).alias("near_share"))


def class_coverage(values: DataFrame) -> DataFrame:
    """values(site, class, verdict, area): share matched by count and by area; near misses count half."""
    m = F.when(F.col("verdict") == "match", 1.0).when(F.col("verdict") == "near", 0.5).otherwise(0.0)
    by = values.groupBy("site", "class").agg(rounded(F.avg(m), 3).alias("by_count"), rounded(F.sum(m * F.col("area")) / F.greatest(F.sum("area"), F.lit(1e-9)), 3).alias("by_area"))
    return by


def hygiene(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """By site: tokens, share unused, deprecated ones in use."""
    rows = tokens.join(used.select("site", "path").distinct().withColumn("used", F.lit(True)), ["site", "path"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("tokens"), rounded(F.avg((~F.col("used")).cast("int")), 3).alias("unused_share"), F.count_if(F.col("used") & F.col("path").contains("deprecated")).alias("deprecated_used")
    )


def system_score(checks: DataFrame) -> DataFrame:
    """checks(site, rule_id, status pass|fail|skip|review|unknown): weight passed of weight judged; 1 if none was."""
    dim = checks.sparkSession.createDataFrame(catalog.SYSTEM_RULES, "rule_id string, weight int")
    judged = F.col("status").isin("pass", "fail")
    by = checks.join(F.broadcast(dim), "rule_id").groupBy("site").agg(
        F.sum(F.when(judged, F.col("weight")).otherwise(0)).alias("judged"), F.sum(F.when(F.col("status") == "pass", F.col("weight")).otherwise(0)).alias("passed")
    )
    score = F.when(F.col("judged") > 0, F.col("passed") / F.col("judged")).otherwise(1.0)
    return by.withColumn("score", rounded(score, 3)).withColumn("tier", F.when(F.col("score") >= 0.8, "Aligned").when(F.col("score") >= 0.5, "Drifting").otherwise("Off-system"))


def design_file(body: Column) -> Column:
    """The ``name: value`` pairs of a design file's front matter, sections as path prefixes, two levels deep."""
    front = F.regexp_extract(body, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<path:string,value:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        k, v = F.trim(F.regexp_extract(line, r"^\s*([A-Za-z0-9_-]+)\s*:", 1)), F.trim(F.regexp_replace(F.regexp_extract(line, r"^\s*[A-Za-z0-9_-]+\s*:\s*(.*)$", 1), "^[\"']|[\"']$", ""))
        inner = line.rlike(r"^\s")
        path = F.when(inner & (acc["section"] != ""), F.concat(acc["section"], F.lit("."), k)).otherwise(k)
        section = F.when(inner, acc["section"]).when(v == "", k).otherwise("")
        out = F.when((k != "") & (v != ""), F.concat(acc["out"], F.array(F.struct(path.alias("path"), v.alias("value"))))).otherwise(acc["out"])
        return F.struct(section.alias("section"), out.alias("out"))

    return F.aggregate(F.split(front, r"\r?\n"), start, step)["out"]
