"""Scores of the design axis from rule signals: weights, four adjustments in order, tier, grade; waivers, presets, config."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.text import bind, grade, rounded, tier

#: signals(page_id, rule_id, weight, status, triggered, error, hero_font, inter_only, secondary_only, has_evidence, node_ids)
SIGNALS = (
    "page_id string, rule_id string, weight int, status string, triggered boolean, error boolean, hero_font string, inter_only boolean, "
    "secondary_only boolean, has_evidence boolean, node_ids array<string>"
)


def rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, w, s, k) for k, (i, c, w, s) in enumerate(catalog.DESIGN_RULES)], "rule_id string, category string, weight int, status string, ord int")


def assembled(signals: DataFrame) -> DataFrame:
    """Signals with what the catalogue knows of each rule: status and weight in force, and its place."""
    dim = rule_dim(signals.sparkSession).select("rule_id", "category", F.col("weight").alias("own_weight"), F.col("status").alias("own_status"), "ord")
    rows = signals.join(F.broadcast(dim), "rule_id", "left")
    weight = F.coalesce("weight", "own_weight", F.lit(0))
    # a weight given for a rule under review brings it back
    state = F.coalesce("status", F.when(F.col("weight") > 0, F.lit("active")), "own_status", F.lit("active"))
    review = (weight == 0) | state.isin("review", "experimental", "retired")
    status = F.when(F.coalesce("error", F.lit(False)), "unknown").when(~F.col("triggered"), "pass").when(review, "review").otherwise("fail")
    return rows.withColumns({"w": F.when(status == "fail", weight).otherwise(0).cast("double"), "state": status})


def _of(weights: Column, rule: str) -> Column:
    return F.coalesce(F.element_at(weights, rule), F.lit(0.0))


def _set(weights: Column, rule: Column | str, value: Column | float) -> Column:
    return F.transform_values(weights, lambda k, v: F.when(k == rule, value).otherwise(v))


def _others(weights: Column, rule: str) -> Column:
    return F.exists(F.map_entries(weights), lambda e: (e["key"] != rule) & (e["value"] > 0))


def design_score(signals: DataFrame) -> DataFrame:
    """A row per page. A page has at most one row per rule, so its list of rules is bounded by the catalogue."""
    rows = assembled(signals)
    rule = F.struct("ord", "rule_id", "w", "state", "triggered", "hero_font", "inter_only", "secondary_only", "has_evidence", "node_ids")
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    fired = F.filter("rules", lambda r: r["triggered"])
    pages = pages.withColumn("fired", fired).withColumn("w0", F.map_from_entries(F.transform("fired", lambda r: F.struct(r["rule_id"], r["w"]))))
    get = lambda name: F.get(F.filter("fired", lambda r: r["rule_id"] == name), F.lit(0))
    fonts, purple = get("slop_fonts"), get("purple_accent")
    family = F.lower(F.coalesce(fonts["hero_font"], F.lit("")))
    implied = fonts["inter_only"].isNull() & fonts["secondary_only"].isNull() & (family.startswith("inter") | family.startswith("geist"))
    lone = F.coalesce(fonts["inter_only"], F.lit(False)) | F.coalesce(fonts["secondary_only"], F.lit(False)) | implied
    one = fonts.isNotNull() & (_of(F.col("w0"), "slop_fonts") > 0) & F.coalesce(lone, F.lit(False)) & ~_others(F.col("w0"), "slop_fonts")
    pages = pages.withColumn("r1", one).withColumn("w1", F.when(F.col("r1"), _set(F.col("w0"), "slop_fonts", 0.0)).otherwise(F.col("w0")))
    both, hero = _of(F.col("w1"), "slop_fonts") + _of(F.col("w1"), "centered_hero"), _of(F.col("w1"), "centered_hero")
    two = fonts.isNotNull() & get("centered_hero").isNotNull() & (both > 8) & (hero > 0)
    pages = pages.withColumn("r2", two).withColumn("w2", F.when(F.col("r2"), _set(F.col("w1"), "centered_hero", hero - F.least(hero, both - 8))).otherwise(F.col("w1")))
    known = F.coalesce(purple["has_evidence"], F.lit(False)) | (F.size("rules") > 1)
    three = purple.isNotNull() & known & (_of(F.col("w2"), "purple_accent") > 0) & ~_others(F.col("w2"), "purple_accent")
    pages = pages.withColumn("r3", three).withColumn("w3", F.when(F.col("r3"), _set(F.col("w2"), "purple_accent", 0.0)).otherwise(F.col("w2")))
    # pairs of rules with nodes, in order; each pair sees the weights the ones before have left
    noded = F.filter("fired", lambda r: F.size(r["node_ids"]) > 0)
    pages = pages.withColumn("noded", noded)

    def partners(a: Column, i: Column) -> Column:
        return F.transform(F.slice("noded", i + 2, F.size("noded")), lambda b: F.struct(a.alias("a"), b.alias("b")))

    pairs = F.filter(
        F.flatten(F.transform("noded", partners)),
        lambda p: bind(
            F.size(F.array_intersect(p["a"]["node_ids"], p["b"]["node_ids"])),
            lambda n: (n >= 2) & (n / F.least(F.size(F.array_distinct(p["a"]["node_ids"])), F.size(F.array_distinct(p["b"]["node_ids"]))) >= 0.5),
        ),
    )

    def drop_lower(w: Column, p: Column) -> Column:
        a, b = p["a"]["rule_id"], p["b"]["rule_id"]
        return _set(w, F.when(F.element_at(w, a) >= F.element_at(w, b), b).otherwise(a), 0.0)

    pages = pages.withColumn("pairs", pairs).withColumn("w4", F.aggregate("pairs", F.col("w3"), drop_lower))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.aggregate(F.map_values("w4"), F.lit(0.0), lambda a, x: a + x)))
    notes = F.concat(
        F.array_compact(F.array(F.when(F.col("r1"), "slop_fonts_co_signal"), F.when(F.col("r2"), "slop_fonts_centered_hero_cap"), F.when(F.col("r3"), "purple_accent_co_signal"))),
        F.transform("pairs", lambda _: F.lit("overlapping_evidence_dedup")),
    )
    states = lambda s: F.size(F.filter("rules", lambda r: r["state"] == s))
    n = F.size("rules")
    out = pages.select(
        "page_id", F.floor(score + 0.5).cast("int").alias("score"), F.array_join(notes, ",").alias("adjustments"), F.size("fired").alias("flagged"),
        states("fail").alias("scored"), states("review").alias("review"), rounded((n - states("unknown")) / n, 3).alias("coverage"),
        F.array_join(F.transform("fired", lambda r: r["rule_id"]), ",").alias("flags"),
    )
    return out.withColumns({"tier": tier(F.col("score")), "grade": grade(F.col("score"))})


def unified(design: Column, copy: Column) -> Column:
    """The larger score, six points more for each other axis that isn't clean; at most 100. Null axes don't count."""
    dirty = F.coalesce((tier(design) != "Clean").cast("int"), F.lit(0)) + F.coalesce((tier(copy, "copy") != "Clean").cast("int"), F.lit(0))
    return F.least(F.lit(100), F.coalesce(F.greatest(design, copy), F.lit(0)) + 6 * F.greatest(F.lit(0), dirty - 1))


def preset_rules(spark: SparkSession) -> DataFrame:
    """preset, rule_id: which rules each preset keeps."""
    presets = spark.createDataFrame(catalog.PRESETS, "preset string, how string, what string")
    names = presets.groupBy("preset").agg(*[F.collect_list(F.when(F.col("how") == h, F.col("what"))).alias(h) for h in ("only", "include", "exclude", "min_weight")])
    hit = lambda k: F.array_contains(k, F.col("rule_id")) | F.array_contains(k, F.col("category"))
    keep = (
        F.when(F.size("only") > 0, F.array_contains("only", F.col("rule_id")))
        .when(F.size("include") > 0, hit("include")).otherwise(True)
        & ~hit("exclude") & (F.size("min_weight").eqNullSafe(0) | (F.col("weight") >= F.coalesce(F.get("min_weight", F.lit(0)).cast("int"), F.lit(0))))
    )
    # two tables of a few dozen fixed rows
    return rule_dim(spark).join(F.broadcast(names), keep).select("preset", "rule_id", "category", "weight")


def glob_to_regex(pattern: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([.+?^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def resolved_config(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """layers(ord, pattern, key, level, reason): for each page and key the last layer whose pattern matches.

    ``pattern`` null matches all; else it is a regular expression, written as a glob when
    it starts with ``glob:``. Layers come from a config file, so they are few and broadcast.
    """
    glob = F.col("pattern").startswith("glob:")
    rules = layers.withColumn("rx", F.when(glob, glob_to_regex(F.expr("substring(pattern, 6)"))).otherwise(F.col("pattern")))
    hits = pages.select("page_id", "url").join(F.broadcast(rules), F.col("rx").isNull() | F.expr("url rlike rx"))
    return hits.groupBy("page_id", "key").agg(F.max_by(F.struct("level", "reason"), "ord").alias("v")).select("page_id", "key", "v.level", "v.reason")


def waived(signals: DataFrame, waivers: DataFrame) -> DataFrame:
    """signals without what waivers(page_id, rule_id, source, reason) take off: existing ones first, then config, then inline."""
    order = F.array_position(F.array(F.lit("existing"), F.lit("config"), F.lit("inline")), F.col("source"))
    best = waivers.groupBy("page_id", "rule_id").agg(F.min_by(F.struct("source", "reason"), order).alias("waiver"))
    out = signals.join(best, ["page_id", "rule_id"], "left")
    return out.withColumn("waived", F.col("triggered") & F.col("waiver").isNotNull()).withColumn("triggered", F.col("triggered") & F.col("waiver").isNull())


def inline_waivers(html: Column) -> Column:
    """Distinct (rule_id, reason) from ``data-slop-ignore`` attributes and ``slop-ignore`` comments."""
    attrs = F.regexp_extract_all(html, F.lit(r"""data-slop-ignore\s*=\s*["']([^"']*)["']"""), F.lit(1))
    notes = F.regexp_extract_all(html, F.lit(r"<!--\s*slop-ignore\s+([^>]*?)\s*-->"), F.lit(1))

    def split(x: Column) -> Column:
        ids, reason = F.split(F.regexp_replace(x, r"\s+(?:--|:)\s+.*$", ""), r"\s*[,\s]\s*"), F.regexp_extract(x, r"\s+(?:--|:)\s+(.*)$", 1)
        return F.transform(F.filter(ids, lambda i: i != ""), lambda i: F.struct(i.alias("rule_id"), reason.alias("reason")))

    return F.array_distinct(F.flatten(F.transform(F.concat(attrs, notes), split)))


def assertions(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(key, level, max_score, min_score) against scores(page_id, axis, score): which fail, and how."""
    axis = F.regexp_extract("key", "^categories:(.+)$", 1)
    hits = scores.join(F.broadcast(rules.where("level <> 'off'").withColumn("axis", axis)), "axis")
    bad = F.coalesce(F.col("score") > F.col("max_score"), F.lit(False)) | F.coalesce(F.col("score") < F.col("min_score"), F.lit(False))
    return hits.where(bad).select("page_id", "key", F.when(F.col("level") == "error", "failure").otherwise("warning").alias("kind"), "score")


def compiled(rule: dict) -> tuple[Column, Column]:
    """A declarative rule over elements: whether an element matches, and whether a page's matches are enough.

    ``match`` has any of ``tag``, ``text`` (a regular expression), ``style`` (name to
    regular expression), ``role``; ``min_count`` or ``min_ratio`` trigger it.
    """
    test = F.lit(True)
    for k, v in rule["match"].items():
        if k == "style":
            for name, rx in v.items():
                test = test & F.coalesce(F.element_at("style", name), F.lit("")).rlike(rx)
        else:
            test = test & F.coalesce(F.col(k), F.lit("")).rlike(f"(?i)^(?:{v})$" if k == "tag" else v)
    hits, all_ = F.count_if(test), F.count(F.lit(1))
    enough = hits >= rule["min_count"] if "min_count" in rule else hits / F.greatest(all_, F.lit(1)) >= rule["min_ratio"]
    return hits, enough


def community_rules(elements: DataFrame, rules: list[dict]) -> DataFrame:
    """page_id, and hits and triggered of each rule, in one pass over the elements."""
    cols = []
    for rule in rules:
        hits, enough = compiled(rule)
        cols += [hits.alias(f"{rule['id']}_hits"), enough.alias(f"{rule['id']}_triggered")]
    return elements.groupBy("page_id").agg(*cols)


def overlaps(signals: DataFrame) -> DataFrame:
    """Pairs of rules of a page with shared nodes; joined on the node, not on all pairs."""
    nodes = signals.where("triggered").select("page_id", "rule_id", F.explode("node_ids").alias("node")).distinct()
    size = nodes.groupBy("page_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    other = nodes.select("page_id", "node", F.col("rule_id").alias("other"))
    shared = nodes.join(other, ["page_id", "node"]).where("rule_id < other").groupBy("page_id", "rule_id", "other").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(size, ["page_id", "rule_id"]).join(size.select("page_id", F.col("rule_id").alias("other"), F.col("n").alias("m")), ["page_id", "other"])
    return out.select("page_id", "rule_id", "other", "shared", ((F.col("shared") >= 2) & (F.col("shared") / F.least("n", "m") >= 0.5)).alias("deduplicated"))


def category_rollup(signals: DataFrame) -> DataFrame:
    """By page and category: flagged rules, their weight, share left clean, and a tier of its own."""
    dim = rule_dim(signals.sparkSession)
    most = dim.groupBy("category").agg(F.sum("weight").alias("most"))
    by = assembled(signals).groupBy("page_id", "category").agg(F.count_if("triggered").alias("flagged"), F.sum("w").alias("weight"))
    out = by.join(F.broadcast(most), "category")
    share = F.col("weight") / F.greatest(F.col("most"), F.lit(1))
    return out.select(
        "page_id", "category", "flagged", "weight", rounded(100 * (1 - share)).cast("int").alias("clean_percent"),
        F.when(F.col("flagged") == 0, "Clean").when(share >= 0.5, "Heavy").otherwise("Mild").alias("tier"),
    )


def first_place(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


#: What ``only`` and ``skip`` may name beside rules.
AXES = ["design", "copy", "aeo", "craft", "system", "provenance"]


def asked_for(rule: Column, axis: Column, only: list[str] = [], skip: list[str] = []) -> Column:  # noqa: B006
    """Whether a rule runs: ``skip`` wins; axes and rules named by ``only`` are each a filter, and a rule or its axis passes both."""
    named = rule.isin(only) | axis.isin(only) if only else F.lit(True)
    return named & ~(rule.isin(skip) | axis.isin(skip)) if skip else named


def preset_coverage(requests: DataFrame) -> DataFrame:
    """requests(preset, axes): the axes that a preset applies to and those it leaves alone. Presets are about design; ``full`` and unknown ones change nothing."""
    axes = F.array_distinct(F.filter(F.coalesce("axes", F.array().cast("array<string>")), lambda a: a != ""))
    axes = F.when(F.size(axes) == 0, F.array(F.lit("design"))).otherwise(axes)
    plain = ~F.coalesce(F.col("preset"), F.lit("full")).isin([p for p in {p for p, _, _ in catalog.PRESETS} if p != "full"])
    applied = F.when(plain, axes).otherwise(F.array_intersect(axes, F.array(F.lit("design"))))
    return requests.select("preset", F.array_join(applied, ",").alias("applied"), F.array_join(F.array_except(axes, applied), ",").alias("not_applied"))


#: The signs of a default kit, and how many make one.
KIT, KIT_LEAST = ["cream_ground", "hero_accent_word", "numbered_labels", "mono_labels", "pill_buttons"], 4


def kit_match(pages: DataFrame, editorial: Column | None = None) -> DataFrame:
    """``pages`` with hits, matched and signs of the default kit, from a boolean column a sign; null is no sign. A cream ground isn't one under the editorial preset."""
    signs = {k: F.coalesce(F.col(k), F.lit(False)) for k in KIT}
    if editorial is not None:
        signs["cream_ground"] = signs["cream_ground"] & ~F.coalesce(editorial, F.lit(False))
    hits = sum((c.cast("int") for c in signs.values()), F.lit(0))
    return pages.withColumns({"hits": hits, "matched": hits >= KIT_LEAST, "signs": F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in signs.items()])), ",")})
