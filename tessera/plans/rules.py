"""Queries of rules over elements, responses, tokens and signals; over literal cases where the bulk tables have none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.regex import quoted
from tessera.functions.text import sql_fnv1a, sql_normalised, sql_rounded, sql_tier, sql_words
from tessera.operators import aeo, design, report, static, system, watchlist
from tessera.operators import elements as el
from tessera.plans.copy import P_SQL
from tessera.sources import literal
from tessera.sources.html import LINK, copy_input, sql_strip_html
from tessera.sources.tables import SCANS_SQL, SQL_FLAGGED, flagged, scans, spread, table


def design_score_vectors(spark: SparkSession, d: str) -> DataFrame:
    return design.design_score(literal.signals(spark))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).select(F.col("scan_id").cast("string").alias("page_id"), F.explode(flagged(F.col("k"))).alias("rule_id"))
    blank = {"weight": "int", "status": "string", "error": "boolean", "hero_font": "string", "inter_only": "boolean", "secondary_only": "boolean", "has_evidence": "boolean", "node_ids": "array<string>"}
    return s.withColumns({"triggered": F.lit(True), **{k: F.lit(None).cast(t) for k, t in blank.items()}})


def design_score_scans(spark: SparkSession, d: str) -> DataFrame:
    """The scores of a whole history of signals."""
    return design.design_score(_signals(spark, d)).select("page_id", "score", "tier", "adjustments", "flagged")


def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return design.category_rollup(_signals(spark, d))


def overlap_dedup(spark: SparkSession, d: str) -> DataFrame:
    return design.overlaps(literal.signals(spark))


def unify_axes(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("scan_id", "score", F.col("system_score").alias("copy_score"), design.unified(F.col("score"), F.col("system_score")).alias("unified"))


def presets(spark: SparkSession, d: str) -> DataFrame:
    return design.preset_rules(spark)


def preset_filter(spark: SparkSession, d: str) -> DataFrame:
    """What each preset leaves of all flagged rules."""
    kept = design.preset_rules(spark).select("preset", "rule_id")
    return _signals(spark, d).join(F.broadcast(kept), "rule_id").groupBy("preset", "rule_id").agg(F.count(F.lit(1)).alias("n"))


_LAYERS = [(1, None, "slop_fonts", "warn", "base"), (2, r"example\.com", "slop_fonts", "error", "company"), (3, "glob:*/fr/*", "slop_fonts", "off", "french"), (2, "glob:https://*", "gradient_text", "error", "secure")]


def config_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = spark.createDataFrame(_LAYERS, "ord int, pattern string, key string, level string, reason string")
    return design.resolved_config(table(spark, d, "pages"), layers)


def config_assertions(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("categories:design", "error", 27.0, None), ("categories:system", "warn", None, 20.0), ("categories:copy", "off", 1.0, None)], "key string, level string, max_score double, min_score double")
    s = scans(spark, d)
    rows = s.select(F.col("scan_id").alias("page_id"), F.lit("design").alias("axis"), "score").unionByName(s.select(F.col("scan_id").alias("page_id"), F.lit("system").alias("axis"), F.col("system_score").alias("score")))
    return design.assertions(rows, rules)


def waiver_rescore(spark: SparkSession, d: str) -> DataFrame:
    waivers = spark.createDataFrame([("s03-design-md-token-waiver", "purple_accent", "config", "declared colour")], "page_id string, rule_id string, source string, reason string")
    raw = design.design_score(literal.signals(spark)).select("page_id", F.col("score").alias("raw_score"), F.col("tier").alias("raw_tier"))
    after = design.design_score(design.waived(literal.signals(spark), waivers).drop("waiver", "waived"))
    return raw.join(after.select("page_id", "score", "tier"), "page_id")


def inline_waivers(spark: SparkSession, d: str) -> DataFrame:
    html = '<p data-slop-ignore="gradient_text, slop_fonts -- brand"></p><!-- slop-ignore cream_default_bg : paper -->'
    return spark.createDataFrame([("a", html), ("b", "<p>")], "page_id string, html string").select("page_id", F.explode(design.inline_waivers(F.col("html"))).alias("w")).select("page_id", "w.rule_id", "w.reason")


def element_rules(spark: SparkSession, d: str) -> DataFrame:
    return el.counted_rules(literal.elements(spark))


def element_groups(spark: SparkSession, d: str) -> DataFrame:
    return el.grouped_rules(literal.elements(spark))


def element_eyebrows(spark: SparkSession, d: str) -> DataFrame:
    return el.eyebrows(literal.elements(spark))


def element_pills(spark: SparkSession, d: str) -> DataFrame:
    return el.hero_pills(literal.elements(spark))


def element_nested_cards(spark: SparkSession, d: str) -> DataFrame:
    return el.nested_cards(literal.elements(spark))


def element_collisions(spark: SparkSession, d: str) -> DataFrame:
    return el.collisions(literal.elements(spark))


def element_chips(spark: SparkSession, d: str) -> DataFrame:
    return el.chip_hues(literal.elements(spark))


def community_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"id": "many_details", "match": {"tag": "details"}, "min_count": 3}, {"id": "mostly_glass", "match": {"style": {"backdropFilter": "blur"}}, "min_ratio": 0.5}]
    return design.community_rules(literal.elements(spark), rules)


def craft_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    v = static.viewport(p)
    state = lambda c: F.when(F.col(c), "fail").otherwise("pass")
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), state(r).alias("status")) for r in ("viewport_meta_missing", "zoom_disabled")], F.struct(F.lit("mobile_reflow_failure").alias("rule_id"), F.lit("unknown").alias("status")))
    return el.craft_score(v.select("page_id", F.explode(each).alias("c")).select("page_id", "c.*"))


def static_viewport(spark: SparkSession, d: str) -> DataFrame:
    return static.viewport(table(spark, d, "pages"))


def static_scaffold(spark: SparkSession, d: str) -> DataFrame:
    return static.scaffold(table(spark, d, "pages"))


def static_controls(spark: SparkSession, d: str) -> DataFrame:
    return static.controls(copy_input(table(spark, d, "pages")), F.col("links"))


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return aeo.robots_rules(literal.fetches(spark).where("kind = 'robots' AND status = 200").select("site", "body"))


def robots_match(spark: SparkSession, d: str) -> DataFrame:
    paths = spark.createDataFrame([(s, p) for s in literal._ROBOTS for p in ("/", "/a", "/private/x", "/private/open", "/a.php.bak.php", "/~me/x")], "site string, path string")
    return aeo.bot_access(robots_rules(spark, d), paths)


def user_agents(spark: SparkSession, d: str) -> DataFrame:
    return aeo.bot_of(spark.createDataFrame([(a,) for a in _AGENTS], "user_agent string"))


def preview_directives(spark: SparkSession, d: str) -> DataFrame:
    return aeo.previews(literal.fetches(spark))


def edge_access(spark: SparkSession, d: str) -> DataFrame:
    f = literal.fetches(spark)
    base = f.where("kind = 'html'").select("site", F.col("body").alias("baseline"))
    return f.where("kind = 'search_probe'").join(base, "site").select("site", "status", aeo.edge_outcome(F.col("status"), F.col("headers"), F.col("body"), F.col("baseline")).alias("e")).select("site", F.col("status").alias("http_status"), "e.outcome", "e.status")


def aeo_checks(spark: SparkSession, d: str) -> DataFrame:
    return aeo.checks(literal.fetches(spark))


def aeo_score(spark: SparkSession, d: str) -> DataFrame:
    return aeo.aeo_score(aeo_checks(spark, d))


def prompt_injection(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    bad, canary = aeo.injections(text)
    return table(spark, d, "conversations").select("conv_id", "turn", bad.alias("instructions"), canary.alias("canaries"))


def page_readability(spark: SparkSession, d: str) -> DataFrame:
    """What a crawler without scripts gets from each page."""
    p = table(spark, d, "pages").select("page_id", "html", aeo.visible_text(F.col("html")).alias("text"))
    return p.select("page_id", F.regexp_count("text", F.lit(r"\S+")).alias("words"), aeo.operability(F.col("html")).alias("o"), aeo.json_ld(F.col("html")).alias("j")).select(
        "page_id", "words", "o.controls", "o.named_ratio", "o.healthy", F.col("j.blocks").alias("json_ld"), (F.col("words") >= 15).alias("covered"))


def usage_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = [("train-ai=n, search=y",), ("ai-use=?1,foo=bar",), ("nonsense",), (None,)]
    p = aeo.usage_policy(F.col("value"))
    return spark.createDataFrame(rows, "value string").select("value", p.alias("p")).select("value", "p.train_ai", "p.ai_use", "p.search", F.array_join("p.unknown", ",").alias("unknown"))


def _tokens(spark: SparkSession, version: int) -> DataFrame:
    return system.leaves(literal.token_specs(spark).where(F.col("version") == version).select("site", "tokens"))


def tokens_resolved(spark: SparkSession, d: str) -> DataFrame:
    return system.resolved(_tokens(spark, 1))


def tokens_diff(spark: SparkSession, d: str) -> DataFrame:
    return system.changed(_tokens(spark, 1), _tokens(spark, 2))


def palette_nearest(spark: SparkSession, d: str) -> DataFrame:
    palette = tokens_resolved(spark, d).where("path LIKE 'colors.%'")
    return system.nearest_colours(literal.observed_colours(spark), palette)


def palette_distance(spark: SparkSession, d: str) -> DataFrame:
    return system.palette_distance(palette_nearest(spark, d))


def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    return system.class_coverage(palette_nearest(spark, d))


def system_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of colours and text styles from what was observed."""
    palette = tokens_resolved(spark, d).where("path LIKE 'colors.%'")
    colours = system.colour_checks(system.nearest_colours(literal.observed_colours(spark, literal.OFF_SURFACES), palette))
    return colours.unionByName(system.style_check(*literal.text_styles(spark)))


def system_waivers(spark: SparkSession, d: str) -> DataFrame:
    tokens = tokens_resolved(spark, d)
    return system.waived(literal.system_findings(spark), tokens.where("path LIKE 'colors.%'"), tokens.where("path LIKE '%fontFamily'"))


def band_scale(spark: SparkSession, d: str) -> DataFrame:
    """Prices against a declared scale of whole hundreds, within two."""
    rows = table(spark, d, "part").select(F.lit("price").alias("key"), F.col("p_retailprice").cast("double").alias("value"))
    scale = spark.range(9, 25).select(F.lit("price").alias("key"), (F.col("id") * 100.0).alias("step"))
    return system.on_scale(rows, scale, 2.0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("on_scale"))


def contrast_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", "#777777", "#ffffff", False), ("b", "black", "white", False), ("c", "#777", "rgb(255, 255, 255)", True), ("d", "nonsense", "#fff", False)]
    return system.contrast_pairs(spark.createDataFrame(rows, "site string, fg string, bg string, has_image boolean"))


def fonts_declared(spark: SparkSession, d: str) -> DataFrame:
    seen = spark.createDataFrame([("mill", "Georgia, serif", 90), ("mill", "'Inter'", 10)], "site string, family string, n int")
    return system.undeclared_fonts(seen, tokens_resolved(spark, d).where("path LIKE '%fontFamily'"))


def system_score(spark: SparkSession, d: str) -> DataFrame:
    rows = [("mill", "fonts.declared", "fail"), ("mill", "colors.cta", "pass"), ("mill", "radii.scale", "pass"), ("mill", "spacing.scale", "skip"), ("none", "fonts.declared", "skip")]
    return system.system_score(spark.createDataFrame(rows, "site string, rule_id string, status string"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    dim = design.rule_dim(spark).select("rule_id", "weight", "status")
    s = scans(spark, d).select(F.col("scan_id").alias("page_id"), F.concat(F.lit("https://"), "domain", F.lit(".example/")).alias("url"), "score", "tier", F.explode(flagged(F.col("k"))).alias("rule_id"))
    return s.join(F.broadcast(dim), "rule_id").withColumn("triggered", F.lit(True)).withColumn("status", F.when(F.col("status") == "review", "review").otherwise("fail"))


def report_github(spark: SparkSession, d: str) -> DataFrame:
    return report.github(_findings(spark, d))


def report_gitlab(spark: SparkSession, d: str) -> DataFrame:
    return report.gitlab(_findings(spark, d))


def report_sarif(spark: SparkSession, d: str) -> DataFrame:
    return report.sarif(_findings(spark, d))


def report_junit(spark: SparkSession, d: str) -> DataFrame:
    return report.junit(_findings(spark, d)).select("page_id", "tests", "failures", "skipped")


def report_agent(spark: SparkSession, d: str) -> DataFrame:
    return report.agent(_findings(spark, d))


def gate_exit_code(spark: SparkSession, d: str) -> DataFrame:
    return report.exit_code(scans(spark, d), fail_tier="Heavy", fail_over=90)


def avoid_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _findings(spark, d).withColumn("advice", F.concat(F.lit("avoid "), F.replace("rule_id", F.lit("_"), F.lit(" "))))
    return report.avoid_list(rows.select("page_id", "rule_id", "weight", "advice"), 8)


def watch_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return docs.select("doc_id", watchlist.sentence_band(F.col("text")).alias("b"), watchlist.mixed_scripts(F.col("text")).alias("m")).select(
        "doc_id", "b.sentences", "b.in_band", "b.ratio", "b.marks", F.col("b.triggered").alias("even"), F.col("m.count").alias("mixed_words"))


def watch_looks(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.watched(literal.elements(spark))


def page_looks(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.page_rules(literal.elements(spark))


def accent_words(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.accent_words(literal.elements(spark))


def craft_focus(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.focus_indicators(literal.focus_probes(spark))


def craft_ctas(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.dead_ctas(literal.cta_probes(spark))


def craft_forms(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.form_feedback(literal.form_probes(spark))


def page_status(spark: SparkSession, d: str) -> DataFrame:
    """Which pages are blocked or dead, by title and visible words."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"), aeo.visible_text(F.col("html")).alias("text"))
    n = F.regexp_count("text", F.lit(r"\S+"))
    return watchlist.page_status(p.select("page_id", "title", n.alias("visible"), n.alias("with_evidence")))


def only_skip(spark: SparkSession, d: str) -> DataFrame:
    """The rules that run when whole axes or single rules are asked for."""
    rows = rule_catalogue(spark, d)
    asked = {"copy_but_one": (["copy"], ["em_dash_overload"]), "two_rules": (["slop_fonts", "md.twin"], []), "no_design": ([], ["design"]), "skip_wins": (["craft"], ["craft", "zoom_disabled"])}
    each = [rows.where(design.asked_for(F.col("rule_id"), F.col("axis"), *lists)).select(F.lit(k).alias("asked"), "axis", "rule_id") for k, lists in asked.items()]
    return reduce(DataFrame.unionByName, each)


def preset_coverage(spark: SparkSession, d: str) -> DataFrame:
    return design.preset_coverage(spark.createDataFrame(_COVERED, "preset string, axes array<string>"))


def default_kit(spark: SparkSession, d: str) -> DataFrame:
    """Signs read off the flags of scans; every third is under the editorial preset."""
    signs = {k: F.col("k").bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(design.KIT)}
    return design.kit_match(scans(spark, d).withColumns(signs), F.col("scan_id") % 3 == 0).select("scan_id", "hits", "matched", "signs")


def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_CATALOGUE, "axis string, rule_id string, category string, weight int, status string")


QUERIES = {f.__name__: f for f in (
    design_score_vectors, design_score_scans, category_rollup, overlap_dedup, unify_axes, presets, preset_filter, config_layers, config_assertions, waiver_rescore, inline_waivers,
    element_rules, element_groups, element_eyebrows, element_pills, element_nested_cards, element_collisions, element_chips, community_rules, craft_score, static_viewport, static_scaffold,
    static_controls, robots_rules, robots_match, user_agents, preview_directives, edge_access, aeo_checks, aeo_score, prompt_injection, page_readability, usage_policies, tokens_resolved,
    tokens_diff, palette_nearest, palette_distance, class_coverage, system_checks, system_waivers, band_scale, contrast_pairs, fonts_declared, system_score, report_github, report_gitlab, report_sarif, report_junit,
    report_agent, gate_exit_code, avoid_list, watch_sentences, watch_looks, page_looks, accent_words, craft_focus, craft_ctas, craft_forms, page_status, rule_catalogue, only_skip, preset_coverage, default_kit,
)}
_DIM = "dim(rule_id, category, weight, status, ord) AS (VALUES " + ", ".join(f"('{i}', '{c}', {w}, '{s}', {k})" for k, (i, c, w, s) in enumerate(catalog.DESIGN_RULES)) + ")"
_SIG = f"{SCANS_SQL}, {_DIM}, sg AS (SELECT scan_id, score, tier, domain, unnest({SQL_FLAGGED}) AS rule_id FROM scans)"
_PRESET = "kept AS (SELECT p.preset, d.rule_id, d.category, d.weight FROM dim d, (VALUES " + ", ".join(f"('{p}')" for p in dict.fromkeys(p for p, _, _ in catalog.PRESETS)) + """) p(preset) WHERE CASE p.preset
  WHEN 'strict' THEN weight >= 5 WHEN 'marketing' THEN category IN ('fonts', 'colors', 'images') OR rule_id IN ('centered_hero', 'hero_eyebrow_pill', 'all_caps_labels', 'eyebrow_label')
  WHEN 'minimal' THEN rule_id IN ('slop_fonts', 'purple_accent', 'gradient_text') WHEN 'editorial' THEN rule_id NOT IN ('cream_default_bg', 'editorial_cream_kit')
  WHEN 'devtool' THEN rule_id NOT IN ('display_mono_heading', 'perma_dark_mode') ELSE true END)"""
_FIND = f"{_SIG}, fi AS (SELECT scan_id AS page_id, 'https://' || domain || '.example/' AS url, score, tier, rule_id, weight, CASE WHEN status = 'review' THEN 'review' ELSE 'fail' END AS status FROM sg JOIN dim USING (rule_id))"
_CATALOGUE = [("copy", i, "copy", w, s) for i, _, _, w, s, _ in catalog.COPY_RULES] + [("design", i, c, w, s) for i, c, w, s in catalog.DESIGN_RULES] + [
    (axis, i, axis, w, "active") for axis, of in (("craft", catalog.CRAFT_RULES), ("system", catalog.SYSTEM_RULES)) for i, w in of] + [("aeo", i, s, w, "active") for i, w, s in catalog.AEO_RULES]
_COVERED = [("full", ["design", "copy"]), ("strict", ["design", "copy", "aeo"]), ("minimal", ["copy", "copy"]), ("editorial", []), ("nonsense", ["aeo"]), (None, None)]
_AGENTS = ["Mozilla/5.0 (compatible; Googlebot/2.1)", "Applebot-Extended/1.0", "GPTBot/1.1", "Mozilla/5.0 Firefox"]


def _visible(html: str) -> str:
    out = f"regexp_replace({html}, '<!--[\\s\\S]*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "svg", "template"):
        out = rf"regexp_replace({out}, '(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_SEEN = f"v AS (SELECT page_id, html, {_visible('html')} AS text FROM pages)"
_WORDS = r"len(regexp_extract_all(text, '\S+'))"
_TOKENS = "tok(site, version, path, value) AS (VALUES " + ", ".join(
    f"('mill', {v}, '{p}', '{x}')" for v, tokens in ((1, literal.TOKENS[0]), (2, literal.TOKENS[1])) for p, x in literal.flat(tokens)) + ")"
_sql_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _sql_lab(rgb: str) -> str:
    """L, a, b as a list, of a list of three channels from 0 to 255."""
    of = lambda *w: " + ".join(f"{x}::DOUBLE * l[{i}]" for i, x in enumerate(w, 1))
    lin = f"list_transform({rgb}, lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.04045 THEN c / 255.0::DOUBLE / 12.92 ELSE pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    lms = f"list_transform([{lin}], lambda l: [cbrt({of(0.4122214708, 0.5363325363, 0.0514459929)}), cbrt({of(0.2119034982, 0.6806995451, 0.1073969566)}), cbrt({of(0.0883024619, 0.2817188376, 0.6299787005)})])"
    return f"list_transform({lms}, lambda l: [{of(0.2104542553, 0.7936177850, -0.0040720468)}, {of(1.9779984951, -2.4285922050, 0.4505937099)}, {of(0.0259040371, 0.7827717662, -0.8086757660)}])[1]"


_RGB = lambda c: f"CASE WHEN {c} LIKE '#%' THEN list_transform([2, 4, 6], lambda i: ('0x' || substr({c}, i, 2))::INT) WHEN {c} LIKE 'rgb%' THEN list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: x::INT) END"
_SEEN_COLOURS = _sql_rows(literal.OBSERVED_COLOURS)
_NEAREST = f"""{_TOKENS}, seen(site, class, colour, area) AS (VALUES {_SEEN_COLOURS}),
pal AS (SELECT site, path, {_RGB('value')} AS rgb FROM tok WHERE version = 1 AND path LIKE 'colors.%' AND value LIKE '#%' UNION ALL SELECT 'mill', 'colors.link', [124, 58, 237]),
pl AS (SELECT site, path, {_sql_lab('rgb')} AS lab FROM pal), sr AS (SELECT *, row_number() OVER () AS i, {_RGB('colour')} AS rgb FROM seen), sl AS (SELECT *, CASE WHEN rgb IS NOT NULL THEN {_sql_lab('rgb')} END AS lab FROM sr),
far AS (SELECT s.*, p.path AS token, list_distance(s.lab, p.lab) AS d FROM sl s LEFT JOIN pl p ON s.site = p.site AND s.lab IS NOT NULL),
near AS (SELECT site, class, colour, area, token, {sql_rounded('d', 4)} AS distance, CASE WHEN d <= 0.02 THEN 'match' WHEN d <= 0.05 THEN 'near' WHEN d IS NOT NULL THEN 'off' END AS verdict FROM far QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, token) = 1)"""
_FETCHES = "fetched(site, kind, status, waf, price, body) AS (VALUES " + ", ".join(
    f"('{site}', '{kind}', {status}, '{headers.get('x-amzn-waf-action', '')}', {'crawler-price' in headers}, {quoted(body)})" for site, kind, _, status, headers, body in literal.FETCHES) + ")"
ORACLES = {
    "category_rollup": f"""WITH {_SIG}, m AS (SELECT category, sum(weight) AS most FROM dim GROUP BY category),
g AS (SELECT scan_id::VARCHAR AS page_id, category, count(*) AS flagged, sum(weight)::DOUBLE AS weight FROM sg JOIN dim USING (rule_id) GROUP BY ALL)
SELECT page_id, category, flagged, weight, floor(100 * (1 - weight / most) + 0.5)::INT AS clean_percent, CASE WHEN weight / most >= 0.5 THEN 'Heavy' ELSE 'Mild' END AS tier FROM g JOIN m USING (category)""",
    "design_score_scans": f"""WITH {_SIG}, w AS (SELECT scan_id::VARCHAR AS page_id, sum(weight) AS raw, count(*) AS flagged, bool_or(rule_id = 'slop_fonts') AS sf, bool_or(rule_id = 'centered_hero') AS ch, bool_or(rule_id = 'purple_accent') AS pa
  FROM sg JOIN dim USING (rule_id) GROUP BY scan_id),
r AS (SELECT *, sf AND ch AS two, pa AND flagged > 1 AND raw - 4 <= 0 AS three FROM w), s AS (SELECT *, (raw - CASE WHEN two THEN 4 ELSE 0 END - CASE WHEN three THEN 4 ELSE 0 END)::INT AS score FROM r)
SELECT page_id, score, {sql_tier('score')} AS tier, CASE WHEN two THEN 'slop_fonts_centered_hero_cap' WHEN three THEN 'purple_accent_co_signal' ELSE '' END AS adjustments, flagged FROM s""",
    "unify_axes": f"""WITH {SCANS_SQL} SELECT scan_id, score, system_score AS copy_score, least(100, greatest(score, system_score) + CASE WHEN score >= 10 AND system_score >= 8 THEN 6 ELSE 0 END) AS unified FROM scans""",
    "presets": f"WITH {_DIM}, {_PRESET} SELECT * FROM kept",
    "preset_filter": f"WITH {_SIG}, {_PRESET} SELECT preset, rule_id, count(*) AS n FROM sg JOIN kept USING (rule_id) GROUP BY ALL",
    "config_layers": r"""WITH l(ord, rx, key, level, reason) AS (VALUES (1, NULL, 'slop_fonts', 'warn', 'base'), (2, 'example\.com', 'slop_fonts', 'error', 'company'), (3, '^.*/fr/.*$', 'slop_fonts', 'off', 'french'), (2, '^https://.*$', 'gradient_text', 'error', 'secure'))
SELECT page_id, key, level, reason FROM pages, l WHERE rx IS NULL OR regexp_matches(url, rx) QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY ord DESC) = 1""",
    "config_assertions": f"""WITH {SCANS_SQL} SELECT scan_id AS page_id, 'categories:design' AS key, 'failure' AS kind, score FROM scans WHERE score > 27
UNION ALL SELECT scan_id, 'categories:system', 'warning', system_score FROM scans WHERE system_score < 20""",
    "craft_score": f"""WITH v AS (SELECT page_id, {static.SQL_VIEWPORT} AS m FROM pages),
b AS (SELECT page_id, NOT contains(m, 'width=device-width') AS missing, regexp_matches(m, 'user-scalable\\s*=\\s*(?:no|0)') OR coalesce(try_cast(regexp_extract(m, 'maximum-scale\\s*=\\s*([0-9.]+)', 1) AS DOUBLE) < 2, false) AS locked FROM v)
SELECT page_id, 30::BIGINT AS applicable, (CASE WHEN missing THEN 0 ELSE 15 END + CASE WHEN locked THEN 0 ELSE 15 END)::BIGINT AS earned, 1::BIGINT AS unknown,
  floor(100.0 * (CASE WHEN missing THEN 0 ELSE 15 END + CASE WHEN locked THEN 0 ELSE 15 END) / 30 + 0.5)::INT AS score FROM b""",
    "static_viewport": f"""WITH v AS (SELECT page_id, {static.SQL_VIEWPORT} AS m FROM pages)
SELECT page_id, NOT contains(m, 'width=device-width') AS viewport_meta_missing, regexp_matches(m, 'user-scalable\\s*=\\s*(?:no|0)') OR coalesce(try_cast(regexp_extract(m, 'maximum-scale\\s*=\\s*([0-9.]+)', 1) AS DOUBLE) < 2, false) AS zoom_disabled FROM v""",
    "static_scaffold": f"""WITH h AS (SELECT page_id, html, {' + '.join(f'regexp_matches(html, {quoted(rx)})::INT' for rx in static.SCAFFOLD)} AS hits FROM pages)
SELECT page_id, hits, hits >= 1 AS scaffold_defaults, regexp_matches(html, {quoted(static.SPOTLIGHT)}) AS cursor_spotlight, nullif(regexp_extract(html, {quoted(static.GENERATOR)}, 1), '') AS generator FROM h""",
    "static_controls": f"""WITH {P_SQL}, l AS (SELECT page_id, bare, {LINK.sql_all('bare', 1)} AS h, {LINK.sql_all('bare', 2)} AS t FROM p),
n AS (SELECT page_id, list_filter(list_transform(range(1, least(300, len(h)) + 1), lambda i: CASE WHEN regexp_matches(substr({sql_strip_html('t[i]')}, 1, 100), {quoted(static.GENERIC)}) THEN trim(h[i]) END), lambda x: x IS NOT NULL) AS g FROM l),
a AS (SELECT page_id, len(regexp_extract_all(html, {quoted(static.BAD_ALT)})) AS bad_alt, regexp_extract_all(html, {quoted(static.ANCHOR)}, 1) AS hrefs FROM pages),
b AS (SELECT *, len(list_filter(hrefs, lambda x: regexp_matches(trim(x), {quoted(static.DEAD)}))) AS dead FROM a)
SELECT page_id, len(g) AS generic, len(list_distinct(g)) AS targets, bad_alt, (len(g) >= 3 AND len(list_distinct(g)) >= 2) OR bad_alt >= 1 AS generic_control_labels, len(hrefs) AS anchors, dead, dead >= 0.3 * greatest(1, len(hrefs)) AS dead_links FROM n JOIN b USING (page_id)""",
    "prompt_injection": f"""SELECT conv_id, turn, {' + '.join(p.sql_count("coalesce(text, '')") for p in catalog.INJECTION.values())} AS instructions, {catalog.CANARY.sql_count("coalesce(text, '')")} AS canaries FROM conversations""",
    "band_scale": "WITH r AS (SELECT p_retailprice::DOUBLE AS v FROM part) SELECT 'price' AS key, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM range(9, 25) s(i) WHERE abs(v - i * 100.0) <= 2)) AS on_scale FROM r",
    "report_github": f"""WITH {_FIND} SELECT page_id, rule_id, '::' || CASE WHEN status = 'review' OR weight = 0 THEN 'warning' WHEN weight >= 6 THEN 'error' ELSE 'warning' END || ' title=' || rule_id || '::' || url || ' weight ' || weight AS line FROM fi""",
    "report_junit": f"WITH {_FIND} SELECT page_id, count(*) AS tests, count(*) FILTER (status = 'fail') AS failures, count(*) FILTER (status = 'review') AS skipped FROM fi GROUP BY page_id",
    "report_agent": f"""WITH {_FIND} SELECT page_id, any_value(url) || ' ' || any_value(score) || ' ' || any_value(tier) || ' ' || string_agg(rule_id, ',' ORDER BY weight DESC, rule_id) AS line FROM fi GROUP BY page_id""",
    "watch_sentences": f"""WITH d0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace({sql_normalised('trim(text)')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_words('x')}), lambda n: n >= 3) AS l,
  len(list_distinct(regexp_extract_all(text, '[.,;:!?—–()\\[\\]"'']'))) AS marks FROM d0),
e AS (SELECT doc_id, text, len(l) AS sentences, len(list_filter(l, lambda n: n BETWEEN 8 AND 20)) AS in_band, marks FROM d),
r AS (SELECT *, CASE WHEN sentences > 0 THEN {sql_rounded('in_band::DOUBLE / sentences', 2)} ELSE 0.0 END AS ratio FROM e)
SELECT doc_id, sentences, in_band, ratio, marks, sentences >= 6 AND ratio >= 0.75 AND marks <= 3 AS even,
  len(list_filter(list_transform(regexp_extract_all(text, '\\S*[\\x{{370}}-\\x{{4FF}}]\\S*'), lambda t: regexp_replace(t, '^[.,;:!?"''(\\[{{]+|[.,;:!?"'')\\]}}]+$', '', 'g')),
    lambda t: len(t) >= 2 AND regexp_matches(t, '[A-Za-z]'))) AS mixed_words FROM r""",
    "rule_catalogue": "SELECT * FROM (VALUES " + ", ".join(
        f"('{a}', '{i}', '{c}', {w}, '{st}')" for a, i, c, w, st in _CATALOGUE
    ) + ") t(axis, rule_id, category, weight, status)",
    "only_skip": "WITH c(axis, rule_id) AS (VALUES " + ", ".join(f"('{a}', '{i}')" for a, i, *_ in _CATALOGUE) + """) SELECT 'copy_but_one' AS asked, axis, rule_id FROM c WHERE axis = 'copy' AND rule_id <> 'em_dash_overload'
UNION ALL SELECT 'two_rules', axis, rule_id FROM c WHERE rule_id IN ('slop_fonts', 'md.twin') UNION ALL SELECT 'no_design', axis, rule_id FROM c WHERE axis <> 'design'""",
    "preset_coverage": f"""WITH r(preset, axes) AS (VALUES {", ".join("(" + ("NULL" if p is None else f"'{p}'") + ", " + ("NULL" if a is None else f"{a}::VARCHAR[]") + ")" for p, a in _COVERED)}),
u AS (SELECT preset, CASE WHEN coalesce(len(axes), 0) = 0 THEN ['design'] ELSE axes END AS axes, coalesce(preset IN ('strict', 'marketing', 'minimal', 'editorial', 'devtool'), false) AS narrow FROM r),
x AS (SELECT preset, narrow, unnest(axes) AS axis FROM u) SELECT preset, coalesce(string_agg(DISTINCT axis, ',' ORDER BY axis DESC) FILTER (NOT narrow OR axis = 'design'), '') AS applied,
  coalesce(string_agg(DISTINCT axis, ',' ORDER BY axis DESC) FILTER (narrow AND axis <> 'design'), '') AS not_applied FROM x GROUP BY preset""",
    "default_kit": f"""WITH {SCANS_SQL}, b AS (SELECT scan_id, [{", ".join(f"(k & {1 << i}) <> 0" + (" AND scan_id % 3 <> 0" if i == 0 else "") for i in range(len(design.KIT)))}] AS f FROM scans),
s AS (SELECT scan_id, list_filter([{", ".join(f"CASE WHEN f[{i}] THEN '{k}' END" for i, k in enumerate(design.KIT, 1))}], lambda x: x IS NOT NULL) AS l FROM b)
SELECT scan_id, len(l) AS hits, len(l) >= 4 AS matched, array_to_string(l, ',') AS signs FROM s""",
    "report_gitlab": f"""WITH {_FIND}, h AS (SELECT *, lower(lpad(to_hex({sql_fnv1a("rule_id || ':' || url")}), 8, '0')) AS f FROM fi)
SELECT page_id, rule_id, '{{"check_name":"' || rule_id || '","severity":"' || CASE WHEN status = 'review' OR weight = 0 THEN 'info' WHEN weight >= 8 THEN 'critical' WHEN weight >= 6 THEN 'major' ELSE 'minor' END
  || '","fingerprint":"' || f || '","location":{{"path":"' || url || '","lines":{{"begin":1}}}}}}' AS item FROM h""",
    "report_sarif": f"""WITH {_FIND}, h AS (SELECT *, lower(lpad(to_hex({sql_fnv1a("rule_id || ':' || url")}), 8, '0')) AS f FROM fi),
r AS (SELECT page_id, string_agg('{{"ruleId":"' || rule_id || '","level":"' || CASE WHEN status = 'review' OR weight < 6 THEN 'warning' ELSE 'error' END || '","partialFingerprints":{{"primary":"' || f || '"}}}}', ',' ORDER BY rule_id) AS l FROM h GROUP BY page_id)
SELECT page_id, '{{"version":"2.1.0","runs":[{{"results":[' || l || ']}}]}}' AS sarif FROM r""",
    "avoid_list": f"""WITH {_FIND}, a AS (SELECT page_id, rule_id, 'avoid ' || replace(rule_id, '_', ' ') AS advice, weight FROM fi),
o AS (SELECT page_id, list(struct_pack(id := rule_id, advice := advice, n := len(string_split(advice, ' '))) ORDER BY weight DESC, rule_id) AS l FROM a GROUP BY page_id),
x AS (SELECT page_id, list_reduce(list_prepend(struct_pack(id := '', advice := '', n := 0), l), lambda t, i: CASE WHEN t.n + i.n <= 8 THEN struct_pack(id := '', advice := t.advice || '; ' || i.advice, n := t.n + i.n)
  WHEN t.n + 1 <= 8 THEN struct_pack(id := '', advice := t.advice || '; ' || i.id, n := t.n + 1) ELSE t END).advice AS t FROM o)
SELECT page_id, substr(t, 3) AS avoid FROM x""",
    "page_status": rf"""WITH {_SEEN}, t AS (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, {_WORDS} AS n FROM v)
SELECT page_id, CASE WHEN {" OR ".join(f"contains(title, {quoted(x)})" for x in watchlist.CHALLENGE_TITLES)} THEN 'cloudflare_challenge'
  WHEN regexp_matches(title, '(?i)access denied|forbidden|akamai') AND n < 20 THEN 'access_blocked' WHEN n < 10 THEN 'empty_page' END AS blocked FROM t""",
    "page_readability": rf"""WITH {_SEEN}, c AS (SELECT *, {_WORDS} AS words, list_concat(regexp_extract_all(html, '(?i)<button\b[^>]*>[\s\S]*?</button>'), regexp_extract_all(html, '(?i)<a\b[^>]*>[\s\S]*?</a>')) AS found FROM v),
n AS (SELECT *, len(list_filter(found, lambda x: regexp_matches(x, '(?i)\b(?:aria-label(?:ledby)?|title)\s*=\s*["''][^"'']+["'']') OR {_visible('x')} <> '')) AS named FROM c),
r AS (SELECT *, CASE WHEN len(found) > 0 THEN {sql_rounded('named::DOUBLE / len(found)', 3)} ELSE 1.0 END AS ratio FROM n)
SELECT page_id, words, len(found) AS controls, ratio AS named_ratio, ratio >= 0.8 AND NOT regexp_matches(html, '(?i)<[^>]+class\s*=\s*["''][^"'']*price[^"'']*["''][^>]*>\s*</[^>]+>') AS healthy,
  len(regexp_extract_all(html, '(?i)<script\b[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>')) AS json_ld, words >= 15 AS covered FROM r""",
    "tokens_resolved": f"""WITH RECURSIVE {_TOKENS}, a AS (SELECT site, path, value, 0 AS hop FROM tok WHERE version = 1
  UNION ALL SELECT a.site, a.path, t.value, hop + 1 FROM a JOIN tok t ON t.version = 1 AND t.site = a.site AND a.value = '{{' || t.path || '}}' WHERE hop < 8),
l AS (SELECT site, path, arg_max(value, hop) AS value FROM a GROUP BY ALL) SELECT site, path, CASE WHEN value NOT LIKE '{{%' THEN value END AS value FROM l""",
    "tokens_diff": f"""WITH {_TOKENS}, b AS (SELECT site, path, value AS "old" FROM tok WHERE version = 1), n AS (SELECT site, path, value AS "new" FROM tok WHERE version = 2)
SELECT site, path, "old", "new", CASE WHEN "old" IS NULL THEN 'added' WHEN "new" IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM b FULL JOIN n USING (site, path) WHERE "old" IS DISTINCT FROM "new\"""",
    "contrast_pairs": f"""WITH p(site, fg, bg, has_image, a, b) AS (VALUES ('a', '#777777', '#ffffff', false, 119, 255), ('b', 'black', 'white', false, 0, 255),
  ('c', '#777', 'rgb(255, 255, 255)', true, 119, 255), ('d', 'nonsense', '#fff', false, NULL, 255)),
l AS (SELECT *, (1 + 0.05) / (CASE WHEN a = 0 THEN 0::DOUBLE ELSE pow((a / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END + 0.05) AS ratio FROM p)
SELECT site, fg, bg, has_image, {sql_rounded('ratio', 2)} AS contrast, CASE WHEN has_image OR ratio IS NULL THEN 'unknown' WHEN ratio < 4.5 THEN 'review' ELSE 'pass' END AS status FROM l""",
    "fonts_declared": f"""WITH {_TOKENS}, seen(site, family, n) AS (VALUES ('mill', 'Georgia, serif', 90), ('mill', '''Inter''', 10)),
f AS (SELECT site, lower(trim(translate(string_split(family, ',')[1], '"''', ''))) AS family, n, sum(n) OVER (PARTITION BY site) AS every FROM seen)
SELECT site, family, {sql_rounded('sum(n)::DOUBLE / any_value(every)', 3)} AS share FROM f
WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.version = 1 AND t.site = f.site AND t.path LIKE '%fontFamily' AND lower(t.value) = f.family) GROUP BY site, family""",
    "palette_nearest": f"WITH {_NEAREST} SELECT site, class, colour, area, token, distance, verdict FROM near",
    "palette_distance": f"""WITH {_NEAREST} SELECT site, {sql_rounded('avg(distance)', 4)} AS mean_distance, {sql_rounded('avg((distance <= 0.05)::INT)', 3)} AS near_share FROM near WHERE distance IS NOT NULL GROUP BY site""",
    "class_coverage": f"""WITH {_NEAREST}, m AS (SELECT *, CASE verdict WHEN 'match' THEN 1.0::DOUBLE WHEN 'near' THEN 0.5 ELSE 0 END AS hit FROM near)
SELECT site, class, {sql_rounded('avg(hit)', 3)} AS by_count, {sql_rounded('sum(hit * area) / greatest(sum(area), 1e-9)', 3)} AS by_area FROM m GROUP BY site, class""",
    "system_checks": f"""WITH {_NEAREST.replace(_SEEN_COLOURS, _SEEN_COLOURS + ", " + _sql_rows(literal.OFF_SURFACES))}, c AS (SELECT site, class, count(*) AS n, count(*) FILTER (verdict = 'off') AS off FROM near WHERE distance IS NOT NULL GROUP BY ALL),
k AS (SELECT site, CASE class WHEN 'cta' THEN 'colors.cta' WHEN 'surface' THEN 'colors.surface' ELSE 'colors.headings' END AS rule_id, CASE WHEN class = 'heading' AND 2 * off <= n OR off = 0 THEN 'pass' ELSE 'fail' END AS status, n, off FROM c),
d(site, fam, size, height, spacing) AS (VALUES {_sql_rows(literal.DECLARED_STYLES)}), o(site, ord, fam, size, height, spacing) AS (VALUES {_sql_rows(literal.OBSERVED_STYLES)}),
e AS (SELECT site, EXISTS (SELECT 1 FROM d WHERE d.site = o.site AND d.size IS NOT NULL AND coalesce(o.fam = d.fam, true) AND coalesce(abs(o.size - d.size) <= 0.5, true)
  AND coalesce(abs(o.height - d.height) <= 0.05, true) AND coalesce(abs(o.spacing - d.spacing) <= 0.25, true)) AS fits FROM o),
t AS (SELECT site, count(*) AS n, count(*) FILTER (NOT fits) AS off FROM e GROUP BY site)
SELECT * FROM k UNION ALL SELECT site, 'typography.styles', CASE WHEN 2 * off > n THEN 'fail' ELSE 'pass' END, n, off FROM t WHERE site IN (SELECT site FROM d WHERE size IS NOT NULL)
UNION ALL SELECT site, 'typography.styles', 'skip', n, 0 FROM t WHERE site NOT IN (SELECT site FROM d WHERE size IS NOT NULL)""",
    "system_waivers": f"""WITH {_NEAREST}, f(site, rule_id, weight, colour, family) AS (VALUES {_sql_rows(literal.SYSTEM_FINDINGS)}),
w AS (SELECT f.*, EXISTS (SELECT 1 FROM near n WHERE n.site = f.site AND n.colour = f.colour AND n.distance <= 0.05) OR EXISTS (SELECT 1 FROM tok t WHERE t.version = 1 AND t.site = f.site AND t.path LIKE '%fontFamily' AND lower(t.value) = lower(f.family)) AS waived FROM f)
SELECT site, sum(weight)::BIGINT AS before, coalesce(sum(weight) FILTER (NOT waived), 0)::BIGINT AS score, count(*) FILTER (waived) AS waived, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (waived), '') AS rules FROM w GROUP BY site""",
    "system_score": f"""WITH dim(rule_id, weight) AS (VALUES {", ".join(f"('{i}', {w})" for i, w in catalog.SYSTEM_RULES)}),
c(site, rule_id, status) AS (VALUES ('mill', 'fonts.declared', 'fail'), ('mill', 'colors.cta', 'pass'), ('mill', 'radii.scale', 'pass'), ('mill', 'spacing.scale', 'skip'), ('none', 'fonts.declared', 'skip')),
s AS (SELECT site, coalesce(sum(weight) FILTER (status IN ('pass', 'fail')), 0)::BIGINT AS judged, coalesce(sum(weight) FILTER (status = 'pass'), 0)::BIGINT AS passed FROM c JOIN dim USING (rule_id) GROUP BY site),
r AS (SELECT *, CASE WHEN judged > 0 THEN {sql_rounded('passed::DOUBLE / judged', 3)} ELSE 1.0 END AS score FROM s)
SELECT *, CASE WHEN score >= 0.8 THEN 'Aligned' WHEN score >= 0.5 THEN 'Drifting' ELSE 'Off-system' END AS tier FROM r""",
    "user_agents": f"""WITH bot(bot, purpose) AS (VALUES {", ".join(f"('{n}', '{p}')" for n, p, *_, only in catalog.BOTS if not only)}),
a(user_agent) AS (VALUES {", ".join(f"('{u}')" for u in _AGENTS)})
SELECT user_agent, arg_max(bot, length(bot)) AS bot, arg_max(purpose, length(bot)) AS purpose FROM a LEFT JOIN bot ON contains(lower(user_agent), lower(bot)) GROUP BY user_agent""",
    "edge_access": f"""WITH {_FETCHES}, f AS (SELECT p.*, h.body AS baseline FROM fetched p JOIN fetched h USING (site) WHERE p.kind = 'search_probe' AND h.kind = 'html'),
o AS (SELECT site, status AS http_status, CASE WHEN status = 202 AND waf = 'challenge' THEN 'challenge' WHEN status = 405 AND waf = 'captcha' THEN 'captcha' WHEN regexp_matches(body, {quoted(aeo.CHALLENGE)}) THEN 'challenge'
  WHEN status = 402 AND price THEN 'paid' WHEN status IN (401, 403, 451) THEN 'blocked' WHEN status = 429 OR status >= 500 THEN 'inconclusive'
  WHEN status BETWEEN 200 AND 299 AND length(baseline) >= 200 AND length(body) < 0.2 * length(baseline) AND regexp_matches(body, {quoted(aeo.DENIED)}) THEN 'divergent-2xx'
  WHEN status BETWEEN 200 AND 299 THEN 'ok' ELSE 'inconclusive' END AS outcome FROM f)
SELECT site, http_status, outcome, CASE outcome WHEN 'ok' THEN 'pass' WHEN 'paid' THEN 'warn' WHEN 'inconclusive' THEN 'unknown' ELSE 'fail' END AS status FROM o""",
    "gate_exit_code": f"WITH {SCANS_SQL} SELECT CASE WHEN count(*) FILTER (tier = 'Heavy' OR score > 90) > 0 THEN 1 ELSE 0 END AS exit_code, count(*) FILTER (tier = 'Heavy' OR score > 90) AS failed, 0::BIGINT AS unscored FROM scans",
}
