"""Design and craft rules over a captured table of elements, one row per visible element of a page.

Columns: page_id, node_id, parent_id, ord, tag, class_name, text, href, role, rect (struct of
top, left, width, height in pixels) and style (map of computed CSS values). Rules that judge
elements one by one are counted together in a single aggregate; those that compare elements
of a page join or group within the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.color import chroma, contrast, hue, is_cream, is_purple, luminance, oklab, parse, spread

FOLD = 900


def style(name: str) -> Column:
    return F.coalesce(F.element_at("style", name), F.lit(""))


def px(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(regexp_extract(style['{name}'], '^(-?[0-9.]+)', 1) AS double)"), F.lit(0.0))


def visible(e: DataFrame) -> DataFrame:
    """Elements a reader can see."""
    shown = (style("display") != "none") & (style("visibility") != "hidden") & (style("opacity") != "0")
    return e.where(shown & (F.col("rect.width") >= 4) & (F.col("rect.height") >= 4))


def facts(e: DataFrame) -> DataFrame:
    """Elements with the numbers and colours that rules read, each computed once."""
    family = F.trim(F.regexp_replace(F.lower(F.split(style("fontFamily"), ",")[0]), "[\"']", ""))
    text = F.trim(F.coalesce("text", F.lit("")))
    out = e.withColumns({
        "tag": F.upper("tag"), "family": family, "size": px("fontSize"), "bg": parse(style("backgroundColor")), "fg": parse(style("color")), "text": text,
        "n_words": F.regexp_count(text, F.lit(r"\S+")), "gradient": style("backgroundImage").contains("gradient"), "radius": px("borderRadius"),
        "width": F.col("rect.width"), "height": F.col("rect.height"), "top": F.col("rect.top"), "left": F.col("rect.left"), "class_name": F.lower(F.coalesce("class_name", F.lit(""))),
    })
    slop = F.exists(F.array(*[F.lit(p) for p in catalog.SLOP_FONTS]), lambda p: F.startswith(F.col("family"), p))
    hero = F.col("top").between(-100, FOLD)
    tracking = px("letterSpacing") / F.greatest(F.col("size"), F.lit(1.0))
    return out.withColumns({"slop_font": slop, "in_hero": hero, "tracking": tracking, "heading": F.col("tag").isin("H1", "H2", "H3"), "control": F.col("tag").isin("A", "BUTTON")})


def _border(side: str) -> Column:
    return px(f"border{side}Width")


def _stripe(least: float) -> Column:
    widths = {s: _border(s) for s in ("Top", "Right", "Bottom", "Left")}
    def wide(side: str) -> Column:
        rest = F.greatest(*[w for s, w in widths.items() if s != side])
        return (widths[side] >= least) & (widths[side] > rest + 1)
    return (F.col("width") >= 100) & (F.col("height") >= 60) & (wide("Top") | wide("Left"))


def _shadow_blur() -> Column:
    sizes = F.regexp_extract_all(style("boxShadow"), F.lit(r"(-?[0-9.]+)px"), F.lit(1))
    return F.coalesce(F.get(sizes, F.lit(2)).cast("double"), F.lit(0.0))


def _shadow_colour() -> Column:
    return parse(F.regexp_extract(style("boxShadow"), r"(rgba?\([^)]*\)|#[0-9a-fA-F]{3,8})", 1))


def single_rules() -> dict[str, tuple[Column, int]]:
    """Rules that count elements of a kind: the test of an element, and how many it takes."""
    text_len, c = F.length("text"), F.col
    fill = c("bg").isNotNull() & (c("bg.a") >= 0.5)
    cta = c("control") | c("class_name").rlike("btn|button|cta")
    glow = _shadow_colour()
    sparkle = F.lit(r"[\x{2728}\x{2B50}\x{1F4AB}\x{1F31F}]")
    return {
        "purple_accent": (cta & ~c("class_name").rlike("outline|ghost") & fill & is_purple(c("bg")), 1),
        "gradient_text": ((style("backgroundClip") == "text") & c("gradient"), 1),
        "accent_stripe": (_stripe(3), 2),
        "accent_stripe_2026": ((px("borderTopWidth") == 2) & (_border("Bottom") < 1) | ((_border("Bottom") >= 2) & (c("radius") > 0) & (_border("Top") < 1)), 2),
        "glassmorphism": (style("backdropFilter").contains("blur") & c("bg").isNotNull() & (c("bg.a") < 0.8), 2),
        "colored_glows": ((_shadow_blur() >= 24) & (glow["a"] > 0.2) & (is_purple(glow) | (spread(glow) > 60)), 1),
        "centered_hero": ((c("tag") == "H1") & (style("textAlign") == "center") & (c("size") >= 28) & c("slop_font"), 1),
        "faq_accordion": ((c("tag") == "DETAILS"), 3),
        "gradient_letter_avatars": (c("width").between(28, 96) & (F.abs(c("width") - c("height")) <= 4) & (c("radius") >= c("width") / 3) & (c("gradient") | fill) & c("text").rlike("^[A-Za-z]{1,3}$"), 2),
        "aurora_mesh_gradient": (c("gradient") & (c("width") >= 200) & (c("height") >= 200) & (F.regexp_extract(style("filter"), r"blur\(([0-9.]+)px\)", 1).try_cast("double") >= 24), 2),
        "ai_sparkle_badges": ((F.regexp_count("text", sparkle) > 0) & (text_len <= 40), 1),
        "crushed_tracking": ((c("size") >= 28) & text_len.between(3, 80) & (c("tracking") <= -0.05), 1),
        "oversized_hero_h1": ((c("tag") == "H1") & (c("size") >= 72) & (text_len >= 40), 1),
        "pulsing_status_badge": ((style("animationIterationCount") == "infinite") & c("n_words").between(1, 4) & c("text").rlike("(?i)live|online|operational|new|beta|available|status"), 1),
        "display_mono_heading": (c("tag").isin("H1", "H2") & (c("size") >= 24) & c("family").rlike("mono|courier|consolas|menlo"), 1),
        "cursor_spotlight_gradient": (style("cssText").rlike(r"--(?:mouse|cursor|x|y)-?(?:x|y)?\b"), 1),
        "infinite_marquee_ticker": ((style("animationIterationCount") == "infinite") & (style("animationTimingFunction") == "linear") & (c("n_words") >= 4)
            & (F.size(F.array_distinct(F.split("text", r"\s+"))) <= F.ceil(c("n_words") / 2)), 1),
        "wide_body_tracking": ((text_len >= 60) & (c("size") <= 22) & (c("tracking") > 0.05), 2),
        "gray_on_color": (c("text").rlike(r"\S") & (spread(c("fg")) < 25) & (luminance(c("fg")).between(0.05, 0.6)) & (spread(c("bg")) >= 30), 3),
        "content_stuck_hidden": ((c("n_words") >= 3) & (F.coalesce(F.expr("try_cast(style['opacity'] AS double)"), F.lit(1.0)) <= 0.01) & c("in_hero"), 1),
        "reduced_motion_ignored": ((style("animationPlayState") == "running") & (style("prefersReducedMotion") == "reduce"), 1),
    }


def counted_rules(e: DataFrame) -> DataFrame:
    """page_id and, of each rule that counts elements, hits and triggered; with the page-wide shares in the same aggregate."""
    rows = facts(e)
    rules = single_rules()
    rows = rows.withColumns({f"_{k}": F.coalesce(test, F.lit(False)) for k, (test, _) in rules.items()})
    written = F.col("text").rlike(r"\S")
    sizes = F.when(written & F.col("size").between(8, 199), F.round("size"))
    checked = (F.length("text") >= 20) & (F.col("size") < 24) & F.col("fg").isNotNull() & F.col("bg").isNotNull() & (spread(F.col("fg")) < 40)
    area = lambda: F.greatest(F.col("width"), F.lit(0)) * F.greatest(F.col("height"), F.lit(0))
    rows = rows.withColumns({"_checked": checked, "_fails": checked & (contrast(F.col("fg"), F.col("bg")) < 4.5)})
    out = rows.groupBy("page_id").agg(
        *[F.count_if(f"_{k}").alias(f"{k}_hits") for k in rules],
        F.avg(F.when(written, F.col("slop_font").cast("int"))).alias("slop_share"),
        F.max(F.when((F.col("tag") == "H1") & F.col("in_hero"), F.col("slop_font"))).alias("slop_hero"),
        F.count_distinct(sizes).alias("sizes"), (F.max(sizes) / F.min(sizes)).alias("size_range"),
        F.count_if("_checked").alias("contrast_checked"), F.count_if("_fails").alias("contrast_fails"),
        F.max_by("bg", F.when(F.col("tag").isin("BODY", "HTML", "MAIN") & F.col("bg").isNotNull(), area())).alias("surface"),
        F.count_if(written & (spread(F.col("fg")) < 30) & luminance(F.col("fg")).between(0.1, 0.6)).alias("grey_texts"), F.count_if(written).alias("texts"),
        F.sum(F.when(F.col("gradient"), area()).otherwise(0)).alias("gradient_area"), F.max(area()).alias("largest"),
        F.count_distinct(F.when(F.col("gradient"), F.col("parent_id"))).alias("gradient_sections"),
        F.max(F.when(F.col("tag") == "H1", oklab(F.col("fg"))["L"])).alias("h1_lightness"),
    )
    checks, fails = F.col("contrast_checked"), F.col("contrast_fails")
    more = {
        "slop_fonts": F.coalesce("slop_hero", F.lit(False)) | (F.coalesce("slop_share", F.lit(0.0)) >= 0.6),
        "flat_type_hierarchy": (F.col("sizes") >= 3) & (F.col("size_range") < 2),
        "low_contrast_text": (checks >= 4) & (fails >= 4) & (fails >= 0.25 * checks),
        "cream_default_bg": is_cream(F.col("surface")),
        "perma_dark_mode": (luminance(F.col("surface")) < 0.05) & ((F.col("grey_texts") >= 5) | (F.col("grey_texts") >= 0.3 * F.col("texts"))),
        "gradient_backgrounds": (F.col("gradient_area") >= 0.15 * F.col("largest")) & (F.col("gradient_sections") >= 2),
    }
    flags = {**{k: F.col(f"{k}_hits") >= least for k, (_, least) in rules.items()}, **{k: F.coalesce(v, F.lit(False)) for k, v in more.items()}}
    return out.select("page_id", *[F.col(f"{k}_hits") for k in rules], *[v.alias(k) for k, v in flags.items()])


def _most(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The largest group of each page."""
    return rows.groupBy("page_id", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.max("n").alias(name))


def grouped_rules(e: DataFrame) -> DataFrame:
    """page_id and the rules that look at siblings: card grids, bento grids, hovers, sections, terminals, logos, steps, banners, fades."""
    rows = facts(e)
    cards = rows.where((F.col("width").between(150, 600)) & F.col("height").between(100, 600) & (F.coalesce(F.element_at("style", "icon"), F.lit("")) != ""))
    grid = _most(cards.withColumn("bucket", F.round(F.col("width") / 20)), ["parent_id", "bucket"], "cards")
    hover = rows.where((F.col("width") >= 150) & (F.col("height") >= 80) & (style("transitionDuration") != "") & (style("transitionDuration") != "0s"))
    hover = _most(hover.withColumns({"p": style("transitionProperty"), "d": style("transitionDuration"), "t": style("transitionTimingFunction")}), ["p", "d", "t"], "hovers")
    section = rows.where("tag = 'SECTION'").withColumn("signature", F.concat_ws(":", style("display"), style("gridTemplateColumns")))
    shape = section.groupBy("page_id", "signature").agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.max("n").alias("alike"), F.sum("n").alias("sections"))
    dots = rows.where(F.col("width").between(6, 16) & (F.abs(F.col("width") - F.col("height")) <= 1) & (F.col("radius") >= F.col("width") / 2))
    terminal = _most(dots, ["parent_id"], "dots")
    logos = rows.where("tag = 'IMG'").groupBy("page_id", "parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("d"))
    logos = logos.where(F.col("n").between(4, 12) & (F.col("d") < F.col("n"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("logo_rows"))
    number = F.regexp_extract("text", r"^0?([1-9])[.)]?\s", 1)
    steps = rows.where(number != "").groupBy("page_id", "parent_id").agg(F.collect_set(number).alias("s"), F.count(F.lit(1)).alias("n"))
    steps = steps.where((F.col("n") <= 6) & F.array_contains("s", "1") & F.array_contains("s", "2") & F.array_contains("s", "3")).groupBy("page_id").agg(F.count(F.lit(1)).alias("steps"))
    stats = rows.where(F.col("text").rlike(r"^[$€£]?[0-9][0-9.,]*\s*(?:[kKmMbB%+x]|\+)*$") & (F.col("size") >= 28) & (F.length("text") <= 12))
    near = F.count(F.lit(1)).over(W.partitionBy("page_id").orderBy((F.col("top") * 1000).cast("long")).rangeBetween(0, 79_999))
    stats = stats.withColumn("near", near).groupBy("page_id").agg(F.max("near").alias("stats"))
    fades = rows.where((F.expr("try_cast(style['opacity'] AS double)") <= 0.01) & (F.col("top") > FOLD) & style("transform").rlike(r"translateY\((?:[89]|[1-5][0-9]|60)px\)"))
    fades = fades.groupBy("page_id").agg(F.count(F.lit(1)).alias("fades"), F.count_distinct("parent_id").alias("fade_sections"))
    bento = rows.where((F.col("radius") >= 12) & (style("gridColumn") != "")).groupBy("page_id", "parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(style("gridColumn")).alias("spans"))
    bento = bento.where((F.col("n") >= 5) & (F.col("spans") >= 2)).groupBy("page_id").agg(F.count(F.lit(1)).alias("bentos"))
    soft = rows.where((F.col("radius") > 0) & (F.col("width") >= 40))
    radii = soft.groupBy("page_id", "radius").agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.max_by(F.struct("radius", "n"), "n").alias("top"), F.sum("n").alias("all"))
    out = rows.select("page_id").distinct()
    for part in (grid, hover, shape, terminal, logos, steps, stats, fades, bento, radii):
        out = out.join(part, "page_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "page_id", (n("cards") >= 3).alias("icon_card_grid"), (n("hovers") >= 4).alias("uniform_card_hover"),
        ((n("alike") >= 3) & (n("alike") >= 0.5 * n("sections"))).alias("section_template_repetition"), (n("dots") >= 3).alias("fake_macos_terminal"),
        (n("logo_rows") >= 1).alias("fake_logo_bar"), (n("steps") >= 1).alias("numbered_steps"), (n("stats") >= 3).alias("stat_banner"),
        ((n("fades") >= 6) & (n("fade_sections") >= 3)).alias("fade_up_monoculture"), (n("bentos") >= 1).alias("bento_grid"),
        ((n("all") >= 8) & (F.coalesce("top.radius", F.lit(0.0)) >= 12) & (F.coalesce("top.n", F.lit(0)) >= 0.8 * n("all"))).alias("uniform_radius_shadow"),
    )


def eyebrows(e: DataFrame) -> DataFrame:
    """page_id, headings, labelled, triggered: headings with a small tracked or upper-case label up to 48 pixels above.

    Headings and labels of a page meet through buckets of 64 pixels, not in all pairs.
    """
    rows = facts(e)
    bucket = lambda y: F.floor(y / 64)
    heads = rows.where("tag IN ('H2', 'H3')").select("page_id", F.col("node_id").alias("head"), F.col("top").alias("y"))
    heads = heads.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("y") - 48), bucket(F.col("y") + 8)))))
    small = (F.col("size") <= 14) & F.col("n_words").between(1, 6) & ((style("textTransform") == "uppercase") | (F.col("tracking") >= 0.04))
    labels = rows.where(small & ~F.col("heading")).select("page_id", (F.col("top") + F.col("height")).alias("bottom")).withColumn("bucket", bucket(F.col("bottom")))
    hit = heads.join(labels, ["page_id", "bucket"]).where(F.col("bottom").between(F.col("y") - 48, F.col("y") + 8)).select("page_id", "head").distinct()
    total = rows.where("tag IN ('H2', 'H3')").groupBy("page_id").agg(F.count(F.lit(1)).alias("headings"))
    out = total.join(hit.groupBy("page_id").agg(F.count(F.lit(1)).alias("labelled")), "page_id", "left").na.fill(0, ["labelled"])
    return out.withColumn("triggered", F.col("labelled") >= 0.6 * F.col("headings"))


def hero_pills(e: DataFrame) -> DataFrame:
    """page_id and the text of a pill up to 250 pixels above the first heading."""
    rows = facts(e)
    h1 = rows.where("tag = 'H1'").groupBy("page_id").agg(F.min("top").alias("h1_top"))
    pill = rows.where(F.col("width").between(40, 500) & (F.col("height") <= 80) & (F.col("radius") >= F.col("height") / 3) & F.length("text").between(2, 80))
    hit = pill.join(h1, "page_id").where((F.col("top") < F.col("h1_top")) & (F.col("top") >= F.col("h1_top") - 250))
    hit = hit.where(F.col("text").rlike(r"(?i)\b(?:new|introducing|now|beta|launch|announc|powered|backed|v[0-9])|[\x{1F300}-\x{1FAFF}\x{2728}]"))
    return hit.groupBy("page_id").agg(F.min_by("text", "ord").alias("pill"))


def nested_cards(e: DataFrame, depth: int = 30) -> DataFrame:
    """page_id and how many innermost cards stand inside another card. Ancestors are walked up level by level."""
    rows = facts(e).where("parent_id IS NOT NULL OR tag = 'BODY'")
    card = (F.col("radius") >= 8) & (F.col("width") >= 120) & (F.col("height") >= 60) & ((_border("Top") > 0) | (style("boxShadow") != "") & (style("boxShadow") != "none"))
    nodes = rows.select("page_id", "node_id", "parent_id", card.alias("card"))
    up = nodes.select("page_id", F.col("node_id").alias("at"), F.col("parent_id").alias("next"), F.col("card").alias("at_card"))
    walk = nodes.where("card").select("page_id", "node_id", F.col("parent_id").alias("at"))
    found = None
    for _ in range(depth):
        step = walk.join(up, ["page_id", "at"]).persist()
        if step.isEmpty():
            break
        hit = step.where("at_card").select("page_id", "node_id", F.col("at").alias("outer"))
        found = hit if found is None else found.unionByName(hit)
        walk = step.where("NOT at_card AND next IS NOT NULL").select("page_id", "node_id", F.col("next").alias("at"))
    if found is None:
        return nodes.groupBy("page_id").agg(F.lit(0).cast("long").alias("nested"))
    inner = found.select("page_id", "node_id").distinct().join(found.select("page_id", F.col("outer").alias("node_id")).distinct(), ["page_id", "node_id"], "left_anti")
    return nodes.select("page_id").distinct().join(inner.groupBy("page_id").agg(F.count(F.lit(1)).alias("nested")), "page_id", "left").na.fill(0)


def collisions(e: DataFrame) -> DataFrame:
    """page_id and pairs of text boxes that overlap by over 2 pixels each way and 4 square pixels, found in cells of 256 pixels."""
    boxes = visible(e).where(F.length(F.trim("text")) > 0).select(
        "page_id", "node_id", F.col("rect.left").alias("x0"), F.col("rect.top").alias("y0"),
        (F.col("rect.left") + F.col("rect.width")).alias("x1"), (F.col("rect.top") + F.col("rect.height")).alias("y1"),
    )
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / 256), F.floor(F.col(b) / 256))
    spread_out = boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    other = spread_out.select("page_id", "cx", "cy", *[F.col(c).alias(f"{c}_") for c in ("node_id", "x0", "y0", "x1", "y1")])
    both = spread_out.join(other, ["page_id", "cx", "cy"]).where("node_id < node_id_")
    w, h = F.least("x1", "x1_") - F.greatest("x0", "x0_"), F.least("y1", "y1_") - F.greatest("y0", "y0_")
    return both.where((w > 2) & (h > 2) & (w * h > 4)).select("page_id", "node_id", "node_id_").distinct().groupBy("page_id").agg(F.count(F.lit(1)).alias("collisions"))


def chip_hues(e: DataFrame) -> DataFrame:
    """page_id, chips and hue clusters: in page order, a hue over 30 degrees around the circle from all clusters' first hues starts one."""
    small = F.col("height").between(16, 40) & F.col("width").between(30, 220) & F.col("n_words").between(1, 3)
    chip = facts(e).where(small & (F.col("radius") >= 4) & ~F.col("tag").isin("NAV", "HEADER", "FOOTER", "UL", "OL") & (chroma(oklab(F.col("bg"))) >= 0.04))
    seen = F.array_sort(F.collect_list(F.struct("ord", hue(oklab(F.col("bg"))).alias("hue"))))
    hues = chip.groupBy("page_id").agg(F.count(F.lit(1)).alias("chips"), F.transform(seen, lambda x: x["hue"]).alias("h"))
    apart = lambda a, b: F.least(F.abs(a - b) % 360, 360 - F.abs(a - b) % 360) > 30
    starts = F.aggregate("h", F.array().cast("array<double>"), lambda found, x: F.when(F.forall(found, lambda c: apart(c, x)), F.concat(found, F.array(x))).otherwise(found))
    return hues.select("page_id", "chips", F.size(starts).alias("clusters")).withColumn("triggered", (F.col("chips") >= 6) & (F.col("clusters") >= 4))


def craft_score(checks: DataFrame) -> DataFrame:
    """checks(page_id, rule_id, status pass|fail|unknown|na): points earned of those that apply; 100 if none does."""
    dim = checks.sparkSession.createDataFrame(catalog.CRAFT_RULES, "rule_id string, weight int")
    rows = checks.join(F.broadcast(dim), "rule_id").withColumn("counts", F.col("status").isin("pass", "fail") & (F.col("weight") > 0))
    by = rows.groupBy("page_id").agg(
        F.sum(F.when(F.col("counts"), F.col("weight")).otherwise(0)).alias("applicable"), F.sum(F.when(F.col("counts") & (F.col("status") == "pass"), F.col("weight")).otherwise(0)).alias("earned"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
    return by.withColumn("score", F.when(F.col("applicable") > 0, F.floor(100 * F.col("earned") / F.col("applicable") + 0.5)).otherwise(100).cast("int"))
