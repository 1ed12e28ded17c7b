"""Rules and scores on literal cases: each rule fires on its case and stays silent on the others that it should."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog, color
from tessera.functions.spans import View
from tessera.functions.text import TOKEN, compatibility, fnv1a, normalised, words
from tessera.operators import corpus, report
from tessera.operators.copyrules import context, evidence
from tessera.plans.registry import queries
from tests.conftest import SMALL

#: What every implementation of the scores must agree on: page, score, tier, flagged, scored, adjustments.
VECTORS = {
    "clean-editorial": (0, "Clean", 0, 0, ""), "pioneer-inter-alone": (0, "Clean", 1, 1, "slop_fonts_co_signal"), "pioneer-purple-alone": (0, "Clean", 1, 1, "purple_accent_co_signal"),
    "mild-corroborated-hero-cap": (12, "Mild", 3, 3, "slop_fonts_centered_hero_cap"), "heavy-convergent-cluster": (31, "Heavy", 5, 5, ""),
    "k04-weight-zero-review-rule": (4, "Clean", 2, 1, ""), "fix19-overlapping-dom-dedup": (6, "Clean", 2, 2, "overlapping_evidence_dedup"), "s03-design-md-token-waiver": (12, "Mild", 2, 2, ""),
}
COPY = {
    "clean": ("", 0), "thin": ("", 0), "german": ("", 0), "buzzwords": ("buzzword_density", 7), "buzzword_chain": ("buzzword_density", 7), "em_dash_alone": ("em_dash_overload", 0),
    "em_dash_joined": ("em_dash_overload,filler_openers", 7), "one_em_dash": ("", 0), "antithesis": ("antithesis_construction", 6), "filler": ("filler_openers", 5), "closer": ("formulaic_closers", 4),
    "closer_comma": ("", 0), "half_weight": ("formulaic_closers", 2), "three": ("rule_of_three", 0), "whether": ("whether_youre", 3), "emoji_bullets": ("emoji_bullet_headers", 3),
    "emoji_ratio": ("emoji_heading_ratio", 0), "math_bold": ("fake_bold_math_alnum", 4), "invisible": ("invisible_characters", 0), "tags": ("hidden_tag_characters", 0), "flag": ("", 0),
    "markup": ("chatbot_markup_leak", 0), "residue": ("chatbot_reply_residue", 0), "utm": ("ai_referral_utm_links", 0), "grok": ("ai_referral_utm_links", 0), "placeholder": ("unfilled_placeholders", 0),
    "placeholder_generic": ("unfilled_placeholders", 0), "markdown": ("leaked_markdown", 0), "avatars": ("structural_fake_social_proof", 0), "no_no_just": ("bare_antithesis,context_leak_copy", 0),
    "announced": ("announced_structure", 0), "restated": ("restated_thesis_closer", 0), "browser": ("context_leak_copy", 0), "participial": ("trailing_participial_clauses", 0),
    "homoglyph": ("buzzword_density", 7), "empty": ("", 0),
}


def run(spark, name):
    return queries()[name](spark, SMALL).collect()


def test_catalogue(spark):
    assert [len(x) for x in (catalog.COPY_RULES, catalog.DESIGN_RULES, catalog.CRAFT_RULES, catalog.AEO_RULES, catalog.SYSTEM_RULES, catalog.BOTS, catalog.BUZZWORDS)] == [26, 45, 11, 16, 9, 39, 59]
    assert len(catalog.CONFUSABLES[0]) == len(catalog.CONFUSABLES[1]) and sum(w for _, w, _ in catalog.AEO_RULES) == 100


def test_copy_cases(spark):
    assert {r["case_id"]: (r["flags"], r["score"]) for r in run(spark, "copy_cases")} == COPY


def test_vectors(spark):
    assert {r["page_id"]: (r["score"], r["tier"], r["flagged"], r["scored"], r["adjustments"]) for r in run(spark, "design_score_vectors")} == VECTORS


def test_waiver(spark):
    by = {r["page_id"]: r for r in run(spark, "waiver_rescore")}
    assert tuple(by["s03-design-md-token-waiver"])[1:] == (12, "Mild", 4, "Clean")


def test_element_rules(spark):
    fired: dict[str, set] = {}
    for name in ("element_rules", "element_groups"):
        for r in run(spark, name):
            fired.setdefault(r["page_id"], set()).update(k for k, v in r.asDict().items() if v is True)
    elsewhere = {"chip_rainbow", "collisions", "eyebrow_label", "hero_eyebrow_pill", "nested_cards", "outline_purple", "plain", "hero_accent_word", "neobrutalist_hard_shadow", "unbranded_chat_bubble", "template_page_order"}
    for page, rules in fired.items():
        assert rules == (set() if page in elsewhere else {page} | ({"slop_fonts"} if page == "centered_hero" else set())), page
    assert [r["page_id"] for r in run(spark, "element_eyebrows") if r["triggered"]] == ["eyebrow_label"]
    assert [r["page_id"] for r in run(spark, "element_pills")] == ["hero_eyebrow_pill"]
    assert {r["page_id"]: r["nested"] for r in run(spark, "element_nested_cards") if r["nested"]} == {"nested_cards": 3}
    assert {r["page_id"]: r["collisions"] for r in run(spark, "element_collisions")}["collisions"] == 1
    assert [tuple(r) for r in run(spark, "element_chips")] == [("chip_rainbow", 6, 5, True)]


def test_robots(spark):
    got = {(r["site"], r["path"], r["bot"]): r["allowed"] for r in run(spark, "robots_match")}
    assert not got["tie", "/a.php.bak.php", "Googlebot"] and not got["tie", "/a.php.bak.php", "Applebot"]
    assert got["tie", "/a", "Googlebot"] and not got["tie", "/~me/x", "bingbot"] and got["tie", "/~me/x", "GPTBot"]
    assert not got["blocked", "/", "Googlebot"] and got["blocked", "/", "CCBot"] and got["good", "/private/open", "GPTBot"] and not got["good", "/private/x", "GPTBot"]
    assert got["soft", "/", "Googlebot"] and got["empty", "/", "Googlebot"]


def test_crawler_checks(spark):
    assert {r["site"]: r["outcome"] for r in run(spark, "edge_access")} | {"good": "ok"} == {
        "good": "ok", "tie": "ok", "blocked": "ok", "soft": "ok", "empty": "ok", "divergent": "divergent-2xx", "captcha": "captcha", "paid": "paid", "busy": "inconclusive",
        "moment": "challenge", "forbidden": "blocked", "waf": "challenge",
    }
    p = {r["site"]: r for r in run(spark, "preview_directives")}
    assert (p["snippet"]["google"], p["snippet"]["bing"], p["scoped"]["google"], p["scoped"]["bing"], p["hidden"]["google"]) == ("warn", "pass", "pass", "fail", "warn")
    s = {r["site"]: (r["score"], r["tier"]) for r in run(spark, "aeo_score")}
    assert s["good"] == (100, "Eligible") and s["blocked"] == (80, "Eligible") and s["busy"] == (61, "Partially Eligible")


def test_design_system(spark):
    values = {r["path"]: r["value"] for r in run(spark, "tokens_resolved")}
    assert values["colors.link"] == "#7c3aed" and values["colors.loop"] is None
    assert {(r["path"], r["kind"]) for r in run(spark, "tokens_diff")} == {("colors.primary", "changed"), ("rounded.lg", "added"), ("spacing.m", "removed")}
    assert {r["colour"]: r["verdict"] for r in run(spark, "palette_nearest")} == {"rgb(124, 58, 237)": "match", "#7d3cee": "match", "#131313": "match", "#ff0000": "off", "not a colour": None}
    assert {r["site"]: r["status"] for r in run(spark, "contrast_pairs")} == {"a": "review", "b": "pass", "c": "unknown", "d": "unknown"}
    assert {r["site"]: (r["score"], r["tier"]) for r in run(spark, "system_score")} == {"mill": (0.545, "Drifting"), "none": (1.0, "Aligned")}


def test_small_functions(spark):
    one = spark.createDataFrame([("ab", "ﬁ𝐁​x   а…",)], "a string, t string")
    r = one.select(fnv1a(F.col("a")).alias("h"), normalised(F.col("t")).alias("n"), color.oklab(color.parse(F.lit("#ffffff"))).alias("w")).first()
    assert r["h"] == 1294271946 and r["n"] == "fiBx a..." and abs(r["w"]["L"] - 1) < 1e-6
    assert len(compatibility()[0]) == len(compatibility()[1])
    assert corpus.clopper_pearson(0, 10) == (0.0, 0.3085) and corpus.clopper_pearson(5, 10) == (0.1871, 0.8129)
    assert math.isclose(corpus.beta_share(2, 3, 0.5), 0.6875)


def test_reports(spark):
    rows = spark.createDataFrame([("p", "https://a/?x=1&y=2", "r1", "fail", 7, True, 7, "Clean"), ("p", "https://a/?x=1&y=2", "r2", "review", 0, True, 7, "Clean"), ("q", "u", "r1", "pass", 7, False, None, None)],
                                 "page_id string, url string, rule_id string, status string, weight int, triggered boolean, score int, tier string")
    assert {r["line"].split(" ")[0] for r in report.github(rows).collect()} == {"::error", "::warning"}
    junit = {r["page_id"]: r["junit"] for r in report.junit(rows).collect()}
    assert "x=1&amp;y=2" in junit["p"] and 'failures="1" skipped="1"' in junit["p"] and 'failures="0"' in junit["q"]
    assert tuple(report.exit_code(rows.select("page_id", "score", "tier").distinct(), fail_over=5).first()) == (2, 1, 1)
    assert report.sarif(rows).count() == 1 and "r1,r2" in [r["line"] for r in report.agent(rows).collect() if r["line"].startswith("https")][0]


def test_scores_are_in_range(spark):
    rows = run(spark, "copy_score")
    assert rows and all(0 <= r["score"] <= 100 for r in rows)


def test_multi_page_scores(spark):
    for r in run(spark, "site_multipage"):
        assert (r["status"] == "ok") == (r["qualifying_pages"] >= 5) == (r["score"] is not None)
        assert r["score"] is None or r["p10"] <= r["p50"] <= r["p90"]


@pytest.mark.parametrize(("stream", "batch", "keys"), [("stream_watch", "watch_alerts", ["domain", "scan_id"])])
def test_streams_agree_with_batches(spark, stream, batch, keys):
    got = {tuple(r[k] for k in keys) for r in run(spark, stream)}
    assert got == {tuple(r[k] for k in keys) for r in run(spark, batch)}


def test_typicality(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = {}
    for k, r in enumerate(rows):
        d = np.sort(np.delete(np.sqrt(((z - z[k]) ** 2).sum(1)), k))[:25]
        want[r["vec_id"]] = d.mean()
    got = {r["vec_id"]: r["distance"] for r in run(spark, "knn_typicality")}
    assert all(abs(got[k] - v) < 2e-3 for k, v in want.items())
    near, ids = np.array(list(got.values())), list(got)
    ranks = {r["vec_id"]: (r["percentile"], r["atypicality"]) for r in run(spark, "knn_typicality")}
    assert all(ranks[i] == (int(100 * (near >= v).mean() + 0.5), int(100 * (near <= v).mean() + 0.5)) for i, v in zip(ids, near))


def test_typicality_over_many_blocks(spark):
    from tessera.operators.corpus import typicality

    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    whole, dealt = ({r["vec_id"]: r["distance"] for r in typicality(vectors, vectors, block=n).collect()} for n in (8192, 37))
    assert whole == dealt and len(whole) == vectors.count()
    odd = spark.createDataFrame([(-1, None), (-2, [1.0])], vectors.schema)
    assert {r["vec_id"]: r["distance"] for r in typicality(vectors.union(odd.limit(1)), vectors.limit(3), block=50).collect()}.items() <= whole.items()
    assert typicality(vectors.limit(1), vectors).count() == 0 and typicality(vectors.limit(0), vectors).count() == 0



def test_probes(spark):
    assert {r["page_id"]: r["triggered"] for r in run(spark, "craft_focus")} == {"seen": False, "lost": True, "late": False, "ring": False}
    assert {r["page_id"]: r["triggered"] for r in run(spark, "craft_ctas")} == {"fine": False, "hero": True, "many": True, "acts": False}
    assert {r["page_id"]: r["status"] for r in run(spark, "craft_forms")} == {"none": "na", "unprobed": "unknown", "told": "pass", "silent": "fail"}


def test_watch_list(spark):
    hit = lambda name, rule: [r["page_id"] for r in run(spark, name) if r[rule]]
    assert hit("watch_looks", "neobrutalist_hard_shadow") == ["neobrutalist_hard_shadow"] and hit("watch_looks", "unbranded_chat_bubble") == ["unbranded_chat_bubble"]
    assert hit("page_looks", "template_page_order") == ["template_page_order"]
    assert [r["page_id"] for r in run(spark, "accent_words")] == ["hero_accent_word"]


def test_spearman_counts_ties_as_ranks_of_rows(spark):
    import pandas as pd

    from tessera.operators.corpus import spearman

    rows = [(k % 7, (k * k) % 11) for k in range(60)] + [(None, 1), (2, None)]
    frame = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    got = spearman(spark.createDataFrame(rows, "a long, b long"), "a", "b").first()
    assert got["n"] == 60 and abs(got["rho"] - frame["a"].rank().corr(frame["b"].rank())) < 1e-4
    none = spearman(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), "a", "b").first()
    assert (none["n"], none["rho"]) == (2, None)


def test_a_response_is_read_whole(spark):
    from tessera.operators import aeo

    rows = [
        ("s", "html", "http://s/", 200, {"content-type": "text/html"}, "<html><body>" + "short words here " * 80 + "</body></html>", None, 100),
        ("s", "html", "http://s/", 503, {"x-robots-tag": "noindex"}, "zzz" * 1000, None, 0),
    ]
    fetches = spark.createDataFrame(rows, "site string, kind string, url string, status int, headers map<string,string>, body string, error string, rendered_words int")
    by = {r["check_id"]: r["status"] for r in aeo.checks(fetches).collect()}
    assert by["html.reachable"] == "pass"


def test_hues_near_red_are_one_cluster(spark):
    from tessera.operators import elements

    def chips(colours):
        return [
            (1, k, 0, k, "SPAN", "chip", f"rgb({r},{g},{b})") for k, (r, g, b) in enumerate(colours)
        ]

    def clusters(colours):
        e = spark.createDataFrame(chips(colours), "page_id string, node_id int, parent_id int, ord int, tag string, text string, bg string".replace("page_id string", "page_id int"))
        e = e.select(
            F.col("page_id").cast("string").alias("page_id"), "node_id", "parent_id", "ord", "tag", F.lit("").alias("id"), F.lit("").alias("class_name"), "text", F.col("text").alias("direct_text"), F.lit(None).cast("string").alias("href"),
            F.lit(None).cast("string").alias("role"), F.create_map().cast("map<string,string>").alias("attrs"),
            F.expr("struct(0d AS top, 0d AS left, 60d AS width, 24d AS height, 60d AS right, 24d AS bottom)").alias("rect"),
            F.create_map(F.lit("backgroundColor"), F.col("bg"), F.lit("borderRadius"), F.lit("12px")).alias("style"),
        )
        return elements.chip_hues(e).first()["clusters"]

    # two pinks and reds on both sides of hue 0, then four hues that are far apart
    assert clusters([(230, 60, 110), (230, 60, 90), (230, 60, 130)] * 2) == 1
    assert clusters([(220, 40, 40), (200, 180, 30), (40, 160, 60), (40, 80, 220), (220, 40, 40), (40, 80, 220)]) == 4


def test_held_out_rows_stop_a_fit(spark):
    from tessera.operators.corpus import held_out_guard

    rows = spark.createDataFrame([("a", "dev"), ("b", None)], "domain string, split string")
    assert held_out_guard(rows).count() == 2
    with pytest.raises(Exception, match="held-out domain"):
        held_out_guard(rows.union(spark.createDataFrame([("c", "held_out")], rows.schema))).collect()


def test_words_and_views_are_the_same_by_every_way(spark):
    """Counting by first letters against counting matches, and letters left alone against all of them looked up."""
    rng = random.Random(3)
    letters = ["a", "B", ".", "\u00e4", "\u00aa", "\u0132", "\u00a0", "\u00ad", "\u2003", "\u3000", "\ufeff", "\u202f", "\u0430", "\U0001d400", "\ufb01", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85"]
    texts = ["", " ", "\n a", "a ", "\u00a0a"] + ["".join(rng.choices(letters[: rng.choice([3, 5, 8, 23])] + letters[15:17], k=rng.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", words(F.col("text")).alias("n"), F.regexp_count("text", F.lit(TOKEN)).alias("m"), normalised(F.col("text")).alias("v")).collect()
    assert [r["n"] for r in got] == [r["m"] for r in got]
    assert [r["v"] for r in got] == [View(t).text for t in texts]


def test_counting_words_makes_no_list_of_them(spark):
    """A regular expression's matches are values of their own: for words that was most of a score's time."""
    plan = spark.createDataFrame([("a b",)], "text string").select(words(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_buzzwords_are_found_as_one_by_one(spark):
    text = " ".join(catalog.BUZZWORDS) + " " + " ".join(w + "x -" + w for w in catalog.BUZZWORDS) + " delve delve delve"
    got = evidence(context(spark.createDataFrame([(text,)], "text string")), ["buzzword_density"]).first()["buzzword_density"]
    assert (got["total"], got["distinct"]) == (len(catalog.BUZZWORDS) + 2, len(catalog.BUZZWORDS))
