"""Element trees, spans, quotations, addresses and running sums against plain code and stated cases."""

from __future__ import annotations


import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.functions.prefix import running
from tessera.functions.text import normalised
from tessera.operators import markup, ruleset, site
from tessera.sources import dom
from tessera.sources.html import page_links, resolve, scan_folder, sitemap_frontier

NODE = ("node", "parent", "tag", "depth", "start", "stop", "text_start", "text_stop", "attributes", "direct_text", "inside")


def tree(page: str) -> list[dict]:
    return [dict(zip(NODE, n)) for n in dom.parse(page)[0]]


class Plain(HTMLParser):
    """Tags, parents and texts of pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.text = [], [], []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, self.open[-1] if self.open else None, {k: v or "" for k, v in attrs}))
        if tag not in dom.VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.found.append((tag, self.open[-1] if self.open else None, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if self.open and self.found[self.open[-1]][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)


def page(rng: random.Random, depth: int = 0) -> str:
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.randrange(4)
        if kind == 0 or depth > 4:
            out.append(rng.choice(["text ", "a &amp; b", "&copy; x", " ", "1 < 2 "]))
        elif kind == 1:
            out.append(rng.choice(["<br>", '<img src="a>b.png">', "<!-- <div> -->", "<hr/>"]))
        else:
            tag = rng.choice(["div", "span", "b", "section", "em"])
            given = rng.choice(["", ' class="a b"', """ id='q' title="x > y\""""])
            out.append(f"<{tag}{given}>{page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_trees_of_closed_pages_are_those_of_another_parser():
    rng = random.Random(5)
    for _ in range(300):
        source = page(rng)
        plain = Plain()
        plain.feed(source.replace("1 < 2", "1 &lt; 2"))
        got = tree(source)
        assert [(n["tag"], n["parent"], {k: v for k, v in n["attributes"]}) for n in got] == plain.found
        assert dom.parse(source)[1].split() == " ".join(plain.text).split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "</li>", "<div>", "</div>", "<td>", "<tr>", "<table>", "</table>", "x", "<br>", "<", ">", "<script>", "</script>", "<!--", "-->"]), max_size=30).map("".join))
def test_intervals_nest_and_hold_what_is_inside(source):
    got = tree(source)
    for n in got:
        assert 0 <= n["start"] < n["stop"] <= len(source) and n["text_start"] <= n["text_stop"] <= len(dom.parse(source)[1]) + 1  # the blank after the last word
        inner = [m["node"] for m in got if n["start"] < m["start"] and m["stop"] <= n["stop"]]
        assert inner == list(range(n["node"] + 1, n["node"] + 1 + n["inside"]))
        if n["parent"] is not None:
            up = got[n["parent"]]
            assert up["start"] < n["start"] and n["stop"] <= up["stop"] and n["depth"] == up["depth"] + 1


def test_what_ends_what():
    tags = lambda s: [(n["tag"], n["parent"]) for n in tree(s)]
    assert tags("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<div>g</p>") == [("ul", None), ("li", 0), ("li", 0), ("ul", 2), ("li", 3), ("li", 0), ("p", None), ("p", None), ("div", None)]
    assert tags("<table><tr><td>a<td>b<tr><td>c</table>d") == [("table", None), ("tr", 0), ("td", 1), ("td", 1), ("tr", 0), ("td", 4)]
    assert tags('<script>var a = "<p>"</script><style>p > b {}</style><p>') == [("script", None), ("style", None), ("p", None)]
    assert tree("<div>a<b>c</b>d</div>")[0]["direct_text"] == "a d" and dom.parse("</p>x</div>") == ([], "x") and dom.parse("") == ([], "")


def test_references_end_with_a_semicolon():
    nodes, text = dom.parse('<a href="?a=1&copy=2&amp;b">R&amp;D &NBSP;&#8217;&eacute;&Eacute; and&amp to&#65 &unknown;</a>')
    assert text == "R&D \u2019\u00e9\u00c9 and&amp to&#65 &unknown;" and dict(nodes[0][8]) == {"href": "?a=1&copy=2&b"}


def test_a_batch_of_pages_is_unfolded_in_stretches():
    rng = random.Random(5)
    pages = [None, "", *[page(rng) for _ in range(50)], "<p>" * 3000, "", "no tags"]
    part = pa.array(pages, pa.string())
    few = list(dom._slices(part, 500))
    assert [x for f in few for x in f.to_pylist()] == pages and len(few) > 2
    assert all(len(f) == 1 or sum(len((x or "").encode()) for x in f.to_pylist()) <= 500 for f in few)
    got = [x for f in few for x in dom._trees(f).to_pylist()]
    assert [([tuple(n.values()) for n in g["nodes"]], g["page_text"]) for g in got] == [dom.parse(x or "") for x in pages]
    assert [len(f) for f in dom._slices(pa.array(["x" * 2_000_000] * 7))] == [2, 2, 2, 1]


def test_structure_rules_fire(spark):
    pages = {
        1: "<h2>Frequently asked questions</h2>", 2: "<ol><li>1. Sign up</li><li>2. Wait</li><li>03 Done</li></ol>", 3: "<div>" + "<img src='a.png'>" * 4 + "</div>", 4: "<span>✨ New</span>",
        5: "<div><div class='card'>a</div><div class='x-card-y'>b</div><div class='Tile'>c</div></div><a href='#'>x</a>", 6: "<h1>a</h1><details></details><details></details><details></details>", 7: None,
    }
    df = spark.createDataFrame([(k, "http://a/", v) for k, v in pages.items()], "page_id long, url string, html string")
    rules = ("faq_accordion", "numbered_steps", "fake_logo_bar", "ai_sparkle_badges", "card_row", "dead_links")
    got = {r["page_id"]: [c for c in rules if r[c]] for r in markup.structure(dom.elements(df)).collect()}
    assert got == {1: ["faq_accordion"], 2: ["numbered_steps"], 3: ["fake_logo_bar"], 4: ["ai_sparkle_badges"], 5: ["card_row", "dead_links"], 6: ["faq_accordion"]}
    styled = spark.createDataFrame([(1, "u", "<p style='color: red; Background-Color:#fff;color:blue'>x</p>")], "page_id long, url string, html string")
    assert {k: v for k, v in dom.elements(styled.withColumn("html", F.regexp_replace("html", "color:blue", "--x:1"))).first()["style"].items() if k in ("color", "backgroundColor")} == {"color": "red", "backgroundColor": "#fff"}


LETTERS = st.text(alphabet="aZ \t ​­аﬁＡ é", max_size=25)


@settings(max_examples=500, deadline=None)
@given(LETTERS)
def test_views_lead_back(text):
    view = spans.View(text)
    places = [view.letter(k) for k in range(len(view.text))]
    assert all(0 <= a < b <= len(text) for a, b in places) and places == sorted(places)
    for k, (a, b) in enumerate(places):
        assert spans.View(text[a:b]).text in (view.text[k], spans.View(text[a:b]).text) and view.text[k] in spans.View(text[a:b]).text


def test_views_are_the_normalised_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aZ \t ​­аﬁＡ \n") for _ in range(30)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalised(F.col("t")).alias("n")).collect()
    assert all(spans.View(r["t"]).text == r["n"] for r in got)


def test_samples_are_as_written():
    text = "We  de​lve  into Delve; DELVE and dеlve, ﬁnal delve."
    rule, n, shown, at = spans.found(text, {"delve": re.compile("delve( +into)?", re.I | re.A), "final": re.compile("final"), "none": re.compile("zzz")})[0]
    assert (rule, n) == ("delve", 5) and shown == ["de​lve  into", "Delve", "dеlve"] and [text[a:b] for a, b in at] == shown
    assert spans.found(text, {"final": re.compile("final")})[0][2] == ["ﬁnal"]
    assert spans.found("", {"x": re.compile("x")}) == []


def test_quotations():
    cut = lambda t: "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in spans.quoted_in(t)))
    assert cut("a “b “c” d” e") == "a  e" and cut("a “b\nc” d") == "a \nc” d"
    assert cut('x "y" z "open\nnext') == "x  z \nnext" and cut("> said\nme\n  >> more") == "\nme\n" and cut("” a") == "” a"


def test_merged_and_without(spark):
    rows = [("0123456789", [(2, 4), (3, 6), (6, 7), (9, 9), (8, 9)]), ("abc", []), ("abc", None), ("abc", [(0, 3)]), ("", [])]
    df = spark.createDataFrame(rows, "t string, s array<struct<start: int, stop: int>>")
    got = df.select(spans.merged(F.col("s")).alias("m"), spans.without(F.col("t"), F.col("s")).alias("w")).collect()
    assert [[tuple(x) for x in r["m"]] for r in got] == [[(2, 7), (8, 9)], [], [], [(0, 3)], []]
    assert [r["w"] for r in got] == ["01\n\n7\n\n9", "abc", "abc", "", ""]


@pytest.mark.parametrize("base", ["http://a.example/b/c/d;p?q#f", "https://Host.example", "http://a.example/b/"])
def test_addresses(spark, base):
    hrefs = ["g", "./g", "g/", "/g", "//g.example/x", "?y", "g?y", ";x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http:g", "g?y/../x", " spaced "]
    got = {r["h"]: r["u"] for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", resolve(F.lit(base), F.col("h")).alias("u")).collect()}
    for h in hrefs:
        want = urljoin(base, h.strip())
        if h == "http:g":
            continue
        origin = re.match(r"https?://[^/?#]*", want)[0]
        if not want[len(origin) :].startswith("/"):
            want = origin + "/" + want[len(origin) :]
        assert got[h] == origin.lower() + want[len(origin) :], (base, h)
    rest = spark.createDataFrame([(h,) for h in ("", "#a", "mailto:a@b", "JavaScript:x()", "tel:1", "data:,x", None, "café x")], "h string").select(resolve(F.lit(base), F.col("h"))).collect()
    assert [r[0] for r in rest[:7]] == [None] * 7 and rest[7][0].endswith("/caf%C3%A9%20x")


def test_links_and_site_maps(spark):
    pages = spark.createDataFrame([(1, "http://a/b/c", "<a href='../x'>1</a><a href='#y'>2</a><a href='mailto:q@r'>3</a>"), (2, "http://a/", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in page_links(pages).collect()] == [(1, 0, "../x", "http://a/x")]
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    maps = [
        ("s", "r.xml", True, loc("p1", "m1.xml", "m2.xml?v=1", "m3.xml", "p2")), ("s", "m1.xml", False, loc("q1", "deep.xml", "q&amp;2")), ("s", "m3.xml", False, loc("never")), ("t", "r.xml", True, loc("gone.xml")), ("u", "r.xml", True, None),
    ]
    got = sitemap_frontier(spark.createDataFrame(maps, "site string, url string, root boolean, xml string")).collect()
    assert sorted(tuple(r) for r in got) == [("s", 1, "p1"), ("s", 2, "p2"), ("s", 3, "q1"), ("s", 4, "q&2")]


def test_rule_sets_are_checked_and_run(spark):
    good = {"id": "r", "label": "R", "short": "r", "weight": 1, "detect": {"when": [{"text": {"minLen": 2}}]}}
    assert ruleset.faults(good) == []
    wrong = [
        ("x", "object"), ({**good, "id": "A b"}, "id"), ({**good, "label": ""}, "label"), ({**good, "weight": 41}, "weight"), ({**good, "weight": True}, "weight"), ({**good, "category": "x"}, "category"), ({**good, "detect": None}, "detect"),
        ({**good, "detect": {"when": []}}, "when"), ({**good, "detect": {"when": [{}]}}, "when[0]"), ({**good, "detect": {"when": [{"text": {"matches": "("}}]}}, "matches"), ({**good, "detect": {"when": [{"semantic": "pink"}]}}, "semantic"),
        ({**good, "detect": {**good["detect"], "trigger": {"x": 1}}}, "trigger"), ({**good, "detect": {**good["detect"], "scope": {"selector": "a > b"}}}, "selector"),
    ]
    assert all(any(word in f for f in ruleset.faults(rule)) for rule, word in wrong)
    with pytest.raises(ValueError):
        ruleset.parsed([json.dumps(good), json.dumps(good)])
    with pytest.raises(ValueError):
        ruleset.parsed([json.dumps({**good, "weight": -1})])
    page = "<div class='ad x' style='color:#7c3aed;padding:12.5px;font-family:\"Inter\", serif'>Buy now</div><p style='color: #111'>abc</p><p>de</p><b></b>"
    e = dom.elements(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    cases = {
        "a": ({"when": [{"semantic": "purple"}]}, 1), "b": ({"when": [{"style": "padding", "gte": 12, "lte": 13}]}, 1), "c": ({"when": [{"style": "padding", "gte": 13}]}, 0), "d": ({"when": [{"semantic": "slopFont", "style": "fontFamily"}]}, 1),
        "e": ({"when": [{"style": "color", "oneOf": ["#111", "#222"]}, {"text": {"maxLen": 3}}]}, 1), "f": ({"scope": {"selector": ".ad.x"}, "when": [{"text": {"matches": "BUY", "flags": "i"}}]}, 1),
        "g": ({"scope": {"selector": "p, b"}, "when": [{"text": {"notMatches": "c"}}]}, 2), "h": ({"when": [{"style": "color", "equals": "#111"}]}, 1), "i": ({"when": [{"style": "color", "includes": "7c3"}]}, 1), "j": ({"when": [{"semantic": "dark"}]}, 1),
    }
    rules = [{**good, "id": k, "detect": {**d, "trigger": {"minRatio": 0.5}}} for k, (d, _) in cases.items()]
    got = {r["rule_id"]: r for r in ruleset.applied(e, ruleset.parsed(map(json.dumps, rules))).collect()}
    assert {k: r["hits"] for k, r in got.items()} == {k: n for k, (_, n) in cases.items()}
    assert got["g"]["total"] == 3 and got["g"]["triggered"] and got["g"]["samples"] == ["de"] and not got["a"]["triggered"]
    kinds = ruleset.rule_assertions(ruleset.applied(e, rules), {"f": "error", "g": "warn", "a": "error", "b": "off"}).collect()
    assert {(r["key"], r["kind"]) for r in kinds} == {("f", "failure"), ("g", "warning")}


def test_chunks_keep_figures_at_their_ends(spark):
    text = " ".join(f"{k} is part {k}." for k in range(120)) + " 126.40.69.100!!"
    got = spark.createDataFrame([(text,)], "text string").select(site.chunks(F.col("text")).alias("c")).first()["c"]
    assert got == [*[f"{k} is part {k}." for k in range(120)], "126.40.69.100!!"]


def test_artifacts_are_found_before_boilerplate_goes(spark):
    """A notice on every page is boilerplate, and still a finding; hashes leave out what strings would."""
    notice = "As an AI language model, I cannot fulfill this request."
    texts = [f"Page {k} tells of mill number {k} and its wheel. {notice}" for k in range(6)]
    pages = site.html_sites(spark.createDataFrame([(k, f"http://a.example/{k}", f"<html lang='en'><h1>Mill {k}</h1><p>{t}</p></html>") for k, t in enumerate(texts)], "page_id long, url string, html string"))
    cut = site.stripped(pages).collect()
    assert all(r["stripped"] == 1 and notice not in r["text"] and f"mill number {r['page_id']}" in r["text"] for r in cut)
    found = site.artifact_findings(pages)
    assert {r["url"] for r in found.where("rule_id = 'chatbot_reply_residue'").collect()} == {f"http://a.example/{k}" for k in range(6)}


def test_folders_are_scanned_in_order_up_to_a_bound(spark, tmp_path):
    for name in ("b.html", "a.htm", "sub/c.HTML", "node_modules/x.html", ".git/y.html", "d.txt", "sub/deep/e.html"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"<p>{name}</p>")
    got = scan_folder(spark, str(tmp_path), 2).collect()
    assert sorted((r["url"].rsplit("/", 1)[1], r["html"], r["truncated"]) for r in got) == [("a.htm", "<p>a.htm</p>", True), ("b.html", "<p>b.html</p>", True)]
    whole = scan_folder(spark, str(tmp_path)).collect()
    assert {r["truncated"] for r in whole} == {False} and {"a.htm", "b.html", "e.html"} <= {r["url"].rsplit("/", 1)[1] for r in whole} and not any("node_modules" in r["url"] or ".git" in r["url"] for r in whole)


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(g, k, rng.randint(1, 9)) for g in "ab" for k in rng.sample(range(-500, 500), 300)] + [("a", None, 5), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    out = running(df, "g", "k", "n", "upto", parts=16)
    for r in out.collect():
        own = [(x is not None, x, n) for g, x, n in rows if g == r["g"]]
        assert r["upto_of"] == sum(n for _, _, n in own)
        assert r["upto"] == sum(n for known, x, n in own if not known or (r["k"] is not None and x <= r["k"]))
    assert out.count() == len(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line or "[g#" in line for line in plan.splitlines() if line.strip().startswith(("Window", "+- Window", ":- Window")))
