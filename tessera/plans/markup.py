"""Queries over the element trees of ``pages``, and SQL that builds the same trees with a stack in a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.regex import quoted
from tessera.operators import design, markup, ruleset
from tessera.sources import dom
from tessera.sources.html import ENTITIES
from tessera.sources.tables import spread, table


def element_tree(spark: SparkSession, d: str) -> DataFrame:
    return markup.shape(dom.with_tree(spread(table(spark, d, "pages")).select("page_id", "html")))


def page_structure(spark: SparkSession, d: str) -> DataFrame:
    return markup.structure(dom.elements(spread(table(spark, d, "pages"))))


#: Rules as someone would write them.
RULESET = [
    '{"id": "long_paragraphs", "label": "Long paragraphs", "short": "Long", "weight": 3, "category": "copy", "detect": {"scope": {"selector": "p"}, "when": [{"text": {"minLen": 200}}], "trigger": {"minCount": 2}}}',
    '{"id": "short_links", "label": "Short link texts", "short": "Links", "weight": 2, "detect": {"scope": {"selector": "a"}, "when": [{"text": {"maxLen": 3, "matches": "^[a-z]", "flags": "i"}}], "trigger": {"minRatio": 0.4}}}',
    '{"id": "plain_ads", "label": "Ads without figures", "short": "Ads", "weight": 1, "detect": {"scope": {"selector": "div.ad, aside"}, "when": [{"text": {"notMatches": "[0-9]"}}, {"text": {"minLen": 20}}]}}',
    '{"id": "painted", "label": "Purple text", "short": "Purple", "weight": 4, "category": "colors", "detect": {"when": [{"semantic": "purple"}]}}',
]


def page_ruleset(spark: SparkSession, d: str) -> DataFrame:
    found = ruleset.applied(dom.elements(spread(table(spark, d, "pages"))), ruleset.parsed(RULESET))
    return found.withColumn("samples", F.array_join("samples", "|"))


def page_assertions(spark: SparkSession, d: str) -> DataFrame:
    found = ruleset.applied(dom.elements(spread(table(spark, d, "pages"))), ruleset.parsed(RULESET))
    return ruleset.rule_assertions(found, {"long_paragraphs": "error", "short_links": "warn", "plain_ads": "off"})


def page_waivers(spark: SparkSession, d: str) -> DataFrame:
    """Waivers that pages would carry if their ads' comments and boxes named rules."""
    html = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<!-- ad "), F.lit("<!-- slop-ignore stat_banner bento_grid, ad_")), F.lit('class="ad"'), F.lit('class="ad" data-slop-ignore="purple_accent, gradient_text -- brand colours"'))
    return table(spark, d, "pages").select("page_id", F.explode(design.inline_waivers(html)).alias("w")).select("page_id", "w.rule_id", "w.reason")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def _decoded(text: str) -> str:
    for entity, letter in [("&copy;", "©"), ("&middot;", "·"), *ENTITIES]:
        text = f"regexp_replace({text}, {quoted(entity)}, {quoted(letter)}, 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_CLOSED = "CASE name " + " ".join(f"WHEN {quoted(k)} THEN {_list(v)}" for k, v in dom.CLOSES.items()) + " ELSE []::VARCHAR[] END"
_TAG = r"""(?:"[^"]*"|'[^']*'|[^'">])*>"""
_BARE = "html"
for _t in dom.TEXT:
    _BARE = f"regexp_replace({_BARE}, {quoted(rf'(?i)(<{_t}{_TAG})[\s\S]*?</{_t}\s*>')}, {quoted(chr(92) + '1')}, 'g')"
_TOKEN = quoted(dom.TOKEN)
#: Tokens by page, and the text before each and after the last; then the stack, one token of every page a step.
TREE = f"""RECURSIVE src AS (SELECT page_id, {_BARE} AS html FROM pages),
tok AS (SELECT page_id, list_transform(list_zip(regexp_extract_all(html, {_TOKEN}, 1), regexp_extract_all(html, {_TOKEN}, 2), regexp_extract_all(html, {_TOKEN}, 3)),
    lambda t: {{'slash': t[1], 'name': lower(t[2]), 'rest': t[3]}}) AS toks,
  list_transform(string_split(regexp_replace(html, {_TOKEN}, chr(1), 'g'), chr(1)), lambda x: {_decoded('x')}) AS texts FROM src),
st AS (
  SELECT page_id, 0 AS i, []::STRUCT(n INT, tag VARCHAR)[] AS stack, 0 AS nxt, NULL::INT AS node, NULL::VARCHAR AS tag, NULL::INT AS parent, NULL::INT AS depth, NULL::VARCHAR AS rest, []::STRUCT(n INT, size INT)[] AS ended FROM tok
  UNION ALL
  SELECT page_id, i, CASE WHEN opens AND NOT atom THEN list_append(kept, {{'n': nxt, 'tag': name}}) ELSE kept END, CASE WHEN opens THEN nxt + 1 ELSE nxt END,
    CASE WHEN opens THEN nxt END, CASE WHEN opens THEN name END, CASE WHEN opens AND len(kept) > 0 THEN kept[len(kept)].n END, CASE WHEN opens THEN len(kept) END, rest,
    list_transform(stack[keep + 1 :], lambda s: {{'n': s.n, 'size': nxt - 1 - s.n}})
  FROM (SELECT *, stack[: keep] AS kept FROM (
    SELECT *, CASE WHEN name = '' THEN len(stack) WHEN NOT opens THEN coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda k: stack[k].tag = name)), len(stack) + 1) - 1
      ELSE coalesce(list_min(list_filter(range(1, len(stack) + 1), lambda k: k > held AND list_contains(closed, stack[k].tag))), len(stack) + 1) - 1 END AS keep
    FROM (SELECT *, coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda k: list_contains({_list(dom.KEEPS)}, stack[k].tag) AND NOT list_contains(closed, stack[k].tag))), 0) AS held
      FROM (SELECT page_id, i + 1 AS i, stack, nxt, t.name AS name, t.rest AS rest, t.name <> '' AND t.slash = '' AS opens, {_CLOSED.replace('CASE name', 'CASE t.name')} AS closed,
          list_contains({_list(dom.VOID + dom.TEXT)}, t.name) OR t.rest LIKE '%/' AS atom
        FROM (SELECT st.page_id, i, stack, nxt, toks[i + 1] AS t FROM st JOIN tok USING (page_id) WHERE i < len(toks))))))),
done AS (SELECT page_id, unnest(ended).n AS node, unnest(ended).size AS size FROM st
  UNION ALL SELECT page_id, s.n, nxt - 1 - s.n FROM (SELECT page_id, nxt, unnest(stack) AS s FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i DESC) = 1))),
el AS (SELECT page_id, i, node, tag, parent, depth, rest, coalesce(size, 0) AS inside FROM st LEFT JOIN done USING (page_id, node) WHERE node IS NOT NULL)"""

_HEADINGS = "(" + ", ".join(map(quoted, markup.HEADINGS)) + ")"
_ATTR = lambda n: rf"""regexp_extract(rest, '(?i)(?:^|\s){n}\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 1)"""
#: The whole text of every element.
_TEXTS = r"""tx AS (SELECT page_id, unnest(range(1, len(texts) + 1)) AS k, unnest(texts) AS x FROM tok),
ev AS (SELECT st.page_id, st.i, st.stack FROM st),
fu AS (SELECT el.page_id, el.node, string_agg(tx.x, ' ' ORDER BY tx.k) AS text FROM el
  JOIN ev ON ev.page_id = el.page_id AND ev.i >= el.i AND list_contains(list_transform(ev.stack, lambda s: s.n), el.node) JOIN tx ON tx.page_id = ev.page_id AND tx.k = ev.i + 1 AND tx.x <> '' GROUP BY ALL),
"""
_RULED = f"""{TREE}, {_TEXTS} f AS (SELECT el.page_id, node, tag, trim(coalesce(text, '')) AS t, string_split_regex({_ATTR('class')}, '\\s+') AS cls FROM el LEFT JOIN fu USING (page_id, node)),
h AS (SELECT page_id, node, t, 'long_paragraphs' AS rule_id, length(t) >= 200 AS hit FROM f WHERE tag = 'p'
  UNION ALL SELECT page_id, node, t, 'short_links', length(t) <= 3 AND regexp_matches(t, '(?i)^[a-z]') FROM f WHERE tag = 'a'
  UNION ALL SELECT page_id, node, t, 'plain_ads', NOT regexp_matches(t, '[0-9]') AND length(t) >= 20 FROM f WHERE (tag = 'div' AND list_contains(cls, 'ad')) OR tag = 'aside'
  UNION ALL SELECT page_id, node, t, 'painted', false FROM f),
g AS (SELECT page_id, rule_id, count(*) AS total, count(*) FILTER (hit) AS hits FROM h GROUP BY ALL),
m AS (SELECT page_id, rule_id, string_agg(substr(t, 1, 40), '|' ORDER BY node) AS samples FROM (SELECT * FROM h WHERE hit AND t <> '' QUALIFY row_number() OVER (PARTITION BY page_id, rule_id ORDER BY node) <= 3) GROUP BY ALL),
k AS (SELECT * FROM (SELECT DISTINCT page_id FROM f), (VALUES ('long_paragraphs', 3.0::DOUBLE), ('short_links', 2.0), ('plain_ads', 1.0), ('painted', 4.0)) v(rule_id, weight)),
o AS (SELECT page_id, rule_id, weight, coalesce(total, 0) AS total, coalesce(hits, 0) AS hits, coalesce(samples, '') AS samples,
  CASE rule_id WHEN 'long_paragraphs' THEN coalesce(hits, 0) >= 2 WHEN 'short_links' THEN coalesce(hits / total >= 0.4, false) ELSE coalesce(hits, 0) >= 1 END AS triggered FROM k LEFT JOIN g USING (page_id, rule_id) LEFT JOIN m USING (page_id, rule_id))"""
QUERIES = {f.__name__: f for f in (element_tree, page_structure, page_ruleset, page_assertions, page_waivers)}
ORACLES = {
    "element_tree": f"""WITH {TREE},
g AS (SELECT page_id, count(*) AS elements, max(depth) AS deepest, string_agg(concat_ws(':', node, tag, coalesce(parent, -1), depth, inside), ',' ORDER BY node) AS lines FROM el GROUP BY page_id)
SELECT page_id, coalesce(elements, 0)::BIGINT AS elements, coalesce(deepest, -1)::BIGINT AS deepest, sha256(coalesce(lines, '')) AS tree,
  sha256(array_to_string(list_filter(texts, lambda x: x <> ''), ' ')) AS text_sha256 FROM tok LEFT JOIN g USING (page_id)""",
    "page_structure": rf"""WITH {TREE},
{_TEXTS}f AS (SELECT el.*, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words, {_ATTR('class')} AS cls,
  coalesce(nullif({_ATTR('href')}, ''), {_ATTR('src')}) AS href, regexp_extract(coalesce(text, ''), {quoted(markup.STEP)}, 1) AS step FROM el LEFT JOIN fu USING (page_id, node)),
b AS (SELECT page_id, parent, count(*) FILTER (tag = 'p') AS paragraphs, count(*) FILTER (tag = 'li') AS items, count(*) FILTER (tag = 'a') AS anchors, count(*) FILTER (tag = 'details') AS details,
  count(*) FILTER (tag = 'img') AS images, count(DISTINCT CASE WHEN tag = 'img' THEN href END) AS sources, count(DISTINCT CASE WHEN step IN ('1', '2', '3') THEN step END) AS steps,
  count(*) FILTER (step <> '') AS numbered, count(*) FILTER (regexp_matches(lower(cls), {quoted(markup.CARD)})) AS cards, count(*) FILTER (tag = 'a' AND trim(href) IN ('', '#')) AS bare,
  count(*) FILTER (regexp_matches(text, {quoted(markup.SPARKLE)}) AND length(text) <= 40 AND inside = 0) AS sparkles, count(*) FILTER (tag IN {_HEADINGS} AND regexp_matches(text, {quoted(markup.FAQ)})) AS faqs,
  count(*) FILTER (tag IN ('b', 'strong') AND words >= 1) AS leads, max(CASE WHEN tag = 'p' THEN words END) AS longest, count(*) FILTER (tag IN {_HEADINGS}) AS headings, count(*) FILTER (tag = 'h1') AS h1,
  count(*) AS children, count(*) FILTER (inside = 0) AS leaves FROM f GROUP BY page_id, parent),
p AS (SELECT page_id, sum(children)::BIGINT AS elements, sum(leaves)::BIGINT AS leaves, max(children) AS most_children, max(paragraphs) AS most_paragraphs, max(items) AS longest_list, sum(anchors)::BIGINT AS anchors, sum(bare)::BIGINT AS bare_links,
  sum(sparkles)::BIGINT AS sparkles, sum(leads)::BIGINT AS bold_leads, coalesce(max(longest), 0) AS longest_paragraph, sum(headings)::BIGINT AS headings, sum(h1)::BIGINT AS h1, sum(details)::BIGINT AS details, sum(faqs)::BIGINT AS faqs,
  max(cards) AS cards, count(*) FILTER (steps = 3 AND numbered <= 6) AS step_rows, count(*) FILTER (images BETWEEN 4 AND 12 AND sources < images) AS logo_rows FROM b GROUP BY page_id)
SELECT *, details >= 3 OR faqs >= 1 AS faq_accordion, step_rows >= 1 AS numbered_steps, logo_rows >= 1 AS fake_logo_bar, sparkles >= 1 AS ai_sparkle_badges, cards >= 3 AS card_row, bare_links >= 1 AS dead_links, h1 <> 1 AS h1_not_single FROM p""",
    "page_ruleset": f"WITH {_RULED} SELECT * FROM o",
    "page_assertions": f"WITH {_RULED} SELECT page_id, rule_id AS key, CASE rule_id WHEN 'long_paragraphs' THEN 'failure' ELSE 'warning' END AS kind FROM o WHERE triggered AND rule_id IN ('long_paragraphs', 'short_links')",
    "page_waivers": """WITH h AS (SELECT page_id, replace(replace(coalesce(html, ''), '<!-- ad ', '<!-- slop-ignore stat_banner bento_grid, ad_'), 'class="ad"', 'class="ad" data-slop-ignore="purple_accent, gradient_text -- brand colours"') AS html FROM pages),
n AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'data-slop-ignore\\s*=\\s*["'']([^"'']*)["'']', 1), regexp_extract_all(html, '<!--\\s*slop-ignore\\s+([^>]*?)\\s*-->', 1))) AS x FROM h)
SELECT DISTINCT page_id, rule_id, regexp_extract(x, '\\s+(?:--|:)\\s+(.*)$', 1) AS reason FROM (SELECT page_id, x, unnest(string_split_regex(regexp_replace(x, '\\s+(?:--|:)\\s+.*$', ''), '\\s*[,\\s]\\s*')) AS rule_id FROM n) WHERE rule_id <> ''""".replace("\\\\", "\\"),
}
