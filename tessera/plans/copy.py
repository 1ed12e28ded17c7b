"""Queries of the copy axis over ``documents`` and ``pages``, one by one and scored together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog as c
from tessera.functions.regex import quoted, sql_total
from tessera.functions.text import (
    LEAST_RATIO, LEAST_TOKENS, SQL_FUNCTION_WORDS, SQL_LETTERS, normalised, sql_grade, sql_normalised, sql_rounded, sql_tier, sql_words,
)
from tessera.operators.copyrules import context, evidence
from tessera.operators.copyscore import gates, scored
from tessera.sources.html import (
    KEPT, MOST_ATTRIBUTES, PAIR, TAG,
    HEADING, LANGUAGE, LINK, PARAGRAPH, attributes, copy_input, host, sql_strip_html, sql_without_code, strip_html,
)
from tessera.sources.literal import copy_cases
from tessera.sources.tables import spread, table

D = f"""d0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, {sql_normalised('text')} AS norm, {sql_words('text')} AS words FROM d0)"""


def density(count: str, places: int = 1, least: int | None = None) -> str:
    of = "words" if least is None else f"(CASE WHEN words = 0 THEN {least} ELSE words END)"
    return sql_rounded(f"(CASE WHEN {of} > 0 THEN {count} * 1000.0::DOUBLE / {of} ELSE 0.0 END)", places)


def per(count: str) -> str:
    return f"(CASE WHEN words > 0 THEN {count} * 1000.0::DOUBLE / words ELSE 0.0 END)"


def _rule(name: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = evidence(context(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), [name])
        return docs.select("doc_id", "words", *[F.col(f"{name}.{k}").alias(k) for k in [*columns, "triggered"]])

    return run


def _sql(inner: str, columns: dict[str, str], triggered: str) -> str:
    outer = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"WITH {D}, e AS (SELECT doc_id, words, text, norm, {inner} FROM d) SELECT doc_id, words, {outer}, {triggered} AS triggered FROM e"


_BUZZ = "[" + ", ".join(f"len(regexp_extract_all(lower(norm), '(?:^|[^a-zA-Z-]){w}(?:[^a-zA-Z-]|$)'))" for w in c.BUZZWORDS) + "]"
_BUZZ_WORDS = "[" + ", ".join(map(quoted, c.BUZZWORDS)) + "]"
_TOP = (
    f"array_to_string(list_transform((list_sort(list_filter(list_transform(range(1, {len(c.BUZZWORDS) + 1}), lambda i: "
    f"{{'n': -b[i], 'at': i}}), lambda x: x.n < 0)))[1:6], lambda x: {_BUZZ_WORDS}[x.at] || ':' || (-x.n)::VARCHAR), ' ')"
)
#: name: (rule, evidence columns, SQL)
RULE_QUERIES = {
    "copy_buzzwords": ("buzzword_density", ["total", "distinct", "density", "top_words"], _sql(
        f"{_BUZZ} AS b", {"total": "list_sum(b)::BIGINT", '"distinct"': "len(list_filter(b, lambda x: x > 0))", "density": density("list_sum(b)"), "top_words": _TOP},
        f"len(list_filter(b, lambda x: x > 0)) >= 4 OR (list_sum(b) >= 3 AND {per('list_sum(b)')} >= 6)")),
    "copy_em_dash": ("em_dash_overload", ["em_dashes", "en_dashes", "total", "density"], _sql(
        r"len(regexp_extract_all(text, '—')) AS em, len(regexp_extract_all(text, '\s–\s')) AS en",
        {"em_dashes": "em", "en_dashes": "en", "total": "em + en", "density": density("em")}, f"(em >= 4 AND {per('em')} >= 7) OR (em >= 8 AND words >= 300)")),
    "copy_antithesis": ("antithesis_construction", ["total", "bare"], _sql(
        f"{sql_total(c.ANTITHESIS, 'norm')} AS n, {sql_total(c.BARE_ANTITHESIS, 'norm')} AS b", {"total": "n", "bare": "b"}, "n >= 2")),
    "copy_filler": ("filler_openers", ["total"], _sql(f"{sql_total(c.FILLER, 'norm')} AS n", {"total": "n"}, "n >= 1")),
    "copy_closers": ("formulaic_closers", ["total"], _sql(f"{c.CLOSER.sql_count('norm')} AS n", {"total": "n"}, "n >= 1")),
    "copy_rule_of_three": ("rule_of_three", ["total", "density"], _sql(
        f"{sql_total(c.TRICOLON, 'text')} AS n", {"total": "n", "density": density("n", 1, 100)}, f"n >= 3 AND n * 1000.0 / (CASE WHEN words = 0 THEN 100 ELSE words END) >= 5")),
    "copy_whether": ("whether_youre", ["total"], _sql(f"{c.WHETHER.sql_count('norm')} AS n", {"total": "n"}, "n >= 1")),
    "copy_markdown": ("leaked_markdown", ["bold", "headings", "inline_links", "rules", "total", "kinds", "downgraded"], _sql(
        f"{c.BOLD.sql_count('text')} AS b, {c.MARKDOWN_HEADING.sql_count('text')} AS h, {c.MARKDOWN_LINK.sql_count('text')} AS l, {c.MARKDOWN_RULE.sql_count('text')} AS r, {c.MARKDOWN_WORD.sql_count('text')} AS m",
        {"bold": "b", "headings": "h", "inline_links": "l", "rules": "r", "total": "b + h + l + r", "kinds": "((b > 0)::INT + (h > 0)::INT + (l > 0)::INT + (r > 0)::INT)", "downgraded": "m >= 2"},
        "b + h + l + r >= 2 OR ((b > 0)::INT + (h > 0)::INT + (l > 0)::INT + (r > 0)::INT) >= 2")),
    "copy_placeholders": ("unfilled_placeholders", ["unambiguous", "generic", "total"], _sql(
        f"{sql_total(c.PLACEHOLDERS, 'text')} AS s, {sql_total(c.GENERIC_PLACEHOLDERS, 'text')} AS g", {"unambiguous": "s", "generic": "g", "total": "s + g"}, "s >= 1 OR g >= 2")),
    "copy_invisible": ("invisible_characters", ["in_word", "zero_width", "narrow_nbsp", "nbsp"], _sql(
        r"regexp_replace(text, '(?i)https?://\S+', ' ', 'g') AS w",
        {"in_word": r"len(regexp_extract_all(w, '\p{L}[\x{200B}\x{2060}\x{FEFF}\x{200D}\x{200C}]\p{L}'))", "zero_width": r"len(regexp_extract_all(w, '[\x{200B}\x{2060}\x{FEFF}\x{200D}\x{200C}]'))",
         "narrow_nbsp": r"len(regexp_extract_all(w, '\x{202F}'))", "nbsp": r"len(regexp_extract_all(w, '\x{A0}'))"},
        r"len(regexp_extract_all(w, '\p{L}[\x{200B}\x{2060}\x{FEFF}\x{200D}\x{200C}]\p{L}')) >= 2")),
    "copy_math_alnum": ("fake_bold_math_alnum", ["math_alnum"], _sql(
        r"len(regexp_extract_all(text, '[\x{1D400}-\x{1D7FF}]')) AS n", {"math_alnum": "n"}, "n >= 4")),
    "copy_hidden_tags": ("hidden_tag_characters", ["tag_chars"], _sql(
        r"len(regexp_extract_all(text, '[\x{E0000}-\x{E007F}]')) AS n", {"tag_chars": "n"}, "n >= 1")),
    "copy_markup_leak": ("chatbot_markup_leak", ["total", "families"], _sql(
        ", ".join(f"least({p.sql_count('norm')}, 50) AS m{k}" for k, p in enumerate(c.MARKUP.values())),
        {"total": " + ".join(f"m{k}" for k in range(len(c.MARKUP))),
         "families": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN m{k} > 0 THEN '{f}' END" for k, f in enumerate(c.MARKUP)) + "], lambda x: x IS NOT NULL), ',')"},
        " + ".join(f"m{k}" for k in range(len(c.MARKUP))) + " >= 1")),
    "copy_reply_residue": ("chatbot_reply_residue", ["total", "error_hits", "warning_hits", "the_user", "effective_tier"], _sql(
        f"{sql_total(c.RESIDUE_ERRORS, 'norm')} AS x, {sql_total(c.RESIDUE_WARNINGS, 'norm')} AS y, {c.THE_USER.sql_count('norm')} AS u",
        {"total": "x + y", "error_hits": "x", "warning_hits": "y", "the_user": "u", "effective_tier": "CASE WHEN x > 0 THEN 'Error' WHEN y > 0 THEN 'Warning' ELSE 'Suggestion' END"}, "x + y >= 1")),
    "copy_bare_antithesis": ("bare_antithesis", ["total"], _sql(f"{sql_total(c.BARE_ANTITHESIS, 'norm')} AS n", {"total": "n"}, "n >= 2")),
    "copy_announced": ("announced_structure", ["count"], _sql(
        f"{c.ANNOUNCED.sql_count('(' + sql_normalised('substr(text, 1, 800)') + ')')} AS n", {'"count"': "n"}, "n >= 1")),
    "copy_restated_thesis": ("restated_thesis_closer", ["starts_with_summary", "overlap", "legacy_vs_modern"], f"""
WITH {D}, p AS (SELECT doc_id, words, list_filter(string_split_regex(text, '\\n\\n+'), lambda x: x <> '') AS paras FROM d),
q AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(coalesce(paras[1], '')), '[a-z]{{4,}}')), lambda w: NOT list_contains({SQL_FUNCTION_WORDS}, w)) AS a,
  list_filter(list_distinct(regexp_extract_all(lower(coalesce(paras[-1], '')), '[a-z]{{4,}}')), lambda w: NOT list_contains({SQL_FUNCTION_WORDS}, w)) AS z,
  len(list_filter(paras, lambda x: {c.LEGACY.sql_found('x')} AND {c.MODERN.sql_found('x')})) AS both_ FROM p),
r AS (SELECT *, len(paras) >= 2 AND coalesce({c.SUMMARY_LEAD.sql_found('paras[-1]')}, false) AS s,
  CASE WHEN len(paras) >= 2 AND len(a) > 0 AND len(z) > 0 THEN {sql_rounded("len(list_intersect(a, z))::DOUBLE / greatest(1, least(len(a), len(z)))", 2)} ELSE 0.0 END AS o FROM q)
SELECT doc_id, words, s AS starts_with_summary, o AS overlap, {density('both_', 2, 100)} AS legacy_vs_modern, s AND o >= 0.5 AND len(a) >= 3 AS triggered FROM r"""),
    "copy_context_leak": ("context_leak_copy", [*c.CONTEXT_LEAKS, "total"], _sql(
        ", ".join(f"{p.sql_count('norm' if k == 'no_x_no_y' else 'text')} AS {k}_" for k, p in c.CONTEXT_LEAKS.items()),
        {**{k: f"{k}_" for k in c.CONTEXT_LEAKS}, "total": " + ".join(f"{k}_" for k in c.CONTEXT_LEAKS)}, " + ".join(f"{k}_" for k in c.CONTEXT_LEAKS) + " >= 1")),
    "copy_participial": ("trailing_participial_clauses", ["count", "density", "nominalisation"], _sql(
        f"{c.PARTICIPIAL.sql_count('text')} AS n, {c.NOMINALISATION.sql_count('text')} AS m",
        {'"count"': "n", "density": density("n", 1, 100), "nominalisation": density("m", 1, 100)}, "n >= 3 AND words >= 300")),
    "copy_sentence_stats": ("sentence_length_uniformity", ["sentences", "mean", "sd", "cv", "iqr"], f"""
WITH {D}, s AS (SELECT doc_id, words, list_filter(list_transform(string_split_regex(regexp_replace(text, {quoted(c.ABBREVIATION._plain(c.ABBREVIATION.source))}, '\\0_', 'g'),
  '[.!?]+(?:\\s+|$)'), lambda x: {sql_words('x')}), lambda n: n >= 3) AS l FROM d),
t AS (SELECT *, len(l) AS n, list_sum(l)::BIGINT AS one, list_sum(list_transform(l, lambda x: x * x))::BIGINT AS two, list_sort(l) AS o FROM s)
SELECT doc_id, words, n AS sentences, CASE WHEN n >= 15 THEN {sql_rounded('one::DOUBLE / n', 2)} END AS mean,
  CASE WHEN n >= 15 THEN {sql_rounded('sqrt((n * two - one * one)::DOUBLE) / n', 2)} END AS sd,
  CASE WHEN n >= 15 THEN {sql_rounded('sqrt((n * two - one * one)::DOUBLE) / one', 3)} END AS cv,
  CASE WHEN n >= 15 THEN o[floor(n * 0.75)::INT + 1] - o[floor(n * 0.25)::INT + 1] END AS iqr, false AS triggered FROM t"""),
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))


def copy_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(_documents(spark, sf_dir)).select("doc_id", "tokens", "ratio", "english")


def copy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(_documents(spark, sf_dir), "lang").select("doc_id", "words", "english", "non_english", "short", "medium", "thin", "factor")


_RATIO = f"""t AS (SELECT *, regexp_extract_all(lower(text), {quoted(SQL_LETTERS)}) AS tok FROM d),
g0 AS (SELECT *, len(tok) AS tokens, CASE WHEN len(tok) > 0 THEN {sql_rounded(f"len(list_filter(tok, lambda x: list_contains({SQL_FUNCTION_WORDS}, x)))::DOUBLE / len(tok)", 3)} ELSE 0.0 END AS ratio FROM t)"""


def _gates_sql(declared: bool) -> str:
    measured = f"(tokens < {LEAST_TOKENS} OR ratio >= {LEAST_RATIO})"
    english = f"CASE WHEN lang IS NOT NULL AND trim(lang) <> '' AND NOT starts_with(lower(trim(lang)), 'en') THEN false ELSE {measured} END" if declared else measured
    return f"""{_RATIO},
g1 AS (SELECT *, {english} AS english FROM g0),
g AS (SELECT *, NOT english AND words >= 15 AS non_english, words < 150 AS short, words >= 150 AND words < 300 AS medium,
      words < 150 OR (NOT english AND words >= 15) AS thin, CASE WHEN words >= 150 AND words < 300 THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM g1)"""


def copy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(_documents(spark, sf_dir), "lang")
    return out.select("doc_id", "source", "words", "thin", F.array_join("flags", ",").alias("flags"), F.array_join("adjustments", ",").alias("adjustments"), "score", "tier", "grade")


def copy_score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(_documents(spark, sf_dir), "lang")
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("score").alias("points"), F.max("score").alias("worst"), F.count_if("thin").alias("thin"),
        F.count_if(F.col("tier") != "Clean").alias("mild_or_above"), F.sum("flagged").cast("long").alias("flagged"),
    )


def copy_tier_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(_documents(spark, sf_dir), "lang")
    return out.groupBy("tier", "grade").agg(F.count(F.lit(1)).alias("docs"))


#: Weighted rules that can fire on plain documents, and those without weight, as SQL over d's columns.
_FIRED = {
    "buzzword_density": ("s", f"(len(list_filter(b, lambda x: x > 0)) >= 4 OR (list_sum(b) >= 3 AND {per('list_sum(b)')} >= 6))"),
    "em_dash_overload": ("s", f"((em >= 4 AND {per('em')} >= 7) OR (em >= 8 AND words >= 300))"),
    "antithesis_construction": ("s", f"{sql_total(c.ANTITHESIS, 'norm')} >= 2"),
    "filler_openers": ("s", f"{sql_total(c.FILLER, 'norm')} >= 1"),
    "formulaic_closers": ("s", f"{c.CLOSER.sql_count('norm')} >= 1"),
    "rule_of_three": ("s", f"(tri >= 3 AND tri * 1000.0 / (CASE WHEN words = 0 THEN 100 ELSE words END) >= 5)"),
    "whether_youre": ("s", f"{c.WHETHER.sql_count('norm')} >= 1"),
    "hidden_tag_characters": ("a", r"len(regexp_extract_all(text, '[\x{E0000}-\x{E007F}]')) >= 1"),
    "invisible_characters": ("a", r"len(regexp_extract_all(text, '\p{L}[\x{200B}\x{2060}\x{FEFF}\x{200D}\x{200C}]\p{L}')) >= 2"),
    "fake_bold_math_alnum": ("a", r"len(regexp_extract_all(text, '[\x{1D400}-\x{1D7FF}]')) >= 4"),
    "chatbot_markup_leak": ("a", "(" + " + ".join(p.sql_count("norm") for p in c.MARKUP.values()) + ") >= 1"),
    "chatbot_reply_residue": ("a", f"({sql_total(c.RESIDUE_ERRORS, 'norm')} + {sql_total(c.RESIDUE_WARNINGS, 'norm')}) >= 1"),
    "unfilled_placeholders": ("a", f"({sql_total(c.PLACEHOLDERS, 'text')} >= 1 OR {sql_total(c.GENERIC_PLACEHOLDERS, 'text')} >= 2)"),
    "leaked_markdown": ("a", "(mb + mh + ml + mr >= 2)"),
    "bare_antithesis": ("s", f"{sql_total(c.BARE_ANTITHESIS, 'norm')} >= 2"),
    "announced_structure": ("s", f"{c.ANNOUNCED.sql_count('(' + sql_normalised('substr(text, 1, 800)') + ')')} >= 1"),
    "context_leak_copy": ("s", "(" + " + ".join(p.sql_count("norm" if k == "no_x_no_y" else "text") for k, p in c.CONTEXT_LEAKS.items()) + ") >= 1"),
    "trailing_participial_clauses": ("s", f"({c.PARTICIPIAL.sql_count('text')} >= 3 AND words >= 300)"),
}
_WEIGHT = {name: weight for name, _, _, weight, status, _ in c.COPY_RULES if status not in ("review", "retired")}
_SCORE_SQL = f"""WITH {D}, {_gates_sql(True)},
v AS (SELECT *, {_BUZZ} AS b, len(regexp_extract_all(text, '—')) AS em, {sql_total(c.TRICOLON, 'text')} AS tri, {c.BOLD.sql_count('text')} AS mb,
  {c.MARKDOWN_HEADING.sql_count('text')} AS mh, {c.MARKDOWN_LINK.sql_count('text')} AS ml, {c.MARKDOWN_RULE.sql_count('text')} AS mr FROM g),
f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {'NOT thin AND ' if kind == 's' else ''}{test} THEN '{name}' END" for name, (kind, test) in _FIRED.items())}], lambda x: x IS NOT NULL) AS fl FROM v),
w AS (SELECT *, least(100, floor({' + '.join(f"(CASE WHEN list_contains(fl, '{k}'){' AND len(fl) > 1' if k in ('em_dash_overload', 'rule_of_three') else ''} THEN {_WEIGHT[k]} * {'factor' if _FIRED[k][0] == 's' else '1.0'} ELSE 0 END)" for k in _FIRED if _WEIGHT.get(k))} + 0.5))::INT AS score FROM f),
o AS (SELECT *, array_to_string(fl, ',') AS flags, array_to_string(list_filter([
  CASE WHEN list_contains(fl, 'em_dash_overload') AND len(fl) <= 1 THEN 'copy_co_occurrence_gate:em_dash_overload' END,
  CASE WHEN list_contains(fl, 'rule_of_three') AND len(fl) <= 1 THEN 'copy_co_occurrence_gate:rule_of_three' END], lambda x: x IS NOT NULL), ',') AS adjustments,
  {sql_tier('score', 'copy')} AS tier, {sql_grade('score')} AS grade FROM w)
"""


def copy_cases_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal cases, one or more for each rule, so that every rule is seen to fire and to stay silent."""
    out = scored(context(copy_cases(spark)), "lang")
    return out.select("case_id", "words", "thin", F.array_join("flags", ",").alias("flags"), F.array_join("adjustments", ",").alias("adjustments"), "points", "score", "tier", "grade")


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", normalised(F.col("text")))
    ascii_ = F.length("text") == F.octet_length("text")
    found = lambda letters: F.when(ascii_, 0).otherwise(F.regexp_count("text", F.lit(letters)))
    return docs.select(
        "doc_id", F.sha2("norm", 256).alias("normalised_sha256"), F.length("norm").alias("length"),
        found(f"[{c.CONFUSABLES[0]}]").alias("confusables"), found(c.INVISIBLE).alias("invisibles"),
    )


# Pages ---------------------------------------------------------------------------------------------------------

P_SQL = f"p AS (SELECT page_id, url, {sql_without_code(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')')} AS bare FROM pages)"


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_html(F.coalesce("html", F.lit(""))).alias("text"))


def html_copy_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = copy_input(spread(table(spark, sf_dir, "pages")))
    return p.select(
        "page_id", "lang", F.array_join("headings", "|").alias("headings"), F.array_join("paragraphs", "|").alias("paragraphs"),
        F.size("links").alias("links"), F.size("attributes").alias("attributes"),
    )


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = copy_input(spread(table(spark, sf_dir, "pages")))
    return p.select("page_id", F.posexplode("links").alias("ord", "l")).select("page_id", "ord", "l.href", F.col("l.text").alias("text"))


def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", attributes(F.col("html")).alias("a"))
    return p.select("page_id", F.explode("a").alias("a")).groupBy("page_id", "a.tag", "a.attr").agg(
        F.count(F.lit(1)).alias("n"), F.min("a.value").alias("first_value"), F.max("a.value").alias("last_value")
    )


def utm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.copyrules import is_ai_link
    from tessera.sources.html import query_value

    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.select(
        "page_id", query_value(F.col("url"), "utm_source").alias("utm_source"), query_value(F.col("url"), "page").alias("page"), is_ai_link(F.col("url")).alias("from_assistant")
    )


def page_copy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored(context(copy_input(spread(table(spark, sf_dir, "pages")))), "lang")
    return p.select("page_id", host(F.col("url")).alias("host"), "words", "english", "thin", F.array_join("flags", ",").alias("flags"), "score", "tier", "grade")


_GET = lambda key: rf"nullif(regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&){key}=([^&]*)', 1), '')"

QUERIES = {
    "copy_score": copy_score, "copy_score_by_source": copy_score_by_source, "copy_tier_hist": copy_tier_hist,
    "copy_language_ratio": copy_language_ratio, "copy_gates": copy_gates, "copy_cases": copy_cases_scored, "normalise_text": normalise_text,
    **{k: _rule(rule, columns) for k, (rule, columns, _) in RULE_QUERIES.items()},
    "html_strip": html_strip, "html_copy_input": html_copy_input, "html_links": html_links, "html_attributes": html_attributes,
    "utm_links": utm_links, "page_copy_score": page_copy_score,
}
ORACLES = {
    "copy_score": _SCORE_SQL + "SELECT doc_id, source, words, thin, flags, adjustments, score, tier, grade FROM o",
    "copy_score_by_source": _SCORE_SQL + """SELECT source, count(*) AS docs, sum(score)::BIGINT AS points, max(score) AS worst, count(*) FILTER (thin) AS thin,
  count(*) FILTER (tier <> 'Clean') AS mild_or_above, sum(len(fl))::BIGINT AS flagged FROM o GROUP BY source""",
    "copy_tier_hist": _SCORE_SQL + "SELECT tier, grade, count(*) AS docs FROM o GROUP BY tier, grade",
    "copy_language_ratio": f"WITH {D}, {_gates_sql(False)} SELECT doc_id, tokens, ratio, english FROM g",
    "copy_gates": f"WITH {D}, {_gates_sql(True)} SELECT doc_id, words, english, non_english, short, medium, thin, factor FROM g",
    "normalise_text": f"""WITH {D} SELECT doc_id, sha256(norm) AS normalised_sha256, length(norm) AS length,
  len(regexp_extract_all(text, '[{c.CONFUSABLES[0]}]')) AS confusables, len(regexp_extract_all(text, '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}\\x{{E0000}}-\\x{{E007F}}]')) AS invisibles FROM d""",
    **{k: sql for k, (_, _, sql) in RULE_QUERIES.items()},
    "html_strip": f"SELECT page_id, {sql_strip_html('''coalesce(html, '')''')} AS text FROM pages",
    "html_copy_input": f"""WITH {P_SQL}
SELECT page_id, nullif(regexp_extract(bare, {quoted(LANGUAGE._plain(LANGUAGE.source))}, 1), '') AS lang,
  array_to_string(list_filter(list_transform({HEADING.sql_all('bare', 1)}, lambda x: {sql_strip_html('x')}), lambda x: x <> ''), '|') AS headings,
  array_to_string(list_filter(list_transform({PARAGRAPH.sql_all('bare', 1)}, lambda x: {sql_strip_html('x')}), lambda x: x <> ''), '|') AS paragraphs,
  least(300, len(list_filter({LINK.sql_all('bare', 1)}, lambda x: trim(x) <> ''))) AS links,
  least(300, len(list_filter(flatten(list_transform(regexp_extract_all(bare, '<[a-zA-Z][^>]*>'), lambda t: regexp_extract_all(t, '\\s(?i:href|src|srcset|data-[a-z0-9_-]+)\\s*=\\s*["'']([^"'']*)["'']', 1))),
    lambda v: len(v) BETWEEN 4 AND 500))) AS attributes FROM p""",
    "html_links": f"""WITH {P_SQL}, l AS (SELECT page_id, {LINK.sql_all('bare', 1)} AS h, {LINK.sql_all('bare', 2)} AS t FROM p)
SELECT page_id, i - 1 AS ord, trim(h[i]) AS href, substr({sql_strip_html('t[i]')}, 1, 100) AS text FROM (SELECT *, unnest(range(1, least(300, len(h)) + 1)) AS i FROM l)""",
    "html_attributes": f"""WITH t AS (SELECT page_id, {TAG.sql_all('html', 1)} AS ts, {TAG.sql_all('html', 2)} AS rs FROM pages),
u AS (SELECT page_id, unnest(range(1, len(ts) + 1)) AS i, ts, rs FROM t),
v AS (SELECT page_id, i, lower(ts[i]) AS tag, regexp_extract_all(rs[i], {quoted(PAIR)}, 1) AS ks, regexp_extract_all(rs[i], {quoted(PAIR)}, 2) AS vs FROM u WHERE rs[i] LIKE '%=%'),
w AS (SELECT page_id, i, tag, unnest(range(1, len(ks) + 1)) AS j, ks, vs FROM v),
x AS (SELECT page_id, tag, lower(ks[j]) AS attr, vs[j] AS value, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS place FROM w WHERE regexp_matches(ks[j], {quoted(KEPT)}) AND length(vs[j]) BETWEEN 4 AND 500)
SELECT page_id, tag, attr, count(*) AS n, min(value) AS first_value, max(value) AS last_value FROM x WHERE place <= {MOST_ATTRIBUTES} GROUP BY page_id, tag, attr""",
    "utm_links": f"""SELECT page_id, {_GET('utm_source')} AS utm_source, {_GET('page')} AS page,
  coalesce(lower({_GET('utm_source')}) IN ('chatgpt.com', 'openai', 'copilot.com'), false) OR coalesce(lower({_GET('referrer')}) = 'grok.com', false) AS from_assistant FROM pages""",
}
