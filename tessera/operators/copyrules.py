"""The rules over prose. Each is a struct column of evidence with ``triggered``, made of built-in functions.

A rule reads a context: text, norm (the normalised text), words, headings, paragraphs,
links and attributes. Rules stay separate columns, so that those not asked for cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog as c
from tessera.functions.regex import Pattern, total
from tessera.functions.text import bind, normalised, per_1000, rounded, words


class _Columns:
    """The context's columns by name; made when asked for, as a session must be there by then."""

    names = {"text": "text", "norm": "norm", "n_words": "words", "low": "low", "low_text": "low_text"}

    def __getattr__(self, name: str) -> Column:
        return F.col(self.names[name])


_c = _Columns()


def _one_of(words: list[str]) -> str:
    """An expression for any of the words, the longest where one begins another, that reads each first letter once."""
    ends, by = "" in words, {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    if not by:
        return ""
    inner = "|".join(re.escape(k) + _one_of(rest) for k, rest in by.items())
    return f"(?:{inner})?" if ends else f"(?:{inner})" if len(by) > 1 else inner


_ONE_OF = _one_of(c.BUZZWORDS)
#: A buzzword, and itself again after single separators: counting consumes separators, so of such a chain every second counts.
BUZZ = rf"(?<![a-zA-Z-])({_ONE_OF})(?:[^a-zA-Z-]\1(?![a-zA-Z-]))*(?![a-zA-Z-])"
_LEADS = "".join(f"\\x{{{ord(x):X}}}" for x in c.EMOJI_LEADS)
LEAD = rf"^\s*[{_LEADS}]"
MORE_LEADS = rf"^\s*[{_LEADS}{''.join(f'\\x{{{ord(x):X}}}' for x in c.MORE_EMOJI_LEADS)}]"
URL = r"(?i)https?:\/\/\S+"
FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
#: Pictographs and their modifiers, by ranges of code points.
EMOJI = r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\x{FE0E}\x{FE0F}\x{20E3}"
SCRIPTS = r"\p{IsArabic}\p{IsDevanagari}\p{IsBengali}"


def _struct(triggered: Column, **evidence: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in evidence.items()], F.coalesce(triggered, F.lit(False)).alias("triggered"))


def _density(count: Column, places: int = 1, least: int | None = None) -> Column:
    of = _c.n_words if least is None else F.when(_c.n_words == 0, least).otherwise(_c.n_words)
    return rounded(per_1000(count, of), places)


def buzzword_density() -> Column:
    # the text is searched once: a chain's word is found again within the chain
    chains = F.transform(
        F.transform(F.regexp_extract_all(_c.low, F.lit(BUZZ), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, f"^{BUZZ}$", 1).alias("w"), m.alias("m"))),
        lambda x: F.struct(x["w"].alias("w"), F.ceil((F.length(x["m"]) + 1) / (F.length(x["w"]) + 1) / 2).cast("int").alias("n")),
    )
    known = F.array(*[F.lit(w) for w in c.BUZZWORDS])

    def counted(found: Column) -> Column:
        by = F.transform(
            F.array_distinct(F.transform(found, lambda x: x["w"])),
            lambda w: F.struct(
                F.aggregate(F.filter(found, lambda x: x["w"] == w), F.lit(0), lambda a, x: a - x["n"]).alias("n"), F.array_position(known, w).alias("at"), w.alias("w")
            ),
        )
        return F.struct(F.aggregate(found, F.lit(0), lambda a, x: a + x["n"]).alias("hits"), F.array_sort(by).alias("by"))

    def judged(x: Column) -> Column:
        hits, distinct = x["hits"], F.size(x["by"])
        top = F.transform(F.slice(x["by"], 1, 6), lambda y: F.concat(y["w"], F.lit(":"), (-y["n"]).cast("string")))
        return _struct((distinct >= 4) | ((hits >= 3) & (per_1000(hits, _c.n_words) >= 6)), total=hits, distinct=distinct, density=_density(hits), top_words=F.array_join(top, " "))

    return bind(bind(chains, counted), judged)


def em_dash_overload() -> Column:
    em, en = Pattern(r"—").count(_c.text), Pattern(r"\s–\s").count(_c.text)
    dense = per_1000(em, _c.n_words)
    return _struct(((em >= 4) & (dense >= 7)) | ((em >= 8) & (_c.n_words >= 300)), em_dashes=em, en_dashes=en, total=em + en, density=rounded(dense, 1))


def antithesis_construction() -> Column:
    n = total(c.ANTITHESIS, _c.norm, _c.low)
    return _struct(n >= 2, total=n, bare=total(c.BARE_ANTITHESIS, _c.norm, _c.low))


def filler_openers() -> Column:
    n = total(c.FILLER, _c.norm, _c.low)
    return _struct(n >= 1, total=n)


def formulaic_closers() -> Column:
    last = F.array_join(F.slice("paragraphs", -2, 2), "\n\n")
    n = F.when(F.size("paragraphs") >= 3, c.CLOSER.count(normalised(last))).otherwise(c.CLOSER.count(_c.norm, _c.low))
    return _struct(n >= 1, total=n)


def rule_of_three() -> Column:
    n = total(c.TRICOLON, _c.text, _c.low_text)
    dense = per_1000(n, F.when(_c.n_words == 0, 100).otherwise(_c.n_words))
    return _struct((n >= 3) & (dense >= 5), total=n, density=rounded(dense, 1))


def whether_youre() -> Column:
    n = c.WHETHER.count(_c.norm, _c.low)
    return _struct(n >= 1, total=n)


def unicode_artifacts() -> Column:
    return _struct(F.lit(False), total=F.lit(0))


def emoji_bullet_headers() -> Column:
    n = F.size(F.filter(F.concat("headings", "paragraphs"), lambda x: x.rlike(LEAD)))
    return _struct(n >= 3, count=n)


def _without_urls() -> Column:
    return F.when(_c.text.contains("://"), F.regexp_replace(_c.text, URL, " ")).otherwise(_c.text)


def hidden_tag_characters() -> Column:
    n = F.regexp_count(F.regexp_replace(_without_urls(), FLAG, ""), F.lit(r"[\x{E0000}-\x{E007F}]"))
    return _struct(n >= 1, tag_chars=n)


def invisible_characters() -> Column:
    none = _struct(F.lit(False), **{k: F.lit(0) for k in ("in_word", "zero_width", "narrow_nbsp", "nbsp")})
    may = (F.length(_c.text) != F.octet_length(_c.text)) & _c.text.rlike(r"[\x{A0}\x{200B}-\x{200D}\x{202F}\x{2060}\x{FEFF}]")
    return F.when(may, bind(F.regexp_replace(_without_urls(), FLAG, ""), _invisible)).otherwise(none)


def _invisible(bare: Column) -> Column:
    inside = F.regexp_count(bare, F.lit(r"(?<=\p{L})[\x{200B}\x{2060}\x{FEFF}](?=\p{L})"))
    inside += F.regexp_count(bare, F.lit(r"(?<=\p{L})\x{200D}(?=\p{L})"))
    inside += F.regexp_count(bare, F.lit(rf"(?<=\p{{L}})(?<![{SCRIPTS}])\x{{200C}}(?![{SCRIPTS}])(?=\p{{L}})"))
    zero = F.regexp_count(bare, F.lit(r"[\x{200B}\x{2060}\x{FEFF}]"))
    zero += F.regexp_count(bare, F.lit(rf"(?<![{EMOJI}])\x{{200D}}(?![{EMOJI}])"))
    zero += F.regexp_count(bare, F.lit(rf"(?<![{SCRIPTS}])\x{{200C}}(?![{SCRIPTS}])"))
    return _struct(
        inside >= 2, in_word=inside, zero_width=zero,
        narrow_nbsp=F.regexp_count(_without_urls(), F.lit(r"\x{202F}")), nbsp=F.regexp_count(_without_urls(), F.lit(r"\x{A0}")),
    )


def fake_bold_math_alnum() -> Column:
    n = F.regexp_count(_without_urls(), F.lit(r"[\x{1D400}-\x{1D7FF}]"))
    return _struct(n >= 4, math_alnum=n)


def chatbot_markup_leak() -> Column:
    lines = F.array_join(F.transform("attributes", lambda a: F.concat(a["attr"], F.lit("="), a["value"])), "\n")
    whole = bind(F.concat(_c.norm, F.lit("\n"), lines), lambda w: bind(F.lower(w), lambda small: _markup(w, small)))
    return F.when(F.size("attributes") > 0, whole).otherwise(_markup(_c.norm, _c.low))


def _markup(whole: Column, small: Column) -> Column:
    each = F.struct(*[F.least(p.count(whole, small), F.lit(50)).alias(k) for k, p in c.MARKUP.items()])

    def judged(x: Column) -> Column:
        n = sum([x[k] for k in c.MARKUP], F.lit(0))
        families = F.array_compact(F.array(*[F.when(x[k] > 0, k) for k in c.MARKUP]))
        meta = (F.size(families) >= 3) & c.META.found(_c.norm)
        return _struct(n >= 1, total=n, families=F.array_join(families, ","), effective_tier=F.when(meta, "Warning").otherwise("Error"))

    return bind(each, judged)


def chatbot_reply_residue() -> Column:
    errors, warnings = total(c.RESIDUE_ERRORS, _c.norm, _c.low), total(c.RESIDUE_WARNINGS, _c.norm, _c.low)
    return _struct(
        errors + warnings >= 1, total=errors + warnings, error_hits=errors, warning_hits=warnings, the_user=c.THE_USER.count(_c.norm, _c.low),
        effective_tier=F.when(errors > 0, "Error").when(warnings > 0, "Warning").otherwise("Suggestion"),
    )


def is_ai_link(href: Column) -> Column:
    from tessera.sources.html import query_value

    utm, referrer = F.lower(query_value(href, "utm_source")), F.lower(query_value(href, "referrer"))
    return F.coalesce(utm.isin("chatgpt.com", "openai", "copilot.com"), F.lit(False)) | F.coalesce(referrer == "grok.com", F.lit(False))


def ai_referral_utm_links() -> Column:
    n = F.size(F.filter("links", lambda x: is_ai_link(x["href"])))
    return _struct(n >= 1, count=n)


def unfilled_placeholders() -> Column:
    sure, generic = total(c.PLACEHOLDERS, _c.text, _c.low_text), total(c.GENERIC_PLACEHOLDERS, _c.text, _c.low_text)
    return _struct((sure >= 1) | (generic >= 2), unambiguous=sure, generic=generic, total=sure + generic)


def leaked_markdown() -> Column:
    parts = dict(bold=c.BOLD.count(_c.text, _c.low_text), headings=c.MARKDOWN_HEADING.count(_c.text, _c.low_text), inline_links=c.MARKDOWN_LINK.count(_c.text, _c.low_text), rules=c.MARKDOWN_RULE.count(_c.text, _c.low_text))
    n = sum(parts.values(), F.lit(0))
    kinds = sum([(v > 0).cast("int") for v in parts.values()], F.lit(0))
    return _struct((n >= 2) | (kinds >= 2), **parts, total=n, kinds=kinds, downgraded=c.MARKDOWN_WORD.count(_c.text, _c.low_text) >= 2)


def structural_fake_social_proof() -> Column:
    hosts = F.size(F.filter("attributes", lambda a: c.AVATAR_HOST.found(a["value"])))
    faces = F.transform(F.filter("attributes", lambda a: (a["attr"] == "src") & c.AVATAR.found(a["value"])), lambda a: a["value"])
    twice = F.when(F.size(faces) >= 2, F.size(faces) - F.size(F.array_distinct(faces))).otherwise(0)
    return _struct((hosts >= 1) | (twice >= 1), placeholder_avatars=hosts, duplicate_avatars=twice)


def _no_x_ids(patterns: list[Pattern], each: int) -> Column:
    """Node ids that two rules share for the same phrase, so that it isn't scored twice."""
    found = F.flatten(F.array(*[F.slice(F.array_distinct(p.all(_c.norm)), 1, each) for p in patterns]))
    found = F.when(total(patterns, _c.norm, _c.low) > 0, found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda s: F.concat(F.lit("copy:no_x_no_y:"), F.lower(F.substring(s, 1, 24))))


def bare_antithesis() -> Column:
    n = total(c.BARE_ANTITHESIS, _c.norm, _c.low)
    return _struct(n >= 2, total=n, node_ids=_no_x_ids(c.BARE_ANTITHESIS, 2))


def emoji_heading_ratio() -> Column:
    n, all_ = F.size(F.filter("headings", lambda x: x.rlike(MORE_LEADS))), F.size("headings")
    ratio = F.when(all_ > 0, rounded(n / all_, 3)).otherwise(F.lit(0.0))
    return _struct((all_ >= 6) & (ratio >= 0.3), count=n, total=all_, ratio=ratio, cta_emoji=F.size(F.filter("links", lambda x: x["text"].rlike(MORE_LEADS))))


def announced_structure() -> Column:
    first = F.when(F.size("paragraphs") > 0, F.array_join(F.slice("paragraphs", 1, 2), "\n\n")).otherwise(F.substring(_c.text, 1, 800))
    return bind(bind(bind(first, normalised), c.ANNOUNCED.count), lambda n: _struct(n >= 1, count=n))


def _content(part: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(part), F.lit("[a-z]{4,}"), F.lit(0))), lambda w: ~w.isin(*c.FUNCTION_WORDS))


def restated_thesis_closer() -> Column:
    split = F.filter(F.split(_c.text, r"\n\n+"), lambda x: x != "")
    paras = F.when(F.size("paragraphs") >= 2, F.col("paragraphs")).otherwise(split)
    # paragraphs split off the text are searched only where the text holds what they must
    may = reduce(lambda a, b: a | b, [_c.low_text.contains(n) for n in c.LEGACY.needles], F.size("paragraphs") >= 2)

    def of(paras: Column) -> Column:
        both = F.when(may, F.size(F.filter(paras, lambda p: c.LEGACY.found(p) & c.MODERN.found(p)))).otherwise(0)
        opening, closing = _content(F.coalesce(F.get("headings", F.lit(0)), F.get(paras, F.lit(0)))), F.element_at(paras, -1)
        starts = F.coalesce(c.SUMMARY_LEAD.found(closing), F.lit(False))

        def judged(x: Column) -> Column:
            opening, close = x["opening"], x["close"]
            shared = F.size(F.array_intersect(opening, close)) / F.greatest(F.lit(1), F.least(F.size(opening), F.size(close)))
            overlap = F.when((F.size(opening) > 0) & (F.size(close) > 0), rounded(shared, 2)).otherwise(F.lit(0.0))
            return _struct(starts & (overlap >= 0.5) & (F.size(opening) >= 3), starts_with_summary=starts, overlap=overlap, legacy_vs_modern=_density(both, 2, 100))

        alone = _struct(F.lit(False), starts_with_summary=F.lit(False), overlap=F.lit(0.0), legacy_vs_modern=_density(both, 2, 100))
        return F.when(F.size(paras) >= 2, bind(F.struct(opening.alias("opening"), _content(closing).alias("close")), judged)).otherwise(alone)

    return bind(paras, of)


def context_leak_copy() -> Column:
    each = {k: p.count(_c.norm, _c.low) if k == "no_x_no_y" else p.count(_c.text, _c.low_text) for k, p in c.CONTEXT_LEAKS.items()}
    n = sum(each.values(), F.lit(0))
    return _struct(n >= 1, **each, total=n, node_ids=_no_x_ids([c.NO_NO_JUST], 3))


def trailing_participial_clauses() -> Column:
    n = c.PARTICIPIAL.count(_c.text, _c.low_text)
    return _struct((n >= 3) & (_c.n_words >= 300), count=n, density=_density(n, 1, 100), nominalisation=_density(c.NOMINALISATION.count(_c.text, _c.low_text), 1, 100))


def sentence_lengths(source: Column) -> Column:
    guarded = F.regexp_replace(source, c.ABBREVIATION.java, "$0_")
    return F.filter(F.transform(F.split(guarded, r"[.!?]+(?:\s+|$)"), words), lambda n: n >= 3)


def sentence_length_uniformity() -> Column:
    source = F.when(F.size("paragraphs") > 0, F.array_join("paragraphs", " ")).otherwise(_c.text)

    def sums(lengths: Column) -> Column:
        add = lambda square: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + (x * x if square else x))
        return F.struct(F.size(lengths).alias("n"), add(False).alias("one"), add(True).alias("two"), F.array_sort(lengths).alias("ordered"))

    def judged(x: Column) -> Column:
        n, one = x["n"], x["one"]
        spread = F.sqrt((n * x["two"] - one * one).cast("double"))
        q = lambda share: F.get(x["ordered"], F.floor(n * share).cast("int"))
        many = n >= 15
        return _struct(
            F.lit(False), sentences=n, mean=F.when(many, rounded(one / n, 2)), sd=F.when(many, rounded(spread / n, 2)),
            cv=F.when(many, rounded(spread / one, 3)), iqr=F.when(many, q(0.75) - q(0.25)),
        )

    return bind(bind(sentence_lengths(source), sums), judged)


def excess_vocabulary_log_odds() -> Column:
    """Without a lexicon there is no evidence; :func:`tessera.operators.corpus.excess_vocabulary` joins one."""
    return _struct(F.lit(False), score=F.lit(0.0))


RULES: dict[str, Callable[[], Column]] = {name: globals()[name] for name, *_ in c.COPY_RULES}


def context(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns that rules read; those it lacks are empty. A null text is empty."""
    have = set(df.columns)
    empty = {
        "headings": "array<string>", "paragraphs": "array<string>", "links": "array<struct<href:string,text:string>>",
        "attributes": "array<struct<tag:string,attr:string,value:string>>",
    }
    out = df.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({k: F.coalesce(F.col(k), F.array().cast(t)) if k in have else F.array().cast(t) for k, t in empty.items()})
    return out.withColumns({"norm": normalised(_c.text), "words": words(_c.text)}).withColumns({"low": F.lower(_c.norm), "low_text": F.lower(_c.text)})


def evidence(df: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """A struct column for each rule, beside what ``df`` (a context) has."""
    return df.withColumns({name: RULES[name]() for name in rules or RULES})
