"""Views of a text and the gates that decide which rules may judge it. Built-in functions only."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.regex import SPACES, quoted

TOKEN = rf"[^{SPACES}]+"
LETTERS = r"[a-z\u00C0-\u024F\u0400-\u04FF\u0600-\u06FF]+"
SHORT, MEDIUM = 150, 300
LEAST_TOKENS, LEAST_WORDS, LEAST_RATIO = 20, 15, 0.04


@cache
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility form is one letter, those forms, and the forms of several letters.

    Built from the Unicode tables of the interpreter; letters the catalogue folds are left out.
    """
    one, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or letter in catalog.CONFUSABLES[0]:
            continue
        form = unicodedata.normalize("NFKC", letter)
        if form != letter and form:
            (one if len(form) == 1 else many)[letter] = form
    return "".join(one), "".join(one.values()), many


def normalised(text: Column) -> Column:
    """Invisible letters gone, blanks collapsed (not line ends), look-alikes folded, compatibility forms resolved.

    Forms are resolved letter by letter. Texts without a letter that changes only have their blanks collapsed.
    """
    stripped = F.regexp_replace(text, catalog.INVISIBLE, "")
    blank = F.regexp_replace(stripped, r"[ \t\u00A0\u202F]+", " ")
    one, to, many = compatibility()
    folded = F.translate(blank, catalog.CONFUSABLES[0] + one, catalog.CONFUSABLES[1] + to)
    # of the Latin letters only a few have such forms; other letters are looked up once each
    few = "".join(f"\\x{{{ord(c):X}}}" for c in many if ord(c) < 0x180)
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    strange = F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"[{few}]|[^\x{{0}}-\x{{17F}}]"), F.lit(0)))
    known = F.filter(strange, lambda c: F.element_at(table, c).isNotNull())
    wide = F.aggregate(known, folded, lambda t, c: F.replace(t, c, F.element_at(table, c)))
    may = text.rlike(changing())
    # a single blank is left alone: most are
    return F.when((F.length(text) == F.octet_length(text)) | ~may, F.regexp_replace(text, r"[ \t]{2,}|\t", " ")).otherwise(wide)


@cache
def changing() -> str:
    """A class of all letters beyond Latin, and of the Latin ones that :func:`normalised` changes."""
    one, _, many = compatibility()
    latin = sorted({c for c in catalog.CONFUSABLES[0] + one + "".join(many) + "\u00a0\u00ad" if 0x80 <= ord(c) < 0x180})
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in latin) + r"\x{180}-\x{10FFFF}]"


def sql_normalised(text: str) -> str:
    """The same for texts without compatibility letters."""
    return (
        rf"translate(regexp_replace(regexp_replace({text}, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{AD}}\x{{E0000}}-\x{{E007F}}]', '', 'g'), "
        rf"'[ \t\x{{A0}}\x{{202F}}]+', ' ', 'g'), {quoted(catalog.CONFUSABLES[0])}, {quoted(catalog.CONFUSABLES[1])})"
    )


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def words(text: Column) -> Column:
    """How many runs without white space.

    Each becomes its first letter, so that no word is made a value of its own; what Java
    doesn't take for white space is looked for first, as its class is slow.
    """
    firsts = lambda s: F.length(F.regexp_replace(text, rf"^[{s}]+|([^{s}])[^{s}]*+[{s}]*+", "$1"))
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike(f"[{SPACES.removeprefix(chr(92) + 's')}]")
    return F.when(plain, firsts(r"\s")).otherwise(firsts(SPACES))


def sql_words(text: str) -> str:
    plain = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", TOKEN)
    return f"len(regexp_extract_all({text}, {quoted(plain)}))"


def per_1000(count: Column, of: Column) -> Column:
    return F.when(of > 0, count * 1000.0 / of).otherwise(F.lit(0.0))


def rounded(x: Column, places: int = 0) -> Column:
    """Half up, the same in every engine."""
    return F.floor(x * 10.0**places + 0.5).cast("double") / 10.0**places


def sql_rounded(x: str, places: int = 0) -> str:
    return f"(floor(({x}) * {10.0**places} + 0.5)::DOUBLE / {10.0**places})"


def english_ratio(text: Column) -> Column:
    """n, how many letter tokens there are, and ratio, which share of them are English function words."""
    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        hits = F.size(F.filter(tokens, lambda t: t.isin(*catalog.FUNCTION_WORDS)))
        return F.struct(n.alias("n"), F.when(n > 0, rounded(hits / n, 3)).otherwise(F.lit(0.0)).alias("ratio"))

    return bind(F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0)), of)


SQL_LETTERS = r"[a-z\x{C0}-\x{24F}\x{400}-\x{4FF}\x{600}-\x{6FF}]+"
SQL_FUNCTION_WORDS = "[" + ", ".join(map(quoted, catalog.FUNCTION_WORDS)) + "]"


def is_english(tokens: Column, ratio: Column, declared: Column | None = None) -> Column:
    """A declared language other than English settles it; few tokens pass; else the ratio decides."""
    measured = (tokens < LEAST_TOKENS) | (ratio >= LEAST_RATIO)
    if declared is None:
        return measured
    other = declared.isNotNull() & (F.trim(declared) != "") & ~F.lower(F.trim(declared)).startswith("en")
    return F.when(other, False).otherwise(measured)


def tier(score: Column, axis: str = "design") -> Column:
    mild, heavy = catalog.TIERS[axis]
    return F.when(score.isNull(), None).when(score >= heavy, "Heavy").when(score >= mild, "Mild").otherwise("Clean")


def tier_rank(name: Column) -> Column:
    return F.when(name == "Heavy", 2).when(name == "Mild", 1).when(name == "Clean", 0)


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for most, letter in catalog.GRADES:
        out = out.when(score <= most, letter)
    return out.otherwise("F")


def sql_tier(score: str, axis: str = "design") -> str:
    mild, heavy = catalog.TIERS[axis]
    return f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} >= {heavy} THEN 'Heavy' WHEN {score} >= {mild} THEN 'Mild' ELSE 'Clean' END"


def sql_rank(name: str) -> str:
    return f"CASE {name} WHEN 'Heavy' THEN 2 WHEN 'Mild' THEN 1 WHEN 'Clean' THEN 0 END"


def sql_grade(score: str) -> str:
    steps = " ".join(f"WHEN {score} <= {most} THEN '{letter}'" for most, letter in catalog.GRADES)
    return f"CASE WHEN {score} IS NULL THEN NULL {steps} ELSE 'F' END"


def fnv1a(text: Column) -> Column:
    """The 32-bit hash of a text's code units, as a long. Meant for characters of the basic plane."""
    return F.aggregate(
        F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")),
        F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")),
    )


def sql_fnv1a(text: str) -> str:
    return (
        f"list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), "
        "lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT)"
    )


def verdict(tier_name: Column, rule_ids: Column) -> Column:
    """The sentence for a tier, picked by a hash of the tier and the sorted rule ids."""
    h = fnv1a(F.concat(tier_name, F.lit(":"), F.concat_ws(",", F.array_sort(rule_ids))))
    at = F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h)) % 4
    pools = {k: F.element_at(F.array(*[F.lit(x) for x in v]), (at + 1).cast("int")) for k, v in catalog.VERDICTS.items()}
    return F.when(tier_name == "Clean", pools["Clean"]).when(tier_name == "Heavy", pools["Heavy"]).otherwise(pools["Mild"])
