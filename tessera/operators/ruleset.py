"""Rules written as JSON, checked before they run, and compiled to one aggregate over elements.

A rule has id, label, short, weight (0 to 40), maybe category, and ``detect``: ``when``, a list of
conditions that an element must all meet, maybe ``scope`` (which elements are asked) and
``trigger`` (how many must match: ``minCount``, ``minRatio``; one by default). All rules
of a set are counted in one pass, whatever their number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.color import is_purple, luminance, parse, spread

#: Categories, semantic tests, most weight, and samples of a rule.
CATEGORIES = ("fonts", "colors", "layout", "css", "images", "copy")
SEMANTIC = ("purple", "dark", "midGrey", "slopFont")
MOST_WEIGHT, SAMPLES, SAMPLE = 40, 3, 40
_SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*|\*)?((?:\.[A-Za-z0-9_-]+)*)")


def faults(rule: object) -> list[str]:
    """What is wrong with a rule; nothing if it may run."""
    if not isinstance(rule, dict):
        return ["a rule is an object"]
    out = []
    if not re.fullmatch(r"[a-z0-9_]+", str(rule.get("id") or "")):
        out.append("id: lower-case letters, digits and underscores")
    out += [f"{k}: missing" for k in ("label", "short") if not rule.get(k)]
    weight = rule.get("weight")
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not 0 <= weight <= MOST_WEIGHT:
        out.append(f"weight: a number from 0 to {MOST_WEIGHT}")
    if rule.get("category") and rule["category"] not in CATEGORIES:
        out.append("category: one of " + ", ".join(CATEGORIES))
    detect = rule.get("detect")
    if not isinstance(detect, dict):
        return [*out, "detect: missing"]
    when = detect.get("when")
    if not isinstance(when, list) or not when:
        out.append("detect.when: a list of conditions")
    else:
        out += [f"detect.when[{k}]: {f}" for k, c in enumerate(when) for f in _condition_faults(c)]
    trigger = detect.get("trigger")
    if trigger and trigger.get("minCount") is None and trigger.get("minRatio") is None:
        out.append("detect.trigger: minCount or minRatio")
    for part in (detect.get("scope") or {}).get("selector", "*").split(","):
        if not _SELECTOR.fullmatch(part.strip()) or not part.strip():
            out.append(f"detect.scope.selector: {part.strip()!r} is no tag or class")
    return out


def _condition_faults(c: object) -> list[str]:
    if not isinstance(c, dict) or not {"text", "semantic", "style"} & set(c):
        return ["text, style or semantic"]
    if c.get("semantic") and c["semantic"] not in SEMANTIC:
        return ["semantic: one of " + ", ".join(SEMANTIC)]
    out = []
    for k in ("matches", "notMatches"):
        rx = (c.get("text") or c).get(k)
        try:
            re.compile(rx or "")
        except re.error as e:
            out.append(f"{k}: {e}")
    return out


def parsed(rules: Iterable[str]) -> list[dict]:
    """Rules from JSON texts. One that can't run stops all: a broken rule must not count as one that never fires."""
    out = []
    for text in rules:
        rule = json.loads(text)
        if wrong := faults(rule):
            raise ValueError(f"rule {rule.get('id') if isinstance(rule, dict) else rule!r}: " + "; ".join(wrong))
        out.append(rule)
    names = [r["id"] for r in out]
    if len(set(names)) < len(names):
        raise ValueError("rules that share an id")
    return out


def _matches(value: Column, c: dict) -> Column:
    test = F.lit(True)
    flags = "(?i)" if "i" in (c.get("flags") or "") else ""
    if c.get("matches"):
        test = test & value.rlike(flags + c["matches"])
    if c.get("notMatches"):
        test = test & ~value.rlike(flags + c["notMatches"])
    return test


def condition(c: dict) -> Column:
    """Whether an element (text, style) meets a condition. A style that isn't declared meets none."""
    if c.get("text"):
        t, text = c["text"], F.trim(F.coalesce("text", F.lit("")))
        test = _matches(text, t)
        for k, of in (("minLen", lambda n: F.length(text) >= n), ("maxLen", lambda n: F.length(text) <= n)):
            if t.get(k) is not None:
                test = test & of(t[k])
        return test
    value = F.element_at("style", c.get("style") or "color")
    if c.get("semantic"):
        colour, family = parse(value), F.trim(F.regexp_replace(F.lower(F.split(value, ",")[0]), "[\"']", ""))
        found = {
            "purple": is_purple(colour), "dark": luminance(colour) < 0.05, "midGrey": (spread(colour) < 30) & luminance(colour).between(0.1, 0.6),
            "slopFont": F.exists(F.array(*map(F.lit, catalog.SLOP_FONTS)), lambda p: F.startswith(family, p)),
        }
        return F.coalesce(found[c["semantic"]], F.lit(False))
    test = value.isNotNull() & _matches(value, c)
    number = F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    for k, of in (
        ("equals", lambda v: value == v), ("includes", lambda v: value.contains(v)), ("oneOf", lambda v: value.isin(*v)), ("gte", lambda v: number >= v), ("lte", lambda v: number <= v),
    ):
        if c.get(k) is not None:
            test = test & of(c[k])
    return F.coalesce(test, F.lit(False))


def selected(selector: str | None) -> Column:
    """Whether an element is one of a comma-separated list of tags and classes (``p``, ``.card``, ``div.ad``)."""
    out = F.lit(False)
    for part in (selector or "*").split(","):
        tag, classes = _SELECTOR.fullmatch(part.strip()).groups()
        test = F.lit(True) if tag in (None, "*") else F.lower("tag") == tag.lower()
        for name in classes.split(".")[1:]:
            test = test & F.array_contains(F.split(F.coalesce("class_name", F.lit("")), r"\s+"), name)
        out = out | test
    return out


def applied(elements: DataFrame, rules: list[dict]) -> DataFrame:
    """page_id, rule_id, weight, total (elements asked), hits, samples (the first three texts), triggered: a row per page and rule."""
    rows, figures = elements, []
    for k, rule in enumerate(rules):
        detect = rule["detect"]
        test = F.lit(True)
        for c in detect["when"]:
            test = test & condition(c)
        inside = selected((detect.get("scope") or {}).get("selector"))
        rows = rows.withColumns({f"_in{k}": inside, f"_hit{k}": inside & test})
        shown = F.collect_list(F.when(F.col(f"_hit{k}") & (F.trim("text") != ""), F.struct("ord", F.substring(F.trim("text"), 1, SAMPLE).alias("t"))))
        figures += [F.count_if(f"_in{k}").alias(f"total{k}"), F.count_if(f"_hit{k}").alias(f"hits{k}"), F.transform(F.slice(F.array_sort(shown), 1, SAMPLES), lambda s: s["t"]).alias(f"samples{k}")]
    by = rows.groupBy("page_id").agg(*figures)
    each = []
    for k, rule in enumerate(rules):
        trigger, hits, total = rule["detect"].get("trigger") or {"minCount": 1}, F.col(f"hits{k}"), F.col(f"total{k}")
        enough = F.lit(False)
        if trigger.get("minCount") is not None:
            enough = enough | (hits >= trigger["minCount"])
        if trigger.get("minRatio") is not None:
            enough = enough | F.coalesce(F.try_divide(hits, total) >= trigger["minRatio"], F.lit(False))
        each.append(F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(float(rule["weight"])).alias("weight"), total.alias("total"), hits.alias("hits"), F.col(f"samples{k}").alias("samples"), enough.alias("triggered")))
    return by.select("page_id", F.explode(F.array(*each)).alias("r")).select("page_id", "r.*")


def rule_assertions(findings: DataFrame, asserted: dict[str, str]) -> DataFrame:
    """page_id, key, kind: triggered rules that a config names at level error (a failure) or warn (a warning); those that are off, or not named, are fine."""
    level = F.create_map(*[F.lit(x) for kv in asserted.items() for x in kv]) if asserted else F.create_map().cast("map<string,string>")
    rows = findings.where("triggered").withColumn("level", F.element_at(level, F.col("rule_id"))).where(F.col("level").isNotNull() & (F.col("level") != "off"))
    return rows.select("page_id", F.col("rule_id").alias("key"), F.when(F.col("level") == "error", "failure").otherwise("warning").alias("kind"))
