"""From rule evidence to a score: gates, weights, co-occurrence, shared evidence, tier and grade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.text import LEAST_WORDS, MEDIUM, SHORT, english_ratio, grade, is_english, tier
from tessera.operators.copyrules import evidence

UNSCORED = ("review", "experimental", "retired")


def gates(df: DataFrame, declared: str | None = None) -> DataFrame:
    """tokens, ratio, english, non_english, short, medium, thin and the factor of statistical rules."""
    out = df.withColumn("_ratio", english_ratio(F.col("text")))
    english = is_english(F.col("_ratio.n"), F.col("_ratio.ratio"), F.col(declared) if declared else None)
    words = F.col("words")
    return out.withColumns({"tokens": F.col("_ratio.n"), "ratio": F.col("_ratio.ratio"), "english": english}).drop("_ratio").withColumns({
        "non_english": ~F.col("english") & (words >= LEAST_WORDS), "short": words < SHORT, "medium": (words >= SHORT) & (words < MEDIUM),
    }).withColumns({
        "thin": F.col("short") | F.col("non_english"), "factor": F.when(F.col("medium"), 0.5).otherwise(1.0),
    })


def scored(df: DataFrame, declared: str | None = None) -> DataFrame:
    """A context with ``flags`` (rule ids triggered), ``adjustments``, ``score``, ``tier`` and ``grade``.

    Everything is one projection of the row: no join, no exchange.
    """
    out = evidence(gates(df, declared))
    fired = {}
    for name, statistical, *_ in catalog.COPY_RULES:
        hit = F.col(f"{name}.triggered")
        fired[name] = F.when(F.col("thin"), False).otherwise(hit) if statistical else hit
    out = out.withColumn("fired", F.struct(*[v.alias(k) for k, v in fired.items()]))
    out = out.withColumn("flags", F.array_compact(F.array(*[F.when(F.col(f"fired.{k}"), k) for k in fired])))
    weights, alone = {}, []
    for name, statistical, together, weight, status, _ in catalog.COPY_RULES:
        if weight == 0 or status in UNSCORED:
            continue
        w = weight * F.col("factor") if statistical else F.lit(float(weight))
        w = F.when(F.col(f"fired.{name}"), w).otherwise(0.0)
        if together:
            only = F.col(f"fired.{name}") & (F.size("flags") <= 1)
            alone.append(F.when(only, F.lit(f"copy_co_occurrence_gate:{name}")))
            w = F.when(only, 0.0).otherwise(w)
        weights[name] = w
    # the two rules that share evidence both weigh nothing, so only the adjustment is left of the later one
    shared = F.col("fired.bare_antithesis") & F.col("fired.context_leak_copy") & F.arrays_overlap("bare_antithesis.node_ids", "context_leak_copy.node_ids")
    notes = F.array_compact(F.array(*alone, F.when(shared, "overlapping_evidence_dedup:context_leak_copy")))
    points = sum(weights.values(), F.lit(0.0))
    score = F.least(F.lit(100), F.floor(points + 0.5).cast("int"))
    return out.withColumns({"adjustments": notes, "points": points, "score": score}).withColumns(
        {"tier": tier(F.col("score"), "copy"), "grade": grade(F.col("score")), "flagged": F.size("flags")}
    )
