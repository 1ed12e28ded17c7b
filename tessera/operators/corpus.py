"""Corpus statistics: vocabulary contrasts, likelihood ratios, thresholds, rank correlation, neighbours, splits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.prefix import running
from tessera.functions.regex import Pattern
from tessera.functions.text import fnv1a, rounded
from tessera.operators.ngrams import counted

TERM = "[a-z]{3,}(?:-[a-z]{2,})*"
WORD = "[a-z]+(?:-[a-z]+)*"
#: Fixed value: unigrams that the calibration contrast leaves out.
STOPWORDS = "the and for with that this from your you are our all can more into have will not but out use one get any how per via".split()


#: Terms of a lexicon that go to all tasks; a larger one is joined.
HELD = 200_000


def term_counts(docs: DataFrame, terms: Column, *keys: str, only: DataFrame | None = None) -> DataFrame:
    """How often each term occurs by ``keys``. Terms are counted within the document before they are moved; only those of a small table ``only``, if there is one."""
    within = docs.select(*keys, terms.alias("terms")).select(*keys, F.explode("terms").alias("term"))
    if only is not None:
        within = within.join(F.broadcast(only.select("term")), "term", "left_semi")
    return within.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def log_odds(docs: DataFrame, side: Column, site: Column, scale: float = 10.0, least: float = 0.5, min_z: float = 3.0, min_sites: int = 3) -> DataFrame:
    """Terms that side 1 uses more than side 0: weighted log odds with an informative prior.

    ``side`` is 1 or 0, other rows are left out. A term needs a z of ``min_z`` and
    ``min_sites`` distinct sites on side 1.
    """
    known = F.array(*[F.lit(w) for w in catalog.FUNCTION_WORDS])
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: ~F.array_contains(known, t))
    rows = docs.select("text", side.alias("side"), site.alias("site")).where("side IN (0, 1)")
    counts = term_counts(rows, terms, "side", "site")
    by = counts.groupBy("term").agg(
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("y0"),
        F.count_distinct(F.when(F.col("side") == 1, F.col("site"))).alias("sites"),
    )
    # terms are counted by a column that is never below 0: all of them, by the same columns as below, so that both are made of one shuffle
    total = by.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.greatest(F.lit(1.0), F.count_if(F.col("sites") >= 0) * scale).alias("a0"))
    both = by.join(F.broadcast(total))  # a table of one row
    alpha = F.greatest(F.lit(least), (F.col("y1") + F.col("y0")) / F.greatest(F.lit(1), F.col("n1") + F.col("n0")) * F.col("a0"))
    both = both.withColumn("aw", alpha)
    parts = {}
    for k in ("1", "0"):
        parts["in" + k] = F.col("y" + k) + F.col("aw")
        parts["out" + k] = F.greatest(F.lit(0.5), F.col("n" + k) + F.col("a0") - F.col("y" + k) - F.col("aw"))
    both = both.withColumns(parts)
    delta = F.log(F.col("in1") / F.col("out1")) - F.log(F.col("in0") / F.col("out0"))
    variance = sum([1 / F.col(k) for k in ("in1", "out1", "in0", "out0")], F.lit(0.0))
    out = both.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(variance))
    return out.where((F.col("z") >= min_z) & (F.col("sites") >= min_sites)).select("term", "y1", "y0", "sites", rounded(F.col("delta"), 4).alias("delta"), rounded(F.col("z"), 3).alias("z"))


def ngrams(text: Column, most: int = 3) -> Column:
    """One to ``most`` words in a row; single words without stop words."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 '-]", " ")
    raw = F.transform(F.split(kept, " +"), lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    words = F.filter(raw, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def of(ws: Column) -> Column:
        parts, last = [F.filter(ws, lambda w: ~F.array_contains(stop, w))], ws
        for n in range(2, most + 1):
            # each sequence of n - 1 words with the word that follows it; the last one has none
            some = F.slice(last, F.lit(1), F.greatest(F.size(last) - 1, F.lit(0)))
            last = F.zip_with(some, F.slice(ws, F.lit(n), F.size(ws)), lambda a, w: F.concat(a, F.lit(" "), w))
            parts.append(last)
        return F.concat(*parts)

    return F.element_at(F.transform(F.array(words), of), 1)


def monroe(docs: DataFrame, side: Column, least: float = 0.05, min_count: int = 2, most: int = 3) -> DataFrame:
    """Log odds of words and short word sequences, with a variance of two terms."""
    rows = docs.select("text", side.alias("side")).where("side IN (0, 1)")
    by = counted(rows, most, STOPWORDS, min_count)
    total = by.where("term IS NULL").agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.sum("terms").cast("double").alias("a0"))
    both = by.where("term IS NOT NULL").join(F.broadcast(total))  # a table of one row
    both = both.withColumn("aw", F.greatest(F.lit(least), F.col("a0") * (F.col("y1") + F.col("y0")) / (F.col("n1") + F.col("n0"))))
    odds = lambda k: F.log((F.col("y" + k) + F.col("aw")) / (F.col("n" + k) + F.col("a0") - F.col("y" + k) - F.col("aw")))
    both = both.withColumn("delta", odds("1") - odds("0"))
    z = F.col("delta") / F.sqrt(1 / (F.col("y1") + F.col("aw")) + 1 / (F.col("y0") + F.col("aw")))
    return both.select("term", "y1", "y0", rounded(F.col("delta"), 4).alias("delta"), rounded(z, 4).alias("z"))


def excess_vocabulary(docs: DataFrame, lexicon: DataFrame, words: Column) -> DataFrame:
    """doc_id, matched, score, triggered: how much of a lexicon of (term, z) a text uses.

    The lexicon is made once. Up to ``HELD`` terms go to all tasks, and words that it lacks
    never move; a larger one is joined.
    """
    lexicon, small = lexicon.where("z >= 3").select("term", "z"), None
    found = lexicon.limit(HELD + 1).collect()
    if len(found) <= HELD:
        lexicon = small = F.broadcast(docs.sparkSession.createDataFrame(found, lexicon.schema))
    counts = term_counts(docs, F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)), "doc_id", only=small)
    hits = counts.join(lexicon, "term").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matched"), F.sum(F.col("n") * F.round(F.col("z") * 1000).cast("long")).alias("milli")
    )
    out = docs.select("doc_id", words.alias("words")).join(hits, "doc_id", "left").na.fill(0, ["matched", "milli"])
    score = F.when(F.col("words") > 0, rounded(F.col("milli") / 1000 / F.sqrt("words"), 3)).otherwise(F.lit(0.0))
    return out.select("doc_id", "matched", score.alias("score")).withColumn("triggered", (F.col("matched") >= 3) & (F.col("score") >= 3))


def vocabulary_drift(docs: DataFrame, period: Column, terms: list[str]) -> DataFrame:
    """Change of each term's share of documents from period 0 to period 1, for a list of terms."""
    rows = docs.select("doc_id", period.alias("period"), F.lower("text").alias("low"))
    whole = F.array_distinct(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    known = F.array(*[F.lit(t) for t in terms])
    size = rows.groupBy("period").agg(F.count(F.lit(1)).alias("docs"))
    used = rows.select("period", F.explode(F.array_intersect(whole, known)).alias("term")).groupBy("period", "term").agg(F.count(F.lit(1)).alias("n"))
    share = used.join(F.broadcast(size), "period").withColumn("share", F.col("n") / F.col("docs"))
    at = lambda p: F.coalesce(F.max(F.when(F.col("period") == p, F.col("share"))), F.lit(0.0))
    return share.groupBy("term").agg(rounded(at(0), 4).alias("before"), rounded(at(1), 4).alias("after"), rounded(at(1) - at(0), 4).alias("change"))


def likelihood_ratios(signals: DataFrame, positive: Column) -> DataFrame:
    """signals(rule_id, hit): TPR over FPR by rule with a 95 % interval; half counts where a side has no hit."""
    by = signals.groupBy("rule_id").agg(
        F.count_if(positive & F.col("hit")).alias("tp"), F.count_if(positive).alias("p"), F.count_if(~positive & F.col("hit")).alias("fp"), F.count_if(~positive).alias("n")
    )
    zero = (F.col("tp") == 0) | (F.col("fp") == 0)
    fix = lambda c, by_: F.when(zero, F.col(c) + by_).otherwise(F.col(c).cast("double"))
    by = by.withColumns({"a": fix("tp", 0.5), "b": fix("p", 1.0), "c": fix("fp", 0.5), "d": fix("n", 1.0)})
    tpr, fpr = F.col("a") / F.col("b"), F.col("c") / F.col("d")
    fine = (F.col("p") > 0) & (F.col("n") > 0)
    lr, se = tpr / fpr, F.sqrt((1 - tpr) / F.col("a") + (1 - fpr) / F.col("c"))
    log_lr = F.least(F.lit(math.log(10)), F.greatest(F.lit(-math.log(10)), F.log(lr)))
    low = F.exp(F.log(lr) - 1.96 * se)
    return by.select(
        "rule_id", "tp", "p", "fp", "n", F.when(fine, rounded(lr, 3)).alias("lr"), F.when(fine, rounded(low, 3)).alias("lower"),
        F.when(fine, rounded(F.exp(F.log(lr) + 1.96 * se), 3)).alias("upper"), F.when(fine, rounded(log_lr, 4)).alias("clipped_log"),
        F.when(fine, (rounded(lr, 3) >= 3) & (rounded(low, 3) >= 1.5)).otherwise(False).alias("promotable"),
    )


def promotion(ratios: DataFrame, rates: DataFrame) -> DataFrame:
    """``likelihood_ratios`` with rates(rule_id, before, after): the share of false alarms before and after a change; why a rule can't be promoted.

    Joined from the left: a rule without rates is judged by its ratio and interval alone.
    """
    rows = ratios.select("rule_id", "lr", "lower").join(rates, "rule_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("lr") < 3, F.lit(True)), "ratio below 3"), F.when(F.col("lower") < 1.5, "interval below 1.5"), F.when(F.col("after") > F.col("before"), "more false alarms"),
    ))
    return rows.select("rule_id", "lr", "lower", (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ", ").alias("reasons"))


def both_ends(odds: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` terms of either sign whose z is farthest from zero, numbered; each task keeps only its first."""
    up = odds.where("z > 0").orderBy(F.desc("z"), "term").limit(most).withColumn("side", F.lit(1))
    down = odds.where("z < 0").orderBy("z", "term").limit(most).withColumn("side", F.lit(0))
    place = F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("z")), "term"))
    return up.unionByName(down).withColumn("place", place).select("side", "place", "term", "z")


#: What counts as an anchor in time or number.
ANCHORS = {
    "years": Pattern(r"\b(?:19[7-9]\d|20[0-3]\d)\b"),
    "iso_dates": Pattern(r"\b20\d\d-(?:0[1-9]|1[0-2])(?:-[0-3]\d)?\b"),
    "currencies": Pattern(r"(?:[$€£¥]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s*(?:USD|EUR|GBP|JPY)\b)", ignore_case=True),
    "units": Pattern(r"\b\d+(?:\.\d+)?\s*(?:ms|ns|us|µs|s|sec|min|hr|kb|mb|gb|tb|mib|gib|hz|khz|mhz|ghz|px|rem|mm|cm|g|kg|bps|kbps|mbps|gbps|rps|qps|%)\b", ignore_case=True),
    "versions": Pattern(r"\bv?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?\b"),
}


def specificity(docs: DataFrame) -> DataFrame:
    """doc_id, words, anchors of each kind, per_100 words and an index from 0 to 1 that nears 1 at six of a hundred. Texts without a digit aren't searched."""
    text = F.coalesce("text", F.lit(""))
    found = {k: F.when(text.rlike("[0-9]"), p.count(text)).otherwise(0) for k, p in ANCHORS.items()}
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(r"\S+")).alias("words"), *[n.alias(k) for k, n in found.items()])
    total = sum((F.col(k) for k in ANCHORS), F.lit(0))
    per = F.when(F.col("words") > 0, rounded(total * 100.0 / F.col("words"), 3)).otherwise(F.lit(0.0))
    return rows.withColumn("per_100", per).withColumn("index", rounded(1 - F.exp(-F.col("per_100") / 3.0), 4))


def held_out_guard(rows: DataFrame) -> DataFrame:
    """``rows``, failing as soon as one with split ``held_out`` is read: fitted figures must not see those."""
    seen = F.assert_true(F.coalesce(F.col("split") != "held_out", F.lit(True)), F.concat(F.lit("held-out domain among rows to fit: "), F.coalesce("domain", F.lit("null"))))
    return rows.where(seen.isNull())


def order_threshold(scores: DataFrame, alpha: float) -> DataFrame:
    """The ceil((1 - alpha) n)-th smallest score, found in counts by value: no task sorts all scores."""
    counts = scores.where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    upto = running(counts, "_all", "score", "_n", "upto")
    rank = F.ceil(F.col("upto_of") * F.lit(1 - alpha))
    return upto.where(F.col("upto") >= rank).groupBy(F.col("upto_of").alias("n")).agg(F.min("score").alias("threshold"))


def ranked_with_ties(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``<col>_rank``: average ranks, from counts by value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    ranks = running(counts, "_all", col, "_n", "_upto").select(col, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"{col}_rank"))
    return df.join(ranks, col)


def rank_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pair, n and rho of each pair of columns, of the rows that have both.

    Rows are read once, in long form: counts by pair of values, then by value, are ranked, all pairs together.
    """
    each = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.explode(each).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("_n"))

    # both sides of all pairs are ranked at once
    sides = long.select(F.explode(F.array(*[F.struct(F.concat("pair", F.lit(f"|{c}")).alias("side"), F.col(c).alias("v"), F.col("_n").alias("n")) for c in "xy"])).alias("s"))
    counts = sides.groupBy("s.side", "s.v").agg(F.sum("s.n").alias("_of"))
    ranks = running(counts, "side", "v", "_of", "_upto").select("side", "v", (F.col("_upto") - (F.col("_of") - 1) / 2.0).alias("r"))
    ranked = lambda c: ranks.where(F.col("side").endswith(f"|{c}")).select(F.expr("left(side, length(side) - 2)").alias("pair"), F.col("v").alias(c), F.col("r").alias(f"_{c}"))
    n, x, y = F.col("_n"), F.col("_x"), F.col("_y")
    of = long.join(ranked("x"), ["pair", "x"]).join(ranked("y"), ["pair", "y"]).groupBy("pair").agg(
        F.sum(n).alias("n"), *[F.sum(n * v).alias(name) for name, v in (("x", x), ("y", y), ("xy", x * y), ("xx", x * x), ("yy", y * y))]
    )
    spread = lambda v: F.col("n") * F.col(v + v) - F.col(v) * F.col(v)
    rho = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread("x") * spread("y")))
    return of.select("pair", "n", rounded(rho, 4).alias("rho"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rho of the rows that have both; one row, of 0 and null if none has."""
    found = rank_correlations(df, [(a, b)])
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("rho").alias("rho"))


#: What is set against what in the report on covariates.
COVARIATES = [("design", "specificity"), ("copy", "specificity"), ("design", "colourfulness"), ("design", "edge_density"), ("design", "whitespace")]


def covariate_correlations(records: DataFrame) -> DataFrame:
    """pair, n and rho of the five pairs that scores are checked by. Scores that are missing count as 0, a rho that isn't defined is 0."""
    found = rank_correlations(records.na.fill(0, [c for c in ("design", "copy") if c in records.columns]), COVARIATES)
    return found.withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def covariate_means(records: DataFrame) -> DataFrame:
    """A row per stratum (a where it is missing): how many records, and their mean scores, anchors per 100 words and specificity."""
    mean = lambda c, places: rounded(F.avg(F.coalesce(F.col(c), F.lit(0))), places).alias(f"mean_{c}")
    return records.groupBy(F.coalesce("stratum", F.lit("a")).alias("stratum")).agg(
        F.count(F.lit(1)).alias("records"), mean("design", 2), mean("copy", 2), mean("per_100", 3), mean("specificity", 4),
    )


def scaling(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of every component over all vectors; a constant component has deviation 1.

    Summed around a first mean, so that large offsets cost no digits. One row a component comes to the driver.
    """
    parts = vectors.select(F.posexplode("embedding").alias("at", "x")).select("at", F.col("x").cast("double").alias("x"))
    rows = sorted(parts.groupBy("at").agg(F.avg("x"), F.stddev_samp("x")).collect())
    mean, sd = (np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k in (1, 2))
    return mean, np.where(np.isnan(sd) | (sd == 0), 1.0, sd)


#: Components of a block of vectors, and distances that are held at once.
BLOCK, AT_ONCE = 1 << 21, 1 << 21


def typicality(vectors: DataFrame, queries: DataFrame, k: int = 25, block: int | None = None) -> DataFrame:
    """vec_id, distance: mean distance to the k nearest of all ``vectors``, every component z-scaled over all of them.

    Blocks of queries meet blocks of references, both of some ``block`` rows (``BLOCK`` components,
    8,192 rows at least, unless it is given), dealt by a hash of id and content; there are more
    blocks of queries where the meetings wouldn't fill the cores. Of every meeting only the k nearest
    of each query go on, as one row, so a task holds two blocks, and what moves is (queries +
    references) times the other side's blocks. A query is never its own neighbour: references of the
    same vec_id, a key of the table, are left out. Rows with a null or ragged vector take no part;
    where there are under two references there is nothing to compare with.
    """
    mean, sd = scaling(vectors)
    sound = (F.size("embedding") == len(mean)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    count, asked = vectors.where(sound).count(), queries.where(sound).count()
    rows = block or max(8192, BLOCK // max(1, len(mean)))
    refs_in, queries_in = -(-max(count, 1) // rows), -(-max(asked, 1) // rows)
    queries_in = max(queries_in, min(-(-2 * vectors.sparkSession.sparkContext.defaultParallelism // refs_in), -(-asked // 512)))

    def dealt(rows: DataFrame, into: int, own: str, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(into)).cast("int")
        some = rows.where(sound & F.lit(count >= 2)).select("vec_id", "embedding", part.alias(own))
        return some.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def nearest(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"vec_id": [], "near": []})
        x, y = ((np.stack(side["embedding"].to_numpy()).astype(np.float64) - mean) / sd for side in (q, r))
        asked, ids, length, out = q["vec_id"].to_numpy(), r["vec_id"].to_numpy(), (y**2).sum(1), []
        order, twice = np.argsort(ids, kind="stable"), -2 * y.T
        first, last = (np.searchsorted(ids[order], asked, side) for side in ("left", "right"))
        last_near = min(k, len(y)) - 1
        step = max(1, AT_ONCE // len(y))
        for low in range(0, len(x), step):
            some = x[low : low + step]
            # squares: roots are taken of what is kept
            dist = some @ twice
            dist += length
            dist += (some**2).sum(1)[:, None]
            for n in np.flatnonzero(first[low : low + step] < last[low : low + step]):
                dist[n, order[first[low + n] : last[low + n]]] = np.inf
            dist.partition(last_near, axis=1)
            near = np.sqrt(np.maximum(np.sort(dist[:, : last_near + 1], axis=1), 0))
            out += [row[np.isfinite(row)] for row in near]
        return pd.DataFrame({"vec_id": q["vec_id"], "near": out})

    left = dealt(queries, queries_in, "q", "r", refs_in).groupBy("q", "r")
    right = dealt(vectors, refs_in, "r", "q", queries_in).groupBy("q", "r")
    met = left.cogroup(right).applyInPandas(nearest, "vec_id long, near array<double>")
    best = met.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + x)
    return best.where(F.size("near") > 0).select("vec_id", rounded(total / F.size("near"), 3).alias("distance"))


def typicality_ranks(distances: DataFrame, references: DataFrame) -> DataFrame:
    """``distances`` with percentile (share of ``references`` at least as far, 100: most typical) and atypicality (share at most as far).

    Ranked by distance, from counts by value: distances have three decimals, so values are few beside rows.
    """
    counts = references.groupBy("distance").agg(F.count(F.lit(1)).alias("_n"), F.lit(True).alias("_ref"))
    wanted = distances.select("distance").distinct().withColumns({"_n": F.lit(0).cast("long"), "_ref": F.lit(False)})
    by = counts.unionByName(wanted).groupBy("distance").agg(F.sum("_n").alias("_n"))
    upto, total = F.col("_upto"), F.col("_upto_of")
    share = lambda n: rounded(100 * n / total).cast("int")
    ranks = running(by.withColumn("_all", F.lit(0)), "_all", "distance", "_n", "_upto").select("distance", share(total - upto + F.col("_n")).alias("percentile"), share(upto).alias("atypicality"))
    return distances.join(ranks, "distance")


def domain_split(rows: DataFrame, seed: str = "split-v1", share: float = 0.7) -> DataFrame:
    """domain, bucket, ord, split: within (stratum, builder), domains in hash order; the first 70 % are for development. A split made elsewhere is repeated with its seed."""
    one = rows.groupBy("domain").agg(F.min(F.struct("ord", "stratum", "builder")).alias("f")).select("domain", "f.stratum", "f.builder")
    hashed = one.withColumn("h", fnv1a(F.concat(F.lit(seed + ":"), "domain")))
    bucket = W.partitionBy("stratum", "builder")
    out = hashed.withColumn("ord", F.row_number().over(bucket.orderBy("h", "domain"))).withColumn("n", F.count(F.lit(1)).over(bucket))
    dev = F.greatest(F.lit(1), F.least(F.col("n") - (F.col("n") > 1).cast("int"), F.floor(share * F.col("n") + 0.5)))
    return out.select("domain", "stratum", "builder", "h", "ord", F.when(F.col("ord") <= dev, "dev").otherwise("held_out").alias("split"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 200):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_inverse(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int) -> tuple[float, float]:
    """The exact 95 % interval of a share."""
    if n == 0:
        return 0.0, 1.0
    low = 0.0 if k == 0 else _beta_inverse(0.025, k, n - k + 1)
    high = 1.0 if k == n else _beta_inverse(0.975, k + 1, n - k)
    return math.floor(low * 1e4 + 0.5) / 1e4, math.floor(high * 1e4 + 0.5) / 1e4


def interval_of(k: Column, n: Column) -> Column:
    """The interval as a struct; for tables that are aggregated already."""

    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n)], columns=["lower", "upper"])

    return F.pandas_udf(run, "lower double, upper double")(k, n)


def co_occurrence_confidence(signals: DataFrame, ratios: DataFrame, strong: float = 3.0) -> DataFrame:
    """scan_id, tells, log_odds, confident: strong rules that fired together, their clipped log ratios added."""
    fired = signals.where("hit").join(F.broadcast(ratios.where(F.col("lr") >= strong).select("rule_id", "clipped_log")), "rule_id")
    return fired.groupBy("scan_id").agg(F.count(F.lit(1)).alias("tells"), rounded(F.sum("clipped_log"), 4).alias("log_odds")).withColumn("confident", F.col("tells") >= 2)


def watch_list(sightings: DataFrame, ratios: DataFrame) -> DataFrame:
    """sightings(rule_id, domain): candidates seen on two domains or more with a ratio of 3 or more."""
    seen = sightings.groupBy("rule_id").agg(F.count_distinct("domain").alias("domains"))
    return seen.join(F.broadcast(ratios.select("rule_id", "lr")), "rule_id").withColumn("admitted", (F.col("domains") >= 2) & (F.coalesce("lr", F.lit(0.0)) >= 3))


def confusion(rows: DataFrame) -> DataFrame:
    """expected by predicted; a failed scan has no prediction and counts as wrong."""
    return rows.groupBy("expected").agg(
        *[F.count_if(F.col("predicted") == t).alias(f"as_{t.lower()}") for t in ("Clean", "Mild", "Heavy")],
        F.count_if(F.col("predicted").isNull()).alias("failed"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("expected")).alias("right"),
    )


def paired(off: DataFrame, on: DataFrame) -> DataFrame:
    """off and on(brief_id, score, rules): the same briefs without and with a skill; change of score and of rules."""
    b = on.select("brief_id", F.col("score").alias("on_score"), F.col("rules").alias("on_rules"))
    both = off.select("brief_id", F.col("score").alias("off_score"), F.col("rules").alias("off_rules")).join(b, "brief_id")
    return both.select(
        "brief_id", "off_score", "on_score", (F.col("on_score") - F.col("off_score")).alias("delta"),
        F.array_join(F.array_sort(F.array_except("on_rules", "off_rules")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("off_rules", "on_rules")), ",").alias("removed"),
    )


def paired_rates(off: DataFrame, on: DataFrame) -> DataFrame:
    """A row per rule that either side of a brief fired: hits and rates without and with the skill, their difference and its 95 % interval.

    The interval is that of paired shares: only briefs on which the sides differ widen it. Briefs that one side lacks don't count.
    """
    b = on.select("brief_id", F.array_distinct("rules").alias("on_rules"))
    both = off.select("brief_id", F.array_distinct("rules").alias("off_rules")).join(b, "brief_id")
    total = both.agg(F.count(F.lit(1)).alias("briefs"))
    sides = both.select(F.explode(F.array_union("off_rules", "on_rules")).alias("rule_id"), "off_rules", "on_rules").select(
        "rule_id", F.expr("array_contains(off_rules, rule_id)").alias("off"), F.expr("array_contains(on_rules, rule_id)").alias("on"))
    by = sides.groupBy("rule_id").agg(F.count_if("off").alias("off_hits"), F.count_if("on").alias("on_hits"), F.count_if(F.expr("off AND NOT on")).alias("removed"), F.count_if(F.expr("on AND NOT off")).alias("added"))
    # one row
    rows = by.crossJoin(F.broadcast(total))
    n, away = F.col("briefs"), (F.col("added") - F.col("removed")) / F.col("briefs")
    half = 1.959963984540054 * F.sqrt(F.greatest(F.col("added") + F.col("removed") - F.col("briefs") * away * away, F.lit(0.0))) / n
    return rows.select("rule_id", "off_hits", "on_hits", "removed", "added", "briefs", rounded(F.col("off_hits") / n, 3).alias("off_rate"), rounded(F.col("on_hits") / n, 3).alias("on_rate"),
                       rounded(away, 3).alias("delta_rate"), rounded(away - half, 3).alias("lower"), rounded(away + half, 3).alias("upper"))
