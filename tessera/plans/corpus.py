"""Queries of corpus statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.regex import quoted
from tessera.functions.text import SQL_FUNCTION_WORDS, fnv1a, rounded, sql_fnv1a, sql_rounded, sql_words, tier, verdict, words
from tessera.operators import corpus as c
from tessera.sources.tables import SCAN_RULES, SCANS_SQL, SQL_FLAGGED, flagged, scans, spread, table

DRIFT_TERMS = ["the", "of", "and", "with", "this", "from", "that", "is", "les", "und"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).join(labels, "doc_id")


def logodds_unigram(spark: SparkSession, d: str) -> DataFrame:
    return c.log_odds(_labelled(spark, d), F.col("quality"), F.col("source"))


def logodds_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term, whatever its z."""
    return c.log_odds(_labelled(spark, d), F.col("quality"), F.col("source"), min_z=-1e9, min_sites=0)


def logodds_ngram(spark: SparkSession, d: str) -> DataFrame:
    """Texts move to their labels at every size, unsorted: labels grow with them. This deals them to all cores, too."""
    labels = table(spark, d, "labels").select("doc_id", "quality").where("quality IN (0, 1)")
    return c.monroe(table(spark, d, "documents").select("doc_id", "text").join(labels.hint("shuffle_hash"), "doc_id"), F.col("quality"))


def excess_vocab(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return c.excess_vocabulary(docs, logodds_unigram(spark, d), words(F.coalesce("text", F.lit(""))))


def _by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text", "lang"))
    return docs.where("lang IS NOT NULL").withColumn("side", F.when(F.col("lang") == "fr", 1).otherwise(0))


def logodds_french(spark: SparkSession, d: str) -> DataFrame:
    """Terms that French documents use more than others."""
    return c.log_odds(_by_language(spark, d), F.col("side"), F.col("source"))


def excess_vocab_french(spark: SparkSession, d: str) -> DataFrame:
    """How much every document uses them."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return c.excess_vocabulary(docs, logodds_french(spark, d), words(F.coalesce("text", F.lit(""))))


def vocab_drift(spark: SparkSession, d: str) -> DataFrame:
    return c.vocabulary_drift(table(spark, d, "documents").select("doc_id", "text"), (F.col("doc_id") % 2).cast("int"), DRIFT_TERMS)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(r).alias("rule_id"), (F.col("k").bitwiseAND(F.lit(1 << i)) != 0).alias("hit")) for i, r in enumerate(SCAN_RULES)])
    return scans(spark, d).select("scan_id", "domain", "score", F.explode(every).alias("s")).select("scan_id", "domain", "score", "s.rule_id", "s.hit")


def likelihood_ratio(spark: SparkSession, d: str) -> DataFrame:
    return c.likelihood_ratios(_signals(spark, d), F.col("score") >= 28)


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return c.co_occurrence_confidence(_signals(spark, d), likelihood_ratio(spark, d), 0.98)


def watch_list(spark: SparkSession, d: str) -> DataFrame:
    return c.watch_list(_signals(spark, d).where("hit").select("rule_id", "domain"), likelihood_ratio(spark, d))


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rules with the shares of false alarms in even and odd scans as those before and after."""
    mild = _signals(spark, d).where("score < 28")
    share = lambda odd: F.avg(F.when(F.col("scan_id") % 2 == odd, F.col("hit").cast("int")))
    return c.promotion(likelihood_ratio(spark, d), mild.groupBy("rule_id").agg(share(0).alias("before"), share(1).alias("after")))


def logodds_ends(spark: SparkSession, d: str) -> DataFrame:
    return c.both_ends(logodds_terms(spark, d))


def specificity(spark: SparkSession, d: str) -> DataFrame:
    return c.specificity(spread(table(spark, d, "documents")))


def order_threshold(spark: SparkSession, d: str) -> DataFrame:
    return c.order_threshold(scans(spark, d), 0.05)


def spearman(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("text", "n_chars")).select(words(F.coalesce("text", F.lit(""))).alias("words"), F.col("n_chars"))
    return c.spearman(docs, "words", "n_chars")


def knn_typicality(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against all others, with its ranks among their distances."""
    e = table(spark, d, "embeddings")
    # two numbers a vector, made once: ranks read them several times
    own = c.typicality(e, e).persist()
    return c.typicality_ranks(own, own)


def typicality_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return c.typicality(e, e).join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("farthest"))


def domain_split(spark: SparkSession, d: str) -> DataFrame:
    rows = scans(spark, d).select("domain", F.col("scan_id").alias("ord"), F.col("category").alias("stratum"), "builder")
    return c.domain_split(rows)


def verdict_fnv(spark: SparkSession, d: str) -> DataFrame:
    some = scans(spark, d).withColumn("rules", flagged(F.col("k")))
    return some.select("scan_id", fnv1a(F.col("domain")).alias("domain_hash"), verdict(F.col("tier"), F.col("rules")).alias("verdict"))


def clopper_pearson(spark: SparkSession, d: str) -> DataFrame:
    by = _signals(spark, d).groupBy("rule_id").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return by.select("rule_id", "hits", "n", c.interval_of(F.col("hits"), F.col("n")).alias("ci")).select("rule_id", "hits", "n", "ci.lower", "ci.upper")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = scans(spark, d).select(F.col("tier").alias("expected"), F.when(F.col("k") >= 5, tier(F.col("system_score"))).alias("predicted"))
    return c.confusion(rows)


def bench_pairs(spark: SparkSession, d: str) -> DataFrame:
    some = scans(spark, d).select(F.floor(F.col("scan_id") / 2).alias("brief_id"), (F.col("scan_id") % 2).alias("on"), "score", flagged(F.col("k")).alias("rules"))
    return c.paired(some.where("on = 0").drop("on"), some.where("on = 1").drop("on"))


def bench_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = bench_pairs(spark, d)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("delta").alias("delta_sum"), F.median("delta").alias("delta_median"), F.count_if(F.col("delta") < 0).alias("better"))


def bench_rule_rates(spark: SparkSession, d: str) -> DataFrame:
    some = scans(spark, d).select(F.floor(F.col("scan_id") / 2).alias("brief_id"), (F.col("scan_id") % 2).alias("on"), flagged(F.col("k")).alias("rules"))
    return c.paired_rates(some.where("on = 0").drop("on"), some.where("on = 1").drop("on"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Covariates read off the documents: specificity of the text, and numbers that its letters and its id give."""
    text = F.coalesce("text", F.lit(""))
    docs = spread(table(spark, d, "documents"))
    own = docs.select(
        "doc_id", F.col("source").alias("stratum"), F.col("doc_id") * 37 % 61, F.col("doc_id") * 17 % 23, (F.col("n_chars") % 97).alias("colourfulness"),
        F.regexp_count(text, F.lit("[.,]")).alias("edge_density"), rounded(F.regexp_count(text, F.lit(" ")) / F.greatest(F.length(text), F.lit(1)), 4).alias("whitespace"),
    ).toDF("doc_id", "stratum", "design", "copy", "colourfulness", "edge_density", "whitespace")
    return own.join(c.specificity(docs).select("doc_id", "per_100", F.col("index").alias("specificity")), "doc_id")


def covariate_correlations(spark: SparkSession, d: str) -> DataFrame:
    return c.covariate_correlations(_records(spark, d))


def covariate_means(spark: SparkSession, d: str) -> DataFrame:
    return c.covariate_means(_records(spark, d))


QUERIES = {f.__name__: f for f in (
    logodds_unigram, logodds_terms, logodds_ngram, excess_vocab, logodds_french, excess_vocab_french, vocab_drift, likelihood_ratio, promotion_gate, logodds_ends, specificity, co_occurrence, watch_list, order_threshold, spearman, knn_typicality,
    typicality_by_label, domain_split, verdict_fnv, clopper_pearson, confusion_matrix, bench_pairs, bench_report, bench_rule_rates, covariate_correlations, covariate_means,
)}
_L = "lb AS (SELECT doc_id, source, lower(coalesce(text, '')) AS low, quality AS side FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1))"
_ODDS = f"""{_L}, t AS (SELECT side, source, unnest(list_filter(regexp_extract_all(low, '{c.TERM}'), lambda x: NOT list_contains({SQL_FUNCTION_WORDS}, x))) AS term FROM lb),
y AS (SELECT term, count(*) FILTER (side = 1) AS y1, count(*) FILTER (side = 0) AS y0, count(DISTINCT source) FILTER (side = 1) AS sites FROM t GROUP BY term),
a AS (SELECT *, sum(y1) OVER () AS n1, sum(y0) OVER () AS n0, greatest(1.0, count(*) OVER () * 10.0)::DOUBLE AS a0 FROM y),
w AS (SELECT *, greatest(0.5, (y1 + y0)::DOUBLE / greatest(1, n1 + n0) * a0) AS aw FROM a),
z AS (SELECT *, ln((y1 + aw) / greatest(0.5, n1 + a0 - y1 - aw)) - ln((y0 + aw) / greatest(0.5, n0 + a0 - y0 - aw)) AS dl,
  1 / (y1 + aw) + 1 / greatest(0.5, n1 + a0 - y1 - aw) + 1 / (y0 + aw) + 1 / greatest(0.5, n0 + a0 - y0 - aw) AS var FROM w),
lo AS (SELECT term, y1, y0, sites, {sql_rounded('dl', 4)} AS delta, {sql_rounded('dl / sqrt(var)', 3)} AS z FROM z WHERE dl / sqrt(var) >= 3 AND sites >= 3)"""
_STOP = "[" + ", ".join(map(quoted, c.STOPWORDS)) + "]"
_SIG = "sg AS (SELECT scan_id, domain, score, " + "unnest([" + ", ".join(quoted(r) for r in SCAN_RULES) + "]) AS rule_id, unnest([" + ", ".join(f"(k & {1 << i}) <> 0" for i in range(len(SCAN_RULES))) + "]) AS hit FROM scans)"
_LR = f"""{SCANS_SQL}, {_SIG}, q AS (SELECT rule_id, count(*) FILTER (score >= 28 AND hit) AS tp, count(*) FILTER (score >= 28) AS p, count(*) FILTER (score < 28 AND hit) AS fp, count(*) FILTER (score < 28) AS n FROM sg GROUP BY rule_id),
v AS (SELECT *, tp + CASE WHEN tp = 0 OR fp = 0 THEN 0.5::DOUBLE ELSE 0 END AS a, p + CASE WHEN tp = 0 OR fp = 0 THEN 1.0::DOUBLE ELSE 0 END AS b,
  fp + CASE WHEN tp = 0 OR fp = 0 THEN 0.5::DOUBLE ELSE 0 END AS c, n + CASE WHEN tp = 0 OR fp = 0 THEN 1.0::DOUBLE ELSE 0 END AS d FROM q),
u AS (SELECT *, (a / b) / (c / d) AS r, sqrt((1 - a / b) / a + (1 - c / d) / c) AS se, p > 0 AND n > 0 AS fine FROM v),
lr AS (SELECT rule_id, tp, p, fp, n, CASE WHEN fine THEN {sql_rounded('r', 3)} END AS lr, CASE WHEN fine THEN {sql_rounded('exp(ln(r) - 1.96 * se)', 3)} END AS lower,
  CASE WHEN fine THEN {sql_rounded('exp(ln(r) + 1.96 * se)', 3)} END AS upper, CASE WHEN fine THEN {sql_rounded(f'least({math.log(10)!r}, greatest(-{math.log(10)!r}, ln(r)))', 4)} END AS clipped_log,
  CASE WHEN fine THEN {sql_rounded('r', 3)} >= 3 AND {sql_rounded('exp(ln(r) - 1.96 * se)', 3)} >= 1.5 ELSE false END AS promotable FROM u)"""
_VERDICTS = {k: "([" + ", ".join(map(quoted, v)) + "])" for k, v in catalog.VERDICTS.items()}
_RECORDS = f"""d AS (SELECT doc_id, source, n_chars, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words, {" + ".join(p.sql_count('text') for p in c.ANCHORS.values())} AS found FROM d),
q AS (SELECT *, CASE WHEN words > 0 THEN {sql_rounded("found * 100.0::DOUBLE / words", 3)} ELSE 0.0 END AS per_100 FROM n),
r AS (SELECT source AS stratum, doc_id * 37 % 61 AS design, doc_id * 17 % 23 AS copy, n_chars % 97 AS colourfulness, len(regexp_extract_all(text, '[.,]')) AS edge_density,
  {sql_rounded("len(regexp_extract_all(text, ' '))::DOUBLE / greatest(length(text), 1)", 4)} AS whitespace, per_100, {sql_rounded('1 - exp(-per_100 / 3.0)', 4)} AS specificity FROM q)"""
ORACLES = {
    "logodds_unigram": f"WITH {_ODDS} SELECT * FROM lo",
    "logodds_terms": f"WITH {_ODDS.replace('WHERE dl / sqrt(var) >= 3 AND sites >= 3', '')} SELECT * FROM lo",
    "logodds_ngram": f"""WITH {_L}, w AS (SELECT side, list_filter(list_transform(string_split_regex(regexp_replace(low, '[^a-z0-9 ''-]', ' ', 'g'), ' +'), lambda x: regexp_replace(x, '^[''-]+|[''-]+$', '', 'g')),
  lambda x: len(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS ws FROM lb),
t AS (SELECT side, unnest(list_concat(list_filter(ws, lambda x: NOT list_contains({_STOP}, x)), list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')),
  list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))))) AS term FROM w),
y AS (SELECT term, count(*) FILTER (side = 1) AS y1, count(*) FILTER (side = 0) AS y0 FROM t GROUP BY term),
a AS (SELECT *, sum(y1) OVER () AS n1, sum(y0) OVER () AS n0, (count(*) OVER ())::DOUBLE AS a0 FROM y),
o AS (SELECT *, greatest(0.05, a0 * (y1 + y0) / (n1 + n0)) AS aw FROM a WHERE y1 + y0 >= 2),
z AS (SELECT *, ln((y1 + aw) / (n1 + a0 - y1 - aw)) - ln((y0 + aw) / (n0 + a0 - y0 - aw)) AS dl FROM o)
SELECT term, y1, y0, {sql_rounded('dl', 4)} AS delta, {sql_rounded('dl / sqrt(1 / (y1 + aw) + 1 / (y0 + aw))', 4)} AS z FROM z""",
    "excess_vocab": f"""WITH {_ODDS}, d AS (SELECT doc_id, {sql_words("coalesce(text, '')")} AS words, regexp_extract_all(lower(coalesce(text, '')), '{c.WORD}') AS tk FROM documents),
n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tk) AS term FROM d) GROUP BY ALL),
h AS (SELECT doc_id, count(*) AS matched, sum(n * round(z * 1000)::BIGINT)::BIGINT AS milli FROM n JOIN lo USING (term) WHERE z >= 3 GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(matched, 0) AS matched, CASE WHEN words > 0 THEN {sql_rounded('coalesce(milli, 0)::DOUBLE / 1000 / sqrt(words)', 3)} ELSE 0.0 END AS score FROM d LEFT JOIN h USING (doc_id))
SELECT *, matched >= 3 AND score >= 3 AS triggered FROM s""",
    "vocab_drift": f"""WITH d AS (SELECT doc_id % 2 AS period, list_distinct(regexp_extract_all(lower(text), '{c.WORD}')) AS ws FROM documents), z AS (SELECT period, count(*) AS docs FROM d GROUP BY period),
u AS (SELECT period, term, count(*) AS n FROM d, (SELECT unnest([{', '.join(map(quoted, DRIFT_TERMS))}]) AS term) WHERE list_contains(ws, term) GROUP BY ALL),
s AS (SELECT term, coalesce(max(n::DOUBLE / docs) FILTER (period = 0), 0.0) AS b, coalesce(max(n::DOUBLE / docs) FILTER (period = 1), 0.0) AS a FROM u JOIN z USING (period) GROUP BY term)
SELECT term, {sql_rounded('b', 4)} AS before, {sql_rounded('a', 4)} AS after, {sql_rounded('a - b', 4)} AS change FROM s""",
    "likelihood_ratio": f"WITH {_LR} SELECT * FROM lr",
    "promotion_gate": f"""WITH {_LR}, f AS (SELECT rule_id, avg(hit::INT) FILTER (scan_id % 2 = 0) AS before, avg(hit::INT) FILTER (scan_id % 2 = 1) AS after FROM sg WHERE score < 28 GROUP BY rule_id),
w AS (SELECT rule_id, lr, lower, list_filter([CASE WHEN coalesce(lr < 3, true) THEN 'ratio below 3' END, CASE WHEN lower < 1.5 THEN 'interval below 1.5' END, CASE WHEN after > before THEN 'more false alarms' END], lambda x: x IS NOT NULL) AS why
  FROM lr LEFT JOIN f USING (rule_id)) SELECT rule_id, lr, lower, len(why) = 0 AS eligible, array_to_string(why, ', ') AS reasons FROM w""",
    "logodds_ends": f"""WITH {_ODDS.replace('WHERE dl / sqrt(var) >= 3 AND sites >= 3', '')}, s AS (SELECT (z > 0)::INT AS side, term, z FROM lo WHERE z <> 0)
SELECT side, row_number() OVER (PARTITION BY side ORDER BY abs(z) DESC, term) AS place, term, z FROM s QUALIFY place <= 20""",
    "specificity": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, {", ".join(f"{p.sql_count('text')} AS {k}" for k, p in c.ANCHORS.items())} FROM d),
p AS (SELECT *, CASE WHEN words > 0 THEN {sql_rounded(f"({' + '.join(c.ANCHORS)}) * 100.0::DOUBLE / words", 3)} ELSE 0.0 END AS per_100 FROM n) SELECT *, {sql_rounded('1 - exp(-per_100 / 3.0)', 4)} AS index FROM p""",
    "co_occurrence": f"""WITH {_LR} SELECT scan_id, count(*) AS tells, {sql_rounded('sum(clipped_log)', 4)} AS log_odds, count(*) >= 2 AS confident FROM sg JOIN lr USING (rule_id) WHERE hit AND lr >= 0.98 GROUP BY scan_id""",
    "watch_list": f"WITH {_LR}, s AS (SELECT rule_id, count(DISTINCT domain) AS domains FROM sg WHERE hit GROUP BY rule_id) SELECT rule_id, domains, lr, domains >= 2 AND coalesce(lr, 0) >= 3 AS admitted FROM s JOIN lr USING (rule_id)",
    "order_threshold": f"WITH {SCANS_SQL}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM scans) SELECT n, score AS threshold FROM r WHERE i = ceil(n * (1 - 0.05::DOUBLE))",
    "spearman": f"""WITH d AS (SELECT {sql_words("coalesce(text, '')")} AS a, n_chars AS b FROM documents WHERE n_chars IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM d)
SELECT count(*) AS n, {sql_rounded('corr(ra, rb)', 4)} AS rho FROM r""",
    "domain_split": f"""WITH {SCANS_SQL}, f AS (SELECT domain, arg_min(category, scan_id) AS stratum, arg_min(builder, scan_id) AS builder FROM scans GROUP BY domain),
h AS (SELECT *, {sql_fnv1a("'split-v1:' || domain")} AS h FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY stratum, builder ORDER BY h, domain) AS ord, count(*) OVER (PARTITION BY stratum, builder) AS n FROM h)
SELECT domain, stratum, builder, h, ord, CASE WHEN ord <= greatest(1, least(n - (n > 1)::INT, floor(0.7::DOUBLE * n + 0.5))) THEN 'dev' ELSE 'held_out' END AS split FROM o""",
    "verdict_fnv": f"""WITH {SCANS_SQL}, r AS (SELECT scan_id, domain, tier, {sql_fnv1a(f"tier || ':' || array_to_string(list_sort({SQL_FLAGGED}), ',')")} AS h FROM scans),
i AS (SELECT *, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4 + 1)::INT AS pos FROM r)
SELECT scan_id, {sql_fnv1a('domain')} AS domain_hash, CASE tier WHEN 'Clean' THEN {_VERDICTS['Clean']}[pos] WHEN 'Heavy' THEN {_VERDICTS['Heavy']}[pos] ELSE {_VERDICTS['Mild']}[pos] END AS verdict FROM i""",
    "confusion_matrix": f"""WITH {SCANS_SQL}, r AS (SELECT tier AS expected, CASE WHEN k >= 5 THEN CASE WHEN system_score >= 28 THEN 'Heavy' WHEN system_score >= 10 THEN 'Mild' ELSE 'Clean' END END AS predicted FROM scans)
SELECT expected, count(*) FILTER (predicted = 'Clean') AS as_clean, count(*) FILTER (predicted = 'Mild') AS as_mild, count(*) FILTER (predicted = 'Heavy') AS as_heavy,
  count(*) FILTER (predicted IS NULL) AS failed, count(*) AS n, count(*) FILTER (predicted = expected) AS "right" FROM r GROUP BY expected""",
    "bench_pairs": f"""WITH {SCANS_SQL}, s AS (SELECT scan_id // 2 AS brief_id, scan_id % 2 AS side, score, {SQL_FLAGGED} AS rules FROM scans)
SELECT a.brief_id, a.score AS off_score, b.score AS on_score, b.score - a.score AS delta, array_to_string(list_sort(list_filter(b.rules, lambda x: NOT list_contains(a.rules, x))), ',') AS added,
  array_to_string(list_sort(list_filter(a.rules, lambda x: NOT list_contains(b.rules, x))), ',') AS removed FROM s a JOIN s b USING (brief_id) WHERE a.side = 0 AND b.side = 1""",
    "bench_report": f"""WITH {SCANS_SQL}, p AS (SELECT b.score - a.score AS delta FROM scans a JOIN scans b ON b.scan_id = a.scan_id + 1 AND a.scan_id % 2 = 0)
SELECT count(*) AS pairs, sum(delta)::BIGINT AS delta_sum, quantile_cont(delta, 0.5)::DOUBLE AS delta_median, count(*) FILTER (delta < 0) AS better FROM p""",
    "bench_rule_rates": f"""WITH {SCANS_SQL}, s AS (SELECT scan_id // 2 AS brief_id, scan_id % 2 AS side, {SQL_FLAGGED} AS rules FROM scans),
b AS (SELECT brief_id, a.rules AS ro, z.rules AS rn FROM s a JOIN s z USING (brief_id) WHERE a.side = 0 AND z.side = 1), n AS (SELECT count(*) AS briefs FROM b),
e AS (SELECT ro, rn, unnest(list_distinct(list_concat(ro, rn))) AS rule_id FROM b),
g AS (SELECT rule_id, count(*) FILTER (list_contains(ro, rule_id)) AS off_hits, count(*) FILTER (list_contains(rn, rule_id)) AS on_hits,
  count(*) FILTER (list_contains(ro, rule_id) AND NOT list_contains(rn, rule_id)) AS removed, count(*) FILTER (list_contains(rn, rule_id) AND NOT list_contains(ro, rule_id)) AS added FROM e GROUP BY rule_id),
h AS (SELECT *, (added - removed)::DOUBLE / briefs AS away FROM g, n),
k AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(greatest(added + removed - briefs * away * away, 0)) / briefs AS half FROM h)
SELECT rule_id, off_hits, on_hits, removed, added, briefs, {sql_rounded('off_hits::DOUBLE / briefs', 3)} AS off_rate, {sql_rounded('on_hits::DOUBLE / briefs', 3)} AS on_rate,
  {sql_rounded('away', 3)} AS delta_rate, {sql_rounded('away - half', 3)} AS lower, {sql_rounded('away + half', 3)} AS upper FROM k""",
    "covariate_correlations": f"""WITH {_RECORDS}, p AS ({" UNION ALL ".join(f"SELECT '{a}_vs_{b}' AS pair, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM r" for a, b in c.COVARIATES)}),
k AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0::DOUBLE AS ry
  FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT pair, count(*) AS n, coalesce({sql_rounded('CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END', 4)}, 0) AS rho FROM k GROUP BY pair""",
    "covariate_means": f"""WITH {_RECORDS} SELECT coalesce(stratum, 'a') AS stratum, count(*) AS records, {sql_rounded('avg(design)', 2)} AS mean_design, {sql_rounded('avg(copy)', 2)} AS mean_copy,
  {sql_rounded('avg(per_100)', 3)} AS mean_per_100, {sql_rounded('avg(specificity)', 4)} AS mean_specificity FROM r GROUP BY 1""",
}
_FRENCH = "lb AS (SELECT doc_id, source, lower(coalesce(text, '')) AS low, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS side FROM documents WHERE lang IS NOT NULL)"
ORACLES |= {"logodds_french": ORACLES["logodds_unigram"].replace(_L, _FRENCH), "excess_vocab_french": ORACLES["excess_vocab"].replace(_L, _FRENCH)}
