"""Results as text for other tools: agent lines, annotations, JUnit, SARIF, GitLab, tab separated; and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fnv1a

#: findings(page_id, url, rule_id, status, weight, triggered, score, tier)


def xml_escape(text: Column) -> Column:
    for letter, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(letter), F.lit(entity))
    return text


def one_line(text: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def level(kind: str) -> Column:
    """How loud a finding is, in the words of each tool."""
    w, status = F.col("weight"), F.col("status")
    quiet = status.isin("review", "unknown") | (w == 0)
    if kind == "github":
        return F.when(status == "unknown", "notice").when(quiet, "warning").when(w >= 6, "error").otherwise("warning")
    if kind == "gitlab":
        return F.when(quiet, "info").when(w >= 8, "critical").when(w >= 6, "major").otherwise("minor")
    return F.when(quiet, "warning").when(w >= 6, "error").otherwise("warning")


def fingerprint(*parts: Column) -> Column:
    return F.lpad(F.lower(F.hex(fnv1a(F.concat_ws(":", *parts)))), 8, "0")


def github(findings: DataFrame) -> DataFrame:
    line = F.concat(F.lit("::"), level("github"), F.lit(" title="), F.col("rule_id"), F.lit("::"), one_line(F.concat_ws(" ", "url", F.concat(F.lit("weight "), F.col("weight")))))
    return findings.where("triggered").select("page_id", "rule_id", line.alias("line"))


def gitlab(findings: DataFrame) -> DataFrame:
    item = F.to_json(F.struct(
        F.col("rule_id").alias("check_name"), level("gitlab").alias("severity"), fingerprint(F.col("rule_id"), F.col("url")).alias("fingerprint"), F.struct(F.col("url").alias("path"), F.struct(F.lit(1).alias("begin")).alias("lines")).alias("location")
    ))
    return findings.where("triggered").select("page_id", "rule_id", item.alias("item"))


def sarif(findings: DataFrame) -> DataFrame:
    """One run per page: a JSON list of its results. A page has at most one result for each rule."""
    result = F.struct(F.col("rule_id").alias("ruleId"), level("sarif").alias("level"), F.struct(fingerprint(F.col("rule_id"), F.col("url")).alias("primary")).alias("partialFingerprints"))
    by = findings.where("triggered").groupBy("page_id", "url").agg(F.array_sort(F.collect_list(result)).alias("results"))
    return by.select("page_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct("results")).alias("runs"))).alias("sarif"))


def junit(findings: DataFrame) -> DataFrame:
    """A suite per page; rules under review or unknown are skipped, failures carry the weight."""
    skipped = F.col("status").isin("review", "unknown")
    inner = F.when(skipped, "<skipped/>").when(F.col("triggered"), F.concat(F.lit('<failure message="weight '), F.col("weight"), F.lit('"/>'))).otherwise("")
    case = F.concat(F.lit('<testcase name="'), xml_escape(F.col("rule_id")), F.lit('">'), inner, F.lit("</testcase>"))
    by = findings.groupBy("page_id", "url").agg(
        F.array_join(F.array_sort(F.collect_list(case)), "").alias("cases"), F.count(F.lit(1)).alias("tests"), F.count_if(F.col("triggered") & ~skipped).alias("failures"), F.count_if(skipped).alias("skipped")
    )
    head = F.concat(F.lit('<testsuite name="'), xml_escape(F.col("url")), F.lit('" tests="'), F.col("tests"), F.lit('" failures="'), F.col("failures"), F.lit('" skipped="'), F.col("skipped"), F.lit('">'))
    return by.select("page_id", "tests", "failures", "skipped", F.concat(head, "cases", F.lit("</testsuite>")).alias("junit"))


def agent(findings: DataFrame) -> DataFrame:
    """One line per page with score, tier and flagged rules by weight."""
    hit = F.when(F.col("triggered"), F.struct((-F.col("weight")).alias("w"), "rule_id"))
    by = findings.groupBy("page_id", "url").agg(F.first("score").alias("score"), F.first("tier").alias("tier"), F.array_sort(F.collect_list(hit)).alias("h"))
    return by.select("page_id", F.concat_ws(" ", "url", F.col("score").cast("string"), "tier", F.array_join(F.transform("h", lambda x: x["rule_id"]), ",")).alias("line"))


def tsv(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def avoid_list(rules: DataFrame, most_words: int = 120) -> DataFrame:
    """rules(page_id, rule_id, weight, advice): advice by weight until the words run out; later rules by their id alone."""
    item = F.struct((-F.col("weight")).alias("w"), "rule_id", F.coalesce("advice", "rule_id").alias("advice"))
    by = rules.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.regexp_count(x["advice"], F.lit(r"\S+"))
        full, short = acc["n"] + n <= most_words, acc["n"] + 1 <= most_words
        return F.when(full, F.struct((acc["n"] + n).alias("n"), F.concat(acc["out"], F.array(x["advice"])).alias("out"))).when(
            short, F.struct((acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(x["rule_id"])).alias("out"))).otherwise(acc)

    return by.select("page_id", F.array_join(F.aggregate("r", start, step)["out"], "; ").alias("avoid"))


def exit_code(scores: DataFrame, fail_tier: str | None = None, fail_over: int | None = None) -> DataFrame:
    """0: fine, 1: a page failed the gate, 2: a page could not be scored."""
    rank = {"Mild": ["Mild", "Heavy"], "Heavy": ["Heavy"]}
    bad = F.lit(False)
    if fail_tier:
        bad = bad | F.col("tier").isin(rank[fail_tier])
    if fail_over is not None:
        bad = bad | (F.col("score") > fail_over)
    code = F.when(F.col("score").isNull(), 2).when(bad, 1).otherwise(0)
    return scores.agg(F.max(code).alias("exit_code"), F.count_if(code == 1).alias("failed"), F.count_if(code == 2).alias("unscored"))


def write_baseline(scores: DataFrame, path: str) -> None:
    """Scored pages only: an unscored page is no baseline."""
    scores.where("score IS NOT NULL").write.mode("overwrite").parquet(path)
