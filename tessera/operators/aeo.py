"""Crawler readiness from fetched responses: robots files, previews, edges, twins, policies, and the score over all checks.

Input ``fetches``: site, kind (html, search_probe, robots, md, llms), url, status, headers
(map, names in lower case), body. Everything is rows and expressions; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions.regex import total
from tessera.functions.text import rounded

#: What tells a challenge page and a denial.
CHALLENGE = r"(?i)<title>\s*Just a moment\.\.\.\s*</title>"
DENIED = r"(?i)access denied|forbidden|captcha|challenge"


def bot_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog.BOTS, "bot string, purpose string, legacy boolean, inherits string, robots_only boolean")


def robots_rules(files: DataFrame) -> DataFrame:
    """files(site, body): agent, type, pattern, line of every rule, with the group state carried by a window over lines.

    A group is a run of agent lines and the rules after them; agents that follow a rule
    start a new group. Rules before any agent line are dropped. Agents without rules are
    kept as rows of type ``agent``.
    """
    lines = files.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("site", (F.col("line") + 1).alias("line"), bare.alias("bare")).where(F.col("bare").contains(":"))
    field = F.lower(F.trim(F.substring_index("bare", ":", 1)))
    value = F.trim(F.expr("substring(bare, instr(bare, ':') + 1)"))
    rows = lines.select("site", "line", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "content-signal"))
    order = W.partitionBy("site").orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.lag("field").over(order).isNull() | (F.lag("field").over(order) != "user-agent"))
    rows = rows.withColumn("group", F.sum(starts.cast("int")).over(order))
    agents = rows.where("field = 'user-agent'").select("site", "group", F.lower("value").alias("agent")).distinct()
    rules = rows.where("field IN ('allow', 'disallow') AND group > 0").select("site", "group", F.col("field").alias("type"), F.col("value").alias("pattern"), "line")
    return agents.join(rules, ["site", "group"], "left").select("site", "agent", F.coalesce("type", F.lit("agent")).alias("type"), "pattern", "line")


def _normal(path: Column) -> Column:
    """Per cent escapes of letters, digits and ``-._~`` resolved, others in upper case."""

    def step(text: Column, escape: Column) -> Column:
        letter = F.char(F.conv(F.substring(escape, 2, 2), 16, 10).cast("int"))
        return F.replace(text, escape, F.when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.upper(escape)))

    return F.aggregate(F.array_distinct(F.regexp_extract_all(path, F.lit("%[0-9a-fA-F]{2}"), F.lit(0))), path, step)


def robots_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: ``*`` is anything, a last ``$`` the end."""
    normal = _normal(pattern)
    ends = normal.endswith("$")
    raw = F.when(ends, F.regexp_replace(normal, r"\$$", "")).otherwise(normal)
    quoted = F.regexp_replace(raw, r"([.+?^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def bot_access(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(site, path): which bot may read each. Own group, else the inherited, else ``*``; the longest match wins, allow on ties."""
    bots = bot_dim(rules.sparkSession)
    wanted = bots.select("bot", "purpose", F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.lower("bot").alias("agent")), F.struct(F.lit(2).alias("rank"), F.lower("inherits").alias("agent")), F.struct(F.lit(3).alias("rank"), F.lit("*").alias("agent"))
    )).alias("g")).select("bot", "purpose", "g.rank", "g.agent").where("agent IS NOT NULL")
    there = rules.select("site", "agent").distinct().join(F.broadcast(wanted), "agent")  # 39 bots
    group = there.groupBy("site", "bot", "purpose").agg(F.min_by("agent", "rank").alias("agent"))
    each = F.array(*[F.struct(F.lit(b).alias("bot"), F.lit(p).alias("purpose")) for b, p, *_ in catalog.BOTS])
    every = paths.withColumn("_b", F.explode(each)).select(*paths.columns, "_b.bot", "_b.purpose")
    own = every.join(group.drop("purpose"), ["site", "bot"], "left")
    live = rules.where("type <> 'agent' AND pattern <> ''").withColumn("rx", robots_regex(F.col("pattern"))).withColumn("length", F.length(_normal(F.col("pattern"))))
    hit = own.join(live, ["site", "agent"]).where(F.expr("path rlike rx"))
    best = hit.groupBy("site", "path", "bot").agg(F.max_by(F.struct("type", "pattern"), F.struct("length", (F.col("type") == "allow").alias("allow"))).alias("r"))
    return own.join(best, ["site", "path", "bot"], "left").select(
        "site", "path", "bot", "purpose", F.coalesce("agent", F.lit("*")).alias("group"), F.col("r.pattern").alias("rule"), (F.coalesce("r.type", F.lit("allow")) == "allow").alias("allowed")
    )


def bot_of(agents: DataFrame) -> DataFrame:
    """agents(user_agent): the bot whose name it holds, the longest name first."""
    bots = bot_dim(agents.sparkSession).where("NOT robots_only").select("bot", "purpose")
    hit = agents.join(F.broadcast(bots), F.lower("user_agent").contains(F.lower("bot")), "left")
    return hit.groupBy("user_agent").agg(F.max_by(F.struct("bot", "purpose"), F.length("bot")).alias("b")).select("user_agent", "b.bot", "b.purpose")


def edge_outcome(status: Column, headers: Column, body: Column, baseline: Column) -> Column:
    """What the edge did with a request: outcome and status of the check."""
    header = lambda name: F.lower(F.coalesce(F.element_at(headers, name), F.lit("")))
    price = F.coalesce(F.element_at(headers, "crawler-price"), F.element_at(headers, "x-crawler-price"), F.element_at(headers, "payment-required"))
    waf = header("x-amzn-waf-action")
    short = (F.length(baseline) >= 200) & (F.length(body) < F.length(baseline) * 0.2) & body.rlike(DENIED)
    out = lambda outcome, state: F.struct(F.lit(outcome).alias("outcome"), F.lit(state).alias("status"))
    return (
        F.when(status.isNull(), out("inconclusive", "unknown")).when((status == 202) & (waf == "challenge"), out("challenge", "fail"))
        .when((status == 405) & (waf == "captcha"), out("captcha", "fail")).when(header("cf-mitigated").contains("challenge") | body.rlike(CHALLENGE), out("challenge", "fail"))
        .when((status == 402) & price.isNotNull(), out("paid", "warn")).when(status.isin(401, 403, 451), out("blocked", "fail"))
        .when((status == 429) | (status >= 500), out("inconclusive", "unknown")).when(status.between(200, 299) & short, out("divergent-2xx", "fail"))
        .when(status.between(200, 299), out("ok", "pass")).otherwise(out("inconclusive", "unknown"))
    )


def visible_text(html: Column) -> Column:
    """Text without comments, code, drawings and templates: another reading than that of copy rules."""
    out = F.regexp_replace(html, r"<!--[\s\S]*?-->", " ")
    for tag in ("script", "style", "noscript", "svg", "template"):
        out = F.regexp_replace(out, rf"(?i)<{tag}\b[\s\S]*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def _tokens(header: Column, html: Column) -> Column:
    """(scope, token) of the robots header and of meta tags."""
    scope_of = lambda b: F.when(b == "googlebot", "google").when(b == "bingbot", "bing").when(b == "applebot", "apple").otherwise("all")
    prefix = r"(?i)^(googlebot|bingbot|applebot|robots)\s*:\s*(.*)$"

    def step(acc: Column, part: Column) -> Column:
        p = F.trim(part)
        has = p.rlike(prefix)
        scope = F.when(has, scope_of(F.lower(F.regexp_extract(p, prefix, 1)))).otherwise(acc["scope"])
        token = F.lower(F.trim(F.when(has, F.regexp_extract(p, prefix, 2)).otherwise(p)))
        return F.struct(scope.alias("scope"), F.when(token == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(scope.alias("scope"), token.alias("token"))))).alias("out"))

    start = F.struct(F.lit("all").alias("scope"), F.array().cast("array<struct<scope:string,token:string>>").alias("out"))
    of_header = F.aggregate(F.split(F.coalesce(header, F.lit("")), ","), start, step)["out"]
    metas = F.regexp_extract_all(F.substring(html, 1, 100_000), F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))

    def of_meta(tag: Column) -> Column:
        name = F.lower(F.trim(F.regexp_extract(tag, r"""(?i)\bname\s*=\s*["']([^"']+)["']""", 1)))
        content = F.regexp_extract(tag, r"""(?i)\bcontent\s*=\s*["']([^"']+)["']""", 1)
        scope = F.when(name == "robots", "all").when(name.isin("googlebot", "googlebot-news"), "google").when(name == "bingbot", "bing").when(name == "applebot", "apple")
        parts = F.filter(F.transform(F.split(content, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
        return F.when(scope.isNotNull(), F.transform(parts, lambda t: F.struct(scope.alias("scope"), t.alias("token")))).otherwise(F.array().cast("array<struct<scope:string,token:string>>"))

    return F.concat(of_header, F.flatten(F.transform(metas, of_meta)))


def previews(fetches: DataFrame) -> DataFrame:
    """site, status by engine, share under data-nosnippet, earned of 8 points, noindex."""
    html = F.coalesce("body", F.lit(""))
    rows = fetches.where("kind = 'html'").select("site", html.alias("body"), _tokens(F.element_at("headers", "x-robots-tag"), html).alias("t"))
    marked = F.regexp_extract_all("body", F.lit(r"(?i)<([a-z0-9]+)\b[^>]*\bdata-nosnippet\b[^>]*>([\s\S]*?)</\1>"), F.lit(0))
    hidden = F.aggregate(F.transform(marked, lambda m: F.length(visible_text(m))), F.lit(0), lambda a, x: a + x)
    all_ = F.length(visible_text(F.col("body")))
    rows = rows.withColumn("nosnippet_share", F.when(all_ > 0, rounded(F.least(F.lit(1.0), hidden / all_), 3)).otherwise(F.lit(0.0)))
    for engine in ("google", "bing", "apple"):
        mine = F.transform(F.filter("t", _in(engine)), lambda x: x["token"])
        sizes = F.transform(F.filter(mine, lambda t: t.rlike(r"^max-snippet\s*:\s*-?\d+$")), lambda t: F.regexp_extract(t, r"(-?\d+)$", 1).cast("long"))
        least = F.array_min(F.filter(sizes, lambda n: n >= 0))
        has = lambda *names, m=mine: F.arrays_overlap(m, F.array(*[F.lit(x) for x in names]))
        hard = F.coalesce(has("nosnippet", "none", "noindex"), F.lit(False)) | F.coalesce(least == 0, F.lit(False))
        soft = F.coalesce(least.between(1, 79), F.lit(False)) | F.coalesce(has("noarchive", "nocache"), F.lit(False))
        state = F.when(hard, "fail").when(soft, "warn")
        if engine == "google":
            state = state.when(F.col("nosnippet_share") > 0.5, "warn")
        rows = rows.withColumn(engine, state.otherwise("pass"))
    points = lambda e, w: F.when(F.col(e) == "pass", float(w)).when(F.col(e) == "warn", w / 2).otherwise(0.0)
    rows = rows.withColumn("earned", points("google", 5) + points("bing", 2) + points("apple", 1))
    noindex = F.exists("t", lambda x: (x["scope"] == "all") & x["token"].isin("noindex", "none"))
    return rows.select(
        "site", "google", "bing", "apple", "nosnippet_share", "earned", noindex.alias("noindex"),
        F.when(F.col("earned") >= 7, "pass").when(F.col("earned") >= 4, "warn").otherwise("fail").alias("status"),
    )


def _in(engine: str):
    return lambda x: x["scope"].isin("all", engine)


def injections(text: Column) -> tuple[Column, Column]:
    """How many instructions to models a text holds, and how many canaries of that kind."""
    return total(list(catalog.INJECTION.values()), text), catalog.CANARY.count(text)


def usage_policy(value: Column) -> Column:
    """train-ai, ai-use and search of a usage header: y, n or unset; and labels that aren't known."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    rx = r"^([a-z0-9_-]+)\s*=\s*([a-z0-9?]+)$"
    pairs = F.transform(F.filter(items, lambda x: x.rlike(rx)), lambda x: F.struct(F.regexp_extract(x, rx, 1).alias("k"), F.when(F.regexp_extract(x, rx, 2).isin("y", "yes", "?1", "allow"), "y").otherwise("n").alias("v")))
    last = lambda k: F.coalesce(F.element_at(F.transform(F.filter(F.concat(F.array(F.struct(F.lit(k).alias("k"), F.lit("unset").alias("v"))), pairs), lambda p: p["k"] == k), lambda p: p["v"]), -1), F.lit("unset"))
    return F.struct(
        last("train-ai").alias("train_ai"), last("ai-use").alias("ai_use"), last("search").alias("search"),
        F.transform(F.filter(pairs, lambda p: ~p["k"].isin("train-ai", "ai-use", "search")), lambda p: p["k"]).alias("unknown"),
    )


def markdown_twin(body: Column, kind: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\x{FEFF}?\s*---\r?\n[\s\S]*?\r?\n---\r?\n?", ""), r"(?i)```json\r?\n[\s\S]*?\r?\n```\s*$", "")
    bare = F.trim(bare)
    reason = F.when(F.lower(F.coalesce(kind, F.lit(""))).contains("text/html"), "html_content_type").when(bare.rlike(r"(?i)^\s*(?:<!doctype html|<html\b)"), "html_body").when(F.length(bare) < 50, "too_short")
    return F.coalesce(reason, F.lit("valid"))


def llms_file(body: Column, kind: Column) -> Column:
    text = F.trim(F.coalesce(body, F.lit("")))
    page = F.lower(F.coalesce(kind, F.lit(""))).contains("text/html") | text.rlike(r"(?i)^\s*(?:<!doctype html|<html\b)")
    return (
        F.when(page, "html_response").when(F.length(text) < 50, "too_short").when(~text.rlike(r"(?m)^#\s+\S+"), "missing_h1")
        .when(F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)")) == 0, "missing_links").otherwise("valid")
    )


def operability(html: Column) -> Column:
    """Share of buttons and links with a name, and whether a price is an empty shell."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(rf"(?i)<{t}\b[^>]*>[\s\S]*?</{t}>"), F.lit(0)) for t in ("button", "a")])
    named = F.filter(found, lambda x: x.rlike(r"""(?i)\b(?:aria-label(?:ledby)?|title)\s*=\s*["'][^"']+["']""") | (visible_text(x) != ""))
    ratio = F.when(F.size(found) > 0, rounded(F.size(named) / F.size(found), 3)).otherwise(F.lit(1.0))
    shell = html.rlike(r"""(?i)<[^>]+class\s*=\s*["'][^"']*price[^"']*["'][^>]*>\s*</[^>]+>""")
    return F.struct(F.size(found).alias("controls"), ratio.alias("named_ratio"), shell.alias("empty_price"), ((ratio >= 0.8) & ~shell).alias("healthy"))


def dates(html: Column) -> Column:
    """Days in JSON-LD and in time elements, and whether none agrees."""
    ld = F.array_distinct(F.regexp_extract_all(html, F.lit(r'"date(?:Published|Modified)"\s*:\s*"(\d{4}-\d{2}-\d{2})'), F.lit(1)))
    shown = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<time\b[^>]*datetime\s*=\s*["'](\d{4}-\d{2}-\d{2})"""), F.lit(1)))
    return F.struct(ld.alias("json_ld"), shown.alias("shown"), ((F.size(ld) > 0) & (F.size(shown) > 0) & ~F.arrays_overlap(ld, shown)).alias("mismatch"))


def json_ld(html: Column) -> Column:
    """Blocks of JSON-LD, how many parse, and how many of those say what they are."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?i)<script\b[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>"""), F.lit(1))
    parsed = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    typed = F.filter(parsed, lambda v: F.try_variant_get(v, "$['@context']", "string").isNotNull() & F.try_variant_get(v, "$['@type']", "string").isNotNull())
    return F.struct(F.size(blocks).alias("blocks"), F.size(parsed).alias("parsed"), F.size(typed).alias("typed"))


def checks(fetches: DataFrame) -> DataFrame:
    """site, check_id, status, earned: every check of every site, from one row per site of its responses."""
    kinds = ("html", "search_probe", "robots", "md", "llms")
    # of several responses of a kind one is read whole: one that succeeded, if any did
    response = F.struct(
        F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("reached"), "status",
        F.coalesce("body", F.lit("")).alias("body"), F.to_json("headers").alias("headers"),
    )
    wide = fetches.groupBy("site").agg(*[F.max(F.when(F.col("kind") == k, response)).alias(k) for k in kinds], F.max("url").alias("url"))
    headers = lambda k: F.coalesce(F.from_json(f"{k}.headers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    wide = wide.select(
        "site", "url", *[F.col(f"{k}.status").alias(f"{k}_status") for k in kinds], *[F.col(f"{k}.body").alias(f"{k}_body") for k in kinds], *[headers(k).alias(f"{k}_headers") for k in kinds],
    )
    files = fetches.where("kind = 'robots' AND status BETWEEN 200 AND 299").where(~F.coalesce("body", F.lit("")).rlike(r"(?i)^\s*<(?:!doctype|html)")).select("site", "body")
    access = bot_access(robots_rules(files), files.select("site", F.lit("/").alias("path")))
    blocked = access.where("purpose = 'search' AND NOT allowed").groupBy("site").agg(F.count(F.lit(1)).alias("blocked"))
    wide = wide.join(blocked, "site", "left").join(previews(fetches).select("site", "earned", "noindex", F.col("status").alias("preview")), "site", "left")
    h = F.element_at(F.col("html_headers"), F.lit("vary"))
    edge = edge_outcome(F.col("search_probe_status"), F.col("search_probe_headers"), F.col("search_probe_body"), F.coalesce("html_body", F.lit("")))
    reached = F.coalesce(F.col("html_status").between(200, 299), F.lit(False))
    text = visible_text(F.col("html_body"))
    state = lambda test: F.when(~reached, "na").when(test, "pass").otherwise("fail")
    robots = F.when(F.col("robots_status") >= 500, "fail").when(F.col("robots_status") >= 400, "pass").when(F.coalesce("blocked", F.lit(0)) > 0, "fail").otherwise("pass")
    content = lambda k: F.element_at(F.col(f"{k}_headers"), "content-type")
    llms = llms_file(F.col("llms_body"), content("llms"))
    alternate = F.col("html_body").rlike(r"""(?i)<link\b[^>]*type\s*=\s*["']text/markdown["'][^>]*>""")
    n_bad, _ = injections(F.coalesce(text, F.lit("")))
    policy = usage_policy(F.element_at(F.col("html_headers"), "content-usage"))
    of = {
        "html.reachable": F.when(reached, "pass").otherwise("fail"), "edge.access": F.when(F.col("search_probe_status").isNull(), "unknown").otherwise(edge["status"]),
        "robots.searchAllowed": robots, "html.indexable": state(~F.coalesce("noindex", F.lit(False))), "ai.previewControls": F.when(~reached, "na").otherwise(F.col("preview")),
        "html.serverTextCoverage": state(F.regexp_count(text, F.lit(r"\S+")) >= 15),
        "md.twin": F.when(~reached, "na").when(F.coalesce(F.col("md_status").between(200, 299), F.lit(False)) & (markdown_twin(F.col("md_body"), content("md")) == "valid"), "pass").otherwise("fail"),
        "html.linkAlternate": F.when(~reached, "na").when(alternate, F.when(F.coalesce(F.col("md_status").between(200, 299), F.lit(False)), "pass").otherwise("fail")).otherwise("na"),
        "site.llmsTxt": F.when(~F.coalesce(F.col("llms_status").between(200, 299), F.lit(False)) | (llms == "html_response"), "na").when(llms == "valid", "pass").otherwise("fail"),
        "html.vary": F.when(~reached | ~F.coalesce(F.col("md_status").between(200, 299), F.lit(False)), "na").when(F.coalesce(F.lower(h), F.lit("")).rlike(r"(?:^|,)\s*(?:accept|\*)\s*(?:,|$)"), "pass").otherwise("fail"),
        "ai.manipulation": F.when(n_bad > 0, "warn").otherwise("info"), "agent.operability": F.when(operability(F.coalesce("html_body", F.lit("")))["healthy"], "info").otherwise("warn"),
        "agent.discovery": F.when(F.col("html_body").rlike(r"(?i)webmcp|agentmap"), "pass").otherwise("info"), "ai.usagePolicy": F.when(policy["train_ai"] != "unset", "pass").otherwise("info"),
        "content.dates": F.when(dates(F.coalesce("html_body", F.lit("")))["mismatch"], "warn").otherwise("info"),
        "jsonld.hygiene": F.when(json_ld(F.coalesce("html_body", F.lit("")))["blocks"] > json_ld(F.coalesce("html_body", F.lit("")))["typed"], "warn").otherwise("info"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(v, F.lit("unknown")).alias("status")) for k, v in of.items()])
    dim = fetches.sparkSession.createDataFrame(catalog.AEO_RULES, "check_id string, weight int, severity string")
    rows = wide.select("site", "earned", F.explode(each).alias("c")).select("site", "earned", "c.check_id", "c.status").join(F.broadcast(dim), "check_id")
    got = F.when(F.col("check_id") == "ai.previewControls", F.coalesce("earned", F.lit(0.0))).when(F.col("status") == "pass", F.col("weight")).when(F.col("status") == "warn", F.col("weight") / 2).otherwise(0.0)
    return rows.select("site", "check_id", "status", "weight", "severity", got.alias("earned"))


def aeo_score(rows: DataFrame) -> DataFrame:
    """Points earned of those that apply; checks that are unknown, not applicable or informative leave the denominator."""
    applies = (F.col("weight") > 0) & ~F.col("status").isin("na", "unknown", "info")
    by = rows.groupBy("site").agg(
        F.sum(F.when(applies, F.col("weight")).otherwise(0)).alias("applicable"), F.sum(F.when(applies, F.col("earned")).otherwise(0.0)).alias("earned"),
        F.count_if(F.col("status") == "fail").alias("failed"),
    )
    score = F.when(F.col("applicable") > 0, F.floor(100 * F.col("earned") / F.col("applicable") + 0.5)).otherwise(0).cast("int")
    return by.withColumn("score", score).withColumn("tier", F.when(F.col("score") >= 80, "Eligible").when(F.col("score") >= 50, "Partially Eligible").otherwise("Restricted"))
