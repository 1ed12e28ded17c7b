"""What large tables cost: shapes of plans and how rows are dealt, beside the same results."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import site


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_cut_into_chunks_once_to_count_them(spark):
    """Extracting pages and cutting them was most of a site's time, and was done for the counts, for the lists and for the text."""
    rows = [(f"http://{'abc'[k % 3]}.example/{k}", f"<p>The same line everywhere. Own line of page {k} here.</p>") for k in range(9)]
    cut = site.stripped(site.html_sites(spark.createDataFrame(rows, "url string, html string")))
    assert optimised(cut).count("Generate explode(array_distinct") == 1
    assert {r["text"] for r in cut.collect()} == {f"Own line of page {k} here." for k in range(9)}


@pytest.mark.parametrize("long", [0, 1000])
def test_pages_without_a_site_stay_whole(spark, monkeypatch, long):
    monkeypatch.setattr(site, "LONG", long)
    rows = [(u, f"<p>The same line everywhere. Page {k}.</p>") for k, u in enumerate([None, None, None, "http://a.b/1", "http://a.b/2", "http://c.d/"])]
    got = site.stripped(site.html_sites(spark.createDataFrame(rows, "url string, html string"))).select("url", "stripped", "text").collect()
    assert sorted((str(r["url"]), r["stripped"], r["text"]) for r in got) == [
        *[("None", 0, f"The same line everywhere. Page {k}.") for k in range(3)], ("http://a.b/1", 1, "Page 3."), ("http://a.b/2", 1, "Page 4."), ("http://c.d/", 0, "The same line everywhere. Page 5."),
    ]


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A file is cut into as many tasks as its bytes allow, but only one of them gets the rows of a row group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.sources.tables import spread

    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    rows = pa.table({"k": range(40_000), "s": [f"{k * 7919 % 40_009:x}" * 4 for k in range(40_000)]})
    pq.write_table(rows, one, row_group_size=40_000)
    pq.write_table(rows, many, row_group_size=1_000)
    by_task = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read, even = spark.read.parquet(one), spark.read.parquet(many)
        assert read.rdd.getNumPartitions() >= 8 and by_task(read) == [40_000]
        dealt = spread(read)
        assert len(by_task(dealt)) >= 4 and max(by_task(dealt)) < 12_000
        assert sorted(r["k"] for r in dealt.select("k").collect()) == list(range(40_000))
        assert spread(even) is even
        assert spread(read.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("held", [0, 200_000])
def test_only_a_lexicons_words_move(spark, monkeypatch, held):
    """Counts of every word of every text went through two shuffles to meet a lexicon of few terms; one past the bound still does."""
    from tessera.operators import corpus

    monkeypatch.setattr(corpus, "HELD", held)
    # a term that is listed twice counts twice, a document in two rows is one
    docs = spark.createDataFrame([(1, "mill wheel mill"), (1, "wheel"), (2, None), (3, "nothing of it")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("mill", 3.0), ("wheel", 4.0), ("wheel", 4.0), ("it", 2.9)], "term string, z double")
    found = corpus.excess_vocabulary(docs, lexicon, F.lit(4))
    assert sorted(map(tuple, found.collect())) == [(1, 3, 11.0, True), (1, 3, 11.0, True), (2, 0, 0.0, False), (3, 0, 0.0, False)]
    assert ("LeftSemi" in optimised(found)) == (held > 0)


def test_terms_are_counted_once(spark):
    """The totals and the terms' own rows were made of two passes over the texts."""
    from tessera.operators import corpus

    docs = spark.createDataFrame([(k, f"mill wheel{'s' * (k % 2)} river", f"s{k}") for k in range(12)], "doc_id long, text string, source string")
    odds = corpus.log_odds(docs, (F.col("doc_id") % 2).cast("int"), F.col("source"), min_z=-1e9, min_sites=0)
    odds_rows = odds.collect()
    assert {(r["term"], r["y1"], r["y0"]) for r in odds_rows} == {("mill", 6, 6), ("river", 6, 6), ("wheel", 0, 6), ("wheels", 6, 0)}
    final = odds._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Generate explode") == 1


def test_distances_are_made_once_and_by_all_cores(spark):
    """Every pair of vectors met twice, and those of a table of under 8,192 in one task."""
    from tessera.operators import corpus
    from tessera.plans.registry import queries
    from tests.conftest import SMALL

    assert "InMemoryRelation" in optimised(queries()["knn_typicality"](spark, SMALL))
    # ids that are shared are never neighbours, also where a block holds several
    rows = spark.createDataFrame([(k // 2, [float(k), float(k * k % 7)]) for k in range(1200)], "vec_id long, embedding array<float>")
    plan = optimised(corpus.typicality(rows, rows))
    assert re.search(r"pmod\(xxhash64\([^)]*\), 3\)", plan)
    got = {r["vec_id"]: r["distance"] for r in corpus.typicality(rows, rows, k=1).collect()}
    import numpy as np

    x = np.array([r["embedding"] for r in rows.collect()], float)
    z, ids = (x - x.mean(0)) / x.std(0, ddof=1), np.arange(1200) // 2
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    d[ids[:, None] == ids] = np.inf
    want = np.minimum(d.min(1)[::2], d.min(1)[1::2])
    assert len(got) == 600 and all(abs(got[k] - want[k]) < 2e-3 for k in range(600))


def test_ranks_of_one_row_group_are_made_by_all_cores(spark):
    from tessera.plans.registry import queries
    from tests.conftest import SMALL

    assert "RepartitionByExpression" in optimised(queries()["spearman"](spark, SMALL))


ODD = [
    "The mill's wheel -- the mill's wheel", "rock-'n'-roll 'tis 1990s 1990 -7- a b2 --", "", None, "İstanbul Kelvin café naïve mill\twheel\nmill", "-'-", "'", "x", "and the and the",
    "mill", "wheel the", "한글 mill \U0001f600wheel-", "the the the the the the the the", "don't-- --don't 'don't' 12-34 12'", "mill\x00wheel mill\\nwheel, the mill.", " ", "word " * 3000,
]


@pytest.mark.parametrize("held,most,least", [(1 << 24, 3, 2), (1, 3, 1), (60, 1, 1), (60, 2, 2), (60, 5, 1)])
def test_terms_move_in_rows_of_many(spark, monkeypatch, held, most, least):
    """Each occurrence of a term was a string of its own, made by interpreted functions, and each term of a task a row of the shuffle."""
    from tessera.operators import corpus, ngrams

    monkeypatch.setattr(ngrams, "AT_ONCE", held)
    docs = spark.createDataFrame([(text, (k + j) % 4 - (k % 2)) for k, text in enumerate(ODD) for j in range(3)], "text string, side int").coalesce(1)
    rows = docs.where("side IN (0, 1)")
    terms = rows.select("side", F.explode(corpus.ngrams(F.coalesce("text", F.lit("")), most)).alias("term"))
    want = [(r["term"], r["y1"], r["y0"]) for r in terms.groupBy("term").agg(F.count_if(F.col("side") == 1).alias("y1"), F.count_if(F.col("side") == 0).alias("y0")).collect()]
    got = ngrams.counted(rows, most, corpus.STOPWORDS, least).collect()
    assert sorted((r["term"], r["y1"], r["y0"]) for r in got if r["term"] is not None) == sorted(w for w in want if w[1] + w[2] >= least)
    totals = [r for r in got if r["term"] is None]
    assert [sum(r[k] for r in totals) for k in ("y1", "y0", "terms")] == [sum(w[1] for w in want), sum(w[2] for w in want), len(want)]
    odds = corpus.monroe(docs, F.col("side"), most=most)
    assert "MapInArrow" in optimised(odds) and "explode" not in optimised(odds)
    assert odds.count() == sum(w[1] + w[2] >= 2 for w in want)


def test_no_terms_no_odds(spark):
    from tessera.operators import corpus

    for rows in ([], [(None, 1), ("", 0), ("a -- 7", 1)]):
        assert corpus.monroe(spark.createDataFrame(rows, "text string, side int"), F.col("side")).collect() == []
