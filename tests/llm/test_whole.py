"""What once was cut short: each test holds an operator to all of its input."""

from __future__ import annotations

from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, labelled, langid, mixing, pii, quality, toxicity, warc


def test_long_texts_are_learned_from(spark):
    good = "The mill by the river grinds corn and the miller sweeps the floor each evening. "
    bad = "zq$x9 kk@@ vv##1 click!!! win$$$ qqqq 8812 zz;; "
    rows = [(k, (good if k % 2 else bad + f"{k} ") * (200 if k % 2 else 4)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert all(len(t) > 8000 for k, t in rows if k % 2)
    assert {(r["doc_id"] % 2, r["predicted"]) for r in quality.quality(docs, labels).collect()} == {(0, 0), (1, 1)}
    assert {(r["doc_id"] % 2, r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()} == {(0, 1), (1, 0)}


def test_languages_of_long_texts_are_learned(spark):
    rows = [(k, ("das ist ein haus und der garten ist schön " * 300, "de") if k % 2 else ("the house is by the garden ", "en")) for k in range(60)]
    docs = spark.createDataFrame([(k, *x) for k, x in rows], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") for r in langid.language(docs).collect())


def test_sample_replaces_what_has_no_text_and_counts_ids(spark):
    docs = spark.createDataFrame([(k, None if k % 2 else f"text {k}") for k in range(400)] + [(2, "text 2")] * 50, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = labelled.labelled_sample(docs, labels, "quality", [0, 1], 3, 1, 60)
    assert len(got) == 60 and got.text.nunique() == 60


def test_a_text_over_its_share_gives_pieces_from_all_over(spark):
    assert labelled.level(np.array([1, 5, 100, 100]), 56) == 25 and labelled.level(np.array([3, 2]), 9) == 3
    text = "a" * 4000 + "b" * 4000 + "c" * 4000
    df = spark.createDataFrame([(text,), ("short",)], "text string").select(labelled.excerpt(F.col("text"), 1536).alias("x"))
    long, short = (r["x"] for r in df.collect())
    assert short == "short" and long.split("\n") == ["a" * 512, "b" * 512, "c" * 512]
    assert {c for p in quality.pieces(text.encode(), 256) for c in p.decode()} == {"a", "b", "c"}


def test_exact_dedup_of_docs_that_are_no_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "b"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 3, 4]
    docs.write.parquet(f"{tmp_path}/d.parquet")
    read = spark.read.parquet(f"{tmp_path}/d.parquet")
    for more in (read.union(read), read.groupBy("doc_id").agg(F.max("text").alias("text"))):
        kept = exact_dedup.drop_exact_duplicates(more)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_long_urls_are_read_back(spark):
    urls = ["data:," + "x" * 100_000, "http://a/", "http://b/?" + "k:v&" * 40_000]
    pages = spark.createDataFrame([(k, u, "<p>same</p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert [rows[k]["target_uri"] for k in range(3)] == urls
    assert [rows[k]["record_type"] for k in range(3)] == ["response", "revisit", "revisit"]
    assert [warc._parse(x, 0) for x in (b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b", b"WARC/1.1\r\nA: b\r\n", b"WARC/1.1\r\n\r\n")] == [None] * 4


def test_all_languages_are_learned(spark):
    rows = [(k, f"word{k % 230} text", f"l{k % 230:03d}") for k in range(230 * 6)]
    docs = spark.createDataFrame([*rows, (-1, "12 34", "digits"), (-2, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    fit = {r["lang"] for r in docs.where(~labelled.held_out(F.col("doc_id"), langid.PARTS, langid.PART) & (F.col("doc_id") >= 0)).select("lang").distinct().collect()}
    assert len(fit) > 200 and model.languages == sorted(fit) and model.weights.shape[1] == len(fit)


@pytest.mark.parametrize("text", ["host 192dot168dot1dot7 is up", "host 192 dot168 dot1 dot7 is up", "host 10Punkt 0Punkt 0Punkt 1 up"])
def test_numbers_joined_by_words(text):
    found = pii.disguised(text, pii.detect(text))["ip"]
    assert [text[a:b] for a, b in found] == [text[5:-6] if text.endswith("is up") else text[5:-3]]


PARTS = ["one", "Nine", "fünf", "1", "192", "7", "dot", "DOT", "punkt", "punto", "at", "AT", "@", "[at]", "( dot )", ".", "plus", "+", "jo", "mill", "com", "-", " ", " ", " ", "  ", "a"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
def test_the_gate_hides_nothing(text):
    base = pii.detect(text)
    with mock.patch.object(pii, "hinted", lambda low: True):
        whole = pii.disguised(text, base)
    assert pii.disguised(text, base) == whole


@pytest.mark.parametrize("same", [False, True])
def test_rows_that_share_an_id_are_mixed_one_by_one(spark, same):
    rows = [(None if k % 3 == 0 else k, "a" if same and k % 3 == 0 else f"t{k} " * (1 + k % 4), source) for source in ("a", "b", None) for k in range(300)]
    hot = [(None, "x y" if same else f"x {k}", "c") for k in range(300)]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string, source string")
    want = {r["source"]: (r["target"], r["most"]) for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r["source"]: r["n"] for r in mixing.sized(out).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert all(abs(got.get(k, 0) - t) <= most / 2 + 1 for k, (t, most) in want.items()), (got, want)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(3)).collect()))
