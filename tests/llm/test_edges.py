"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, langid, mixing, packing, pii, quality, simhash, toxicity, topk, warc
from tessera.llm.queries import tokenizer_path

CLASHES = ("h", "size", "fp", "key", "score", "label", "shard", "row", "copies", "predicted", "taken", "norm", "_tessera_row", "rank", "salt", "weight", "p", "s")
LONG = "word " * 60_000
ROWS = [
    (1, "Some plain text about mills.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, LONG, "en", "b"), (5, "Some PLAIN text about mills.", "en", "a"),
    (5, "Some PLAIN text about mills.", "en", "a"), (None, "A text without an id.", "en", "b"), (6, "   \t\n ", "en", "b"), (7, "éé üü ßß " * 30, "de", "c"), (8, "x" * 100_000, "en", "c"),
    (9, "Some plain text about mills!", None, None),
]


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    path = f"{tmp_path_factory.mktemp('messy')}/documents.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 1), (8, 0, 1), (None, 1, 1), (5, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


def stages(df, labels_path):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(df.sparkSession, df, labels_path)
    return out


@pytest.fixture(scope="module")
def labels_dir(labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_exact_dedup(messy):
    rows = exact_dedup.exact_duplicates(messy).collect()
    assert len(rows) == len(ROWS) and sum(r["kept"] for r in rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep_id"] == 5 and by[1]["group_size"] == 3 and by[2]["keep_id"] == 3 and by[3]["group_size"] == 2
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns and kept.count() == 8
    assert {r["_tessera_row"] for r in kept.collect()} == {"own _tessera_row"}


def test_simhash(messy):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[6]["component_id"] == by[3]["component_id"] == 2
    assert by[5]["component_id"] == 1 and by[None]["component_id"] is None
    kept = simhash.one_per_component(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({(r["component_id"], r["fingerprint"]) if r["doc_id"] is None else r["component_id"] for r in rows})


def test_pii(messy):
    rows = pii.personal_data(messy).collect()
    assert len(rows) == len(ROWS) and {r["spans"] for r in rows} == {""}


def test_packing(messy):
    rows = packing.pack(messy, tokenizer_path()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r["length"] == 1 for r in rows) == 3


def test_mixing(messy):
    rows = mixing.mix(messy).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, mixing.mix(messy).collect())) == sorted(map(str, rows))
    docs = mixing.mixed_documents(messy)
    assert docs.columns == messy.columns and docs.where("doc_id = 4").count() <= 3


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/ c\nd", None), (4, "u", ""), (None, "u", "y"), (5, "v", "é" * 300_000), (5, "v", "é" * 300_000)], "page_id long, url string, html string")
    rows = warc.archive_round_trip(pages.withColumn("payload", F.lit(1))).collect()
    by = {r["page_id"]: r for r in rows}
    assert len(rows) == 7 and by[2]["refers_to"] == 1 and by[4]["refers_to"] == 3 and by[5]["payload_bytes"] == 600_000 and by[None]["record_type"] == "response"


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_classifiers(messy, labels, operator):
    found = quality.quality(messy, labels) if operator == "quality" else toxicity.toxicity(messy, labels)
    rows = found.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 5]
    assert same[0] == same[1]


def test_language(messy):
    by = {r["doc_id"]: r for r in langid.language(messy).collect()}
    assert len(by) == len(ROWS) - 1 and by[2]["lang_pred"] == by[3]["lang_pred"] == by[6]["lang_pred"] == "und" and by[1]["lang_pred"] in ("en", "de")


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0])]
    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).collect())
    assert found == [(0, 1, 4), (0, 2, 4), (0, 3, 100), (100, 1, 0), (100, 2, 4), (100, 3, 4)]


def test_empty_tables(spark, messy, labels, labels_dir):
    none = messy.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = topk.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert [
        df.count() for df in (
            exact_dedup.exact_duplicates(none), simhash.near_duplicates(none), pii.personal_data(none), packing.pack(none, tokenizer_path()), mixing.mix(none),
            warc.archive_round_trip(pages), quality.quality(none, labels), toxicity.toxicity(none, labels), langid.language(none), topk.top_k(vectors, vectors),
        )
    ] == [0] * 10
    for name, df in stages(none, labels_dir).items():
        assert df.count() == 0, name


def test_stages_keep_columns(messy, labels_dir):
    found = stages(messy, labels_dir)
    for name, df in list(found.items())[:-1]:
        assert df.columns == messy.columns, name
        assert df.count() <= 3 * len(ROWS)
    assert found["exact dedup"].count() == 8


def test_no_labels(messy, labels):
    assert {r["score"] for r in quality.quality(messy, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(messy, labels.limit(0)).collect()} <= {0}
