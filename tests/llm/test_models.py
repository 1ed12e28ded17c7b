"""Optimised scorers against plain forward passes, held-out rows against bars that no constant answer reaches, and planted disguises."""

from __future__ import annotations

import random
from unittest import mock

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import langid, packing, pii, quality, toxicity
from tessera.llm.queries import QUERIES, tokenizer_path

WORDS = "the miller grinds corn by a river der die das und mühle le moulin et la rivière el molino zxqv grob stupid".split()


def texts(n: int, seed: int, most: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, most))) for _ in range(n)]


def slow_logit(model: toxicity.Model, text: str) -> float:
    words = toxicity.words_of(text) or [""]
    x = np.zeros((len(words) + 2, toxicity.SIZE))
    for k, w in enumerate(words):
        for b in toxicity.buckets(w) if w else []:
            if b in model.rows:
                x[k] += model.embeddings[model.rows[b]]
    pooled = []
    for f, o in zip(model.filters, model.offsets):
        z = [sum(x[k + j] @ f[j] for j in range(len(f))) + o for k in range(len(words))]
        pooled.append(np.maximum(np.max(z, axis=0), 0))
    return float(np.concatenate(pooled) @ model.weights + model.offset)


def test_toxicity_scores_are_the_networks(monkeypatch):
    label = np.arange(80) % 2
    rows = pd.DataFrame({"text": [t + (" stupid grob" if y else "") for t, y in zip(texts(80, 1), label)], "label": label, "weight": 1.0})
    model = toxicity.fit(rows)
    some = [*texts(30, 2), "", " ".join(texts(40, 3)), "stupid"]
    want = [slow_logit(model, t) for t in some]
    for segment, memo in ((toxicity.SEGMENT, toxicity.MEMO), (7, 5)):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        monkeypatch.setattr(toxicity, "MEMO", memo)
        scorer = toxicity.Scorer(model)
        assert np.allclose([scorer.logit(t)[0] for t in some], want, atol=1e-4)


def slow_language(model: langid.Model, text: str) -> np.ndarray:
    total = []
    for row in langid.windows(text):
        x, pooled = model.bytes[row], []
        for f, o in zip(model.filters, model.offsets):
            z = np.array([sum(x[k + j] @ f[j] for j in range(len(f))) for k in range(len(row) - len(f) + 1)])
            pooled.append(np.maximum(z.max(0) + o, 0))
        logit = np.concatenate(pooled) @ model.weights + model.offset
        total.append(logit - logit.max() - np.log(np.exp(logit - logit.max()).sum()))
    mean = np.mean(total, 0)
    return np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()


def test_language_scores_are_the_networks(monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.fit_network(rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), np.arange(40) % 3, ["a", "b", "c"])
    some = [*texts(6, 4), "x", "é" * 700, " ".join(texts(12, 5))]
    monkeypatch.setattr(langid, "BATCH", 4)
    best, p = langid.Scorer(model).predict(some)
    want = [slow_language(model, t) for t in some]
    assert best.tolist() == [int(w.argmax()) for w in want]
    assert np.allclose(p, [w.max() for w in want], atol=1e-4)


def test_quality_is_the_difference_of_compressed_sizes(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 64)
    model = quality.Model(b"the miller grinds corn " * 30, b"zxqv zxqv 123 " * 30, 3.0, 0.5)
    some = [*texts(10, 6), "", "zxqv " * 100]

    def size(raw: bytes, dictionary: bytes) -> int:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(raw[k : k + 64])) for k in range(0, len(raw), 64))

    both = model.compressors()
    for t in some:
        raw = t.encode()
        want = (size(raw, model.bad) - size(raw, model.good)) / max(len(raw), quality.LEAST)
        assert quality.difference(t, both) == pytest.approx(want, abs=1e-3)
    assert quality.difference("zxqv 123 " * 20, both) < quality.difference("the miller grinds corn " * 8, both)
    assert model.score(np.array([0.1])) == pytest.approx(1 / (1 + np.exp(-0.8)))


def auc(label: np.ndarray, score: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize(("query", "label", "folder", "least"), [("op2_toxicity_cnn", "toxic", "sf0.1", 0.9), ("op5_compression_quality", "quality", "sf0.1", 0.9)])
def test_held_out_rows(spark, query, label, folder, least):
    """A constant answer has recall or specificity 0, and an AUC of a half."""
    at = f"/root/testdata/{folder}"
    got = QUERIES[query](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, p = got[label].to_numpy(), got["predicted"].to_numpy()
    assert min((y == 1).sum(), (y == 0).sum()) >= 10 and p[y == 1].mean() >= least and 1 - p[y == 0].mean() >= least and auc(y, got["score"].to_numpy()) >= 0.95


def test_toxicity_is_learned_by_training(spark):
    """Without a training step the same network, calibrated alike, tells nothing apart."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"), toxicity.PARTS, toxicity.PART) & F.col("text").isNotNull()).select("text", "toxic").toPandas()
    rows = toxicity.labelled_sample(docs.select("doc_id", "text"), labels, "toxic", [0, 1], toxicity.PARTS, toxicity.PART, toxicity.ROWS)

    def found(epochs: int) -> tuple[float, float]:
        with mock.patch.object(toxicity, "EPOCHS", epochs):
            model = toxicity.fit(rows)
        p = np.array([model.probability(*x) for x in zip(*toxicity.logits(model, held.text.tolist()))])
        y = held.toxic.to_numpy()
        return ((p[y == 1] >= 0.5).mean() + (p[y == 0] < 0.5).mean()) / 2, auc(y, p)

    (untrained, chance), (trained, good) = found(0), found(toxicity.EPOCHS)
    assert untrained < 0.7 and chance < 0.75 and trained > 0.93 and good > 0.97


def test_packing_comes_from_configurations(spark):
    """Most pieces are in full sequences whose places hold pieces of their own group, and there are no more sequences than best fit alone needs."""
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), tokenizer_path())
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    substituted, own = packing.substituted, []

    def watched(places, use, capacity):
        ranges = [(min(g), max(g)) for g in places if g]
        for n, items in substituted(places, use, capacity):
            own.append((n, len(items), sum(a <= x <= b for x, (a, b) in zip(sorted(items, reverse=True), sorted(ranges, reverse=True)))))
            yield n, items

    with mock.patch.object(packing, "substituted", watched):
        runs, left = packing.configured(histogram)
    large = sum(n for x, n in histogram.items() if x > packing.CAPACITY * packing.LARGE)
    assert all(sum(items) == packing.CAPACITY for _, items in runs)
    assert sum(n * k for n, k, _ in own if k > 1) >= 0.8 * sum(n for x, n in histogram.items() if packing.CAPACITY * packing.LARGE < x < packing.CAPACITY)
    assert sum(n * k for n, k, _ in own) >= 0.85 * large and all(k == hit for _, k, hit in own)
    total, alone = (sum(n for n, _ in r) for r in (packing.plan(histogram), packing._best_fit([], histogram, packing.CAPACITY)))
    assert total <= alone


def test_groups_are_of_equal_cardinality():
    groups = packing.equal_groups([(300, 5), (400, 1), (500, 9), (600, 3)], 6)
    assert groups == {300: {300: 3}, 400: {300: 2, 400: 1}, 500: {500: 9}, 600: {600: 3}}


DIGIT_WORDS = {
    "en": ("zero one two three four five six seven eight nine".split(), "dot", "at"), "de": ("null eins zwei drei vier fünf sechs sieben acht neun".split(), "punkt", "at"),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "punto", "arroba"), "fr": ("zéro un deux trois quatre cinq six sept huit neuf".split(), "point", "chez"),
}
LIKE = str.maketrans("aeopcx", "аеорсх")
WIDE = str.maketrans({**{chr(48 + k): chr(0xFF10 + k) for k in range(10)}, "@": "＠", ".": "．", "+": "＋"})
ARABIC = str.maketrans({chr(48 + k): chr(0x660 + k) for k in range(10)})


def planted(rng: random.Random) -> dict[str, list[str]]:
    """Disguises of made-up personal data, by kind."""
    out: dict[str, list[str]] = {k: [] for k in pii.KINDS}
    for words, dot, at in DIGIT_WORDS.values():
        spell = lambda s: " ".join(words[int(c)] for c in s)  # noqa: B023, E731
        for _ in range(25):
            user, host = "".join(rng.choices("abcdeopx", k=6)), "".join(rng.choices("mnrstceo", k=7))
            end = rng.choice("com org de net fr es".split())
            a, b = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (f"[{at}]", f"[{dot}]"), ("{at}", "{dot}")])
            out["email"] += [
                f"{user} {a} {host} {b} {end}", f"{user}{a}{host}{b}{end}", f"{user} at {host} dot {end}", f"{user} AT {host} DOT {end}", f"{user}@{host}.{end}".translate(LIKE),
                f"{user}@{host}.{end}".translate(WIDE), f"{user} @ {host}.{end}", f"{user[:3]}​{user[3:]}@{host}.­{end}",
            ]
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            out["ip"] += [
                f" {dot} ".join(parts), dot.join(parts), "[.]".join(parts), f" [{dot}] ".join(parts), f" {dot} ".join(map(spell, parts)), ".".join(parts).translate(WIDE), ".".join(parts).translate(ARABIC),
            ]
            card = "4" + "".join(rng.choices("0123456789", k=14))
            card += next(str(k) for k in range(10) if pii.luhn(card + str(k)))
            fours = " ".join(card[k : k + 4] for k in range(0, 16, 4))
            out["card"] += [spell(card), card.translate(WIDE), fours.translate(WIDE), fours.translate(ARABIC), "-".join(words[int(c)] for c in card), "​".join(card)]
            number = "49" + "".join(rng.choices("123456789", k=9))
            out["phone"] += [f"+{spell(number)}", f"plus {number[:2]} {number[2:5]} {number[5:]}", f"plus {spell(number)}", f"+{number[:2]} {number[2:]}".translate(WIDE), f"+{number[:2]} ({number[2:5]}) {number[5:]}".translate(ARABIC)]
    return out


def test_recall_of_planted_disguises():
    rng = random.Random(8)
    for kind, forms in planted(rng).items():
        caught = 0
        for form in forms:
            before, after = "".join(texts(1, rng.random())) + "; ", "; " + "".join(texts(1, rng.random()))
            spans = pii.disguised(before + form + after, pii.detect(before + form + after))[kind]
            caught += any(a < len(before) + len(form) and b > len(before) and b - a >= 0.8 * len(form.strip("+")) for a, b in spans)
        assert caught / len(forms) >= 0.9, (kind, caught / len(forms))


def test_clean_texts_have_no_disguises():
    for t in [*texts(300, 9), "at the mill dot the", "look at one of the two points at noon", "null und eins", "in 3 points or 2 dots"]:
        assert not any(pii.disguised(t, pii.detect(t)).values())
