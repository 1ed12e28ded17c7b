"""Periodic runs, whitening and chat formatting against brute force, another solver, and a reader of their own."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, runs, whitening
from tessera.llm.queries import HOSTILE, QUERIES, with_periodic_tails

SMALL = "/root/testdata/sf0.001"
CLASHES = ("runs", "words", "n", "g", "a", "p", "h", "x", "d", "component", "mixed", "part", "piece", "first", "last", "whitened")


def slow_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """start, length, period of every run: all periods, all stretches."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def slow_digest(doc_id, text: str) -> tuple:
    words, n = re.findall(r"[^\x20\x09-\x0D]+", text), len(re.findall(r"[^\x20\x09-\x0D]+", text))
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    dropped = {i for a, length, p in found for i in range(a + p, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(found), *(best if best else (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_periodic_runs_query(spark):
    """The query over its whole table against all periods of each text."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts) and got == {k: slow_digest(k, t) for k, t in texts.items()}
    assert sum(v[0] for v in got.values()) > 10


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70), st.integers(0, 60), st.integers(1, 12))
def test_runs(words, a, p):
    words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
    want = slow_runs(words)
    assert runs.main_lorentz(list(map(ord, words))) == want
    assert runs.runs_of([[b"x"], [w.encode() for w in words], [], [w.encode() for w in words]]) == [[], want, [], want]


def test_runs_of_long_and_messy_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c " * 30_000), (5, "x" * 200_000), (6, "a b c " * 30_000), (6, "a b c " * 30_000), (None, "é é " * 20), (7, "a b c d e f g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    got = sorted(runs.periodic_runs(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["n_words"] for r in got] == [0, 0, 0, 90_000, 1, 90_000, 90_000, 12, 40]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[], [], [], [(0, 90_000, 3)], [], [(0, 90_000, 3)], [(0, 90_000, 3)], [], [(0, 40, 1)]]
    assert [r["collapsed"] for r in got] == ["", "", "", "a b c", "x" * 200_000, "a b c", "a b c", "a b c d e f g h i j k l", "é"]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert with_periodic_tails(docs).count() == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(n) // 2 * 1.0)):
        a = a + a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max()) * n)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12) and np.allclose(vectors @ a, values[:, None] * vectors, atol=1e-11 * max(1, np.abs(a).max()) * n)


def slow_whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fit = np.unique(x, axis=0)
    centre = fit.mean(0)
    v = (fit - centre).T @ (fit - centre) / len(fit)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return len(fit), (x - centre) @ u[:, :16] / np.sqrt(e[:16]), e[:16] / np.trace(v)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 1_000_000
    n, want, explained = slow_whitened(x)
    sums = np.unique(x, axis=0).sum(0)
    deviations = {r["vec_id"]: int(((n * v - sums) ** 2).sum()) for r, v in zip(rows, x)}
    got = QUERIES["op12_embedding_whitening"](spark, SMALL).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.max() <= 1e-9
    for k, part in got.groupby("component"):
        own = part.whitened.to_numpy()
        other = want[np.argsort([r["vec_id"] for r in rows]), k - 1]
        assert min(np.abs(own - other).max(), np.abs(own + other).max()) < 1e-7
        assert np.allclose(part.explained, explained[k - 1], rtol=1e-9)
        assert {i: d for i, d in zip(part.vec_id, part.deviation)} == deviations


def test_whitening_of_parts_is_that_of_all(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) * 40
    df = whitening.scaled(spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], "vec_id long, embedding array<double>"))
    one, many = whitening.moments(df.coalesce(1))[5], whitening.moments(df.repartition(40), fan=3)[5]
    ints = np.array([r["x"] for r in df.collect()], np.int64)
    assert one.n == many.n == 900 and one.sums == many.sums == ints.sum(0).tolist()
    exact = (ints - ints.mean(0)).T @ (ints - ints.mean(0))
    assert np.allclose(one.products, exact, rtol=1e-12) and np.allclose(many.products, exact, rtol=1e-12)


def test_whitening_of_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(a), float(b), 0.5] for a in range(4) for b in range(5)]
    rows = [(k, v) for k, v in enumerate(good)] + [(30, None), (31, [1.0, None, 2.0]), (32, [nan, 1.0, 2.0]), (33, [1.0, -inf, 2.0]), (34, []), (35, [1.0, 2.0]), (None, good[0]), (0, good[0]), (36, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in CLASHES})
    got = whitening.whiten(df).toPandas()
    assert {(d, len(g)) for d, g in got.groupby("d")} == {(3, 22 * 3), (2, 2 * 2)}
    three = got[got.d == 3]
    # the third entry is constant: a direction without variance
    assert three[three.component == 3].whitened.isna().all() and three[three.component < 3].whitened.notna().all() and three.identity_error.max() < 1e-9
    assert set(three.n) == {20} and got.vec_id.isna().sum() == 3
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 34")).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).where("deviation is null").count() > 0


PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]", "\\", "<", "[", ">", "]", "/", "s", "\n", "é", "INST]", " a "]
CONTENT = st.lists(st.sampled_from(PARTS), max_size=6).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), CONTENT), CONTENT), max_size=6))
def test_chat_round_trip(turns):
    template = chat.Template()
    text, spans = template.format(turns)
    assert template.read(text) == turns
    assert [template.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
    # marks in the output are those of the turns: none is left inside content
    assert len(template.token.findall(text)) == sum(2 if role in template.marks else 4 for role, _ in turns)


def test_only_what_is_in_the_way_is_escaped():
    template = chat.Template()
    turns = [("user", "plain [text] </b>"), ("assistant", "ends </s> here"), ("user", "a \\ b")]
    assert template.format(turns)[0] == "[INST]plain [text] </b>[/INST]\n<s>ends <\\/s> here</s>\n[INST]a \\ b[/INST]\n"
    with pytest.raises(ValueError):
        chat.Template(name=("[INST", "[/ROLE]"))
    for broken in ("[INST]a</s>\n", "<s>a</s>", "x<s>a</s>\n", "<s>a", "[ROLE]user[/ROLE][TEXT]a[/TEXT]\n", "[ROLE]x[/ROLE]\n", "<s>a[INST]</s>\n"):
        assert template.read(broken) is None


def test_chat_pieces_and_messy_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} [INST] " * (1 + t % 3)) for t in range(400)]
    rows += [(2, 0, None, None), (2, 1, "assistant", ""), (2, None, "user", "no turn"), (None, 0, "user", "no id"), (3, 0, "user", "x" * 50_000), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), HOSTILE[0], HOSTILE[1]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in CLASHES if c not in ("a", "p")})

    def want(conv_id):
        turns = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv_id), key=lambda k: (k[0], k[1] or 0, k[2], k[3]))
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(learned), sha(learned)

    for piece in (chat.PIECE, 300):
        pieces = chat.formatted(df, piece=piece)
        assert piece > 300 or pieces.where("conv_id = 1").count() > 20
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(pieces).collect()}
        assert got == {c: want(c) for c in (1, 2, 3, None, -7)}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
