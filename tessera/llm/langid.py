"""Language identification by a convolutional network over bytes.

A text's bytes are cut into windows of fixed length. Filters of several widths
slide over a window, their maxima go to a softmax over the languages. Windows'
log probabilities are averaged over the whole text. Trained in numpy on the
driver, from a bounded sample; applied to windows in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.labelled import fitted, held_out, sample

PARTS, PART = 4, 2
#: Bounds of the fitted sample: rows of each language, windows of a text.
ROWS, SAMPLED = 600, 3
#: Rows of all languages, which share them evenly, and rows that each language has in any case.
ALL_ROWS, LEAST_ROWS = 12_000, 20
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SIZE = 8
EPOCHS = 6
BATCH = 1024
UNKNOWN = "und"
PAD = 32
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    bytes: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The bytes of a text in rows of fixed length: the last window ends with the text, a short text is padded."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= size:
        return np.pad(raw, (0, size - len(raw)), constant_values=PAD)[None]
    whole = raw[: len(raw) // size * size].reshape(-1, size)
    return whole if len(raw) % size == 0 else np.concatenate([whole, raw[None, -size:]])


class Scorer:
    """Looks up what the filters make of each byte and each pair of bytes, instead of multiplying."""

    def __init__(self, model: Model):
        self.model, self.terms = model, []
        for f in model.filters:
            single = [(model.bytes @ f[j]).astype(np.float32) for j in range(len(f))]
            terms = []
            for j in range(0, len(f) - 1, 2):
                terms.append((j, True, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)))
            if len(f) % 2:
                terms.append((len(f) - 1, False, single[-1]))
            self.terms.append(terms)

    def logits(self, block: np.ndarray) -> np.ndarray:
        block = block.astype(np.int32)
        pair = block[:, :-1] << 8 | block[:, 1:]
        pooled = []
        for terms, offset, f in zip(self.terms, self.model.offsets, self.model.filters):
            n = block.shape[1] - len(f) + 1
            z = 0
            for j, two, table in terms:
                z = z + np.take(table, (pair if two else block)[:, j : j + n], axis=0)
            pooled.append(np.maximum(z.max(1) + offset, 0))
        return np.concatenate(pooled, 1) @ self.model.weights + self.model.offset

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its probability, for each text."""
        total = np.zeros((len(texts), len(self.model.languages)))
        count = np.zeros(len(texts))
        waiting, owner, size = [], [], 0

        def settle() -> None:
            logit = self.logits(np.concatenate(waiting))
            logit -= logit.max(1, keepdims=True)
            logit -= np.log(np.exp(logit).sum(1, keepdims=True))
            who = np.concatenate(owner)
            np.add.at(total, who, logit)
            np.add.at(count, who, 1)

        for i, text in enumerate(texts):
            cut = windows(text)
            for at in range(0, len(cut), BATCH):
                part = cut[at : at + BATCH]
                waiting.append(part)
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= BATCH:
                    settle()
                    waiting, owner, size = [], [], 0
        if size:
            settle()
        mean = total / np.maximum(count, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit_network(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """Adam over batches of windows; of each filter only the place of its maximum gets a gradient."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    parts = {
        "b": rng.normal(0, 0.5, (256, SIZE)),
        **{f"f{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)) for w in WIDTHS},
        **{f"o{w}": np.zeros(FILTERS) for w in WIDTHS},
        "w": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, k)),
        "c": np.zeros(k),
    }
    first, second = ({n: np.zeros_like(v) for n, v in parts.items()} for _ in range(2))
    step, size = 0, 32
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), size):
            rows = x[order[at : at + size]]
            n, e, peaks, tops = len(rows), parts["b"][rows], [], []
            for w in WIDTHS:
                f, span = parts[f"f{w}"], WINDOW - w + 1
                z = sum(e[:, j : j + span] @ f[j] for j in range(w))
                top = z.argmax(1)
                tops.append(top)
                peaks.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + parts[f"o{w}"])
            pooled = np.maximum(np.concatenate(peaks, 1), 0)
            logit = pooled @ parts["w"] + parts["c"]
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[order[at : at + size]]] -= 1
            p /= n
            grad = {"w": pooled.T @ p, "c": p.sum(0), "b": np.zeros((256, SIZE))}
            back = p @ parts["w"].T * (pooled > 0)
            for i, (w, top) in enumerate(zip(WIDTHS, tops)):
                g, f = back[:, i * FILTERS : (i + 1) * FILTERS], parts[f"f{w}"]
                df = np.zeros_like(f)
                for j in range(w):
                    hit = np.take_along_axis(rows, top + j, 1)
                    df[j] = np.einsum("nf,nfs->sf", g, parts["b"][hit])
                    np.add.at(grad["b"], hit, g[:, :, None] * f[j].T[None])
                grad[f"f{w}"], grad[f"o{w}"] = df, g.sum(0)
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                parts[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, parts["b"], [parts[f"f{w}"] for w in WIDTHS], [parts[f"o{w}"] for w in WIDTHS], parts["w"], parts["c"])


def fit(rows: pd.DataFrame, languages: list[str]) -> Model:
    """Up to SAMPLED windows of each sampled text, spread over it."""
    x, y = [np.zeros((0, WINDOW), np.uint8)], []
    for text, label in zip(rows.text, rows.label):
        cut = windows(text)
        some = cut[np.unique(np.linspace(0, len(cut) - 1, SAMPLED).astype(int))]
        x.append(some)
        y += [label] * len(some)
    return fit_network(np.concatenate(x), np.array(y, np.int64), languages)


def train(docs: DataFrame) -> Model | None:
    """Fitted on the rows whose text has a letter, the others being ``und`` whatever is learned."""
    rows = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").alias("label"))
    ids = written(fitted(rows, PARTS, PART), "labelled")
    languages = sorted(r["label"] for r in ids.select("label").distinct().collect())
    if not languages:
        return None
    return fit(sample(rows, ids, languages, min(ROWS, max(LEAST_ROWS, ALL_ROWS // len(languages)))), languages)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    ``und`` with score 0 for a null text or one without a letter, and for all where no row
    can be learned from. Rows that repeat get equal predictions. No documents, no rows.
    Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text", "lang")))

    @F.pandas_udf("lang string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = shared.value and Scorer(shared.value)
        for texts in parts:
            out = pd.DataFrame({"lang": pd.Series([UNKNOWN] * len(texts), dtype=object), "score": np.zeros(len(texts))})
            read = np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
            if scorer and read.any():
                best, p = scorer.predict([t for t, r in zip(texts, read) if r])
                out.loc[read, "lang"] = [shared.value.languages[k] for k in best]
                out.loc[read, "score"] = p
            yield out

    rows = docs.select("doc_id", "text").withColumn("p", predicted("text"))
    return rows.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score")
