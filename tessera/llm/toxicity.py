"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of the embeddings of itself and its beginnings, each in the
bucket of its hash. Filters of several widths slide over a text, their maxima
over the whole text enter a logistic unit. All of it starts at random and is trained
in numpy on the driver, in batches, from a bounded sample. Thresholds are calibrated by language, guessed
from a text's own function words, and moved to 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, labelled_sample
from tessera.llm.quality import fit_logistic

PARTS, PART = 5, 0
#: Bound of the fitted sample: rows of each label.
ROWS = 2000
BUCKETS = 1 << 24
SIZE = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
#: A bucket is trained if so many sampled texts reach it; others are zero.
SEEN = 10
BEGINNINGS = range(3, 10)
#: Passes over the sample, texts of a step, step width, and the share of pooled features left out of a step.
EPOCHS, BATCH, RATE, DROPPED = 6, 8, 0.05, 0.2
#: What a number's squared gradients sum to before the first: buckets that few texts move stay near where they began.
START = 1e-2
#: Words of a text scored at once, and words a worker remembers.
SEGMENT, MEMO = 16384, 150_000
#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for with on as are this by from have not be at",
    "fr": "le la les des du et est un une dans que qui pour par sur au aux avec ce il",
    "de": "der die das und ist ein eine nicht mit den von zu im auf für dem sich als auch des",
    "es": "el los las una del y en es que por con para su al lo como más pero se",
    "it": "il lo gli di che è un una per non con del della sono nel alla",
    "pt": "o os as um uma do da dos das em não com para por que se ao",
    "nl": "de het een en van is niet op te dat met voor zijn er aan",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_TONGUE = {w: [k for k, v in enumerate(FUNCTION_WORDS.values()) if w in v.split()] for v in FUNCTION_WORDS.values() for w in v.split()}
_LETTERS = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> list[int]:
    """The buckets of a word's beginnings and of the word: the running CRC of its letters, and that of its end."""
    crc, out = 0, []
    for k, letter in enumerate(word, 1):
        crc = zlib.crc32(letter.encode("utf-8", "surrogatepass"), crc)
        if k in BEGINNINGS:
            out.append(crc % BUCKETS)
    out.append(zlib.crc32(b">", crc) % BUCKETS)
    return out


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def tongue(votes: np.ndarray) -> int:
    return int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1


@dataclass
class Model:
    rows: dict[int, int]
    embeddings: np.ndarray
    #: By width: width x SIZE x FILTERS, and the filters' offsets.
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    #: By language: the logit at which a text counts as toxic.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def probability(self, logit: float, language: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (logit - self.thresholds[language]), -500, 500))))


class Scorer:
    """Scores texts, remembering for each word what every filter makes of it at each place."""

    def __init__(self, model: Model):
        self.model = model
        table = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)
        self.parts = (model.embeddings @ table).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        """Number 0 is no word: what follows the last one."""
        self.seen: dict[str, int] = {"": 0}
        self.made = np.zeros((4096, self.parts.shape[1]), np.float32)
        self.votes = np.zeros((4096, len(FUNCTION_WORDS)), np.int8)

    def learn(self, words: list[str]) -> None:
        first = len(self.seen)
        while first + len(words) > len(self.made):
            self.made, self.votes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.made, self.votes))
        rows, flat, starts = self.model.rows, [], []
        for k, word in enumerate(words, first):
            self.seen[word] = k
            got = [rows[b] for b in buckets(word) if b in rows]
            if got:
                starts.append((k, len(flat)))
                flat += got
            for t in _TONGUE.get(word, ()):
                self.votes[k, t] = 1
        if flat:
            at, begin = np.array(starts).T
            self.made[at] = np.add.reduceat(self.parts[flat], begin, axis=0)

    def logit(self, text: str) -> tuple[float, int]:
        if len(self.seen) > MEMO:
            self.reset()
        words = words_of(text)
        self.learn([w for w in dict.fromkeys(words) if w not in self.seen])
        reach = max(WIDTHS) - 1
        numbers = np.zeros(max(len(words), 1) + reach, np.int64)
        numbers[: len(words)] = list(map(self.seen.__getitem__, words))
        best = [np.full(FILTERS, -np.inf) for _ in WIDTHS]
        votes = np.zeros(len(FUNCTION_WORDS), np.int64)
        for at in range(0, len(numbers) - reach, SEGMENT):
            own = numbers[at : at + SEGMENT + reach]
            n, column, made = len(own) - reach, 0, self.made[own]
            votes += self.votes[own[:n]].sum(0, dtype=np.int64)
            for k, width in enumerate(WIDTHS):
                total = made[:n, column : column + FILTERS]
                for j in range(1, width):
                    c = column + j * FILTERS
                    total = total + made[j : j + n, c : c + FILTERS]
                column += width * FILTERS
                best[k] = np.maximum(best[k], total.max(0))
        pooled = np.concatenate([np.maximum(b + o, 0) for b, o in zip(best, self.model.offsets)])
        return float(pooled @ self.model.weights + self.model.offset), tongue(votes)


class Sample:
    """Texts as numbers of words, every word's buckets, and the distinct buckets of every text."""

    def __init__(self, texts: list[str]):
        number = {"": 0}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in words_of(t)] or [0], np.int64) for t in texts]
        lists = [[], *(buckets(w) for w in list(number)[1:])]
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.buckets = np.fromiter(chain.from_iterable(lists), np.int64, int(self.counts.sum()))
        self.reached = [np.unique(self.buckets[_spread(self.counts, np.unique(t))[0]]) for t in self.texts]
        votes = np.zeros((len(number), len(FUNCTION_WORDS)), np.int64)
        for word, tongues in _TONGUE.items():
            if word in number:
                votes[number[word], tongues] = 1
        self.languages = np.array([tongue(votes[t].sum(0)) for t in self.texts], np.int64)


def _spread(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of these words stand in lists of so many entries each, laid end to end; and how many each has."""
    n = counts[words]
    first = (np.cumsum(counts) - counts)[words]
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def _start(sample: Sample, chosen: np.ndarray, rng: np.random.Generator) -> Model:
    """A network before training: a row for every bucket that enough of the chosen texts reach, and random numbers everywhere."""
    found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(sample.reached[i] for i in chosen)]), return_counts=True)
    rows = {b: k for k, b in enumerate(found[n >= SEEN].tolist())}
    filters = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)) for w in WIDTHS]
    # half of the filters speak for either label
    signs = np.tile(np.where(np.arange(FILTERS) % 2, -1.0, 1.0), len(WIDTHS))
    return Model(rows, rng.normal(0, 0.1, (len(rows), SIZE)), filters, [np.zeros(FILTERS) for _ in WIDTHS], signs * 0.3)


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name, array: np.ndarray, gradient: np.ndarray, at=...) -> None:
        if name not in self.sums:
            self.sums[name] = np.full(array.shape, START)
        total = self.sums[name]
        total[at] += gradient**2
        array[at] -= self.rate * gradient / np.sqrt(total[at])


class _Batch:
    """Texts side by side, with places that hold no word after each: which words they have, and the rows of each."""

    def __init__(self, texts: list[np.ndarray], rows: np.ndarray, counts: np.ndarray):
        gap = np.zeros(max(WIDTHS) - 1, np.int64)
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes + len(gap)) - self.sizes - len(gap)
        #: By place its word, 0 for none.
        words, self.places = np.unique(np.concatenate([x for t in texts for x in (t, gap)]), return_inverse=True)
        at, self.counts = _spread(counts, words)
        self.rows = rows[at]
        self.filled = np.flatnonzero(self.counts)
        self.begin = (np.cumsum(self.counts) - self.counts)[self.filled]
        self.owner = np.repeat(np.arange(len(words)), self.counts)

    def embedded(self, table: np.ndarray) -> np.ndarray:
        words = np.zeros((len(self.counts), SIZE))
        if len(self.filled):
            words[self.filled] = np.add.reduceat(table[self.rows], self.begin, axis=0)
        return words


def _peaks(model: Model, batch: _Batch, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text and filter the maximum over the text, with the filter's offset, and the place of it."""
    tops, peaks = [], []
    for f, o in zip(model.filters, model.offsets):
        z = sum(x[j : len(x) - len(f) + 1 + j] @ f[j] for j in range(len(f)))
        top = np.stack([a + z[a : a + m].argmax(0) for a, m in zip(batch.starts.tolist(), batch.sizes.tolist())])
        tops.append(top)
        peaks.append(np.take_along_axis(z, top, 0) + o)
    return np.maximum(np.concatenate(peaks, axis=1), 0), tops


def _step(model: Model, ada: _Adagrad, batch: _Batch, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    words = batch.embedded(model.embeddings)
    pooled, tops = _peaks(model, batch, words[batch.places])
    keep = (rng.random(pooled.shape) > DROPPED) / (1 - DROPPED)
    p = 1 / (1 + np.exp(-np.clip((pooled * keep) @ model.weights + model.offset, -30, 30)))
    error = (p - label) * weight / len(batch.sizes)
    back = error[:, None] * model.weights * keep * (pooled > 0)
    ada.step("w", model.weights, error @ (pooled * keep) + 1e-4 * model.weights)
    bias = np.array([model.offset])
    ada.step("b", bias, np.array([error.sum()]))
    model.offset = float(bias[0])
    moved = np.zeros_like(words)
    for k, (f, o, top) in enumerate(zip(model.filters, model.offsets, tops)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        df = np.empty_like(f)
        for j in range(len(f)):
            own = batch.places[top + j]
            df[j] = np.einsum("nf,nfs->sf", g, words[own])
            np.add.at(moved, own.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, SIZE))
        ada.step(("f", k), f, df)
        ada.step(("o", k), o, g.sum(0))
    touched = np.abs(moved).sum(1)[batch.owner] > 0
    rows, where = np.unique(batch.rows[touched], return_inverse=True)
    gradient = np.zeros((len(rows), SIZE))
    np.add.at(gradient, where, moved[batch.owner[touched]])
    ada.step("e", model.embeddings, gradient, rows)


def _batches(sample: Sample, chosen: np.ndarray, model: Model) -> Iterator[tuple[np.ndarray, _Batch]]:
    """Batches of the chosen texts, and which they are. Each has texts of all lengths."""
    known = np.array(list(model.rows), np.int64)
    place = np.searchsorted(known, sample.buckets)
    kept = known[np.minimum(place, len(known) - 1)] == sample.buckets if len(known) else np.zeros(len(place), bool)
    counts = np.bincount(np.repeat(np.arange(len(sample.counts)), sample.counts)[kept], minlength=len(sample.counts))
    order = np.array(sorted(chosen.tolist(), key=lambda i: len(sample.texts[i])), np.int64)
    number = -(-len(order) // BATCH)
    for k in range(number):
        yield order[k::number], _Batch([sample.texts[i] for i in order[k::number]], place[kept], counts)


def fit_network(sample: Sample, chosen: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Gradient steps on batches of the chosen texts; of each filter only the place of its maximum in each text gets a gradient. Labels and weights are of the whole sample."""
    rng = np.random.default_rng(seed)
    model = _start(sample, chosen, rng)
    batches, ada = list(_batches(sample, rng.permutation(chosen), model)), _Adagrad(RATE)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            part, batch = batches[k]
            _step(model, ada, batch, label[part], weight[part], rng)
    return model


def sampled_logits(sample: Sample, chosen: np.ndarray, model: Model) -> np.ndarray:
    """The logit of every chosen text."""
    out = np.zeros(len(sample.texts))
    for part, batch in _batches(sample, chosen, model):
        out[part] = _peaks(model, batch, batch.embedded(model.embeddings)[batch.places])[0] @ model.weights + model.offset
    return out[chosen]


def logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The logit and the guessed language of every text."""
    scorer = Scorer(model)
    found = [scorer.logit(t) for t in texts]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int64)


def calibrate(model: Model, logit: np.ndarray, language: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """A logistic curve over all logits, and by language the threshold it crosses 0.5 at, drawn towards the common one.

    Toxic texts are few; a missed one weighs more than a clean one that is caught, by the
    root of the ratio of their numbers.
    """
    if len(set(label.tolist())) < 2:
        model.slope, model.thresholds = 1.0, np.full(len(LANGUAGES), -10.0 if len(label) and label[0] else 10.0)
        return
    share = np.array([weight[label == v].sum() for v in (0, 1)])
    weight = weight / np.sqrt(share)[label]
    weight = weight / weight.mean()
    slope, at = fit_logistic(logit[:, None], label.astype(float), weight, 1e-2)
    model.slope = max(slope, 1e-3)
    model.thresholds[:] = -at / model.slope
    common = model.thresholds[0]
    for k in range(len(LANGUAGES)):
        own = language == k
        n = min(int((label[own] == v).sum()) for v in (0, 1)) if own.any() else 0
        if n:
            x, y, w = logit[own], label[own], weight[own]
            tries = np.linspace(common - 3 / model.slope, common + 3 / model.slope, 61)
            p = 1 / (1 + np.exp(-np.clip(model.slope * (x[:, None] - tries), -30, 30)))
            loss = -(w[:, None] * np.where(y[:, None] == 1, np.log(p), np.log1p(-p))).sum(0)
            model.thresholds[k] = tries[(loss + 2 * (model.slope * (tries - common)) ** 2).argmin()]


def fit(rows: pd.DataFrame) -> Model:
    """The network is trained on all rows, and calibrated on all by the logits that networks trained on the other half give. Labels: 1 is toxic."""
    rows = rows.sample(frac=1, random_state=3).reset_index(drop=True)
    label, weight = rows.label.to_numpy().astype(np.int64), rows.weight.to_numpy()
    sample, every = Sample(rows.text.tolist()), np.arange(len(rows))
    even = np.sqrt(weight / weight.mean()) if len(weight) else weight
    logit = np.zeros(len(rows))
    for k in (0, 1):
        there = every[every % 2 == k]
        logit[there] = sampled_logits(sample, there, fit_network(sample, every[every % 2 != k], label, even))
    model = fit_network(sample, every, label, even)
    calibrate(model, logit, sample.languages, label, weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", [0, 1], PARTS, PART, ROWS))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, language (guessed) of every row of ``docs``.

    Null, empty and wordless texts are scored as one word without an embedding. With
    labels of one kind only, that kind is predicted for all; without any, none is toxic.
    Rows that repeat get equal scores. No documents, no rows. Other columns are not
    looked at.
    """
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels.select("doc_id", "toxic")))

    @F.pandas_udf("score double, language string")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            found = [scorer.logit(t) for t in texts.fillna("")]
            yield pd.DataFrame({
                "score": [shared.value.probability(x, k) for x, k in found],
                "language": [LANGUAGES[k] for _, k in found],
            }).astype({"score": "float64", "language": "object"})

    out = rows.withColumn("s", scored("text")).select(
        "doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "s.score", "s.language"
    )
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")
