"""Quality by compression: which dictionary makes a text smaller, one of good or one of bad text?

Two zstandard dictionaries are built from labelled text. Every block of a text is
compressed with either. The difference of the two compressed sizes, divided by the
length, is calibrated by a logistic curve, fitted on rows whose text isn't in the
dictionaries that measured them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, labelled_sample, level

PARTS, PART = 3, 1
#: Bound of the fitted sample: rows of each label.
ROWS = 2000
DICTIONARY = 512 * 1024
#: Pieces of a text in a dictionary, and bytes of one at least.
PIECES, LEAST_PIECE = 4, 64
BLOCK = 4096
LEVEL = 3
#: Bytes that short texts count as at least, so that few bytes move the score little.
LEAST = 64


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: The curve: what a difference of one, and what none, adds to the log odds.
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -500, 500)))


def difference(text: str, compressors: list[zstandard.ZstdCompressor]) -> float:
    """Compressed size with the bad dictionary less that with the good one, for each byte of the text; 0 for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    bad, good = (sum(len(c.compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK)) for c in compressors)
    return (bad - good) / max(len(data), LEAST)


def pieces(raw: bytes, share: int) -> list[bytes]:
    """A text of at most ``share`` bytes whole, of a longer one pieces spread from its beginning to its end."""
    if len(raw) <= share:
        return [raw]
    n = max(1, min(PIECES, share // LEAST_PIECE))
    size = share // n
    return [raw[at : at + size] for at in np.linspace(0, len(raw) - size, n).astype(int)]


def dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """Pieces from all over the texts, an even share of each; what short texts leave over goes to long ones."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    share = max(LEAST_PIECE, level(np.array([len(x) for x in raw]), size))
    return b"\n".join(p for x in raw for p in pieces(x, share))[:size] or b"\n" * 8


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of x and of 1, by Newton's method on weighted rows."""
    scale = np.where(x.std(0) > 0, x.std(0), 1) if len(x) else np.ones(x.shape[1])
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, weight = np.zeros(a.shape[1]), weight / max(weight.mean(), 1e-12) if len(weight) else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, a.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / np.append(scale, 1)


def fit(rows: pd.DataFrame) -> Model:
    """Measure each half of the rows with dictionaries of the other, fit the curve, then use all rows for the dictionaries.

    Labels: 1 is good. ``weight`` gives the rows the shares that the labels have in the corpus.
    """
    half, label = np.arange(len(rows)) % 2, rows.label.to_numpy()
    x = np.zeros(len(rows))

    def model(among: np.ndarray) -> Model:
        return Model(*(dictionary(rows.text[among & (label == k)].tolist()) for k in (1, 0)))

    for k in (0, 1):
        both = model(half != k).compressors()
        for i in np.flatnonzero(half == k):
            x[i] = difference(rows.text.iloc[i], both)
    final = model(half >= 0)
    if len(set(label.tolist())) == 2:
        final.slope, final.offset = map(float, fit_logistic(x[:, None], label.astype(float), rows.weight.to_numpy()))
    elif len(label):
        final.offset = 4.0 if label[0] == 1 else -4.0
    return final


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, "quality", [0, 1], PARTS, PART, ROWS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (1: good) and predicted. A null text is scored as empty; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        both = m.compressors()
        for texts in parts:
            yield pd.Series(m.score(np.array([difference(t, both) for t in texts.fillna("")], float)))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    With labels of one kind only, that kind is predicted for all; without any the score is
    0.5. Null and empty texts are scored alike. Rows that repeat get
    equal scores. No documents, no rows. Other columns are not looked at.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, train(rows, labels.select("doc_id", "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns, whatever their names.

    Null texts are scored as empty ones, and all empty texts alike. Repeated rows stay or
    go together. With labels of one kind only, that decides for all; without any, all
    stay. No documents, no rows.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).where("predicted = 1").select("row.*")
