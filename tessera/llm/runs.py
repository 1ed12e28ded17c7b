"""Stretches of words that repeat with a period, in every text.

A run is a stretch of consecutive words of smallest period q, at least ``LEAST`` words
and two periods long, that no neighbouring word extends. Words become integers. Main
and Lorentz's divide and conquer then finds all of them: of a block cut in two, Z-functions of the halves say for every period how far
matches reach to both sides of the cut, so that each repetition across the cut is known
by its period and ends. One that goes on beyond the block also crosses the cut of a larger
block, which reports it whole.

In a run of q the words up to q before its end, of which there are six or more, stand
again q words later: every word of a run belongs to six words that the text repeats. So
only stretches of such words are divided, and most texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices

#: Fewest words of a run. Half of them, which a run must hold twice, are the words looked up.
LEAST = 12
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest match of what begins there with the beginning; 0 for the first."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        if i < right:
            known = z[i - left]
            if known < right - i:
                z[i] = known
                continue
            k = right - i
        else:
            k = 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i], left, right = k, i, i + k
    return z


def crossing(u: list[int], v: list[int]) -> Iterator[tuple[int, int, int]]:
    """Repetitions of two periods or more in u + v, as far as u + v goes, that touch the cut: start, end, period."""
    n, m = len(u), len(v)
    back_u, back = u[::-1], v[::-1] + u[::-1]
    # matches of v with itself and of u's end with what ends p after the cut, for periods p that lie in v
    ahead, behind = z_function(v), z_function([*back_u, -1, *back])
    for p in range(1, m + 1):
        right, left = ahead[p] if p < m else 0, behind[n + 1 + m - p]
        if left + right >= p:
            yield n - left, n + p + right, p
    # matches of u's end with itself and of v's beginning with what begins p before the cut, for periods that lie in u
    behind, ahead = z_function(back_u), z_function([*v, -1, *u, *v])
    for p in range(1, n + 1):
        left, right = behind[p] if p < n else 0, ahead[m + 1 + n - p]
        if left + right >= p:
            yield n - p - left, n + right, p


def main_lorentz(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of ``least`` words or more, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    blocks = [(0, len(s))]
    while blocks:
        a, b = blocks.pop()
        if b - a < least:
            continue
        cut = (a + b) // 2
        blocks += [(a, cut), (cut, b)]
        for start, end, p in crossing(s[a:cut], s[cut:b]):
            start, end = a + start, a + end
            if end - start < least or (start == a and a and s[a - 1] == s[a - 1 + p]) or (end == b and b < len(s) and s[b] == s[b - p]):
                continue
            found[start, end] = min(p, found.get((start, end), p))
    return sorted((start, end - start, p) for (start, end), p in found.items())


def repeated(ids: np.ndarray, text: np.ndarray, half: int = LEAST // 2) -> np.ndarray:
    """Which words belong to ``half`` consecutive ones that the same text holds again; few others may be among them (hashes are compared).

    ``text`` numbers the texts, each of which ends with a word of its own.
    """
    count = max(0, len(ids) - half + 1)
    codes = text[:count].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(half):
        codes = codes * np.uint64(0xFF51AFD7ED558CCD) + mixed[k : k + count]
    within = text[:count] == text[half - 1 :]
    again = np.flatnonzero(pd.Series(codes).duplicated(keep=False).to_numpy() & within)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[again] += 1
    edges[again + half] -= 1
    return np.cumsum(edges[:-1]) > 0


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Every text's runs, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(words) for words in texts], np.int64)
    if not sizes.sum():
        return found
    # each text is followed by a number that stands nowhere else
    ends = np.cumsum(sizes + 1)
    ids = np.empty(int(ends[-1]), np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for words in texts for w in words]
    ids[inside], names = pd.factorize(flat)
    ids[ends - 1] = len(names) + np.arange(len(texts))
    number = np.repeat(np.arange(len(texts)), sizes + 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated(ids, number), [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2):
        if b - a >= LEAST:
            k = number[a]
            at = int(a - (ends[k] - sizes[k] - 1))
            found[k] += [(at + start, length, p) for start, length, p in main_lorentz(ids[a:b].tolist())]
    return found


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for first, end in sorted((start + p, start + length) for start, length, p in runs):
        out += words[at : max(at, first)]
        at = max(at, end)
    return out + words[at:]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its number of words, its runs (by start, then period) and its text with each run cut to one period.

    Words are what ASCII white space divides, compared byte by byte, and are joined by
    one space. A null text is empty; an empty text has no words, no runs and stays empty.
    A text of any length is one string of words: time grows a little faster than its
    length, memory with it. Rows that repeat are read each. No documents, no rows. Other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            for part in byte_slices(b, "text"):
                texts = [t.split() for t in part["text"].cast(pa.binary()).to_pylist()]
                found = runs_of(texts)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(runs) for runs in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(words) for words in texts], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(kind))),
                    pc.cast(pa.array([b" ".join(kept(*x)) for x in zip(texts, found)], pa.binary()), pa.string()),
                ], names=[c.split()[0] for c in ("doc_id", "n_words", "runs", "collapsed")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, RUNS)
