"""Exact top-k by inner product from sorted lists, without random access.

Queries are broadcast in waves of a checked size; vectors are read where they lie, in
blocks. Within a block every component has a list of its values in order. A query reads
the lists from their better ends, some entries of each at a time; where a list has come
to bounds what stands further down. So each vector has an upper bound of its score
(what was read of it, and for other components where their lists have come to) and a
lower one (the lists' worse ends instead). Vectors whose upper bound is below the k-th
best lower bound, or below the k-th best score of the blocks before, are out. When
outsiders can't qualify, reading stops, and the few that are left get their final
scores. The tasks' lists of k are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import new_path, written

K = 10
SCALE = 1024
EVERY = 100
#: Vectors and components of a block at most, vectors that a task reads, about, and steps that a whole list is read in.
BLOCK, COMPONENTS, STRIPE, STEPS = 4096, 1 << 21, 1 << 15, 8
#: Bytes of the queries that are broadcast at once.
WAVE = 16 << 20
#: A block is done when so many times k vectors are left.
LEFT = 4
FOUND = "query_id long, query_row long, vec_id long, score long, read_share double, alive_share double"


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers), d (how many), for the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("d"))
    )


class SortedLists:
    """The lists of one block: for each component, the vectors' numbers and values in rising order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.order = np.argsort(vectors.T, axis=1, kind="stable")
        self.values = np.take_along_axis(vectors.T, self.order, axis=1).astype(np.float64)
        self.longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))

    def scores(self, who: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, held within 64 bits."""
        most = float(np.abs(query.astype(np.float64)).max(initial=0)) * float(np.abs(self.values[:, [0, -1]]).max(initial=0))
        if most * len(query) < 2.0**62:
            return self.vectors[who] @ query
        exact = self.vectors[who].astype(object) @ query.astype(object)
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)

    def top(self, query: np.ndarray, own: int, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, float, float]:
        """ids and scores of the k best, highest first, ties to the smaller id; the query's own id takes no part.

        Vectors that can't reach ``bar``, the k-th best score known from elsewhere, may be
        left out. Also the share of the lists' entries that was read, and that of the
        vectors that were left then.
        """
        n, d = len(self.ids), len(query)
        q = query.astype(np.float64)
        worst, step = np.minimum(self.values[:, -1] * q, self.values[:, 0] * q), max(LEFT * k, -(-n // STEPS))
        spare = 1 + 1e-9 * np.sqrt((q**2).sum()) * self.longest  # for rounding
        # a vector that no list has shown may still reach the bar until lists have come so far: they are read that far at once
        stops = np.minimum(np.arange(STEPS + 1) * step, n - 1)
        unseen = (np.where(q[:, None] > 0, self.values[:, n - 1 - stops], self.values[:, stops]) * q[:, None]).sum(axis=0)
        first = np.flatnonzero(unseen + spare < bar)
        goal = max(1, int(stops[first[0]])) if len(first) else min(n, step)
        lower, seen = np.full(n, worst.sum()), np.zeros((d, n), np.float32)
        depth, reached, fell = np.zeros(d, np.int64), np.maximum(self.values[:, -1] * q, self.values[:, 0] * q), np.full(d, np.inf)
        other = self.ids != own
        alive, lists = np.flatnonzero(other), np.arange(d)
        while len(alive) > LEFT * k and len(lists):
            for i in lists.tolist():
                a, b = int(depth[i]), goal if goal else min(n, int(depth[i]) + step)
                at = slice(n - b, n - a) if q[i] > 0 else slice(a, b)
                entries, values = self.order[i, at], self.values[i, at] * q[i]
                lower[entries] += values - worst[i]
                seen[i, entries] = 1
                now = values[0 if q[i] > 0 else -1] if b < n and len(values) else worst[i] if b == n else reached[i]
                depth[i], fell[i], reached[i] = b, reached[i] - now, now
            goal = 0
            if other.sum() >= k:
                bar = max(bar, np.partition(lower[other], -k)[-k] - spare)
            # what a component may add over the worst, where it wasn't seen
            over = reached - worst
            rounding = 1e-5 * np.abs(over).sum()
            alive = np.flatnonzero(other & (lower + (over.sum() + rounding + spare) - over.astype(np.float32) @ seen >= bar))
            # next, half of the lists that aren't read whole: those that fell most at their last step
            lists = np.flatnonzero(depth < n)
            lists = lists[np.argsort(-fell[lists], kind="stable")][: max(1, d // 2)]
        score = self.scores(alive, query)
        first = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][first], score[first], float(depth.sum()) / max(n * d, 1), len(alive) / max(n, 1)


class Answers:
    """The k best so far of queries of ``d`` components: what they have found is the bar for the next block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rows, self.vectors, self.k = ids, rows, vectors, k
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.read, self.alive, self.blocks = np.zeros(len(ids)), np.zeros(len(ids)), 0

    def look(self, lists: SortedLists) -> None:
        self.blocks += 1
        for i, query in enumerate(self.vectors):
            known, scores = self.held[i]
            more, gained, read, alive = lists.top(query, self.ids[i], self.k, float(scores[-1]) if len(scores) == self.k else -np.inf)
            known, scores = np.concatenate([known, more]), np.concatenate([scores, gained])
            best = np.lexsort((known, -scores))[: self.k]
            self.held[i] = known[best], scores[best]
            self.read[i] += read
            self.alive[i] += alive

    def frame(self) -> pd.DataFrame:
        sizes = [len(known) for known, _ in self.held]
        empty = np.zeros(0, np.int64)
        columns = (
            np.repeat(self.ids, sizes), np.repeat(self.rows, sizes), np.concatenate([empty, *(x for x, _ in self.held)]),
            np.concatenate([empty, *(x for _, x in self.held)]), np.repeat(self.read / max(self.blocks, 1), sizes), np.repeat(self.alive / max(self.blocks, 1), sizes),
        )
        return pd.DataFrame(dict(zip([c.split()[0] for c in FOUND.split(", ")], columns)))


def answer(vectors: DataFrame, queries: Broadcast, k: int, block: int) -> DataFrame:
    """Each task's k best of the vectors (vec_id, v) it reads, for every query: by their number of components, ids, rows and vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = {d: Answers(*q, k) for d, q in queries.value.items()}
        held: dict[int, list] = {d: [] for d in answers}
        # the first block is small: it finds the bar for the others
        sizes = {d: max(4 * LEFT * k, block // 8) for d in answers}

        def settle(d: int) -> None:
            ids, rows = zip(*held[d])
            answers[d].look(SortedLists(np.stack(rows).astype(np.int64), np.array(ids, np.int64)))
            held[d] = []
            sizes[d] = max(LEFT * k, min(block, COMPONENTS // max(d, 1)))

        for b in batches:
            for i, v in zip(b["vec_id"].to_numpy(), b["v"].array):
                if len(v) in held:
                    held[len(v)].append((i, v))
                    if len(held[len(v)]) >= sizes[len(v)]:
                        settle(len(v))
        for d in answers:
            if held[d]:
                settle(d)
            yield answers[d].frame()

    return vectors.mapInPandas(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all rows but those with its own vec_id; and the shares of lists read and of vectors left.

    Vectors that are null or hold a null or non-finite component, or whose id is null,
    take no part. Vectors only meet those of as many components. Components and scores
    are 64-bit integers; what lies beyond is held at their bounds. Rows that repeat count
    each as candidates, and once as queries. Fewer than k candidates: all of them. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    # dealt evenly, whatever their ids are; this is the only time that vectors move
    rows = written(vectors.select("vec_id", "v").repartition(max(spark.sparkContext.defaultParallelism, math.ceil(n / STRIPE))), "vectors")
    asked = written(queries.select("vec_id", "v", "d", F.xxhash64("v").alias("row")).distinct().withColumn("size", 8 * F.col("d") + 24), "queries")
    total = asked.agg(F.sum("size")).first()[0] or 0
    waves = 1 if total <= wave else math.ceil(2 * total / wave)
    number = lambda: F.pmod(F.xxhash64("vec_id", "row"), F.lit(waves)).cast("int")
    while (asked.groupBy(number().alias("w")).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0) > wave:
        if waves > total:
            raise ValueError("a wave must hold a query")
        waves *= 2
    # a folder of each wave's queries, and one of its answers: no wave reads what others read
    asking, found = new_path(spark, "asking"), new_path(spark, "answers")
    asked.withColumn("wave", number()).repartition("wave").write.partitionBy("wave").parquet(asking)
    for w in range(waves):
        part = spark.read.schema("vec_id long, v array<long>, d int, row long, wave int").parquet(asking).where(F.col("wave") == w).select("vec_id", "row", "v", "d").toPandas()
        by = {int(d): (g["vec_id"].to_numpy(), g["row"].to_numpy(), np.stack(g["v"].to_numpy()).astype(np.int64)) for d, g in part.groupby("d")}
        shared = spark.sparkContext.broadcast(by)
        answer(rows, shared, k, block).write.parquet(f"{found}/wave={w}")
        shared.destroy()
    best = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    merged = spark.read.schema(f"{FOUND}, wave int").parquet(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score", "read_share", "alive_share")
