"""Near duplicates by SimHash, linked through broadcast BK-trees.

Distinct fingerprints are dealt into shards of some thousands: two that differ in at
most ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of bits, so in the first
bits of that block, by which shards are told apart. Tasks build a shard's BK-tree,
whose children are keyed by their Hamming distance to the parent. The trees are
broadcast in waves of a checked size; all fingerprints of a wave's shards, wherever
they lie, search their tree, following only edges within the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, UPPER, content, free_name, new_path, numbered, written
from tessera.llm.components import components

SHINGLE = 3
RADIUS = 2
BITS = 64
SEED = 42
#: Fingerprints of a shard, about; those of a shard of more than SHARD are dealt anew, by two blocks.
TREE, SHARD = 4096, 65536
#: Bytes of the trees of a wave, which are broadcast together, and of one node; waves that run at once. On executors with memory to spare a
#: wave of some hundred MB means fewer of them.
WAVE, NODE, AT_ONCE = 32 << 20, 13, 2
#: Bytes of fingerprints in a row of packed trees, about, and files of a wave at most.
CHUNK, CHUNKS = 4 << 20, 64
TREES = "shard long, wave int, n int, fps binary, parents binary, distances binary"
PACKED_WAVE = "shards binary, sizes binary, fps binary, parents binary, distances binary"
PACKED = f"wave int, {PACKED_WAVE}"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str) -> int:
    """The fingerprint of one text, as an unsigned integer; 0 without words.

    A shingle is three words; fewer words are one shingle. A bit is set if over half of
    the shingles' hashes have it set.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        joined = b" ".join(words)
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 255 * 128):
        part = raw[at : at + 255 * 128]
        bits = np.unpackbits(part, axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer. A null text has no words."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))

    whole = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), of(whole).alias("fp"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BK-tree of distinct fingerprints: each one's parent and its distance to it; the first is the root, its own parent."""
    n = len(fps)
    parent, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, open_ = np.zeros(n, np.int64), np.arange(1, n)
    while len(open_):
        d = _distance(fps[open_], fps[at[open_]])
        # the first that comes to a free edge of a node hangs there, others go on from it
        _, where, back = np.unique(at[open_] * (BITS + 1) + d, return_index=True, return_inverse=True)
        placed = open_[where]
        parent[placed], distance[placed] = at[placed], d[where]
        at[open_] = placed[back]
        open_ = np.delete(open_, where)
    return parent, distance


class Forest:
    """Trees of many shards as sorted arrays: edges by (parent, distance)."""

    def __init__(self, trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        """Of each tree: shard, fingerprints, parents, distances."""
        trees = sorted(trees, key=lambda t: t[0])
        sizes = np.array([len(t[1]) for t in trees], np.int64)
        self.shards = np.array([t[0] for t in trees], np.int64)
        self.roots = np.cumsum(sizes) - sizes
        self.fps = np.concatenate([np.zeros(0, np.uint64), *[t[1] for t in trees]])
        parents = np.concatenate([np.zeros(0, np.int64), *[t[2] + r for t, r in zip(trees, self.roots)]])
        key = parents * (BITS + 1) + np.concatenate([np.zeros(0, np.int64), *[t[3] for t in trees]])
        child = np.setdiff1d(np.arange(len(self.fps)), self.roots, assume_unique=True)
        self.child = child[np.argsort(key[child])]
        self.edges = key[self.child]
        #: The fingerprints of all trees, each once, and which of them a node holds.
        self.known, self.number = np.unique(self.fps, return_inverse=True)

    def near(self, fps: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius: numbers of the fingerprints that ask, and nodes of their shard's tree."""
        if not len(self.roots):
            return
        place = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        who = np.flatnonzero(self.shards[place] == shard)
        node = self.roots[place[who]]
        while len(who):
            d = _distance(fps[who], self.fps[node])
            hit = d <= radius
            yield who[hit], node[hit]
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(d - radius, 1))
            high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            who = np.repeat(who, n)
            node = self.child[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(who))]


def _blocks(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Lowest bit and width of each of ``radius + 1`` blocks."""
    at = [bits * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def shards(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE, most: int = SHARD) -> DataFrame:
    """fp, shard, part, parts: the shards a fingerprint is in. Two within the radius share at least one.

    Shards are told apart by as many bits as make them about ``tree`` large. What lies in a
    shard of more than ``most`` (texts that share much) is dealt by the whole block and
    one of the blocks of its other bits; a shard that is still larger has several trees,
    of which each of its fingerprints is in one and asks all.
    """
    fp, n = F.col("fp"), distinct.count()
    bits = min(max(0, math.ceil(math.log2(max(n, 1) / tree))), BITS // (radius + 1))
    first = [F.xxhash64(F.lit(k), _bits(fp, low + width - bits, bits)) for k, (low, width) in enumerate(_blocks(radius))]
    rows = distinct.select("fp", F.posexplode(F.array(*first)).alias("k", "shard"))

    def large(of: DataFrame) -> DataFrame:
        return written(of.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large-shards")

    over = large(rows)
    if not over.isEmpty():
        second = []
        for k, (low, width) in enumerate(_blocks(radius)):
            # the other bits, in one piece: two that agree in block k differ in these at most
            above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < BITS else F.lit(0).cast("long")
            other = above.bitwiseOR(_bits(fp, 0, low))
            own = _bits(fp, low, width)
            second.append(F.array(*[F.xxhash64(F.lit(k), own, F.lit(j), _bits(other, a, w)) for j, (a, w) in enumerate(_blocks(radius, BITS - width))]))
        again = rows.join(over.select("shard"), "shard", "left_semi").select("fp", F.explode(F.element_at(F.array(*second), F.col("k") + 1)).alias("shard"))
        rows = written(rows.join(over.select("shard"), "shard", "left_anti").select("fp", "shard").unionByName(again), "shards")
        over = large(rows)
    parts = over.select("shard", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    rows = rows.select("fp", "shard").join(parts, "shard", "left") if not over.isEmpty() else rows.select("fp", "shard").withColumn("parts", F.lit(1))
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.select("fp", "shard", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "parts")


def trees(dealt: DataFrame, waves: int) -> DataFrame:
    """The BK-tree of every part of every shard, as one row, and the wave it is broadcast in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shard = [np.zeros(0, np.int64)], None

        def tree() -> pd.DataFrame:
            fps = np.sort(np.concatenate(held).view(np.uint64))
            # a fixed order that is none of the values': the tree is no deeper for neighbours in a row
            fps = fps[np.argsort(fps * np.uint64(0x9E3779B97F4A7C15))]
            parent, distance = grow(fps)
            return pd.DataFrame({
                "shard": [shard[0]], "wave": [shard[1]], "n": [len(fps)], "fps": [fps.astype("<u8").tobytes()],
                "parents": [parent.astype("<i4").tobytes()], "distances": [distance.astype("u1").tobytes()],
            })

        for b in batches:
            names, waves_, fps = b["tree"].to_numpy(), b["wave"].to_numpy(), b["fp"].to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, z in zip(cuts, cuts[1:]):
                if shard is None or shard[0] != names[a]:
                    if shard is not None:
                        yield tree()
                    held, shard = [], (names[a], waves_[a])
                held.append(fps[a:z])
        if shard is not None:
            yield tree()

    rows = dealt.select("fp", _tree("part").alias("tree")).withColumn("wave", _wave(waves))
    return rows.repartition("tree").sortWithinPartitions("tree").mapInPandas(run, TREES)


def _tree(part: str) -> Column:
    return F.xxhash64("shard", part)


def _wave(waves: int) -> Column:
    return F.pmod(F.xxhash64("tree"), F.lit(waves)).cast("int")


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b, pair by pair; ``parent`` stays flat."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def search(asking: DataFrame, forest: Broadcast, radius: int, batch: int = 16384) -> DataFrame:
    """u and v: links that join each fingerprint of ``asking`` (fp, tree) to what its tree holds within the radius.

    Of all links a task finds it sends on as many as join what they join: at most one for each fingerprint of the forest, and for each that asks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = forest.value
        n = len(held.known)
        parent = np.arange(n)
        for b in batches:
            fps, tree = b["fp"].to_numpy().view(np.uint64), b["tree"].to_numpy()
            # those that ask for a part that they aren't in come after the forest's own, and so never are what others are joined to
            own = np.minimum(np.searchsorted(held.known, fps), n - 1) if n else np.zeros(len(fps), np.int64)
            own = np.where(held.known[own] == fps, own, n + np.arange(len(fps))) if n else n + np.arange(len(fps))
            parent = np.concatenate([parent, n + np.arange(len(fps))])
            for at in range(0, len(fps), batch):
                for who, node in held.near(fps[at : at + batch], tree[at : at + batch], radius):
                    _unite(parent, own[at + who], held.number[node])
            out = np.flatnonzero(parent[n:] < n)
            yield pd.DataFrame({"u": fps[out].view(np.int64), "v": held.known[parent[n + out]].view(np.int64)})
            parent = parent[:n]
        moved = np.flatnonzero(parent != np.arange(n))
        yield pd.DataFrame({"u": held.known[moved].view(np.int64), "v": held.known[parent[moved]].view(np.int64)})

    return asking.mapInPandas(run, "u long, v long")


def packed(grown: DataFrame) -> DataFrame:
    """The trees (wave, shard, fps, parents, distances) of each wave, chunk by chunk as arrays: a row holds ``CHUNK`` bytes of trees, about."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                wave = held.setdefault(row.wave, [])
                wave.append(row)
                if sum(len(r.fps) for r in wave) >= CHUNK:
                    yield _chunk(held.pop(row.wave))
        for rows in held.values():
            yield _chunk(rows)

    return grown.repartition("wave", F.pmod(F.xxhash64("shard"), F.lit(CHUNKS))).mapInPandas(run, PACKED)


def _chunk(rows: list) -> pd.DataFrame:
    joined = {c: [b"".join(getattr(r, c) for r in rows)] for c in ("fps", "parents", "distances")}
    numbers = {c: [np.array([getattr(r, c) for r in rows], "<i8").tobytes()] for c in ("shard", "n")}
    return pd.DataFrame({"wave": [rows[0].wave], "shards": numbers["shard"], "sizes": numbers["n"], **joined})


def forest_of(rows: DataFrame) -> Forest:
    """The trees of one wave, put together on the driver out of arrays of many trees: their bytes are checked by the caller."""
    trees = []
    for r in rows.select("shards", "sizes", "fps", "parents", "distances").toLocalIterator():
        cuts = np.cumsum(np.frombuffer(r["sizes"], "<i8"))[:-1]
        parts = (np.split(np.frombuffer(r[c], t), cuts) for c, t in (("fps", "<u8"), ("parents", "<i4"), ("distances", "u1")))
        trees += [(shard, fps, parents.astype(np.int64), distances.astype(np.int64)) for shard, fps, parents, distances in zip(np.frombuffer(r["shards"], "<i8").tolist(), *parts)]
    return Forest(trees)


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE, most: int = SHARD, wave: int = WAVE) -> DataFrame:
    """u and v: links that join the distinct fingerprints ``fp`` as all pairs within the radius would.

    Trees, what asks them and what is found lie in folders by wave: a wave reads its own
    rows only, and the result is one folder, however many waves there are. Two waves run
    at once, so that one's trees are read while another searches.
    """
    spark = distinct.sparkSession
    dealt = shards(distinct, radius, tree, most)
    total = (radius + 1) * distinct.count() * NODE
    waves = 1 if total <= wave else math.ceil(2 * total / wave)
    while True:
        grown = written(trees(dealt, waves), "trees")
        if (grown.groupBy("wave").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) * NODE <= wave:
            break
        if waves > 2 * total:
            raise ValueError("a wave must hold a tree")
        waves *= 2
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = dealt.select("fp", "shard", every.alias("asked")).select("fp", _tree("asked").alias("tree")).withColumn("wave", _wave(waves))
    forests, questions, found = (new_path(spark, label) for label in ("forests", "asking", "links"))
    packed(grown).write.partitionBy("wave").parquet(forests)
    asking.repartition("wave", F.pmod(F.xxhash64("fp"), F.lit(CHUNKS))).write.partitionBy("wave").parquet(questions)

    def one(k: int) -> None:
        # the folder itself, so that planning a wave doesn't list the others
        at = f"/wave={k}"
        forest = spark.sparkContext.broadcast(forest_of(spark.read.schema(PACKED_WAVE).parquet(forests + at)))
        search(spark.read.schema("fp long, tree long").parquet(questions + at), forest, radius).write.parquet(found + at)
        forest.destroy()

    there = sorted(r["wave"] for r in grown.select("wave").distinct().toLocalIterator())
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(one), k) for k in there]:
            done.result()
    if not there:
        return spark.createDataFrame([], "u long, v long")
    return spark.read.schema("u long, v long, wave int").parquet(found).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over links, the document's own
    included; null ids are passed over, unless the component has no other. Null and
    wordless texts have fingerprint zero and are linked like any other. Rows that repeat
    are in one component. No documents, no rows. Other columns are not looked at.
    """
    if not isinstance(docs.schema[id_col].dataType, T.StructType):
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        id_col, text_col = "doc_id", "text"
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns, whatever their names.

    The row with the smallest id stays, a null id being smaller than any other; of rows
    that share it one is chosen by what the rows hold, so that reruns agree. Null, empty
    and wordless texts have fingerprint zero and are one component: one of them stays.
    No rows in, no rows out.
    """
    key = free_name(docs, "_tessera_row")
    rows = numbered(docs, key, F.col(id_col).alias("id"), content(docs).alias("content"))
    kept = near_duplicates(rows.select(key, text_col), key, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
