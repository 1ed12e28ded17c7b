"""Pack tokenised documents into fixed-length sequences by linear grouping.

The plan depends on the histogram of piece lengths alone (at most ``capacity``
entries), so the driver's work and memory do not grow with the corpus:

1. large lengths are rounded up within groups of equal cardinality;
2. configurations of the few rounded sizes are optimised (column generation);
3. actual lengths of each place's own group are substituted, such that they fill the
   sequence; where a group has none that do, the configuration is given up. What is left
   is grouped and configured again, a few times;
4. small lengths, and the few large ones that are left, are placed best fit in falling
   order.

The plan is a table of runs, "so many sequences with these lengths". Executors
rank the pieces of each length and look their places up in it.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, written

CAPACITY = 2048
#: Groups of large lengths, and how often what is left is grouped again.
GROUPS, ROUNDS = 48, 4
#: Lengths over this share of a sequence count as large.
LARGE = 1 / 16
#: Pre-tokens of a generation that a worker remembers the ids of.
MEMO = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The characters whose words are cut here, as the tokenizer cuts them: Latin letters, digits and signs up to U+024F.
_BELOW = [chr(k) for k in range(0x250) if chr(k) != "\u0130"]
_CLASSES = {kind: "".join(map(re.escape, (c for c in _BELOW if unicodedata.category(c)[0] == kind))) for kind in "LN"}
_FAR = re.compile(f"[^{''.join(map(re.escape, _BELOW))}]")
#: Fixed value: the tokenizer's pre-tokens.
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_CLASSES['L']}]+|[{_CLASSES['N']}]|[^\t-\r\\x20\\x85\\xa0{_CLASSES['L']}{_CLASSES['N']}]+")


def _byte_letters() -> dict[int, int]:
    """The stand-in of every byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in printable else next(rest) for b in range(256)}


class WordIds(dict):
    """Ids, as little-endian bytes, of the pre-tokens met so far, lower-cased.

    The tokenizer drops white space and never joins characters across it, so a text's
    ids are its words' ids in order, and a word's are those of its pre-tokens, which go
    to the tokenizer's model directly. Words with other than Latin letters, and those
    that may hold one of the tokenizer's special tokens, go to the tokenizer whole. Two
    generations are kept, so that frequent ones outlive rare ones.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.memo, self.old, self.letters = self.tokenizer.model, memo, {}, _byte_letters()
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            ids, plain = self.ids, part.isascii() and part.isprintable()
            got = b"".join([ids[t.id] for t in self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(self.letters))])
        if len(self) > self.memo:
            self.old = dict(self)
            self.clear()
        self[part] = got
        return got

    def word(self, word: str) -> bytes:
        """The ids of a text without ASCII white space."""
        if (not word.isascii() and _FAR.search(word)) or "<|" in word:
            return b"".join([self.ids[k] for k in self.tokenizer.encode(word, add_special_tokens=False).ids])
        low = word.lower()
        if low.isalpha():
            return self[low]
        core = low.rstrip(".,;:!?")
        if core.isalpha():
            return self[core] + self[low[len(core) :]]
        return b"".join([self[p] for p in _PRE_TOKENS.findall(low)])

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and where each text's begin (and the end of all).

        Arrow cuts the texts into words and tells them apart; each word is tokenized once.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        raw = [self.word(w) for w in coded.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(raw), "<u4")
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        upto = np.append(0, np.cumsum(n))
        ends = lists.value_lengths().to_numpy().cumsum()
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        every = np.arange(upto[-1])
        out = np.zeros(len(every) + len(ends), "<u4")
        # every text before a word has added an end id
        out[every + np.repeat(owner, n)] = pool[every + np.repeat(first[which] - upto[:-1], n)]
        return out, np.append(0, upto[ends] + np.arange(1, len(ends) + 1))


@cache
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_path)
        for batch in batches:
            for some in byte_slices(batch, "text"):
                flat, bounds = ids.documents(some["text"])
                counts = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(counts)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[row] - start, capacity)
                at = bounds[:-1][row] + start
                crc = [zlib.crc32(flat[a : a + n]) for a, n in zip(at, length)]
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


def _best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes that fits and has the highest total price, by number of items."""
    at = np.arange(capacity + 1) - sizes[:, None]
    at[at < 0] = capacity + 1  # no such room
    best = np.append(np.zeros(capacity + 1), -np.inf)
    chosen = []
    while True:
        value = best[at] + price[:, None]
        k = value.argmax(0)
        value = value[k, np.arange(capacity + 1)]
        better = value > best[:-1] + 1e-12
        if not better.any():
            break
        chosen.append(np.where(better, k, -1))
        best = np.append(np.where(better, value, best[:-1]), -np.inf)
    pattern, room = np.zeros(len(sizes)), capacity
    for took in reversed(chosen):
        if took[room] >= 0:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns of the rounded sizes and how often to use each, by column generation; uses are fractions."""
    m = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        price = inverse.sum(0)
        pattern = _best_pattern(sizes, price, capacity)
        if pattern @ price <= 1 + 1e-3:
            break
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        use, change = inverse @ counts, inverse @ pattern
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
    use = np.maximum(np.linalg.solve(basis, counts), 0)
    return [(basis[:, k].astype(np.int64), float(use[k])) for k in range(m) if use[k] > 1e-9]


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> dict[int, dict[int, int]]:
    """Rounded size and histogram of each group, from short to long: every group has as many pieces as any other (the last may have fewer).

    A length that crosses a border is split between the groups on both sides; groups
    that round up to the same length are one.
    """
    total, room = sum(n for _, n in lengths), 0
    share = max(1, -(-total // groups))
    cut: list[dict[int, int]] = []
    for x, n in lengths:
        while n:
            if not room:
                cut.append({})
                room = share
            k = min(n, room)
            cut[-1][x] = cut[-1].get(x, 0) + k
            n, room = n - k, room - k
    merged: dict[int, dict[int, int]] = {}
    for group in cut:
        held = merged.setdefault(max(group), {})
        for x, n in group.items():
            held[x] = held.get(x, 0) + n
    return merged


def whole(patterns: list[tuple[np.ndarray, float]], counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole uses of fractional patterns: rounded down, then what each still finds all its pieces for, largest fraction first."""
    counts = counts.astype(np.int64)
    uses = []
    for pattern, use in sorted(patterns, key=lambda p: -(p[1] % 1)):
        uses.append([pattern, int(use + 1e-6)])
        counts -= uses[-1][1] * pattern
    for entry in uses:
        pattern = entry[0]
        on = pattern > 0
        more = int((counts[on] // pattern[on]).min())
        if more > 0:
            entry[1] += more
            counts -= more * pattern
    return [(pattern, use) for pattern, use in uses if use]


def fullest(places: list[dict[int, int]], capacity: int) -> list[int] | None:
    """A length of each place's group such that together they fill ``capacity``; None if no lengths do.

    Bit r of ``reach[k]`` says that lengths of the first k groups sum to r.
    """
    reach, all_ = [1], (1 << (capacity + 1)) - 1
    for group in places:
        sums = 0
        for x in group:
            sums |= reach[-1] << x
        reach.append(sums & all_)
    if not reach[-1] >> capacity & 1:
        return None
    at, items, taken = capacity, [], defaultdict(int)
    for group, below in zip(reversed(places), reversed(reach[:-1])):
        x = next((x for x in sorted(group, reverse=True) if x <= at and below >> (at - x) & 1 and taken[id(group), x] < group[x]), None)
        if x is None:
            return None
        taken[id(group), x] += 1
        items.append(x)
        at -= x
    return items[::-1]


def substituted(places: list[dict[int, int]], use: int, capacity: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Up to ``use`` full sequences, in runs of equal ones, with lengths out of each place's own group; what they take leaves the groups."""
    while use and (items := fullest(places, capacity)):
        taken: dict[tuple[int, int], int] = defaultdict(int)
        groups = {id(g): g for g in places}
        for group, x in zip(places, items):
            taken[id(group), x] += 1
        n = min([use, *(groups[g][x] // k for (g, x), k in taken.items())])
        for (g, x), k in taken.items():
            groups[g][x] -= n * k
            if not groups[g][x]:
                del groups[g][x]
        use -= n
        yield n, tuple(sorted(items, reverse=True))


def configured(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, rounds: int = ROUNDS) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Runs (number of sequences, lengths in each) that linear grouping makes of the large lengths, and the histogram of what is left.

    Documents fall short of their rounded size by so much on average; a configuration
    counts on that room, and its documents are chosen such that they fit.
    """
    stock = {x: n for x, n in histogram.items() if x > capacity * LARGE and n > 0}
    left = {x: n for x, n in histogram.items() if x <= capacity * LARGE and n > 0}
    runs: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(rounds):
        if not stock:
            break
        rounded = equal_groups(sorted(stock.items()), groups)
        held = list(rounded.values())
        counts = np.array([sum(g.values()) for g in held])
        short = np.array([sum((size - x) * n for x, n in g.items()) for size, g in rounded.items()]) // counts
        sizes = np.array(list(rounded)) - short
        patterns = whole(configurations(sizes, counts.astype(float), capacity), counts)
        # few and tight ones first, while there is most to choose from
        made = [run for pattern, use in sorted(patterns, key=lambda p: (p[0].sum(), -(p[0] @ sizes)))
                for run in substituted([held[k] for k in np.repeat(np.arange(len(held)), pattern)[::-1]], use, capacity)]
        if not made:
            break
        runs += made
        stock = defaultdict(int)
        for group in held:
            for x, n in group.items():
                stock[x] += n
    return runs, left | stock


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of sequences, lengths in each) that hold every piece of the histogram."""
    runs, left = configured(histogram, capacity, groups)
    return _best_fit(runs, left, capacity)


def _best_fit(runs: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Place what is left, longest first, where it leaves the least room; open sequences when none has any."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms = 0  # bit r: some sequence has room r
    for n, items in runs:
        room = capacity - sum(items)
        open_[room][items] += n
        rooms |= 1 << room
    for x in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[x]
        while n:
            fits = rooms >> x
            if not fits:
                each = capacity // x
                full, rest = divmod(n, each)
                for count, k in ((full, each), (1, rest)):
                    if count and k:
                        room = capacity - k * x
                        open_[room][(x,) * k] += count
                        rooms |= 1 << room
                break
            room = x + (fits & -fits).bit_length() - 1
            items, count = open_[room].popitem()
            k = min(n, count)
            if count > k:
                open_[room][items] = count - k
            elif not open_[room]:
                rooms &= ~(1 << room)
            open_[room - x][items + (x,)] += k
            rooms |= 1 << (room - x)
            n -= k
    return [(n, items) for by in open_.values() for items, n in by.items()]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Sorted intervals: from (length, rank) on, sequence and offset. Rank r of the interval is in sequence base + r - rank."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for n, items in runs:
        at = 0
        for x in items:
            rows.append((x, used[x], base, at))
            used[x] += n
            at += x
        base += n
    rows.sort()
    got = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return got[:, 0], got[:, 1], got[:, 2], got[:, 3]


def ranked(parts: DataFrame, salts: int) -> DataFrame:
    """Number the pieces of each length from 0 without one task having to hold a length.

    Pieces of a length are dealt into ``salts`` parts and numbered within each; the
    parts' counts say where each part's numbers begin.
    """
    dealt = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = dealt.withColumn("rank", within - 1).join(starts, ["length", "salt"])
    return numbered.withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone, a piece of length 1. Only documents of
    more than ``capacity`` ids are cut. Rows that repeat are packed each. No documents,
    no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = written(pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity, groups)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, base, offset = table.value
        key = length << 40 | rank
        for batch in batches:
            at = np.searchsorted(key, batch["length"].to_numpy() << 40 | batch["rank"].to_numpy(), "right") - 1
            yield batch.assign(sequence_id=base[at] + batch["rank"].to_numpy() - rank[at], offset=offset[at]).drop(columns="rank")

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked(parts, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
