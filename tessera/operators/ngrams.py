"""Counts of words and short word sequences of large tables, by two sides.

Tasks cut and count a few megabytes of text at once, by numbers instead of strings; what they find
moves in rows of many terms, by buckets of the terms' hashes, and each bucket is added up by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task counts at once; a longer text is counted alone.
AT_ONCE = 8 << 20
#: Buckets of a shuffle partition, so that partitions even out, and of a table at least, so that a bucket's terms are few.
BUCKETS, LEAST = 16, 512
FOUND = "bucket int, terms string, y1 array<int>, y0 array<int>"

#: 2: letters and digits, 1: what counts within a word only, 0: what words are cut at.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")], _KIND[list(b"'-")] = 2, 1


def cut(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of the bytes of texts that are in lower case and end in a blank each: their numbers, their texts' places, and the words by number.

    Words have two characters at least and aren't digits only; hyphens and apostrophes around them are gone.
    """
    kind = _KIND[text]
    marks = np.flatnonzero(kind == 1)
    if len(marks):
        opens = np.diff(marks, prepend=-2) > 1
        first, last = marks[opens], marks[np.append(opens[1:], True)]
        # a text ends in a blank, so there is a place after each mark; before the first one there may be none
        inside = (first > 0) & (kind[first - 1] == 2) & (kind[last + 1] == 2)
        kind[marks[~inside[np.cumsum(opens) - 1]]] = 0
    on = kind > 0
    edge = np.diff(on.view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(text[on])).dictionary_encode()
    known = coded.dictionary
    sound = pc.and_(pc.greater_equal(pc.binary_length(known), 2), pc.invert(pc.match_substring_regex(known, "^[0-9]+$"))).to_numpy(zero_copy_only=False)
    words = coded.indices.to_numpy().astype(np.int64)
    kept = sound[words]
    return words[kept], np.searchsorted(ends, start[kept], "right"), known


def count(texts: pa.Array, side: np.ndarray, most: int, stop: pa.Array, buckets: int) -> pa.RecordBatch:
    """Terms of up to ``most`` words of some texts and how often either side has them, a row for each bucket: its terms line by line, and their counts."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    words, text, known = cut(np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds[1:] - bounds[0])
    one, hashes = side[text], np.fromiter((zlib.crc32(w) for w in known.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))
    # of each length: the terms' numbers where they start, the terms by number and their hashes
    at, terms, mixed, found = words, known, hashes, []
    for n in range(1, most + 1):
        if n > 1:
            pairs = pa.array(at[: len(words) - n + 1] * len(known) + words[n - 1 :]).dictionary_encode()
            head, tail = np.divmod(pairs.dictionary.to_numpy(), max(1, len(known)))
            at, terms = pairs.indices.to_numpy().astype(np.int64), pc.binary_join_element_wise(terms.take(head), known.take(tail), pa.scalar(" ", pa.large_string()))
            mixed = mixed[head] * np.uint64(0x9E3779B97F4A7C15) + hashes[tail]
        whole = text[: len(at)] == text[n - 1 :]
        by = np.bincount(at[whole] * 2 + one[: len(at)][whole], minlength=2 * len(terms)).reshape(-1, 2)
        some = by.any(axis=1)
        if n == 1:
            some &= ~pc.is_in(terms, stop).to_numpy(zero_copy_only=False)
        where = np.flatnonzero(some)
        found.append((terms, where, by[where], (mixed[where] ^ mixed[where] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)))
    by, bucket = np.concatenate([b for _, _, b, _ in found]), np.concatenate([h for *_, h in found]) % np.uint64(buckets)
    base = np.cumsum([0, *(len(t) for t, *_ in found)])
    named = np.concatenate([w + k for k, (_, w, *_) in zip(base, found)])
    # within a bucket by the counts, so that they are packed to little
    order = np.argsort(np.minimum(by, 3).astype(np.uint8) @ np.array([4, 1], np.uint8), kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    each, y1, y0 = bucket[order], by[:, 1].astype(np.int32)[order], by[:, 0].astype(np.int32)[order]
    first = np.flatnonzero(np.diff(each, prepend=np.uint64(buckets)))
    offsets = pa.array(np.append(first, len(each)), pa.int32())
    ordered = pa.concat_arrays([t for t, *_ in found]).take(pa.array(named[order])).cast(pa.string())
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (ordered, pa.array(y1), pa.array(y0))]
    return pa.RecordBatch.from_arrays([pa.array(each[first].astype(np.int32)), pc.binary_join(lists[0], "\n"), *lists[1:]], ["bucket", "terms", "y1", "y0"])


def counted(rows: DataFrame, most: int, stop: list[str], least: int) -> DataFrame:
    """term, y1, y0 of the terms of rows(side, text) that occur ``least`` times in all; and of each bucket
    a row without a term: y1 and y0 of all its terms, and in ``terms`` how many they are.

    ``side`` is 1 or 0. Single words of ``stop`` are left out.
    """
    # a row of the shuffle holds what a few megabytes of text have of a bucket, and a bucket what its share of the terms is
    buckets = max(LEAST, BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, held, size = pa.array(stop, pa.large_string()), [], 0

        def done() -> pa.RecordBatch:
            texts = pa.concat_arrays([b["low"].cast(pa.large_string()) for b in held])
            return count(texts, np.concatenate([b["side"].to_numpy() for b in held]).astype(np.int64), most, none, buckets)

        for batch in batches:
            sizes, low = pc.binary_length(batch["low"]).to_numpy(zero_copy_only=False).tolist(), 0
            for k, n in enumerate(sizes):
                if size and size + n > AT_ONCE:
                    held.append(batch.slice(low, k - low))
                    yield done()
                    held, size, low = [], 0, k
                size += n
            held.append(batch.slice(low))
        if size:
            yield done()

    def add(group: pa.Table) -> pa.Table:
        flat = pa.table({"terms": pc.list_flatten(pc.split_pattern(group["terms"], "\n")), "y1": pc.list_flatten(group["y1"]), "y0": pc.list_flatten(group["y0"])})
        by = flat.group_by("terms", use_threads=False).aggregate([("y1", "sum"), ("y0", "sum")])
        kept = by.filter(pc.greater_equal(pc.add(by["y1_sum"], by["y0_sum"]), least))
        own = {"term": [None], "y1": [pc.sum(by["y1_sum"]).as_py()], "y0": [pc.sum(by["y0_sum"]).as_py()], "terms": [len(by)]}
        schema = pa.schema([("term", pa.string()), ("y1", pa.int64()), ("y0", pa.int64()), ("terms", pa.int64())])
        found = pa.table([kept["terms"], kept["y1_sum"], kept["y0_sum"], pa.nulls(len(kept), pa.int64())], schema=schema)
        return pa.concat_tables([found, pa.table(own, schema=schema)])

    lowered = rows.select(F.col("side").cast("int").alias("side"), F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")).alias("low"))
    return lowered.mapInArrow(read, FOUND).groupBy("bucket").applyInArrow(add, "term string, y1 long, y0 long, terms long")
