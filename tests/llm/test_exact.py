"""Operators against brute force on small tables, held-out accuracy, and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, mixing, packing, pii, quality, simhash, topk, warc
from tessera.llm.queries import QUERIES, tokenizer_path

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def slow_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbB é\t\n\x0b", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_query(spark):
    """The query over its whole table against all pairs."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    fp = {k: slow_fingerprint(t) for k, t in texts.items()}
    parent = {k: k for k in fp}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    rows = QUERIES["op1_simhash_neardup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{v:016x}", root(k)) for k, v in fp.items()}


def near_base(rng, n):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    return np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(b)) for b in (3, 17, 40)]]))


def test_bk_forest():
    fps = near_base(np.random.default_rng(5), 40)
    parent, distance = simhash.grow(fps)
    assert all(int(fps[k] ^ fps[p]).bit_count() == d for k, (p, d) in enumerate(zip(parent, distance)))
    assert len({(p, d) for p, d in zip(parent[1:], distance[1:])}) == len(fps) - 1
    forest = simhash.Forest([(7, fps, parent, distance), (3, fps[:1], parent[:1], distance[:1])])
    pairs = [(int(a), int(forest.fps[b])) for x, y in forest.near(fps, np.full(len(fps), 7), 2) for a, b in zip(x, y)]
    assert sorted(pairs) == sorted((a, int(fps[b])) for a, b in itertools.product(range(len(fps)), repeat=2) if int(fps[a] ^ fps[b]).bit_count() <= 2)


def test_the_triangle_rule_skips_most_of_a_tree_of_thousands():
    fps = near_base(np.random.default_rng(6), 1024)
    forest = simhash.Forest([(0, fps, *simhash.grow(fps))])
    looked, near = 0, forest.child

    class Counted:
        def __getitem__(self, at):
            nonlocal looked
            looked += len(at)
            return near[at]

    forest.child = Counted()
    assert sum(len(a) for a, _ in forest.near(fps, np.zeros(len(fps), np.int64), 2)) >= 4 * 3 * 1024
    assert len(fps) > 4000 and looked < 0.5 * len(fps) ** 2


def test_shards_hold_thousands_and_lose_nothing(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    hot = [base[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(20), 2)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), 2)) for b in base for _ in range(6)} | set(base) | set(hot)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in sorted(fps)], "fp long")
    whole = {tuple(r) for r in simhash.components(simhash.links(df)).collect()}
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(b)] = root(a)
    groups: dict[int, set] = {}
    for r in whole:
        groups.setdefault(r[1], {r[1] % 2**64}).add(r[0] % 2**64)
    want: dict[int, set] = {}
    for f in fps:
        want.setdefault(root(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    # many small shards, shards dealt anew, several trees of a shard, and several waves give the same
    for tree, most, wave in ((4, 32, 1 << 20), (4, 3, 1 << 20), (16, 64, 2000)):
        assert {tuple(r) for r in simhash.components(simhash.links(df, tree=tree, most=most, wave=wave)).collect()} == whole
    grown = simhash.trees(simhash.shards(simhash.written(spark.range(20000).select(F.xxhash64("id").alias("fp")), "fps")), 1)
    assert grown.agg(F.min("n")).first()[0] > 1000


def test_many_waves_make_no_deeper_plan(spark):
    """Each wave has folders of its own, of which the trees and questions of others are no part; the result is one folder."""
    df = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    near = df.union(df.select(F.col("fp").bitwiseXOR(F.lit(1 << 30 | 1)).alias("fp")))
    one, many = simhash.links(near, tree=16), simhash.links(near, tree=16, wave=8_000)
    folders = lambda d: {f.rsplit("/", 2)[-2] for f in d.inputFiles()}
    assert len(folders(one)) == 1 and len(folders(many)) >= 50
    depth = lambda d: len(d._jdf.queryExecution().executedPlan().toString().splitlines())
    assert depth(one) == depth(many)
    assert {tuple(r) for r in simhash.components(one).collect()} == {tuple(r) for r in simhash.components(many).collect()}
    assert simhash.components(many).count() == 3000  # one of each pair is its root


def test_packing_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op3_best_fit_packing"](spark, SMALL).collect()
    want = {}
    for r in docs:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], k] = (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    sequences = len({r["sequence_id"] for r in rows})
    assert sequences <= -(-sum(r["length"] for r in rows) // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_every_piece(histogram):
    runs = packing.plan(histogram, 64, 8)
    held: dict[int, int] = {}
    for n, items in runs:
        assert sum(items) <= 64
        for x in items:
            held[x] = held.get(x, 0) + n
    assert held == histogram


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1257@.+- ()é", max_size=50))
def test_pii_base(text):
    assert pii.detect(text) == slow_base(text)


def test_pii_base_of_documents(spark):
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect():
        assert pii.detect(r["text"] or "") == slow_base(r["text"] or "")


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail jo [at] mill [dot] org now", "email", "jo [at] mill [dot] org"), ("mail jo at mill dot com now", "email", "jo at mill dot com"),
    ("call +4nine 30 one two three four five six now", None, None), ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("mail jо@mill.org now", "email", "jо@mill.org"), ("card four one one one 1111 1111 1111 1 1 1 1", None, None), ("at the mill dot the", None, None),
])
def test_pii_disguises(text, kind, span):
    found = pii.disguised(text, pii.detect(text))
    if kind:
        assert [text[a:b] for a, b in found[kind]] == [span]
    else:
        assert not found["email"]


def test_salvage_skips_damage(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "<p>" + str(k) * 500) for k in range(1, 9)], "page_id long, url string, html string")
    data = b"".join(bytes(r["member"]) for r in warc.members(warc.record_plan(pages)).collect())
    whole = list(warc.salvage(data))
    assert len(whole) == 8 and all(r[4] for r in whole)
    cut = bytearray(data)
    middle = (whole[3][0] + whole[3][1]) // 2
    cut[middle : middle + 5] = b"\0\0\0\0\0"
    found = list(warc.salvage(bytes(cut)))
    assert sum(r[4] is not None for r in found) == 7
    assert [r[:2] for r in found if r[4] is None] == [(whole[3][0], whole[3][1])]
    plain = b"".join(gzip.decompress(data[r[0] : r[1]]) for r in whole)
    assert sum(r[4] is not None for r in warc.salvage(b"junk" + plain + b"WARC/1.1\r\nbroken")) == 8


def record(k: int, size: int = 400) -> bytes:
    body = random.Random(k).randbytes(size).hex()
    return warc._record(k, f"http://a/{k}", body, len(body), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode(), "response", None)


def numbers(data: bytes) -> list[int]:
    return [warc._number(r[4]["warc-record-id"]) for r in warc.salvage(data) if r[4]]


def test_salvage_inside_members():
    records = [record(k) for k in range(20)]
    raw = bytearray(b"".join(records))
    raw[len(records[0]) + len(records[1]) // 2] ^= 1  # the block of the second record
    member = gzip.compress(bytes(raw), mtime=0)
    assert numbers(member) == [0, *range(2, 20)]
    assert [(r[2], r[3]) for r in warc.salvage(member) if r[4] is None] == [(len(records[0]), len(records[0]) + len(records[1]))]
    whole, after = gzip.compress(b"".join(records), mtime=0), gzip.compress(record(99), mtime=0)
    for share in (0.2, 0.5, 0.9):
        cut = whole[: int(len(whole) * share)]
        got = numbers(cut + after)
        assert got[-1] == 99 and got[:-1] == list(range(len(got) - 1)) and len(got) - 1 >= int(20 * share) - 1
    bad = whole[:-6] + b"\0\0" + whole[-4:]  # the member's own checksum
    assert numbers(bad + after) == [*range(20), 99]
    assert [warc._number(r[4]["warc-record-id"]) if r[4] else r[:2] for r in warc.salvage(b"junk" + after)] == [(0, 4), 99]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_salvage_loses_only_what_is_damaged(data):
    parts = [gzip.compress(record(k, 60), mtime=0) for k in range(6)]
    k = data.draw(st.integers(0, 5))
    at = data.draw(st.integers(0, len(parts[k]) - 1))
    parts[k] = parts[k][:at] + bytes([parts[k][at] ^ data.draw(st.integers(1, 255))]) + parts[k][at + 1 :]
    got = numbers(b"".join(parts))
    assert [x for x in range(6) if x != k] == [x for x in got if x != k]


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    """Pages that don't compress, of all sizes, one of them larger than an archive: every page is read back."""
    rows = [(k, f"http://a/{k}", random.Random(k).randbytes(700_000 if k == 30 else 200 + 997 * k).hex()) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.record_plan(pages), path, most=100_000)
    sizes = {r["path"]: r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()}
    assert len(sizes) > 15 and sum(n > 100_100 for n in sizes.values()) == 1
    got = warc.read_archives(spark, path).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["kind"] == "record"} == {k: html for k, _, html in rows}
    assert not [r for r in got if r["kind"] == "gap"]
    again = warc.archive_round_trip(pages, most=100_000).collect()
    assert sorted(r["page_id"] for r in again) == list(range(60)) and {r["record_type"] for r in again} == {"response"}


def test_gaps_are_logged(spark, tmp_path):
    data = gzip.compress(record(1), mtime=0) + b"damage" + gzip.compress(record(2), mtime=0)
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [1, 2]
    assert [data[r["start"] : r["stop"]] for r in rows if r["kind"] == "gap"] == [b"damage"]


def test_topk_random(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 12)).astype(np.float32)
    v[40:60] = v[0]
    df = topk.scaled(spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<float>"))
    whole = np.floor(v.astype(np.float64) * 1024).astype(np.int64)
    asked = df.where("vec_id % 100 = 0")
    got = sorted(tuple(r)[:4] for r in topk.top_k(df, asked, block=128).collect())
    assert sorted(tuple(r)[:4] for r in topk.top_k(df, asked, block=128, wave=300).collect()) == got
    want = []
    for q in range(0, 700, 100):
        score = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(700), -score)) if k != q][:10]
        want += [(q, i, int(k), int(score[k])) for i, k in enumerate(order, 1)]
    assert got == sorted(want)


def test_lists_are_read_in_order_until_outsiders_cannot_qualify():
    rows = np.stack(pq.read_table(f"{MORE[:-2]}1/embeddings.parquet")["embedding"].to_numpy()).astype(np.float64)
    v = np.floor(rows * 1024).astype(np.int64)
    assert len(v) == 2000
    lists, first = topk.SortedLists(v[160:], np.arange(160, 2000)), topk.SortedLists(v[:160], np.arange(160))
    broken = topk.SortedLists(v[160:], np.arange(160, 2000))
    rng = np.random.default_rng(4)
    for i in range(64):
        inside = np.r_[0, 1 + rng.permutation(len(v) - 162), len(v) - 161]
        broken.order[i], broken.values[i] = broken.order[i][inside], broken.values[i][inside]
    reads, alive, wrong = [], [], 0
    for q in range(0, 2000, 100):
        _, bar, _, _ = first.top(v[q], q, 10)
        ids, scores, read, left = lists.top(v[q], q, 10, float(bar[-1]))
        reads.append(read)
        alive.append(left)
        assert (scores == v[ids] @ v[q]).all()
        best = np.sort((v[160:] @ v[q])[np.arange(160, 2000) != q])[::-1][:10]
        reach = int((best >= bar[-1]).sum())
        assert (scores[:reach] == best[:reach]).all()
        other, _, depth, _ = broken.top(v[q], q, 10, float(bar[-1]))
        wrong += list(other) != list(ids) or depth != read
    assert max(alive) <= 40 / 1840 + 1e-9
    # most of each list, never all of them
    assert max(reads) < 1 and np.mean(reads) < 0.95
    assert wrong >= 18


def test_the_read_entries_bound_what_was_not_read():
    """Where few vectors stand out, lists are left near their better ends."""
    rng = np.random.default_rng(9)
    v = rng.integers(0, 20, (4000, 8))
    v[:60] += 500
    lists = topk.SortedLists(v, np.arange(4000))
    ids, scores, read, _ = lists.top(np.arange(1, 9), -1, 10)
    assert (scores == np.sort(v @ np.arange(1, 9))[::-1][:10]).all() and read < 0.15


def test_topk_in_many_waves(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 6))
    df = topk.scaled(spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>"))
    asked = df.where("vec_id % 2 = 0")
    one, many = topk.top_k(df, asked), topk.top_k(df, asked, wave=500)
    folders = {f.rsplit("/", 2)[-2] for f in many.inputFiles()}
    assert len(folders) >= 50
    assert sorted(tuple(r)[:4] for r in one.collect()) == sorted(tuple(r)[:4] for r in many.collect())
    depth = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert depth(one) == depth(many)


def test_scores_beyond_64_bits_are_held_at_the_bounds(spark):
    rows = [(0, [3e15, 1.0]), (100, [-3e15, 2.0]), (1, [3e15, 4.0]), (2, [1.0, 1e30])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    whole = {r["vec_id"]: r["v"] for r in df.collect()}
    for q, c in itertools.permutations(whole, 2):
        if q % 100 == 0:
            assert got[q, c] == min(max(sum(a * b for a, b in zip(whole[q], whole[c])), -(2**63)), 2**63 - 1)


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "Aa. " * 700, "x" * 20_000, "a\nb" * 400, "\U0001d400. " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks_of(F.col("text")).alias("c"))
    assert all("".join(r["c"]) == r["text"] for r in df.collect())


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{MORE}/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["want"]) <= r["most"] / 2 + 1 for r in rows)


def test_language_accuracy(spark):
    got = QUERIES["op8_byte_cnn_language"](spark, MORE).join(spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out AND lang_pred <> 'und'").agg(F.count(F.lit(1)), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 100 and right / n >= 0.95


def test_pipeline_against_its_stages(spark):
    """Every stage by plain means on what the one before has kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality"))
    both = model.compressors()
    rows = [r for r in docs.collect() if model.score(np.array(quality.difference(r["text"] or "", both))) >= 0.5]
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for r in rows:
        if fold(r["text"]) not in last or last[fold(r["text"])]["doc_id"] < r["doc_id"]:
            last[fold(r["text"])] = r
    groups: list[list] = []
    for r in last.values():
        near = [g for g in groups if any((slow_fingerprint(r["text"] or "") ^ slow_fingerprint(x["text"] or "")).bit_count() <= 2 for x in g)]
        groups = [g for g in groups if g not in near] + [[r, *sum(near, [])]]
    firsts = [min(g, key=lambda r: r["doc_id"]) for g in groups]
    kept = spark.createDataFrame(firsts, docs.schema)
    # which of them the mix takes, from its own rule: targets by source, then the smallest hashes
    copies = {}
    h = {r["doc_id"]: r["h"] for r in mixing.sized(kept).collect()}
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in firsts}
    targets = {r["source"]: r["target"] for r in mixing.source_targets(mixing.sized(kept)).collect()}
    for source, target in targets.items():
        of = sorted((r["doc_id"] for r in firsts if r["source"] == source), key=h.get)
        whole = sum(sizes[k] for k in of)
        passes, upto = int(target // whole), 0
        rest = target - passes * whole
        for k in of:
            more = upto + sizes[k] <= rest or (upto <= rest and 2 * (rest - upto) >= sizes[k])
            copies[k] = passes + int(more)
            upto += sizes[k]
    want = sorted(k for k, n in copies.items() if sizes[k] for _ in range(n))
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in out.where("piece = 0").collect()) == want
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end OR n > 2048")
    assert full.count() == 0


def test_the_pipeline_repeats_itself(spark, tmp_path):
    """Equal rows whatever the files are called and however many there are."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("source", F.lit("again"))).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    kept = []
    for k, files in enumerate((1, 5)):
        docs.repartition(files, F.rand(k)).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        rows = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{tmp_path}/{k}/{name}"
            stage(spark, rows, f"{tmp_path}/{k}").write.parquet(path)
            rows = spark.read.parquet(path)
        kept.append(sorted(map(str, rows.collect())))
    assert kept[0] == kept[1] and len(kept[0]) > 100


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    from tessera.llm.common import scratch, shared_dir, written

    at = Path(shared_dir(spark).removeprefix("file://")) / "tessera"
    before = {p.name for p in at.glob("*")} if at.exists() else set()
    with scratch(spark):
        assert written(spark.range(5), "some").count() == 5
    assert {p.name for p in at.glob("*")} == before
