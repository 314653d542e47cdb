from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausework.llm import decontamination, exact_topk, near_dedup, sharding, suffix_dedup
from clausework.llm.common import utf8


# Sharding.


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_have_exact_sizes_and_gapless_slots(spark, shards):
    df = spark.range(0, 1003, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(None).cast("string").alias("n"))
    rows = sharding.shard(df, shards, seed=1, rows_per_chunk=50).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1003))
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, slots.values()), reverse=True) == sharding.shard_sizes(1003, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(df, shards, seed=1, rows_per_chunk=50).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_sharding_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty).count() == 0
    same = spark.createDataFrame([(None, "")] * 90, "doc_id long, text string")
    assert sharding.shard(same, 40).groupBy("shard").count().agg(F.max("count")).first()[0] == 3


def test_communication_matrix_is_uniform():
    draws = [sharding.communication_matrix([2, 2], [2, 2], s)[0, 0] for s in range(3000)]
    freq = np.bincount(draws, minlength=3) / len(draws)
    assert np.abs(freq - np.array([1, 4, 1]) / 6).max() < 0.04
    m = sharding.communication_matrix([5, 0, 7], [4, 4, 4], 3)
    assert m.sum(0).tolist() == [4, 4, 4] and m.sum(1).tolist() == [5, 0, 7]


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(x) - 250_000) < 120
    assert 300 < np.std(x) < 570
    assert sharding.hypergeometric(rng, 0, 10**10, 5) == 0 and sharding.hypergeometric(rng, 10**10, 0, 5) == 5


def test_op1_columns(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in sharding.op1_hypergeometric_sharding(spark, tiny).collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


# Exact top-k.


def brute_top(vectors, k):
    out = []
    for q, x in vectors:
        if q % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors if v != q)
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 40)
    monkeypatch.setattr(exact_topk, "QUERIES", 2)
    rng = random.Random(2)
    vectors = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(200)]
    vectors[7] = (7, vectors[8][1])
    df = spark.createDataFrame(vectors, "vec_id long, vector array<double>")
    got = exact_topk.exact_top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(vectors, 5)


def test_bounds_hold_the_score():
    rng = np.random.default_rng(2)
    x, q = (rng.integers(-99, 99, (n, 12)).astype(float) for n in (200, 20))
    block = exact_topk.Block(np.arange(200), x)
    score = q @ x.T
    assert (block.first_bounds(q) >= score).all()
    for depth in range(len(exact_topk.DEPTHS)):
        low, high = (np.stack(b) for b in zip(*[block.bounds(v, np.arange(200), depth) for v in q], strict=True))
        assert (low <= score).all() and (score <= high).all()
        if not depth:
            assert (high <= block.first_bounds(q)).all()
    assert (low == score).all() and (high == score).all()


def test_queries_stop_before_the_lists_end():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(8, 16)))[rng.integers(0, 8, 2000)] + rng.integers(-40, 40, (2000, 16))
    block = exact_topk.Block(np.arange(2000), x)
    i, at, score = block.top(np.arange(0, 2000, 50), x[::50], np.full(40, -np.inf), 5)
    want = np.sort(np.where(np.arange(0, 2000, 50)[:, None] == np.arange(2000), -np.inf, x[::50] @ x.T), axis=1)[:, :-6:-1]
    assert (score.reshape(40, 5) == want).all()
    assert block.stopped[-1] == 0 and sum(block.stopped) == 40


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [0.5, 0.5]), (50, [0.25])]
    v = exact_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = exact_topk.exact_top_k(v, v.where("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 5, 98304), (0, 2, 50, 16384), (50, 1, 0, 16384), (50, 2, 5, 8192)]
    assert exact_topk.exact_top_k(v.limit(0), v).count() == 0


# Decontamination.

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 7)) for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_distance(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_semiglobal_distance():
    rng = random.Random(3)
    items = decontamination.Items([(1, "abcabcab xyz"), (2, "q" * 9)], 0.8)
    for _ in range(100):
        text = bytes(rng.choices(b"abcxyz q", k=rng.randint(0, 25)))
        for k in (0, 1):
            assert items.distance(k, text) == brute_distance(items.text[k], text)


def test_walks_share_their_heads_but_not_their_keys():
    rng = random.Random(8)
    text = np.frombuffer(" ".join(rng.choice(["a", "ab", "abc", "the", "then", "there"]) for _ in range(400)).encode() + bytes(60), np.uint8)
    at = decontamination.word_starts(text[:-60], np.array([0, len(text) - 60]))
    windows = decontamination.Windows(text, at)
    assert len(windows.first) < len(at)
    for steps, sampled in ((5, 3), (10, 5), (28, 12)):
        walk = decontamination.Walk(1, steps, sampled)
        samples = []
        for p in at.tolist():
            seen = []
            for step in range(max(walk.sampled) + 1):
                if step in walk.sampled:
                    seen.append(int(text[p]))
                p += int(walk.bits[step][text[p]])
            samples.append(tuple(seen))
        places, keys, _ = walk.keys(text, windows)
        assert places.tolist() == at.tolist()
        assert len(set(zip(samples, keys.tolist(), strict=True))) == len(set(samples)) == len(set(keys.tolist()))


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(99, "short one here"), (100, ""), (101, None)]
    docs, truth = [], set()
    for d in range(120):
        text = prose(rng, 120)
        if d % 3 == 0:
            k, item = items[rng.randrange(12)]
            chars = [c for c in item.upper() if rng.random() > 0.04]
            p = rng.randrange(len(text))
            text = text[:p] + " " + "".join(chars).replace(" ", "  ") + ". " + text[p:]
            truth.add((d, k))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "x Short, one here y"), (502, "x Short, one here y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] < 500}
    assert len(truth & got) >= 0.97 * len(truth) and got <= truth
    assert sum(r["doc_id"] == 502 for r in rows) == 2
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [20, 40, 60, 75, 100, 130, 200, 300])
def test_recall_at_the_threshold_for_every_length(size):
    rng, found, wanted = random.Random(23), 0, 0
    for _ in range(120):
        items = decontamination.Items([(1, prose(rng, 80)[:size])], 0.8)
        chars = list(items.text[0].decode())
        for _ in range(len(chars) // 5):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], [rng.choice("abcdefgh")], [chars[at], rng.choice("abcdefgh")]])
        raw = f"{prose(rng, 40)} {''.join(chars)} {prose(rng, 40)}".encode()
        text = decontamination.squeezed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        if items.distance(0, text.tobytes()) <= len(items.text[0]) // 5:
            wanted += 1
            hits = items.hits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            found += len(hits) == 1
    assert wanted > 60 and found >= 0.9 * wanted, (found, wanted)


def test_piece_screen_never_drops_a_hit():
    rng = random.Random(24)
    for _ in range(300):
        items = decontamination.Items([(1, prose(rng, rng.randint(2, 60))), (2, prose(rng, 5))], 0.8)
        n = len(items.text[0])
        allowed = int(0.2 * n + 1e-9)
        chars = list(items.text[0])
        for _ in range(rng.randint(0, allowed)):
            chars[rng.randrange(len(chars))] = rng.choice(b"abcxyz ")
        text = np.frombuffer(prose(rng, 9).encode() + b" " + bytes(chars) + b" " + prose(rng, 9).encode(), np.uint8)
        near = items.pieces_near(text, np.array([0, 0, 1]), np.array([0, 0, 0]), np.array([len(text), 1, len(text)]))
        if items.distance(0, text.tobytes()) <= allowed:
            assert near[0] and not near[1]


def test_edit_minimum_of_many_spans():
    rng = random.Random(25)
    items = ["".join(rng.choices("ab c", k=rng.randint(1, 64))).encode() for _ in range(40)]
    text = np.frombuffer("".join(rng.choices("ab c", k=300)).encode(), np.uint8)
    table = np.zeros((len(items), 256), np.uint64)
    for r, item in enumerate(items):
        for i, c in enumerate(item):
            table[r, c] |= np.uint64(1 << i)
    row = np.array([rng.randrange(40) for _ in range(200)])
    a = np.array([rng.randrange(300) for _ in row])
    b = np.array([rng.randint(x, min(300, x + 90)) for x in a])
    got = decontamination.edit_minimum(text, a, b, table, row, np.array([len(items[r]) for r in row]))
    assert got.tolist() == [brute_distance(items[r], text[x:y].tobytes()) for r, x, y in zip(row, a, b, strict=True)]


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 200)
    rng = random.Random(5)
    items = [(i, prose(rng, 20)) for i in range(6)]
    df = spark.createDataFrame([(i, f"{prose(rng, 10)} {t} {prose(rng, 10)}") for i, t in items], "doc_id long, text string")
    rows = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in rows) == [(i, i, 0) for i in range(6)]


# Near duplicates.


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(row[j + 1], nxt[j]))
        row = nxt
    return row[-1]


def test_banded_alignment():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.randrange(9)
        full = brute_lcs(a, b)
        for least in (0, full, full + 1):
            got = near_dedup.banded_lcs(a, b, least)
            assert got == full if least <= full else got < least


def test_shingles_and_words():
    data, off = utf8(pa.array(["One, two THREE", "one two three", "", "a b c d e f", "É é", None]))
    words, at = near_dedup.word_hashes(data, off)
    assert np.diff(at).tolist() == [3, 3, 0, 6, 2, 0]
    assert words[:3].tolist() == words[3:6].tolist() and words[-1] == words[-2]
    grams, g = near_dedup.shingles(words, at)
    assert np.diff(g).tolist() == [1, 1, 0, 2, 1, 0]


def edited(rng, text, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split())


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = prose(rng, 150)
        texts += [base, base, edited(rng, base, 0.006), edited(rng, base, 0.02), edited(rng, base, 0.2)]
    texts += ["", None, "!!!", "tiny text", "Tiny text!"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, copy string")
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    grams = [near_dedup.grams_of(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or near_dedup.similarity(grams[i], grams[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: (find(i), find(i) == i) for i in range(len(texts))}
    assert got == want


def test_near_duplicates_that_share_a_template(spark):
    rng = random.Random(2)
    template, texts = prose(rng, 170), []
    for _ in range(60):
        own = prose(rng, 24)
        texts.append(f"{template} {own}")
    texts += [edited(rng, t, 0.025) for t in texts[20:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    grams = [near_dedup.grams_of(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(grams[i], grams[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) == 84
    assert got == dict(enumerate(root))


def test_histograms_never_drop_a_pair_that_is_alike(spark):
    rng = random.Random(22)
    base = prose(rng, 200)
    texts = [base, *[edited(rng, base, r / 400) for r in range(12)], prose(rng, 200), "word " * 3000, "word " * 3001]
    data, off = utf8(pa.array(texts))
    bins = near_dedup.histograms(*near_dedup.shingles(*near_dedup.word_hashes(data, off)))
    assert bins[-1] is None
    pairs = [(i, j, bins[i], bins[j]) for i in range(len(texts)) for j in range(i)]
    df = spark.createDataFrame(pairs, "i int, j int, x binary, y binary").withColumn("can", near_dedup.possible(0.8)("x", "y"))
    grams = [near_dedup.grams_of(t) for t in texts]
    can = {(r["i"], r["j"]): r["can"] for r in df.collect()}
    assert all(can[i, j] for i, j in can if near_dedup.similarity(grams[i], grams[j]) >= 0.8) and not can[13, 0]


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(5)
    long, other = prose(rng, 300), prose(rng, 40)
    rows = [(1, None), (2, ""), (3, "one"), (4, "One!"), (None, "one"), (7, long), (7, other), (7, other), (9, long + " end"), (None, other + " end"), (None, "alone"), (2, long)]
    df = spark.createDataFrame([(d, t, "c", "k") for d, t in rows], "doc_id long, text string, class_id string, kept string")
    out = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()]
    first = {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (None, 3, False), (7, 2, False), (7, 7, True), (9, 2, False), (None, 7, False), (None, None, True), (2, 2, True)}
    assert len(out) == len(rows) and set(out) == first and out.count((7, 7, True)) == 2
    left = near_dedup.first_of_class(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(1, None), (3, "one"), (7, other), (0, "alone"), (2, long)], key=lambda r: (r[0], r[1] or "")), left.collect()
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.first_of_class(df.limit(0)).count() == 0


def test_shown_shingles_always_meet(spark):
    """Two sets that are alike have their first common shingle among those that they show, at a place from which the rest is enough."""
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 60)
        x = set(rng.sample(range(200), n))
        y = set(x)
        for _ in range(rng.randint(0, max(1, n // 5))):
            y.discard(rng.choice(sorted(y or {0})))
            if rng.random() < 0.5:
                y.add(rng.randint(0, 400))
        if not y or len(x & y) < 0.8 * len(x | y):
            continue
        x, y = sorted([sorted(x), sorted(y)], key=len)
        few, many = near_dedup.shown(np.array([len(x), len(y)]), 0.8)
        common = min(set(x) & set(y))
        i, j = x.index(common), y.index(common)
        assert i < few[0] and j < many[1]
        assert min(len(x) - i, len(y) - j) >= 0.8 / 1.8 * (len(x) + len(y)) - 1e-6


def test_order_matters_to_a_sketch():
    a = [f"w{i}" for i in range(60)]
    data, off = utf8(pa.array([" ".join(a), " ".join(a[30:] + a[:30])]))
    keys = near_dedup.sketches(*near_dedup.shingles(*near_dedup.word_hashes(data, off)), 200)
    same = (keys[0] == keys[1]).mean()
    assert 0.3 < same < 0.75


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(root) if find(i) != i}
    roots = near_dedup.components(spark.createDataFrame(edges[::2], "a long, b long"))
    more = near_dedup.joined(roots, spark.createDataFrame(edges[1::2], "a long, b long"))
    assert {r["node"]: r["root"] for r in more.collect()} == got and more.count() == len(got)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated passages.


def brute_removal(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            if d is not None:
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((d, int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_removal_equals_brute_force(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passages = [letters(n) for n in (49, 50, 51, 60, 130)]
    rows = [(d, letters(rng.randint(0, 60)) + rng.choice(passages) + letters(rng.randint(0, 60)) + rng.choice(passages)[: rng.randint(0, 130)]) for d in range(60)]
    rows += [(60, "x" * 200), (61, "x" * 120), (62, "é" * 40), (63, "é" * 30 + "q"), (64, "abc" * 40), (65, "zabc" * 3 + "abc" * 30)]
    rows += [(66, rows[0][1]), (67, rows[0][1]), (67, rows[0][1]), (68, "short"), (69, "short"), (70, None), (71, ""), (None, rows[0][1]), (5, rows[5][1] + passages[4])]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string")
    got = [(r["doc_id"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute_removal(rows)


def test_windows_sorted_with_the_cover():
    rng = np.random.default_rng(10)
    n = 60
    near = rng.integers(97, 99, (n, suffix_dedup.SPAN + 4)).astype(np.uint8)
    near[20:40] = near[:20]
    near[30:40, 60:] = 120
    doc = rng.permutation(n).astype(np.int64)
    gram = np.zeros(n, np.uint64)
    place = np.full(n, 0 << 12 | suffix_dedup.REACH << 6 | 0, np.int64)
    hit = suffix_dedup.sorted_windows(gram, doc, place, near)
    for distance in range(suffix_dedup.REACH + 1):
        s = suffix_dedup.REACH - distance
        window = [near[i, s : s + suffix_dedup.LENGTH].tobytes() for i in range(n)]
        least = {w: min(doc[i] for i in range(n) if window[i] == w) for w in window}
        assert hit[:, distance].tolist() == [bool(doc[i] > least[window[i]]) for i in range(n)]


def test_removal_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0
    one = spark.createDataFrame([(1, "a" * 500)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(one).first()["n_removed"] == 0


def test_whole_characters(spark):
    df = spark.createDataFrame([(bytearray("é".encode()[1:] + b"ab" + "é".encode()[:1]),)], "kept binary")
    assert df.select(suffix_dedup.whole_characters(F.col("kept")).alias("t")).first()["t"] == "ab"
