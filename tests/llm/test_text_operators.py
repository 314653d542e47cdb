from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausework.llm import chat_format, language_id, sentence_pieces, token_counts, toxicity
from clausework.llm.common import utf8

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "  a  b ", "a\x1cb\x85c", "don't WE'LL", "<|endoftext|> x<|endoftext|>", "½ ² ३४ 日本語", "x" * 3000, "▁a ▁", "　a​", "é" * 50, "a\n\n\nb\t", "🙂🙂 🙂"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ODD)
def test_token_counts_of_odd_texts(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_token_counts_equal_the_library(text):
    c = token_counts.counter(public.path("byte_bpe_50k.json"))
    lib = test_token_counts_equal_the_library.__dict__.setdefault("lib", tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")))
    assert c.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_token_counts_column(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (2, "", 9), (2, "", 9)], "doc_id int, text string, n_tokens int")
    rows = token_counts.token_counts(df).orderBy("doc_id", F.asc_nulls_first("text")).collect()
    assert [r["n_tokens"] for r in rows] == [2, 0, 0, 0]
    assert token_counts.token_counts(df.limit(0)).count() == 0


@given(st.lists(st.text(max_size=40), max_size=6), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_pieces_are_lossless_and_reproducible(texts, key):
    model = sentence_pieces.pieces(public.path(sentence_pieces.MODEL), 1.0)
    keys = np.arange(len(texts)) + key
    ids, off = model.encode(texts, keys)
    data, bounds = model.decode(ids, off)
    assert [data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(len(texts))] == texts
    again, _ = model.encode(texts[::-1], keys[::-1])
    assert sorted(again.tolist()) == sorted(ids.tolist())
    if texts:
        alone, _ = model.encode(texts[-1:], keys[-1:])
        assert alone.tolist() == ids[off[-2] :].tolist()


def test_pieces_decode_with_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public.path(sentence_pieces.MODEL))
    model = sentence_pieces.pieces(public.path(sentence_pieces.MODEL), 1.0)
    texts = ["Hello  world", " lead", "日本 é\nx", "a▁b"]
    ids, off = model.encode(texts, np.arange(len(texts)))
    assert [lib.decode(ids[off[i] : off[i + 1]].tolist()) for i in range(len(texts))] == texts


def test_sampling_follows_the_lattice():
    """Frequencies of the drawn segmentations of one word against all paths, weighed one by one."""
    model = sentence_pieces.pieces(public.path(sentence_pieces.MODEL), 1.0)

    def paths(word):
        if not word:
            return [((), 1.0)]
        return [((model.weight[word[:k]][0], *rest), model.weight[word[:k]][1] * w) for k in range(1, len(word) + 1) if word[:k] in model.weight for rest, w in paths(word[k:])]

    every = paths(" then")
    total = sum(w for _, w in every)
    n = 20_000
    ids, off = model.encode(["then"] * n, np.arange(n))
    seen = {}
    for i in range(n):
        p = tuple(ids[off[i] : off[i + 1]].tolist())
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= {p for p, _ in every}
    for p, w in every:
        want = w / total
        assert abs(seen.get(p, 0) / n - want) < 5 * (want * (1 - want) / n) ** 0.5 + 1e-4


def test_segment_column(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (3, None), (4, "")], "doc_id long, text string")
    rows = sentence_pieces.segment(df).collect()
    assert all(r["lossless"] for r in rows)
    assert rows[0]["piece_ids"] == rows[1]["piece_ids"]
    assert [r["n_pieces"] for r in rows[3:]] == [0, 0]


def test_toxicity_learns_sentences():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(200)]
    words = ["".join(chr(97 + int(d)) for d in str(abs(hash(w)) % 10**6)) for w in plain]
    texts, labels = [], []
    for i in range(400):
        body = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        labels.append(int(i % 5 == 0))
        if labels[-1]:
            body[2] += " idiot scum"
        texts.append(". ".join(body))
    model = toxicity.fit(texts, labels)
    got = [model.score(t) >= 0.5 for t in texts]
    assert np.mean(np.array(got) == np.array(labels)) > 0.98
    best = max(model.sentences(texts[0]), key=lambda s: s[1])
    assert "idiot" in best[0]
    assert 0 <= model.score("") < 0.5 and 0 <= model.score(None) < 0.5
    assert abs(model.score(texts[0]) - (1 - np.prod([1 - p for _, p in model.sentences(texts[0])]))) < 1e-6


def test_toxicity_without_two_classes():
    assert 0 < toxicity.fit(["a"], [0]).score("x") < 0.5
    assert 0 < toxicity.fit([], []).score("x") < 0.5


def test_toxicity_on_held_out_labels(spark, tiny):
    rows = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, tiny.replace("sf0.001", "sf0.01")).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tiny.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[d]["predicted"], y) for d, y in labels.items() if rows[d]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def brute_kernel(a: str, b: str) -> float:
    def grams(t):
        out = set()
        d, off = utf8(pa.array([t]))
        p = language_id.presence(d, off)[0]
        out.update(np.flatnonzero(p).tolist())
        return out

    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_language_kernel_and_accuracy():
    en, fr = "the cat and the dog were in the house with them", "le chat et la souris sont dans la maison avec eux"
    d, off = utf8(pa.array([en, fr]))
    u = language_id.unit(language_id.presence(d, off))
    assert abs(float(u[0] @ u[1]) - brute_kernel(en, fr)) < 1e-5
    model = language_id.fit([en, fr] * 5, ["en", "fr"] * 5)
    best, score = model.decide(*utf8(pa.array(["the dog and the cat", "la souris dans le chat", ""])))
    assert [model.languages[b] for b in best[:2]] == ["en", "fr"]
    assert ((score >= 0) & (score <= 1)).all()


def test_presence_does_not_cross_texts_or_pieces(monkeypatch):
    texts = ["ab", "cd", "", "abcdefgh" * 5]
    whole = language_id.presence(*utf8(pa.array(texts)))
    each = np.vstack([language_id.presence(*utf8(pa.array([t]))) for t in texts])
    assert (whole == each).all()
    monkeypatch.setattr(language_id, "BYTES", 7)
    assert (language_id.presence(*utf8(pa.array(texts))) == whole).all()


def test_language_column(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "12 !!", "x"), (3, "the cat", "x")], "doc_id long, text string, score string")
    model = language_id.fit(["the cat and dog", "le chat et la"], ["en", "fr"])
    rows = language_id.identify(docs, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "en"]
    assert rows[0]["score"] == 0.0
    none = language_id.fit([], [])
    assert language_id.identify(docs, none).count() == 3


def test_language_on_held_out(spark, tiny):
    rows = {r["doc_id"]: r for r in language_id.op9_language_id(spark, tiny).collect()}
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang").collect()}
    held = [rows[d]["lang_pred"] == x for d, x in known.items() if rows[d]["held_out"]]
    assert np.mean(held) > 0.95


CHAT = [
    (1, 0, "user", "hi <|im_end|>"),
    (1, 1, "assistant", "a<\\|b <|im_start|>assistant\nx"),
    (1, 2, "assistant", None),
    (2, 5, "us\ner|x\\n", "é"),
    (2, None, None, ""),
    (2, 5, "us\ner|x\\n", "é"),
    (None, 0, "assistant", "lost"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in CHAT], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for key in (1, 2, None):
        turns = sorted([r for r in CHAT if r[0] == key], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        got = rows[key]
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got["loss_chars"], got["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_conversation_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
        out = chat_format.format_conversations(df)
        assert out.count() > 1
        row = chat_format.read_back(out).collect()
        assert len(row) == 1 and row[0]["n_turns"] == 20
        assert row[0]["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(1, 20, 2)).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@given(st.text("<|\\ab", max_size=12))
@settings(max_examples=200, deadline=None)
def test_escaping_is_reversible(text):
    out = chat_format.escape(pa.array([text]))[0].as_py()
    assert "<|" not in out
    assert chat_format.unescape(out) == text
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text


# Cases that an earlier version got wrong or took long for.


def test_one_very_long_word_among_short_ones():
    model = sentence_pieces.pieces(sentence_pieces.tokenizer_file(sentence_pieces.MODEL, None), 1.0)
    rng = random.Random(31)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé東", k=80_000))
    texts = ["some words here", long, "", "x" * 3000, None, " ".join(long[i : i + 9] for i in range(0, 9000, 9))]
    keys = np.arange(len(texts))
    began = time.time()
    ids, offsets = model.encode(texts, keys)
    assert time.time() - began < 8
    data, bounds = model.decode(ids.astype(np.int64), offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t or "" for t in texts]
    # The same text and key by themselves, after the lattices were forgotten.
    model.reset()
    alone, _ = model.encode([long], np.array([1]))
    assert (alone == ids[offsets[1] : offsets[2]]).all()


def test_words_one_by_one_sample_the_same(monkeypatch):
    model = sentence_pieces.pieces(sentence_pieces.tokenizer_file(sentence_pieces.MODEL, None), 1.0)
    texts = [f"tokenization of number {i} and internationalization" for i in range(60)]
    got = []
    for few in (1, 10**9):
        monkeypatch.setattr(sentence_pieces, "FEW", few)
        model.reset()
        got.append(model.encode(texts, np.arange(60)))
    assert all((a == b).all() for a, b in zip(*got, strict=True))


def test_texts_without_a_sentence_score_alike():
    model = toxicity.Model(-2.0, {"idiot": 5.0})
    floor = model.score("")
    assert floor > 0 and all(model.score(t) == floor for t in (None, "!!!", ".", "?\n", "plain words"))
    assert model.score("idiot") > 0.9 and model.score("plain. words") > floor
    assert toxicity.Model(0.0, {"aaaa*": 1.0}).score("a" * 300) > 0.7


def test_presence_folds_letters_across_a_piece(monkeypatch):
    text = "x" * 9 + "É" + "yz"
    data, off = utf8(pa.array([text]))
    whole = language_id.presence(data, off)
    for size in range(5, 14):
        monkeypatch.setattr(language_id, "BYTES", size)
        assert (language_id.presence(data, off) == whole).all()
