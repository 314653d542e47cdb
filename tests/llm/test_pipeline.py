"""The stages of the pipeline, each against brute force on its own input."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 7)) for i in range(500)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda n: ". ".join(" ".join(rng.choice(WORDS) for _ in range(10)) for _ in range(n))
    folder = tmp_path_factory.mktemp("corpus")
    texts, labels = [], []
    for d in range(300):
        text = prose(8)
        if d % 10 == 3:
            text += " idiot moron scum"
        labels.append((d, 1, int(d % 10 == 3)))
        texts.append(text)
    bench = [(i, prose(2)) for i in range(4)]
    texts[20] += " " + bench[1][1]
    texts[41] = texts[40]
    texts[52] = texts[51].replace(" ", "  ", 1)
    passage = prose(1)
    texts[60] += " " + passage
    texts[70] = passage + " " + texts[70]
    rows = [(d, t, "en", "s", len(t)) for d, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "lonely words here", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = set(range(300))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        rows = {r["doc_id"]: r for r in out.collect()}
        assert None in rows
        gone = ids - set(rows)
        if name == "toxicity":
            assert gone == {d for d in range(300) if d % 10 == 3}
        elif name == "near_dedup":
            assert gone == {41, 52}
        elif name == "suffix_dedup":
            assert not gone
            assert passage not in rows[70]["text"] and rows[60]["text"] == texts[60]
            assert rows[70]["n_chars"] == len(rows[70]["text"])
        elif name == "decontamination":
            assert gone == {20}
        else:
            assert not gone and all(r["lossless"] for r in rows.values())
        ids &= set(rows)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_contaminated_rows_without_an_id_or_with_a_repeated_one(spark, corpus):
    folder, texts, _ = corpus
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(None, f"some {bench} more"), (None, texts[0]), (7, texts[1]), (7, bench), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(None, texts[0]), (7, texts[1]), (8, None)}


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    got = {r["doc_id"] for r in out.collect()}
    assert not got & {3, 41, 52, 20} and {40, 51, 60, 70} <= got
