"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of a bias and the
weights of its words; a document's is the noisy-or of its sentences. Only documents carry labels,
and the gradient of the document likelihood reaches the sentences that explain it, so the trained
model also points at the offending sentences. Features of a word are the word and its prefixes.

The model is fitted on the driver on a bounded sample (SAMPLE_PER_CLASS labelled documents of each
class, whole texts); scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import held_out, table

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
#: Features at most, and the documents that a feature needs.
FEATURES, MIN_DOCS = 20_000, 3
PREFIXES = (4, 5, 6, 7)
WORDS_KEPT = 200_000
#: Words of so many letters are not kept.
LONG = 100

SENTENCES, WORDS = re.compile(r"[.!?\n\r]+"), re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Model(dict):
    """Weight of each word, by word; features hold the weights that make them up."""

    def __init__(self, bias: float, weights: dict[str, float]):
        super().__init__()
        self.bias, self.weights = bias, weights

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def __missing__(self, word: str) -> float:
        w = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) < LONG:
            self[word] = w
        return w

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """Every sentence with its probability, in order."""
        return [(s, 1 / (1 + math.exp(-min(30.0, self.bias + sum(map(self.__getitem__, WORDS.findall(s.lower()))))))) for s in SENTENCES.split(text) if s.strip()]

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences; a text without any, as an empty one or one of stops alone, scores as one empty sentence."""
        get, bias, keep, plain = self.__getitem__, self.bias, 0.0, 0
        for s in SENTENCES.split((text or "").lower()):
            z = sum(map(get, WORDS.findall(s)))
            if z:
                keep -= math.log1p(math.exp(min(30.0, bias + z)))
            elif s:
                plain += 1
        return -math.expm1(keep - (plain or not keep) * math.log1p(math.exp(bias)))


def fit(texts: list[str], toxic: list[int], rounds: int = 300, decay: float = 2e-4) -> Model:
    """Maximum likelihood of the document labels under noisy-or, by Adam on all documents at once."""
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        rate = min(0.99, max(0.01, y.mean())) if len(y) else 0.01
        return Model(math.log(rate / (1 - rate)), {})
    seen, bad = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        found = {f for w in set(WORDS.findall(text.lower())) for f in features(w)}
        seen.update(found)
        if label:
            bad.update(found)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = {f: math.log(((bad[f] + 0.25) / (n1 + 0.5)) / ((n - bad[f] + 0.25) / (n0 + 0.5))) for f, n in seen.items() if n >= MIN_DOCS and bad[f] >= 2}
    strong = sorted((f for f, r in ratio.items() if r >= 1.0), key=lambda f: (-ratio[f] * bad[f], f))[:FEATURES]
    stems = {f for f in strong if f.endswith("*")}
    mild = [f for f, n in seen.items() if n >= MIN_DOCS and f not in ratio and any(g in stems for g in features(f)[1:])]
    index = {f: i for i, f in enumerate(strong + sorted(mild)[:FEATURES])}
    rows, cols, docs = [], [], []
    for d, text in enumerate(texts):
        for s in SENTENCES.split(text.lower()):
            if s or not text:
                hit = [index[f] for w in WORDS.findall(s) for f in features(w) if f in index]
                rows += [len(docs)] * len(hit)
                cols += hit
                docs.append(d)
    rows, cols, docs = np.array(rows, np.int64), np.array(cols, np.int64), np.array(docs, np.int64)
    theta = np.zeros(len(index) + 1)
    theta[-1] = math.log(0.1 / max(1.0, len(docs) / len(y)))
    theta[:-1] = [0.3 * min(4.0, max(-1.0, ratio.get(f, -1.0))) for f in index]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * min(n0, n1) * 2 / len(y) if n1 * 20 < n0 else np.full(len(y), 1 / len(y))
    for step in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(rows, theta[cols], len(docs)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        miss = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the chance that no sentence offends
        clean = np.exp(miss)
        pull = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0) * weight
        g = pull[docs] * p
        grad = np.append(np.bincount(cols, g[rows], len(index)), g.sum())
        grad[:-1] -= decay * theta[:-1] / max(1, len(index)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3})


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled documents that are not held out: those of the smallest hashes in each class."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    wanted = F.lit(False)
    for c, n in sizes.items():
        wanted = wanted | ((F.col("toxic") == c) & (place < int(min(1.0, (per_class + 3 * per_class**0.5) / n) * (1 << 30))))
    picked = known.where(wanted).orderBy(place, "doc_id").limit(3 * per_class * max(1, len(sizes)))
    rows = docs.where("text is not null").join(F.broadcast(picked), "doc_id").select("toxic", place.alias("place"), "doc_id", "text").collect()
    out, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r["place"], r["doc_id"], r["text"])):
        if taken[r["toxic"]] < per_class:
            taken[r["toxic"]] += 1
            out.append((r["text"], int(r["toxic"] > 0)))
    return [t for t, _ in out], [y for _, y in out]


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with the toxicity of its text column, 0 to 1. Null counts as empty; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            yield pa.array([model.score(x.as_py()) for x in texts], pa.float64())
        model.clear()  # a worker outlives its task, and the next stage needs the room

    return df.withColumn(into, scores(F.col(text)))


def offending(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """df with `offending`: the sentences of probability `least` or more, in order, each with its probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("probability", pa.float64())]))

    @F.arrow_udf("array<struct<sentence string, probability double>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"sentence": s, "probability": p} for s, p in shared.value.sentences(x.as_py() or "") if p >= least] for x in texts], kind)

    return df.withColumn("offending", found(F.col(text)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
