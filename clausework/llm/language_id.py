"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (orders 1 to 4, blended, each counted once)
that both hold, over the root of the product of their numbers. Landmark texts approximate it
(Nyström), and one ridge regression for each language against the rest is solved in the landmark
space. The landmarks' n-gram vectors are folded into the solution, so a batch of texts is scored
by one matrix product of its presence matrix.

The model is fitted on the driver on a bounded sample (SAMPLE texts, PER_LANGUAGE of each language);
scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import held_out, table, utf8

#: Texts that the model is fitted on, in all and of each language, and landmarks, at most.
SAMPLE, PER_LANGUAGE, LANDMARKS = 3000, 400, 256
ORDERS, SLOTS, RIDGE = 4, 1 << 14, 1e-2
#: Rows of one presence matrix, and bytes that are hashed at once.
ROWS, BYTES = 256, 1 << 20

LETTER = re.compile(r"[^\W\d_]")


def fold_table() -> np.ndarray:
    """ASCII letters in lower case, other ASCII as white space, all else as it is."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    for b in range(97, 123):
        out[b] = out[b - 32] = b
    return out


FOLD = fold_table()


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text, 1 in the slots of its n-grams. n-grams never cross texts; slots are the bytes and, from 256, hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, SLOTS), np.float32)
    for start in range(0, len(data), BYTES):
        piece = FOLD[data[start : start + BYTES + ORDERS]]
        lead = np.concatenate([data[start - 1 : start] if start else [0], piece[:-1]])
        piece = np.where((lead == 0xC3) & (piece >= 0x80) & (piece <= 0x9E) & (piece != 0x97), piece + 0x20, piece).astype(np.uint32)
        at = np.arange(start, min(start + BYTES, len(data)))
        row = np.searchsorted(offsets, at, side="right") - 1
        end = offsets[row + 1]
        gram = np.zeros(len(at), np.uint32)
        for k in range(ORDERS):
            nxt = piece[k : k + len(at)]
            gram[: len(nxt)] = gram[: len(nxt)] << np.uint32(8) | nxt
            fits = at + k < end
            slot = gram if k == 0 else np.uint32(256) + ((gram ^ np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(SLOTS - 256)
            out[row[fits], slot[fits]] = 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


class Model:
    """languages, and for each the weight of every slot and a bias."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the index of the best language, and its score."""
        best, score = [], []
        for a in range(0, len(offsets) - 1, ROWS):
            off = offsets[a : a + ROWS + 1]
            f = unit(presence(data[off[0] : off[-1]], off - off[0])) @ self.weights + self.bias
            best.append(f.argmax(1))
            score.append(np.clip((f.max(1) + 1) / 2, 0, 1))
        return np.concatenate(best or [np.zeros(0, int)]), np.concatenate(score or [np.zeros(0)])


def fit(texts: list[str], langs: list[str], seed: int = 9) -> Model:
    """Kernel ridge regression in the space of the landmarks, one language against the rest."""
    names = sorted(set(langs))
    if not names:
        return Model(["und"], np.zeros((SLOTS, 1), np.float32), np.zeros(1, np.float32))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(texts))
    turn = Counter()
    ranks = {}
    for i in order:
        ranks[i] = turn[langs[i]]
        turn[langs[i]] += 1
    marks = sorted(order, key=lambda i: ranks[i])[:LANDMARKS]
    land = unit(presence(*packed([texts[i] for i in marks]))).astype(np.float64)
    cross = np.vstack([unit(presence(*packed(texts[a : a + ROWS]))) @ land.T for a in range(0, len(texts), ROWS)])
    values, vectors = np.linalg.eigh(land @ land.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi, mean = cross @ root, y.mean(0)
    solved = np.linalg.solve(phi.T @ phi + RIDGE * np.eye(phi.shape[1]), phi.T @ (y - mean))
    return Model(names, (land.T @ (root @ solved)).astype(np.float32), mean.astype(np.float32))


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """A bounded sample of the documents that have a language and are not held out: those of the smallest hashes in each language."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()}
    most = max(1, min(PER_LANGUAGE, SAMPLE // max(1, len(sizes))))
    if not sizes:
        return [], []
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    bars = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, (most + 4 * most**0.5) / n) * (1 << 30)))])
    rows = known.where(place < F.element_at(bars, F.col("lang"))).select("lang", place.alias("place"), "doc_id", "text").collect()
    out, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r["place"], r["doc_id"], r["text"])):
        if taken[r["lang"]] < most:
            taken[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return [t for t, _ in out], [x for _, x in out]


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `lang_pred` and `score` (0 to 1); columns of those names are replaced.

    Null texts and texts without a letter are `und` with score 0. Every text is read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def told(texts: pa.Array) -> pa.Array:
        model = shared.value
        best, score = model.decide(*utf8(texts))
        named = [bool(x is not None and LETTER.search(x)) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([model.languages[b] if ok else "und" for b, ok in zip(best, named, strict=True)], pa.string()), pa.array(np.where(named, score, 0.0).astype(np.float64))],
            names=["lang_pred", "score"],
        )

    out = df.drop("lang_pred", "score")
    return out.withColumn("told", told(F.col(text))).select(*[F.col(f"`{c}`") for c in out.columns], "told.lang_pred", "told.score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(*training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
