"""Uniform shuffle into shards of exact size.

A communication matrix drawn from the multivariate hypergeometric law says how many rows each
input part sends to each (shard, chunk). Every part permutes its rows locally and deals them out
by its row of the matrix; one exchange moves them; every chunk permutes what it received. All
N! orders are equally likely and every shard has exactly its size, without a global sort.

Bounds: at most MAX_PARTS rows and MAX_CHUNKS columns of the matrix live on the driver (64 MB at
most); a local permutation holds 8 bytes for each row of a part. Shards larger than
rows_per_chunk are cut into chunks that tasks fill separately.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import shared_dir, stage, table

MAX_PARTS, MAX_CHUNKS = 2048, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement. numpy refuses populations from 1e9; beyond, rejection from a ratio of uniforms."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    if n >= good + bad:
        return good
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    lg = math.lgamma

    def weight(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(n - k + 1) + lg(bad - n + k + 1))

    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    mean = n * good / total
    sd = math.sqrt(max(n * good / total * bad / total * (total - n) / max(1, total - 1), 0.25))
    top, half = weight(mode), 1.72 * (sd + 0.5) + abs(mean - mode) + 1.5
    while True:
        u, v = 1.0 - rng.random(), 2.0 * rng.random() - 1.0
        k = math.floor(mode + 0.5 + half * v / u)
        if low <= k <= high and 2.0 * math.log(u) <= weight(k) - top:
            return k


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, uniformly over all ways to deal the rows out."""
    assert sum(rows) == sum(columns)
    rng, left = np.random.Generator(np.random.PCG64([seed, 0x5EED])), np.array(columns, np.int64)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest = int(left.sum())
        if rest < 1_000_000_000 and len(columns):
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            for j, c in enumerate(map(int, left)):
                rest -= c
                out[i, j] = k = hypergeometric(rng, c, rest, n)
                n -= k
        left -= out[i]
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def chunks_of(size: int, rows_per_chunk: int) -> int:
    return max(1, -(-size // rows_per_chunk))


def shard(df: DataFrame, num_shards: int = 40, seed: int = 17, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Every row of df, all columns kept, with `shard` int and `slot` long (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Null values, empty texts and repeated rows are rows like
    any other; an empty table gives an empty result. Input columns called shard or slot are replaced.
    The input is staged once, so a recomputed task deals out the same rows again.
    """
    spark = df.sparkSession
    kept = df.drop("shard", "slot")
    staged = stage(kept.select(F.struct("*").alias("row") if kept.columns else F.lit(None).alias("row"), F.monotonically_increasing_id().alias("rid")), "parts")
    part, pos = F.shiftright("rid", 33), F.col("rid").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in staged.groupBy(part.alias("p")).count().collect())
    total = sum(n for _, n in counts)
    sizes = shard_sizes(total, num_shards)
    while sum(chunks_of(s, rows_per_chunk) for s in sizes) > max(MAX_CHUNKS, num_shards):
        rows_per_chunk *= 2
    per_shard = [chunks_of(s, rows_per_chunk) for s in sizes]
    columns = [c for s, k in zip(sizes, per_shard, strict=True) for c in np.diff([i * s // k for i in range(k + 1)]).tolist()]
    width, group, base, rows = max(1, -(-len(counts) // MAX_PARTS)), {}, {}, []
    for i, (p, n) in enumerate(counts):
        if i % width == 0:
            rows.append(0)
        group[p], base[p] = len(rows) - 1, rows[-1]
        rows[-1] += n
    first = np.concatenate([[0], np.cumsum(per_shard)])
    shared = spark.sparkContext.broadcast((group, base, rows, np.cumsum(communication_matrix(rows, columns, seed), axis=1), first))

    @F.pandas_udf("struct<shard int, chunk int>")
    def dealt(parts: pd.Series, positions: pd.Series) -> pd.DataFrame:
        group, base, rows, ends, first = shared.value
        at, where, out = parts.to_numpy(), positions.to_numpy(), np.zeros(len(parts), np.int64)
        for p in np.unique(at):
            g, here = group[p], at == p
            if KEPT.get("key") != (seed, g, rows[g]):
                KEPT["key"], KEPT["order"] = (seed, g, rows[g]), np.random.Generator(np.random.PCG64([seed, 1, g])).permutation(rows[g])
            out[here] = np.searchsorted(ends[g], KEPT["order"][base[p] + where[here]], side="right")
        to = np.searchsorted(first, out, side="right") - 1
        return pd.DataFrame({"shard": to.astype(np.int32), "chunk": (out - first[to]).astype(np.int32)})

    sent = staged.withColumn("to", dealt(part, pos)).select("row", "rid", "to.shard", "to.chunk")
    order = Window.partitionBy("shard", "chunk").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")
    size = F.lit(total // num_shards) + (F.col("shard") < total % num_shards).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(size / F.lit(rows_per_chunk))).cast("long")
    slot = F.expr("chunk").cast("long") * size
    slot = F.floor((slot - F.pmod(slot, pieces)) / pieces).cast("long") + F.row_number().over(order) - 1
    return sent.select(*([f"row.`{c}`" for c in kept.columns]), "shard", slot.alias("slot"))


#: The last local permutation of this worker.
KEPT: dict = {}


def op1_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
