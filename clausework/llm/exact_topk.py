"""Exact top-k inner products by aggregation of sorted lists without random access.

The candidates are cut into blocks; in a block every component has its list of candidates, sorted, and
a query reads each list from its best end, in rounds. What it has read up to a depth gives every
candidate an upper bound (unread components at the value where the list stands) and a lower bound
(unread components at the list's worst value). The k-th best lower bound is the query's bar; candidates
whose upper bound is below it are dropped for good, and a query stops as soon as only a few candidates
(RESOLVED for each of the k) can still reach the bar, no outsider of them qualifying, or its lists end.
The scores of those few are then resolved. An entry of a list carries its vector's length too, so after
the first round the unread components are also bounded by the lengths of what is unread of both
vectors. A candidate's upper bound in the first round is its inner product with components cut at the values where the
lists stand, so the first round is one product for all queries of a batch; later rounds look at the
candidates left to each query alone.

A query comes to a block with a bar: its k-th best score in one block of the longest vectors, which is
a lower bound of the final one. Blocks are of one band of lengths each, and a query does not go to
bands that cannot reach its bar (length times length). Every candidate is moved once, to its block; the
queries stream past it, so a task holds one block and one Arrow batch of queries. Equal rows are one
candidate with a number.

In many dimensions the bounds say little until much of the lists is read, so on vectors without
structure queries stop late (README has the shares); the answer is exact wherever they stop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import stage, table

#: Queries whose bounds are taken at once, candidates of one block, bands of lengths, partitions at most.
QUERIES, CANDIDATES, BANDS, PARTITIONS = 128, 1 << 15, 8, 20_000
#: A query stops when no more than so many candidates for each of its k can reach its bar.
RESOLVED = 2
#: Shares of the lists after which a round ends.
DEPTHS = (1 / 2, 5 / 8, 3 / 4, 7 / 8, 15 / 16, 1)


class Block:
    """Candidates with their sorted lists, of which the values at each depth are kept."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, n = ids[order], x[order], len(ids)
        lists = np.sort(self.x, axis=0)
        self.least, self.most = lists[0], lists[-1]
        depths = [max(1, min(n, int(np.ceil(n * share)))) for share in DEPTHS]
        #: Where the lists stand after each round, read from the top and from the bottom.
        self.down, self.up = [lists[n - d] for d in depths], [lists[d - 1] for d in depths]
        #: How many queries stopped in each round.
        self.stopped = [0] * len(DEPTHS)

    def first_bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of all queries and candidates after the first round."""
        high = np.maximum(q, 0) @ np.maximum(self.x, self.down[0]).T
        return np.add(high, np.minimum(q, 0) @ np.minimum(self.x, self.up[0]).T, out=high)

    def bounds(self, q: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of one query's candidates at a depth."""
        x, plus = self.x[at], q >= 0
        now, worst = np.where(plus, self.down[depth], self.up[depth]), np.where(plus, self.least, self.most)
        read = np.where(plus, x >= now, x <= now)
        known, unread = np.where(read, x, 0) @ q, ~read
        # What is left of the squared lengths, and a little more than rounding can take.
        left = np.sqrt((unread @ np.square(q, dtype=np.float64)) * (np.square(x, dtype=np.float64) * unread).sum(axis=1)) * (1 + 1e-9)
        low = np.maximum(np.where(read, x, worst) @ q, known - left)
        return low, np.minimum(np.where(read, x, now) @ q, known + left)

    def best(self, q: np.ndarray, at: np.ndarray, bar: float, k: int) -> np.ndarray:
        """The candidates among `at` that may be in the query's best k, once it has stopped."""
        for depth in range(len(DEPTHS)):
            low, high = self.bounds(q, at, depth)
            if len(at) >= k:
                bar = max(bar, -np.partition(-low, k - 1)[k - 1])
            able = high >= bar
            at, low = at[able], low[able]
            if len(at) <= RESOLVED * k:
                break
        self.stopped[depth] += 1
        return at

    def top(self, qids: np.ndarray, q: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, row of the candidate, score) of up to k best of each query that reach its bar; ties to the smaller candidate, a query never meets its own id."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.x.dtype))]
        for lo in range(0, len(qids), QUERIES):
            here = slice(lo, lo + QUERIES)
            high = self.first_bounds(q[here])
            high[self.ids[None, :] == qids[here, None]] = -np.inf
            for i, row in enumerate(high, lo):
                at = self.best(q[i], np.flatnonzero(np.isfinite(row) & (row >= bars[i])), bars[i], k)
                score = self.x[at] @ q[i]
                order = np.lexsort((at, -score))[:k]
                order = order[score[order] >= bars[i]]
                out.append((np.full(len(order), i), at[order], score[order]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with 0."""
    off, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    size = np.diff(off)
    x = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    x[np.repeat(np.arange(len(size)), size), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = flat[off[0] : off[-1]]
    return x


ROWS = "query_id long, vec_id long, score long, times int"


def streamed(k: int):
    """Batch function over rows sorted by block, candidates before queries: each query's best of the block."""

    def answers(block: Block, times: np.ndarray, asked: list[pa.RecordBatch]) -> pa.RecordBatch:
        asked = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
        q = matrix(asked.column("vector"), block.x.shape[1])
        qids, bars = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "bar"))
        x = block.x
        if q.shape[1] > x.shape[1]:
            q = q[:, : x.shape[1]]
        # Sums of whole numbers are exact in single precision up to 2^24.
        exact = x.shape[1] * max(1.0, np.abs(block.most).max(initial=0), np.abs(block.least).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < 1 << 23
        i, at, score = (block if exact else Block(block.ids, x.astype(np.float64))).top(qids, q.astype(np.float32 if exact else np.float64), bars, k)
        often = np.minimum(asked.column("times").to_numpy()[i] * times[at], k).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(block.ids[at]), pa.array(np.rint(score).astype(np.int64)), pa.array(often)], names=["query_id", "vec_id", "score", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block, times = None, [], None, None
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != number:
                    number, held, block = blocks[lo], [], None
                part = b.slice(lo, hi - lo)
                if not kinds[lo]:
                    held.append(part)
                    continue
                if block is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    x = matrix(whole.column("vector"))
                    ids, times = whole.column("vec_id").to_numpy(), whole.column("times").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    single = np.abs(x).max(initial=0) < 1 << 24
                    block, times, held = Block(ids[order], x[order].astype(np.float32 if single else np.float64)), times[order], []
                if block is not None:
                    yield answers(block, times, [part])

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k candidates with the largest inner product.

    Both inputs hold `vec_id` long and `vector` array<double> of whole numbers. Ties go to the smaller
    vec_id; a candidate of the query's own id takes no part; with fewer candidates all are returned.
    Repeated rows are candidates each; query rows of one vec_id are ranked together, each with its
    pairs. Vectors of unequal length are compared as if filled up with 0; empty tables give no rows.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return stage(df.groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")).select("*", norm), name)

    them, asked = counted(candidates, "candidates"), counted(queries, "queries")
    limits = sorted(set(them.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.01)), reverse=True)
    # Band 0 has the longest vectors.
    band = F.lit(0)
    for i, limit in enumerate(limits, 1):
        band = F.when(F.col("norm") < limit, i).otherwise(band)
    them = them.withColumn("band", band)
    sizes = {r["band"]: (r["n"], r["longest"]) for r in them.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    first, blocks, placed = 0, 0, F.lit(None).cast("int")
    reach = []
    for b, (n, longest) in sorted(sizes.items()):
        number = -(-n // CANDIDATES)
        placed = F.when(F.col("band") == b, F.lit(blocks) + F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number)).cast("int")).otherwise(placed)
        reach.append((blocks, blocks + number, longest))
        blocks += number
    them = them.select(placed.alias("block"), F.lit(0).alias("kind"), "vec_id", "vector", "times", F.lit(None).cast("double").alias("bar"))
    parts = max(1, min(blocks, PARTITIONS))

    def best(them: DataFrame, asked: DataFrame) -> DataFrame:
        both = them.unionByName(asked.select("block", F.lit(1).alias("kind"), "vec_id", "vector", "times", "bar"))
        return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(streamed(k), ROWS)

    low = F.lit(float("-inf"))
    start = stage(best(them.where(F.col("block") == first), asked.select("*", F.lit(first).alias("block"), low.alias("bar"))), "start")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Of several query rows of one id each has pairs here; a bar must hold for all of them, so the ranks go by query and candidate.
    single = start.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    bars = single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    asked = asked.join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", low))
    # Length times length bounds every product; the small part more than makes up for rounding.
    able = [F.when(F.col("norm") * longest * (1 + 1e-9) >= F.col("bar"), F.sequence(F.lit(lo), F.lit(hi - 1))).otherwise(F.array().cast("array<int>")) for lo, hi, longest in reach]
    asked = asked.withColumn("block", F.explode(F.concat(*able) if able else F.array().cast("array<int>"))).where(F.col("block") != first)
    found = start.unionByName(best(them.where(F.col("block") != first), asked))
    found = found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(df: DataFrame) -> DataFrame:
    """floor(256 x) of every component; vectors that are null or hold null or non-finite components go."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
