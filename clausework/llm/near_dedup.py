"""Near duplicates by Order MinHash and banded alignment.

A document is its sequence of five-word shingles, each labelled with its occurrence number. A sketch
takes the ELL labelled shingles that are smallest under a random order and keeps them in text
order, so it is sensitive to edit similarity: the same shingles in another order give another
sketch. Documents that share one of SKETCHES sketches are candidates. The similarity of a pair is
L / (n + m - L), L being the longest common subsequence of its n and m shingles, found exactly in
the band that a similarity of `least` leaves; pairs from `least` on are links, and classes are the
connected components of the links.

Scale: equal texts are one representative from the start (an aggregation with partial sums), so a
huge group of copies costs one row. In a bucket everyone is first held against the smallest member,
and again in buckets refined by the next sketch, so that a large class costs a pair a row. A bucket
whose members are then still in different components is open: its leader may be like neither of two
that are alike. Buckets are not compared pair by pair, which would grow with the square of the
documents that share a template. Instead all documents of open buckets are joined exactly: every
document shows only the rarest of its labelled shingles, as many as it cannot do without in a pair
that is alike (a fifth at 0.8, a ninth for the shorter document), and documents that show a common one
are a candidate if the rest after it can still be enough. A template's shingles are frequent, so they
are not shown but by documents that are little else. No pair that is alike is lost in this step,
whatever the order is. Then a histogram of the shingles bounds what two documents can have in common
(it never drops a pair that is alike), and what is left is aligned. Links and components stay
distributed; every round of the components is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import mix64, prepare, stage, table, utf8

SHINGLE, LEAST = 5, 0.8
SKETCHES, ELL = 12, 2
#: Bytes of text that are hashed at once; a longer document is one piece.
PIECE = 1 << 19
#: Counts in a document's histogram of shingles.
BINS = 256
#: Slots in which shingles are counted, to tell frequent ones: the table is as large whatever the input.
SLOT_BITS = 16

BASE = 0x9E3779B97F4A7C15 | 1
MAXIMUM = np.uint64(0xFFFFFFFFFFFFFFFF)


def fold_table() -> np.ndarray:
    """ASCII letters in lower case, digits and all beyond ASCII as they are, other ASCII as white space."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    for b in [*range(48, 58), *range(97, 123)]:
        out[b] = b
    for b in range(97, 123):
        out[b - 32] = b
    return out


FOLD = fold_table()


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with letters in lower case (ASCII and Latin-1) and every other ASCII sign as a blank."""
    out = FOLD[data]
    at = np.flatnonzero(out[:-1] == 0xC3) + 1
    up = at[(out[at] >= 0x80) & (out[at] <= 0x9E) & (out[at] != 0x97)]
    out[up] += 0x20
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of each at least."""
    if len(POWERS.get("up", ())) < n:
        size = max(n, PIECE + 1024)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return POWERS["up"], POWERS["down"]


POWERS: dict[str, np.ndarray] = {}


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the offsets of each text's words."""
    n = len(offsets) - 1
    text = folded(data)
    letter = np.zeros(len(text) + 2, bool)
    letter[1:-1] = text != 32
    cut = np.zeros(len(text) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(letter[1:-1] & (~letter[:-2] | cut[:-1]))
    end = np.flatnonzero(letter[1:-1] & (~letter[2:] | cut[1:])) + 1
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start]), np.searchsorted(start, offsets) if n else np.zeros(1, np.int64)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `size` words of a text, and offsets; a shorter text is one shingle, a text without words none."""
    count = np.diff(offsets)
    number = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    ends = np.cumsum(number)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - number), number)
    stop = np.repeat(offsets[1:], number)
    padded = np.append(words, np.zeros(size, np.uint64))
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + np.where(at + k < stop, padded[at + k], np.uint64(k + 1))
    return mix64(out), np.concatenate([[0], ends])


def labelled(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The shingles, each told from earlier equal ones of its text."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = grams ^ mix64(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    where = np.arange(len(key))
    run = np.maximum.accumulate(np.where(same, 0, where))
    number = np.empty(len(key), np.uint64)
    number[order] = where - run
    return np.where(number > 0, mix64(grams + number * np.uint64(BASE)), grams)


def sketches(grams: np.ndarray, offsets: np.ndarray, number: int = SKETCHES) -> np.ndarray:
    """One row for each text that has a shingle, one key for each sketch: its ELL smallest labelled shingles, in text order."""
    x = labelled(grams, offsets)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts, count = offsets[full], np.diff(offsets)[full]
    owner = np.repeat(np.arange(len(full)), count)
    out = np.zeros((len(full), number), np.uint64)
    for r in range(number):
        odd = np.uint64((2 * r + 1) * 0xD6E8FEB86659FD93 % 2**64 | 1)
        v = x * odd
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        picked = np.full((len(full), ELL), np.iinfo(np.int64).max)
        for e in range(ELL):
            least = np.minimum.reduceat(v, starts) if len(full) else v[:0]
            hit = np.flatnonzero((v == least[owner]) & (v != MAXIMUM))
            mine, first = np.unique(owner[hit], return_index=True)
            picked[mine, e] = hit[first]
            v[hit[first]] = MAXIMUM
        picked.sort(axis=1)
        key = np.full(len(full), r + 1, np.uint64)
        for e in range(ELL):
            there = picked[:, e] < len(x)
            key = mix64(key * np.uint64(BASE) + np.where(there, x[np.minimum(picked[:, e], max(0, len(x) - 1))], np.uint64(0)))
        out[:, r] = key
    return out


def pieces_of(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def histograms(grams: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """How many shingles of each text have each first byte, one byte each; None where a count does not fit."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(owner * BINS + (grams >> np.uint64(56)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    fits = count.max(axis=1) < 256 if n else np.zeros(0, bool)
    return [c.tobytes() if f else None for c, f in zip(count.astype(np.uint8), fits, strict=True)]


def possible(least: float):
    """Column function: whether two histograms leave room for a similarity of `least`."""

    @F.arrow_udf("boolean")
    def possible_(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.ones(len(x), bool)
        both = np.flatnonzero(~np.asarray(x.is_null()) & ~np.asarray(y.is_null()))
        left, right = (np.frombuffer(b"".join(c.take(pa.array(both)).to_pylist()), np.uint8).reshape(-1, BINS) for c in (x, y))
        total = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
        common = np.minimum(left, right).sum(axis=1, dtype=np.int64)
        out[both] = common >= np.ceil(least * total / (1 + least) - 1e-9)
        return pa.array(out)

    return possible_


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column("text"))
        number, keys = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
        for lo, hi in pieces_of(offsets):
            off = offsets[lo : hi + 1]
            grams, at = shingles(*word_hashes(data[off[0] : off[-1]], off - off[0]))
            number[lo:hi] = np.diff(at)
            found = sketches(grams, at).view(np.int64).tolist()
            for row, key in zip(np.flatnonzero(np.diff(at) > 0), found, strict=True):
                keys[lo + row] = key
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(number), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "copy", "n", "keys"])


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with the shingles of their texts."""
    for b in batches:
        data, offsets = utf8(b.column("text"))
        for lo, hi in pieces_of(offsets):
            off = offsets[lo : hi + 1]
            yield b.slice(lo, hi - lo), *shingles(*word_hashes(data[off[0] : off[-1]], off - off[0]))


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many labelled shingles fall into each slot, one table a task."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for _, grams, at in gram_batches(batches):
        total += np.bincount(slot_of(labelled(grams, at)), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "number"])


def shown(count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest shingles a text of so many shows to longer texts, and to shorter ones."""
    below = lambda x: np.ceil(x * count - 1e-9).astype(np.int64)
    return count - below(2 * least / (1 + least)) + 1, count - below(least) + 1


def shown_tokens(usual: np.ndarray, least: float):
    """Batch function: a row for each shingle that a text shows, with its rank by rarity and the shingle before it, and the text's histogram at rank 0 (nulls elsewhere)."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, grams, at in gram_batches(batches):
            x, count = labelled(grams, at), np.diff(at)
            owner = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((x, usual[slot_of(x)], owner))
            rank = np.arange(len(x)) - at[owner]
            few, many = shown(count, least)
            keep = np.flatnonzero(rank < many[owner])
            ordered = x[order]
            doc, rank, token, before = owner[keep], rank[keep], ordered[keep], ordered[keep - 1]
            bins = histograms(grams, at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node").take(pa.array(doc)),
                    b.column("root").take(pa.array(doc)),
                    pa.array(token.view(np.int64)),
                    pa.array(before.view(np.int64), mask=rank == 0),
                    pa.array(count[doc].astype(np.int32)),
                    pa.array(rank.astype(np.int32)),
                    pa.array(rank < few[doc]),
                    pa.array([bins[d] if r == 0 else None for d, r in zip(doc.tolist(), rank.tolist(), strict=True)], pa.binary()),
                ],
                names=["node", "root", "token", "before", "n", "rank", "few", "bins"],
            )

    return show


def banded_lcs(a: list[int], b: list[int], least: int) -> int:
    """Length of the longest common subsequence if it is `least` or more, else some number below. Bits of one integer are the columns of the band."""
    n, m = len(a), len(b)
    if least > min(n, m):
        return 0
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b, n, m, same = a[lead : n - tail], b[lead : m - tail], n - lead - tail, m - lead - tail, lead + tail
    if not n or not m:
        return same
    need = max(0, least - same)
    below, above = n - need, m - need
    if below < 0 or above < 0:
        return 0
    width = below + above + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[int, int] = {}
    for j, s in enumerate(b):
        where[s] = where.get(s, 0) | 1 << j
    row, done = mask, 0
    for i, s in enumerate(a):
        if i:
            done += not row & 1
            row = row >> 1 | top
        if hit := where.get(s):
            base = i - below
            met = row & (hit >> base if base >= 0 else hit << -base) & mask
            row = (row + met | row - met) & mask
    return same + done + width - row.bit_count()


def similarity(a: list[int], b: list[int], least: float = LEAST) -> float:
    """L / (n + m - L) if that is `least` or more, else 0."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    common = banded_lcs(a, b, need)
    return common / (n + m - common) if common >= need else 0.0


def grams_of(text: str) -> list[int]:
    data, offsets = utf8(pa.array([text], pa.large_string()))
    return shingles(*word_hashes(data, offsets))[0].tolist()


def alike(least: float):
    @F.arrow_udf("double")
    def alike_(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, grams = [], None, []
        for x, y in zip(left, right, strict=True):
            x, y = x.as_py() or "", y.as_py() or ""
            if x != last:
                last, grams = x, grams_of(x)
            out.append(similarity(grams, grams_of(y), least))
        return pa.array(out, pa.float64())

    return alike_


def components(edges: DataFrame) -> DataFrame:
    """node, root of the connected components of edges (a, b): large-star and small-star by turns, each round written out, until every node has one root and no root has one."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = large.unionByName(now.join(least, "u").select("u", F.col("m").alias("v")).where("u <> v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = stage(small, "edges")
        seen = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links a, b: the components of the roots, and the nodes' roots brought up to date."""
    old = links
    for c in ("a", "b"):
        old = old.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    above = components(old.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # Roots that have a root now are nodes too; so are nodes that no link had before.
    return stage(moved.unionByName(above.join(roots.select("node"), "node", "left_anti")), "roots")


def text_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each text of docs (doc_id long, text, copy): copy, class_id, keeper_id, keeper_copy.

    class_id is the smallest id of the text's class (null if no row of it has one); the keeper is the
    class's first row by id (null last), then by copy. copy is the text's 16-byte hash.
    """
    # Sketches are a scan without a shuffle; from here on only they move, until texts are verified.
    sketched = stage(docs.mapInArrow(sketch_batches, "doc_id long, copy binary, n long, keys array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "keys")).alias("first")
    # Texts are numbered once, as they are written: short names that are unique whatever the ids are.
    firsts = stage(sketched.groupBy("copy").agg(first).select("copy", "first.*").withColumn("node", F.monotonically_increasing_id()), "firsts")
    close = F.least("n", "lead.n") >= F.lit(least) * F.greatest("n", "lead.n")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """The rows of nodes (node and others) with their texts."""
        named = nodes.join(firsts.select("node", F.col("doc_id").alias("first_id"), F.col("copy").alias("first_copy")), "node")
        found = docs.select("doc_id", "copy", "text").join(named, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == F.col("first_copy")))
        return found.select(*nodes.columns, "text").dropDuplicates(nodes.columns)

    def verified(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """The pairs a, b whose texts are alike."""
        wanted = pairs.select(F.col("b").alias("node"), "a").unionByName(pairs.select(F.col("a").alias("node"), "a").distinct())
        texts = stage(texts_of(wanted) if texts is None else wanted.join(texts, "node"), "texts")
        left = texts.where("a = node").select("a", F.col("text").alias("x"))
        right = texts.where("a <> node").select("a", F.col("node").alias("b"), F.col("text").alias("y"))
        found = right.join(left, "a").withColumn("alike", alike(least)("x", "y")).where(F.col("alike") >= least)
        return stage(found.select("a", "b").distinct(), "links")

    single = F.transform("keys", lambda k, i: F.xxhash64(i, k))
    double = F.transform("keys", lambda k, i: F.xxhash64(i + SKETCHES, k, F.element_at("keys", F.pmod(i + 1, F.lit(SKETCHES)) + 1)))
    rows = firsts.where("keys is not null").select("node", "n", F.explode(F.concat(single, double)).alias("key"))
    # Written, so that the join below is one of two plain shuffles, whose large partitions the engine can split.
    leaders = stage(rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", "lead"), "leaders")
    pairs = rows.join(leaders, "key").where("lead.node < node").where(close)
    links = verified(stage(pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs"))
    roots = components(links)

    # The documents of buckets that are not in one component yet.
    member = firsts.where("keys is not null").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode(single).alias("key"))
    member = stage(member, "member")
    buckets = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = stage(texts_of(member.join(buckets, "key", "left_semi").select("node", "root").distinct()), "open")
    usual = np.zeros(1 << SLOT_BITS, np.int64)
    for slot, number in open_.mapInArrow(count_slots, "slot long, number long").groupBy("slot").agg(F.sum("number")).collect():
        usual[slot] = number
    tokens = stage(open_.mapInArrow(shown_tokens(usual, least), "node long, root long, token long, before long, n int, rank int, few boolean, bins binary"), "tokens")
    bins = stage(tokens.where("rank = 0").select("node", "bins"), "bins")

    def enough(x: str, y: str):
        """Where the first common shingle is, those after it must still be enough; and one text must not be much longer."""
        n, m, i, j = (F.col(f"{c}.{v}") for v in ("n", "rank") for c in (x, y))
        return (F.least(n, m) >= F.lit(least) * F.greatest(n, m)) & (F.least(n - i, m - j) >= F.lit(least / (1 + least)) * (n + m) - 1e-6)

    def linked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The roots after the links among pairs of nodes a, b."""
        for c in "ab":
            pairs = pairs.join(bins.select(F.col("node").alias(c), F.col("bins").alias(f"bins_{c}")), c)
        pairs = stage(pairs.where(possible(least)("bins_a", "bins_b")).select("a", "b"), "rest")
        more = verified(pairs, open_.select("node", "text"))
        return roots if more.isEmpty() else joined(roots, more)

    def both(x: str, y: str):
        return F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")

    # First with the text that has the fewest rarer shingles, which is in the middle of its like, so that a large class does not cost its pairs.
    middle = F.min(F.struct("rank", "n", "node", "root")).alias("hub")
    hubs = tokens.groupBy("token").agg(middle, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "hub")
    x = tokens.drop("bins").alias("x")
    roots = linked(x.join(hubs, "token").where((F.col("x.root") != F.col("hub.root")) & enough("x", "hub")).select(*both("x", "hub")).distinct(), roots)
    known = stage(tokens.drop("bins", "root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    x, y = known.alias("x"), known.alias("y")
    fits = (F.col("x.token") == F.col("y.token")) & F.col("x.few") & (F.col("x.root") != F.col("y.root")) & enough("x", "y")
    # Where the shingles before are the same too, the pair has met there.
    fits &= F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    roots = linked(x.join(y, fits & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))).select(*both("x", "y")).distinct(), roots)
    classes = firsts.select("copy", "none", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keeper = classes.groupBy("root").agg(F.min(F.struct("none", "doc_id", "copy")).alias("keeper"))
    named = keeper.select("root", F.col("keeper.doc_id").alias("class_id"), F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.copy").alias("keeper_copy"))
    return classes.select("copy", "root").join(named, "root").drop("root")


def with_copy(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, and copy, the text's 16-byte hash. Null counts as the empty text."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.withColumn("copy", F.unhex(F.md5("text")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each row of df: doc_id, class_id (smallest id of its class), kept (its id and text are its class's first).

    Equal texts are one class, null counting as empty; texts without a word have no other partners.
    Rows of one id with different texts are different documents; equal rows are all kept or all not.
    A row without an id comes after all others: its class may have an id, it is kept only in a class
    that has none. An empty table gives no rows. Other columns are left out.
    """
    docs = with_copy(df, doc_id, text)
    classes = stage(text_classes(docs, least), "classes")
    out = docs.select("doc_id", "copy").join(classes, "copy", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("copy") == F.col("keeper_copy"))
    return out.select("doc_id", "class_id", kept.alias("kept"))


def first_of_class(df: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of df (with doc_id and text) that are their class's first by id, one row for each class; of rows equal in id and text the smallest by all columns."""
    spark, columns = df.sparkSession, df.columns
    prepare(spark)
    keyed = df.withColumn("_copy", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    first = text_classes(with_copy(df), least).where("copy = keeper_copy").select(F.col("keeper_id").alias("_id"), F.col("copy").alias("_copy"))
    left = stage(keyed.join(first, "_copy").where(F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id"), "first")
    often = left.groupBy("_copy").count().where("count > 1").select("_copy")
    if often.isEmpty():
        return left.select(*columns)
    least_row = F.min(F.struct(*columns)).alias("row")
    some = left.join(often, "_copy", "left_semi").groupBy("_copy").agg(least_row).select("row.*")
    return left.join(often, "_copy", "left_anti").select(*columns).unionByName(some)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
