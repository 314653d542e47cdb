"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Every byte that a LENGTH-byte string covers goes if the string also starts in a document with a
smaller id. Equal strings are found by sorting suffixes, one bucket at a time:

1. Each window of LENGTH bytes falls to the leftmost smallest of its GRAM-byte grams (by hash), so
   equal windows fall to equal grams, at the same distance. A gram's windows and all their bytes lie
   in its surroundings of SPAN bytes. Only (gram hash, surroundings hash, document, place) is shuffled,
   one record for about 18 bytes of text, to the bucket of the gram.
2. In a bucket, grams of one document go. Equal surroundings mean equal windows: all but those of the
   smallest document are repeats. Where a gram has several surroundings, one document of each asks
   for its bytes.
3. Those surroundings, again in the bucket of their gram, are the suffixes to sort: their windows at
   one distance from the gram are one suffix bucket, sorted by its first 8 bytes; long ties are
   resolved by precomputed ranks of the 24-byte strings that start in a difference cover modulo 13,
   two of which reach every window's last 8 bytes. Runs of equal windows tell the smallest document.
4. The runs of window starts, by document, meet the texts, and the bytes go.

Equal texts are one document until step 4: all but the smallest of them go whole. A task holds one
bucket, about BUCKET bytes of the text it stands for, whatever the size of the corpus. Everything
that passes from step to step is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import emptied, mix64, stage, table, utf8
from clausework.llm.near_dedup import pieces_of

LENGTH, GRAM = 50, 16
#: Grams of a window; bytes before and from the gram's start that its windows reach.
REACH = LENGTH - GRAM
SPAN = REACH + LENGTH
#: Partitions that the buckets are dealt to, at most; each works on its buckets one at a time.
PARTITIONS = 20_000
#: Text that one bucket stands for, text worked on at once, and records kept back before they are sent.
BUCKET, PIECE, KEPT = 1 << 22, 1 << 18, 1 << 17
#: Records whose windows are sorted at once; one gram's are not parted.
SORTED = 1 << 14
#: A difference cover: every distance modulo 13 is one of two members.
PERIOD, COVER, NAMED = 13, (0, 1, 3, 9), 24
PLACE_BITS = 24
#: Where a packed place holds the number of the text among those of one id.
VARIANT = 43

RECORDS = "bucket int, gram binary, around binary, doc binary, place binary, span binary"
FOUND = "kind int, block int, doc binary, place binary, span binary, gram binary"
ASKED = "bucket int, gram binary, doc binary, place binary, span binary, bytes binary"


def words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from every position as one number."""
    return np.ndarray(shape=(len(data) - 7,), dtype=f"{order}u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def surroundings(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """SPAN bytes around each gram, zero beyond its document; 4 bytes more for whole words."""
    out = np.empty((len(at), SPAN + 4), np.uint8)
    for lo in range(0, len(at), 1 << 13):
        here = slice(lo, lo + (1 << 13))
        where = at[here, None] + np.arange(-REACH, LENGTH + 4)
        inside = (where >= first[here, None]) & (where < np.minimum(last[here], at[here] + LENGTH)[:, None])
        out[here] = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each gram that windows fall to: its hash, text, place, and the first and last of those windows' starts."""
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing.view(np.uint64), nothing, nothing, nothing, nothing
    w = words(np.append(data, np.zeros(16, np.uint8)), "<")
    h = mix64(w[:n] * np.uint64(0x9E3779B97F4A7C15) + mix64(w[8 : 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F))
    bits = np.uint64(max(PLACE_BITS, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = h & ~low | np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= REACH + 1:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    m = np.minimum(m[: len(m) - (REACH + 1 - step)], m[REACH + 1 - step :])
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(mark, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(mark)[: len(m)] == 0)
    place = (m[start] & low).astype(np.int64)
    if not len(place):
        return nothing.view(np.uint64), nothing, nothing, nothing, nothing
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    a, b = start[new], start[np.append(new[1:], len(start)) - 1]
    at = place[new]
    return h[at], np.searchsorted(offsets, at, side="right") - 1, at, a, b


def packed(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place in the document, distances of the first and the last window's start before it, in one number."""
    return at << 12 | (at - a) << 6 | (at - b)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place_of(place)
    return at, at - (place >> 6 & 63), at - (place & 63)


def place_of(place: np.ndarray) -> np.ndarray:
    return place >> 12 & (1 << VARIANT - 12) - 1


def runs(gram: np.ndarray, around: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of records that are equal and at most LENGTH bytes apart in one text, and how far the run's last one lies.

    Texts that repeat a word or a sign give one record and not one for each repetition. What goes
    from a run goes from all its places, and as they lie so close, the bytes between go too.
    """
    same = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1]) & (row[1:] == row[:-1]) & (np.diff(at) <= LENGTH)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(head[1:], len(at)) - 1
    return head, at[last] - at[head]


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' rows as bytes for each destination."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else [0]
    columns = [c[order] for c in columns]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[lo]), [c[lo:hi].tobytes() for c in columns]


def batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = [f.split() for f in names.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def record_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            gram, around, doc, place, span = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return batch([(k, *cols) for k, cols in dealt(bucket_of(gram, buckets), [gram, around, doc, place, span])], RECORDS)

        for b in batches:
            ids, variant = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "variant"))
            data, offsets = utf8(b.column("text"))
            for lo, hi in pieces_of(offsets, PIECE):
                off = offsets[lo : hi + 1] - offsets[lo]
                text = data[offsets[lo] : offsets[hi]]
                gram, row, at, first, last = grams(text, off)
                if not len(gram):
                    continue
                near = surroundings(text, at, off[row], off[row + 1]).view("<u8")
                around = mix64((np.minimum(at - off[row], REACH) << 8 | np.minimum(off[row + 1] - at, LENGTH)).astype(np.uint64))
                for k in range(near.shape[1]):
                    around = around * np.uint64(0x9E3779B97F4A7C15) + near[:, k]
                    around ^= around >> np.uint64(31)
                around = mix64(around)
                head, span = runs(gram, around, row, at)
                gram, around, row, at, first, last = (x[head] for x in (gram, around, row, at, first, last))
                held.append((gram, around, ids[lo + row], packed(at - off[row], first - off[row], last - off[row]) | variant[lo + row] << VARIANT, span))
                if sum(len(x[0]) for x in held) >= KEPT:
                    yield sent()
        if held:
            yield sent()

    return run


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *[utf8(c)[0] for c in column.chunks]]).view(kind)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return bucket_of(mix64(doc.view(np.uint64)), blocks)


def matched(blocks: int):
    """Step 2: kind 0, runs of repeated windows; kind 1, places whose bytes are asked for."""

    def run(rows: pa.Table) -> pa.Table:
        gram, around, doc, place, span = (joined(rows.column(c), k) for c, k in (("gram", np.uint64), ("around", np.uint64), ("doc", np.int64), ("place", np.int64), ("span", np.int64)))
        order = np.argsort(gram, kind="stable")
        lead = first_of_runs(gram[order])
        start = np.flatnonzero(lead)
        d = doc[order]
        shared = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start) if len(d) else lead[:0]
        order = order[shared[np.cumsum(lead) - 1]] if len(d) else order
        gram, around, doc, place, span = (x[order] for x in (gram, around, doc, place, span))
        order = np.lexsort((doc, around, gram))
        gram, around, doc, place, span = (x[order] for x in (gram, around, doc, place, span))
        by_gram, by_both = first_of_runs(gram), first_of_runs(gram, around)
        kinds = np.bincount(np.cumsum(by_gram)[by_both] - 1) if len(gram) else np.zeros(0, np.int64)
        smallest = doc[np.maximum.accumulate(np.where(by_both, np.arange(len(doc)), 0))] if len(doc) else doc
        repeat = doc > smallest
        ask = ~repeat & (kinds[np.cumsum(by_gram) - 1] > 1) if len(doc) else repeat
        out = []
        for kind, chosen in ((0, repeat), (1, ask)):
            out += [(kind, k, *cols) for k, cols in dealt(block_of(doc[chosen], blocks), [doc[chosen], place[chosen], span[chosen], gram[chosen]])]
        if out:
            out = [(k, b, dd, p, w, g if k else b"") for k, b, dd, p, w, g in out]
        return pa.Table.from_batches([batch(out, FOUND)])

    return emptied(run)


@emptied
def by_document(rows: pa.Table) -> pa.Table:
    """The rows of a block as one row for each document."""
    doc, place, span = (joined(rows.column(c), np.int64) for c in ("doc", "place", "span"))
    gram = joined(rows.column("gram"), np.uint64)
    order = np.lexsort((place >> VARIANT, doc))
    doc, place, span = doc[order], place[order], span[order]
    gram = gram[order] if len(gram) else None
    cuts = np.append(np.flatnonzero(first_of_runs(doc, place >> VARIANT)), len(doc))
    spans = [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table(
        {
            "doc_id": pa.array(doc[cuts[:-1]], pa.int64()),
            "variant": pa.array((place >> VARIANT)[cuts[:-1]], pa.int64()),
            "place": pa.array([place[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
            "span": pa.array([span[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
            "gram": pa.array([gram[lo:hi].tobytes() if gram is not None else b"" for lo, hi in spans], pa.binary()),
        }
    )


def asked_batches(buckets: int):
    """The bytes around every place asked for, sent to their gram's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            gram, doc, place, span, near = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return batch([(k, *cols) for k, cols in dealt(bucket_of(gram, buckets), [gram, doc, place, span, near])], ASKED)

        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, (d, p, w, g) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("place"), b.column("span"), b.column("gram"), strict=True)):
                text, place = data[offsets[i] : offsets[i + 1]], np.frombuffer(p.as_py(), np.int64)
                at = place_of(place)
                near = surroundings(text, at, np.zeros(len(at), np.int64), np.full(len(at), len(text)))
                held.append((np.frombuffer(g.as_py(), np.uint64), np.full(len(at), d, np.int64), place, np.frombuffer(w.as_py(), np.int64), near))
            if sum(len(x[0]) for x in held) >= KEPT // 8:
                yield sent()
        if held:
            yield sent()

    return run


def sorted_windows(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each record and window distance 0 to REACH: does the window also start in a smaller document?"""
    n = len(gram)
    cover = [p for p in range(SPAN - NAMED + 1) if p % PERIOD in COVER]

    def word(p: int) -> np.ndarray:
        return np.ascontiguousarray(near[:, p : p + 8]).view(">u8")[:, 0].astype(np.uint64)

    # Ranks of the cover's strings, over all of them at once.
    names: dict[int, np.ndarray] = {}
    if n:
        keys = [np.concatenate([word(p + 8 * k) for p in cover]) for k in range(NAMED // 8)]
        order = np.lexsort(keys[::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(first_of_runs(*(k[order] for k in keys)))
        names = {p: rank[i * n : (i + 1) * n] for i, p in enumerate(cover)}
    far, close = place >> 6 & 63, place & 63
    out = np.zeros((n, REACH + 1), bool)
    for distance in range(REACH + 1):
        rows = np.flatnonzero((far >= distance) & (close <= distance))
        if len(rows) < 2:
            continue
        s = REACH - distance
        p1 = min(p for p in cover if p >= s)
        p2 = max(p for p in cover if p <= min(p1 + NAMED, s + LENGTH - NAMED))
        keys = [gram[rows], word(s)[rows], names[p1][rows], names[p2][rows], word(s + LENGTH - 8)[rows]]
        order = np.lexsort((doc[rows], *keys[::-1]))
        new = first_of_runs(*(k[order] for k in keys))
        smallest = doc[rows[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]]
        out[rows[order], distance] = doc[rows[order]] > smallest
    return out


def resolved(blocks: int):
    """Step 3: sort the suffixes of a bucket; kind 0 rows for its repeated windows."""

    def run(rows: pa.Table) -> pa.Table:
        gram, doc, place, span = (joined(rows.column(c), k) for c, k in (("gram", np.uint64), ("doc", np.int64), ("place", np.int64), ("span", np.int64)))
        near = joined(rows.column("bytes"), np.uint8).reshape(len(gram), SPAN + 4)
        # A few grams at a time: only windows of one gram are compared, and only theirs are copied.
        order = np.argsort(gram, kind="stable")
        lead = np.append(np.flatnonzero(first_of_runs(gram[order])), len(gram))
        hits, lo = [], 0
        while lo < len(gram):
            hi = int(lead[min(np.searchsorted(lead, lo + SORTED), len(lead) - 1)])
            some = order[lo:hi]
            hit = sorted_windows(gram[some], doc[some], place[some], near[some])
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, near_end = np.nonzero(edge == 1)
            far_end = np.nonzero(edge == -1)[1] - 1
            row = some[row]
            hits.append((doc[row], (place[row] >> 12) << 12 | far_end << 6 | near_end, span[row]))  # keeps the variant
            lo = hi
        found = [np.concatenate(x) for x in zip(*hits, strict=True)] if hits else [np.zeros(0, np.int64)] * 3
        out = [(0, k, *cols, b"") for k, cols in dealt(block_of(found[0], blocks), found)]
        return pa.Table.from_batches([batch(out, FOUND)])

    return emptied(run)


def union(place: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    _, a, b = unpacked(place)
    order = np.argsort(a, kind="stable")
    a, b = a[order], (b + span)[order] + LENGTH
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[new], reach[np.append(np.flatnonzero(new)[1:], len(a)) - 1]


CUT = "struct<kept binary, n_removed long, spans array<struct<start: long, end: long>>>"


def cut(texts: pa.Array, copies: pa.Array, places: pa.Array, lengths: pa.Array) -> pa.Array:
    kept, gone, spans = [], [], []
    for t, copy, p, w in zip(texts, copies.to_pylist(), places, lengths, strict=True):
        raw, p = (t.as_py() or "").encode(), p.as_py()
        if copy and len(raw) >= LENGTH:
            a, b = np.array([0]), np.array([len(raw)])
        elif p:
            a, b = union(np.frombuffer(p, np.int64), np.frombuffer(w.as_py(), np.int64))
        else:
            kept.append(raw)
            gone.append(0)
            spans.append([])
            continue
        bounds = [0, *np.ravel([a, b], "F").tolist(), len(raw)]
        kept.append(b"".join(raw[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True)))
        gone.append(int((b - a).sum()))
        spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, kind)], names=["kept", "n_removed", "spans"])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of df with `kept` (binary: the bytes left), `n_removed` and `spans` (removed runs of bytes).

    Null texts are empty. Rows of one id do not count against each other; a null id neither loses
    bytes nor takes them. Repeated rows get the same answer. Columns of the new names are replaced.
    """
    cols = [c for c in df.columns if c not in ("kept", "n_removed", "spans")]
    docs = df.select(F.struct(*cols).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("copy", F.unhex(F.md5("text")))
    known = docs.where("doc_id is not null").groupBy("doc_id", "copy").agg(F.max(F.octet_length("text")).alias("size"))
    # An id with several texts has a number for each.
    variant = F.row_number().over(Window.partitionBy("doc_id").orderBy("copy")).cast("long") - 1
    known = stage(known.withColumn("variant", variant), "known")
    firsts = known.groupBy("copy").agg(F.min(F.struct("doc_id", "variant")).alias("first"), F.max("size").alias("size")).where(f"size >= {LENGTH}")
    firsts = stage(firsts.select("copy", "first.*", "size"), "firsts")
    buckets = max(8, -(-(firsts.agg(F.sum("size")).first()[0] or 0) // BUCKET))
    parts = min(buckets, PARTITIONS)
    texts = docs.select("doc_id", "copy", "text").where(F.octet_length("text") >= LENGTH)
    reps = stage(texts.join(firsts.select("copy", "doc_id", "variant").hint("shuffle_hash"), ["copy", "doc_id"]).select("doc_id", "variant", "text"), "reps")
    found = stage(reps.mapInArrow(record_batches(buckets), RECORDS).repartition(parts, "bucket").groupBy("bucket").applyInArrow(matched(buckets), FOUND), "found")
    by_doc = "doc_id long, variant long, place binary, span binary, gram binary"
    asked = found.where("kind = 1").groupBy("block").applyInArrow(by_document, by_doc)
    around = reps.join(asked.hint("shuffle_hash"), ["doc_id", "variant"]).mapInArrow(asked_batches(buckets), ASKED)
    sorted_ = stage(around.repartition(parts, "bucket").groupBy("bucket").applyInArrow(resolved(buckets), FOUND), "sorted")
    places = found.where("kind = 0").unionByName(sorted_).groupBy("block").applyInArrow(by_document, by_doc)
    places = places.join(firsts.select("doc_id", "variant", "copy"), ["doc_id", "variant"]).select("doc_id", "copy", "place", "span", F.lit(False).alias("again"))
    again = known.join(firsts.select("copy", F.col("doc_id").alias("first")), "copy").where("doc_id > first")
    told = stage(places.unionByName(again.select("doc_id", "copy", *[F.lit(None).cast("binary").alias(c) for c in ("place", "span")], F.lit(True).alias("again"))), "told")
    out = docs.join(told.hint("shuffle_hash"), ["doc_id", "copy"], "left").withColumn("cut", F.arrow_udf(cut, CUT)("text", F.coalesce("again", F.lit(False)), "place", "span"))
    return out.select(*[f"row.`{c}`" for c in cols], "cut.kept", "cut.n_removed", "cut.spans")


def whole_characters(kept: Column) -> Column:
    """Text of bytes that were cut; what is left of a character cut in two goes."""

    @F.arrow_udf("string")
    def text(raw: pa.Array) -> pa.Array:
        return pa.array([(x.as_py() or b"").decode("utf-8", "ignore") for x in raw], pa.string())

    return text(kept)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = f"""
with b as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), w as (
  select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as g
  from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as i from b where n >= {LENGTH})
), m as (
  select g, min(doc_id) as d from w group by g
), f as (
  select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) as p from w join m on w.g = m.g where w.doc_id > m.d
), s as (
  select doc_id, i, sum(case when p is null or i > p + {LENGTH} then 1 else 0 end) over (partition by doc_id order by i) as k from f
), r as (
  select doc_id, min(i) as a, max(i) + {LENGTH} as e from s group by doc_id, k
), g as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 0) as x, a as y from r
  union all select doc_id, max(e), null from r group by doc_id
  union all select doc_id, 0, null from b where doc_id not in (select doc_id from r)
), k as (
  select b.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' order by x, y nulls last) as kept from g join b on b.doc_id = g.doc_id group by b.doc_id
), c as (
  select doc_id, cast(sum(e - a) as bigint) as n_removed, count(*) as n_spans from r group by doc_id
)
select b.doc_id, cast(b.n as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
from b join k on k.doc_id = b.doc_id left join c on c.doc_id = b.doc_id
"""
