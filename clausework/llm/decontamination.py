"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

The CGK walk reads a string and, after each step, moves on by one sign or stays, as a random bit
for (step, sign) says. Strings at a small edit distance soon walk in step again, so edit distance
becomes Hamming distance between walks. A repetition has its own bits and samples some of the walk's
steps; equal samples make a candidate. Windows of an item's size start at every word: of the item's
text and of every document. The sampled steps lie in the walk's first ones (about half as many
signs), as walks part for good after many edits; an item has as many windows as words, and one
window with a clean start is enough, which is where the recall comes from. Steps, sampled steps and
repetitions go by an item's length (LEVELS). Each candidate places the whole item at one point of
the document. An item cut into pieces of at most 64 signs has a piece with its share of the edits, or
fewer, so a place where no piece has goes, all places in step; elsewhere the item is aligned exactly: a
document is contaminated by an item if the edit distance of some part of it is at most (1 - least) of the item's
length, on folded text (letters in lower case, runs of other ASCII signs one blank).

Documents are read once for each block of the benchmark, where they lie, without a shuffle. A block
is BLOCK bytes of items at most, whatever the benchmark's size; nothing else is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import mix64, table, utf8
from clausework.llm.near_dedup import folded, pieces_of

LEAST = 0.8
#: For items of so many signs or more: steps, sampled steps and repetitions. Short items have few windows, so each must hit more easily.
LEVELS = ((0, 10, 5, 8), (56, 28, 12, 8), (130, 44, 15, 8))
STEPS = max(steps for _, steps, _, _ in LEVELS)
#: Signs of a piece of an item, at most, that is held against a candidate's place before the whole item is.
WORD = 64
BLOCK, PIECE = 1 << 22, 1 << 20
#: Pieces that are held against their places in step.
CELLS = 1 << 15
#: After so many sampled signs, windows are held against the items' windows, and the size of those tables.
LOOKS, TABLE_BITS = (5, 7, 9, 12), 18
#: A walk's first steps, so many, read as many signs of a window at most: windows that share these signs take those steps once. 8 at most.
HEAD = 6


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with one blank for each run of blanks, and their offsets."""
    text = folded(data)
    blank = text == 32
    before = np.concatenate([[False], blank[:-1]])
    before[offsets[:-1][offsets[:-1] < len(text)]] = False
    keep = ~(blank & before)
    return text[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def word_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = text != 32
    first = np.ones(len(text), bool)
    first[1:] = ~letter[:-1]
    first[offsets[:-1][offsets[:-1] < len(text)]] = True
    return np.flatnonzero(letter & first)


def edit_minimum(text: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each span a..b of the text the smallest edit distance of any part of it to a string of at most 64 signs: row of a table of the places of each sign, and the string's size. All spans go in step (Myers' bit vectors, one word each)."""
    one = np.uint64(1)
    order = np.argsort(a - b, kind="stable")
    a, length, size = a[order], (b - a)[order], size[order]
    flat, base = table.ravel(), row[order].astype(np.int64) << 8
    top = one << (size - 1).astype(np.uint64)
    up, down, score = (top << one) - one, np.zeros(len(a), np.uint64), size.astype(np.int32)
    best = score.copy()
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for step, n in enumerate(alive.tolist()):
        u, d, t = up[:n], down[:n], top[:n]
        eq = flat.take(base[:n] + text.take(a[:n] + step))
        xv = eq | d
        xh = eq & u
        xh += u
        xh ^= u
        xh |= eq
        ph = xh | u
        np.invert(ph, out=ph)
        ph |= d
        xh &= u
        s = score[:n]
        s += (ph & t) != 0
        s -= (xh & t) != 0
        np.minimum(best[:n], s, out=best[:n])
        ph <<= one
        xh <<= one
        np.bitwise_and(ph, xv, out=d)
        xv |= ph
        np.invert(xv, out=xv)
        np.bitwise_or(xh, xv, out=u)
    out = np.empty(len(a), np.int64)
    out[order] = best
    return out


class Windows:
    """Places of windows, and for each the number of its first HEAD signs among the different ones, which start at `first`. text has 8 spare signs at its end."""

    def __init__(self, text: np.ndarray, at: np.ndarray):
        words = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=np.ascontiguousarray(text), strides=(1,))
        head = words[at] & np.uint64((1 << 8 * HEAD) - 1)
        order = np.argsort(head)
        head = head[order]
        new = np.ones(len(at), bool)
        new[1:] = head[1:] != head[:-1]
        self.at, self.first = at.astype(np.int64), at[order[new]].astype(np.int64)
        self.head = np.empty(len(at), np.int64)
        self.head[order] = np.cumsum(new) - 1


class Walk:
    """One repetition: random bits, and the sampled steps."""

    def __init__(self, seed: int, steps: int, sampled: int):
        rng = np.random.Generator(np.random.PCG64([6, seed, steps]))
        self.bits = rng.integers(0, 2, (steps, 256), dtype=np.uint8).astype(np.int64)
        self.sampled = set(rng.choice(steps, sampled, replace=False).tolist())

    def keys(self, text: np.ndarray, windows: Windows, tables: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Places whose samples may be an item's (all, without tables), their keys, and the keys at the looks. text has spare zeros at its end."""
        at, head, alive = windows.first, True, np.ones(len(windows.first), bool)
        pos, key, number, seen = at.copy(), np.full(len(at), 7, np.uint64), 0, {}
        for step in range(max(self.sampled) + 1):
            if step == HEAD:
                at, pos, key = self.of_windows(windows, alive, pos, key)
                head = False
            sign = text.take(pos)
            if step in self.sampled:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += sign
                number += 1
                if number in LOOKS:
                    look = ((key ^ key >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    if tables is None:
                        seen[number] = look
                    elif head:
                        alive &= tables[number].take(look)
                    else:
                        keep = np.flatnonzero(tables[number].take(look))
                        at, pos, key, sign = at[keep], pos[keep], key[keep], sign[keep]
            pos += self.bits[step].take(sign)
        if head:
            at, pos, key = self.of_windows(windows, alive, pos, key)
        return at, mix64(key), seen

    @staticmethod
    def of_windows(windows: Windows, alive: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, positions and keys of the windows whose heads are alive, from those of the heads."""
        at, which = windows.at, windows.head
        if not alive.all():
            keep = alive.take(which)
            at, which = at[keep], which[keep]
        return at, at + (pos - windows.first).take(which), key.take(which)


class Items:
    """A block of the benchmark with its windows' keys."""

    def __init__(self, rows: list[tuple[int, str]], least: float):
        data, offsets = utf8(pa.array([t for _, t in rows], pa.large_string()))
        text, off = squeezed(data, offsets)
        self.least, self.ids, self.text, self.patterns = least, [], [], []
        for (i, _), a, b in zip(rows, off[:-1], off[1:], strict=True):
            item = text[a:b].tobytes().strip()
            if item:
                self.ids.append(i)
                self.text.append(item)
        for item in self.text:
            where: dict[int, int] = {}
            for j, c in enumerate(item):
                where[c] = where.get(c, 0) | 1 << j
            self.patterns.append(where)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.allowed = ((1 - least) * self.size + 1e-9).astype(np.int64)
        self.levels = []
        above = [low for low, _, _, _ in LEVELS[1:]] + [float("inf")]
        for (low, steps, sampled, repetitions), high in zip(LEVELS, above, strict=True):
            chosen = [k for k, t in enumerate(self.text) if low <= len(t) < high]
            if chosen:
                self.levels += [self.level(Walk(r, steps, sampled), chosen, steps) for r in range(repetitions)]

    def pieces_near(self, text: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For spans a..b of the text and an item for each (in order): whether some piece of the item has its share of the edits allowed, or fewer, in the span."""
        near = np.zeros(len(k), bool)
        number = -(-self.size[k] // WORD)
        which = np.repeat(np.arange(len(k)), number)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        for lo in range(0, len(which), CELLS):
            some, i = which[lo : lo + CELLS], piece[lo : lo + CELLS]
            item = k[some]
            first, last = (self.size[item] * (i + x) // number[some] for x in (0, 1))
            name = item << 32 | i
            known, at, row = np.unique(name, return_index=True, return_inverse=True)
            table = np.zeros((len(known), 256), np.uint64)
            for r, x in enumerate(at.tolist()):
                signs = np.frombuffer(self.text[item[x]], np.uint8)[first[x] : last[x]]
                np.bitwise_or.at(table[r], signs, np.uint64(1) << np.arange(len(signs), dtype=np.uint64))
            size = last - first
            best = edit_minimum(text, a[some], b[some], table, row, size)
            hit = best * self.size[item] <= self.allowed[item] * size
            near[some[hit]] = True
        return near

    def level(self, walk: Walk, chosen: list[int], steps: int) -> tuple:
        joined = np.frombuffer(b"".join(self.text[k] + b" " for k in chosen) + bytes(steps + 8), np.uint8)
        sizes = np.array([len(self.text[k]) + 1 for k in chosen])
        first = np.cumsum(sizes) - sizes
        at = word_starts(joined[: sizes.sum()], np.append(first, sizes.sum()))
        item = np.searchsorted(first, at, side="right") - 1
        room = first[item] + sizes[item] - at > steps // 2
        at, item = at[room | (at == first[item])], item[room | (at == first[item])]
        _, keys, looks = walk.keys(joined, Windows(joined, at))
        tables = {}
        for number, look in looks.items():
            tables[number] = np.zeros(1 << TABLE_BITS, bool)
            tables[number][look] = True
        for number in LOOKS:
            tables.setdefault(number, np.ones(1 << TABLE_BITS, bool))
        order = np.argsort(keys, kind="stable")
        return walk, tables, keys[order], np.array(chosen)[item[order]], (at - first[item])[order]

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of the item's start in the text) that some repetition proposes."""
        items, places, windows = [], [], Windows(text, starts)
        for walk, tables, keys, owner, offset in self.levels:
            at, found, _ = walk.keys(text, windows, tables)
            lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            n = hi - lo
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            items.append(owner[which])
            places.append(np.repeat(at, n) - offset[which])
        return np.concatenate(items or [np.zeros(0, int)]), np.concatenate(places or [np.zeros(0, int)])

    def distance(self, k: int, part: bytes) -> int:
        """Smallest edit distance of item k to any part of the bytes (Myers' bit vectors)."""
        item, where = self.text[k], self.patterns[k]
        if item in part:
            return 0
        n = len(item)
        mask, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score = mask, 0, n
        best = n
        for c in part:
            eq = where.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up) & mask
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                best = min(best, score)
            ph = ph << 1 & mask
            up = mh << 1 & mask | ~(xv | ph) & mask
            down = ph & xv
        return best

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item id, edit distance) of all items found in the texts."""
        text, off = squeezed(data, offsets)
        starts = word_starts(text, off)
        item, place = self.candidates(np.append(text, np.zeros(STEPS + 8, np.uint8)), starts)
        if not len(item):
            return []
        return self.verified(text, off, item, place)

    def verified(self, text: np.ndarray, off: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edit distance) of the hits among the candidates."""
        item, place = (x.astype(np.int64) for x in np.divmod(np.unique(item * (len(text) << 1) + place + len(text)), len(text) << 1))
        place -= len(text)
        size, last = self.size[item], max(0, len(text) - 1)
        slack = np.ceil((1 - self.least) * size).astype(np.int64)
        # A place before its text's start belongs to the text that the window's middle or end is in.
        row = np.concatenate([np.searchsorted(off, np.clip(place + x, 0, last), side="right") - 1 for x in (0 * size, size // 2, size)])
        item, place, size, slack = (np.tile(x, 3) for x in (item, place, size, slack))
        a, b = np.maximum(place - slack, off[row]), np.minimum(place + size + slack, off[row + 1])
        order = np.lexsort((b, a, row, item))
        item, row, a, b = item[order], row[order], a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(row) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
        keep = np.flatnonzero(new & (b - a >= self.least * self.size[item]))
        keep = keep[self.pieces_near(text, item[keep], a[keep], b[keep])]
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for k, d, x, y in zip(item[keep].tolist(), row[keep].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True):
            upto = spans.setdefault((d, k), [])
            if upto and x <= upto[-1][1]:
                upto[-1][1] = max(y, upto[-1][1])
            else:
                upto.append([x, y])
        out = []
        for (d, k), found in spans.items():
            best = min(self.distance(k, text[x:y].tobytes()) for x, y in found)
            if best <= self.allowed[k]:
                out.append((d, k, best))
        return out


HITS = "doc_id long, item_id long, distance long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, distance, similarity: every benchmark item that some part of a document equals up to (1 - least) of its length in edits.

    One row for each pair, the best distance. Null or empty texts and items match nothing; an item of
    no letters or digits is left out; repeated documents each have their rows. Extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast(sorted(((r["item_id"], r["text"]) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, least)
            for b in batches:
                ids, found = b.column("doc_id"), []
                data, offsets = utf8(b.column("text"))
                for lo, hi in pieces_of(offsets, PIECE):
                    off = offsets[lo : hi + 1]
                    found += [(lo + d, k, e) for d, k, e in known.hits(data[off[0] : off[-1]], off - off[0])]
                if found:
                    where, k, e = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(where)), pa.array([known.ids[i] for i in k], pa.int64()), pa.array(e, pa.int64()), pa.array([1 - x / len(known.text[i]) for i, x in zip(k, e, strict=True)], pa.float64())],
                        names=["doc_id", "item_id", "distance", "similarity"],
                    )

        hits = rows.mapInArrow(find, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
