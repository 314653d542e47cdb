"""Sampled SentencePiece segmentations, and decoding.

A text's pieces form a lattice. Forward filtering sums the weights of all paths to every position,
backward sampling draws one path from the end, so segmentations come with their exact probability.
Pieces never cross from a word into the next blank, so the lattice of a text falls apart into those
of its blank-led words, which come again and again: their filtered lattices are kept as flat arrays
(bounded, see UNITS) and all words of a batch are sampled together, a step at a time, in numpy.

The draws are a hash of the row's key, the word's place in its row and the step: the same key gives
the same segmentation on any cluster. Characters without a piece, and the piece model's own blank
mark when it stands in a text, become byte pieces, so decoding returns every text unchanged.

Weights: scores of a unigram model are log probabilities; a byte-pair model's are negative ranks,
which are read by Zipf's law, 1 / (rank + 2). Either is raised to `alpha`.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import mix64, table, utf8
from clausework.llm.token_counts import tokenizer_file

MODEL, BLANK = "piece_bpe_32k.model", "▁"
#: Words and arcs in the kept lattices; beyond, they are built anew.
UNITS, ARCS = 250_000, 6_000_000
#: Words whose lattices are filtered together.
ADDED = 16_384
#: Words of a batch that are still unfinished, below which they go one by one.
FEW = 16
WORDS = re.compile(r" *[^ ]+| +")
#: Of the hash of a piece's beginning.
BASE = np.uint64(0x9E3779B97F4A7C15)


def keyed(x: int) -> float:
    """The draw that an array of keys would get, for one key."""
    return float((mix64(np.array([x], np.uint64)) >> np.uint64(11)).astype(np.float64)[0] * 2.0**-53)


class Pieces:
    """A piece model, and the filtered lattices of the words seen."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranked = all(s == round(s) and s <= 0 for s in scores.values())
        names = {i: model.id_to_piece(i) for i in range(n)}
        log = {i: -math.log(2 - s) if ranked else s for i, s in scores.items()}
        self.weight = {names[i].replace(BLANK, " "): (i, math.exp(alpha * log[i])) for i in plain}
        assert not any(" " in p.lstrip(" ") for p in self.weight), "pieces that cross blanks need another cut"
        # By length, the hashes of all beginnings of pieces; for each the piece that it is (-1: only a beginning) and its log weight.
        self.levels = []
        for k in range(1, max(map(len, self.weight)) + 1):
            heads = sorted({p[:k] for p in self.weight if len(p) >= k})
            hashes = np.zeros(len(heads), np.uint64)
            letters = np.frombuffer("".join(heads).encode("utf-32-le"), np.uint32).reshape(len(heads), k)
            for j in range(k):
                hashes = hashes * BASE + letters[:, j] + np.uint64(1)
            order = np.argsort(hashes)
            found = [self.weight.get(heads[i]) for i in order]
            self.levels.append((hashes[order], np.array([f[0] if f else -1 for f in found], np.int32), np.array([math.log(f[1]) if f else 0.0 for f in found])))
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_weight = math.exp(alpha * min(log.values())) if not ranked else (n + 2.0) ** -alpha
        spoken = [b""] * n
        for p, (i, _) in self.weight.items():
            spoken[i] = p.encode()
        for b, i in enumerate(self.bytes):
            spoken[i] = bytes([b])
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_off = np.concatenate([[0], np.cumsum([len(s) for s in spoken])]).astype(np.int64)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        #: Of each word its last node; of each node its first arc; of each arc the probability up to it, the node before (-1: none), its piece (below 0: a letter as bytes, -1 - its code).
        self.last, self.first, self.upto, self.before, self.piece = array("i"), array("i"), array("d"), array("i"), array("i")

    def arcs(self, letters: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, piece and log weight of every arc of the lattices; room: letters from each place to its word's end."""
        at, h, out = np.arange(len(letters)), np.zeros(len(letters), np.uint64), []
        for k, (hashes, piece, weight) in enumerate(self.levels, 1):
            if k > 1:
                fits = room[at] >= k
                at, h = at[fits], h[fits]
            h = h * BASE + letters[at + k - 1] + np.uint64(1)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[place] == h
            if k == 1:
                odd = np.ones(len(at), bool)
                odd[at[known & (piece[place] >= 0)]] = False
                odd = np.flatnonzero(odd)
                code = letters[odd].astype(np.int64)
                size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                out.append((odd, np.ones(len(odd), np.int64), (-1 - code).astype(np.int32), size * math.log(self.byte_weight)))
            at, h, place = at[known], h[known], place[known]
            whole = piece[place] >= 0
            out.append((at[whole], np.full(int(whole.sum()), k), piece[place[whole]], weight[place[whole]]))
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def add(self, words: list[str]) -> None:
        """Filter the lattices of new words forward, all of them a place at a time, and keep them. A node is the end of a letter."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        begin = np.repeat(ends - size, size)
        start, length, piece, weight = self.arcs(letters, np.repeat(ends, size) - np.arange(len(letters)))
        node = start + length - 1
        depth = node - begin[node]
        order = np.argsort(depth * np.int64(len(letters)) + node, kind="stable")
        start, piece, weight, node, depth = start[order], piece[order], weight[order], node[order], depth[order]
        before = np.where(start == begin[start], -1, start - 1)
        total, chance = np.zeros(len(letters)), np.empty(len(node))
        lead = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        arcs_of = np.diff(np.append(lead, len(node)))
        steps = np.searchsorted(depth, np.arange(int(size.max()) + 1))
        heads = np.searchsorted(lead, steps)
        # Words that are longer than most go alone, a letter at a time, without the cost of an array for each.
        alone = int(np.argmax(np.append(np.diff(heads), 0) < FEW))
        for lo, hi, x, y in zip(steps[:alone], steps[1 : alone + 1], heads[:alone], heads[1 : alone + 1], strict=True):
            back = before[lo:hi]
            sum_ = weight[lo:hi] + np.where(back >= 0, total[back], 0.0)
            first, many = lead[x:y] - lo, arcs_of[x:y]
            most = np.maximum.reduceat(sum_, first)
            share = np.exp(sum_ - np.repeat(most, many))
            whole = np.add.reduceat(share, first)
            total[node[lead[x:y]]] = most + np.log(whole)
            chance[lo:hi] = share / np.repeat(whole, many)
        if alone < len(heads) - 1:
            lo, x = int(steps[alone]), int(heads[alone])
            chance[lo:] = self.forward(total, before[lo:].tolist(), weight[lo:].tolist(), arcs_of[x:].tolist(), node[lead[x:]].tolist())
        upto = np.cumsum(chance) - np.repeat(np.arange(len(lead)), arcs_of)
        upto[np.append(lead[1:], len(node)) - 1] = 2.0
        nodes, kept = len(self.first), len(self.upto)
        first = np.empty(len(letters), np.int32)
        first[node[lead]] = lead + kept
        self.first.frombytes(first.tobytes())
        self.upto.frombytes(upto.tobytes())
        self.before.frombytes(np.where(before >= 0, before + nodes, -1).astype(np.int32).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        number = len(self.last)
        self.last.frombytes((ends - 1 + nodes).astype(np.int32).tobytes())
        self.index.update(zip(words, range(number, number + len(words)), strict=True))

    @staticmethod
    def forward(total: np.ndarray, before: list[int], weight: list[float], arcs_of: list[int], nodes: list[int]) -> list[float]:
        """The share of each arc in its node, node by node, from the logarithms that are known so far."""
        known, out, at = {}, [], 0
        for many, node in zip(arcs_of, nodes, strict=True):
            sums = []
            for i in range(at, at + many):
                back = before[i]
                sums.append(weight[i] + (0.0 if back < 0 else known[back] if back in known else float(total[back])))
            at += many
            most, whole = max(sums), 0.0
            shares = [math.exp(s - most) for s in sums]
            for s in shares:
                whole += s
            known[node] = most + math.log(whole)
            out += [s / whole for s in shares]
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the n + 1 offsets into them."""
        if len(self.index) > UNITS or len(self.upto) > ARCS:
            self.reset()
        units, sizes, index = [], [], self.index
        for t in texts:
            found = WORDS.findall(f" {t}") if t else []
            sizes.append(len(found))
            units += found
        new = list(set(units).difference(index))
        for a in range(0, len(new), ADDED):
            self.add(new[a : a + ADDED])
        sizes = np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        salt = mix64(keys.astype(np.int64).view(np.uint64))[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        last, first = np.frombuffer(self.last, np.int32), np.frombuffer(self.first, np.int32)
        upto, before, piece = np.frombuffer(self.upto), np.frombuffer(self.before, np.int32), np.frombuffer(self.piece, np.int32)
        who = np.arange(len(units))
        node = last[np.fromiter(map(index.__getitem__, units), np.int64, len(units))]
        taken, number, step = [], np.zeros(len(units), np.int64), 0
        while len(who) >= max(1, FEW):
            draw = (mix64(salt[who] ^ np.uint64(step * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = first[node].astype(np.int64)
            low = np.flatnonzero(upto[arc] <= draw)
            while len(low):
                arc[low] += 1
                low = low[upto[arc[low]] <= draw[low]]
            taken.append((who, piece[arc]))
            number[who] += 1
            node = before[arc]
            open_ = node >= 0
            who, node, step = who[open_], node[open_], step + 1
        # The few words that are left go one by one.
        rest: list[tuple[int, int, int]] = []
        for w, node_ in zip(who.tolist(), node.tolist(), strict=True):
            t, salt_ = step, int(salt[w])
            while node_ >= 0:
                draw_, arc_ = keyed(salt_ ^ t * 0xD1B54A32D192ED03 % 2**64), int(first[node_])
                while upto[arc_] <= draw_:
                    arc_ += 1
                rest.append((w, t, int(piece[arc_])))
                node_, t = int(before[arc_]), t + 1
            number[w] = t
        del last, first, upto, before, piece
        ends = np.cumsum(number)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for t, (w, p) in enumerate(taken):
            out[ends[w] - 1 - t] = p
        if rest:
            w, t, p = np.array(rest, np.int64).T
            out[ends[w] - 1 - t] = p
        length = np.ones(len(out), np.int64)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            coded = [np.array([self.bytes[b] for b in chr(-1 - c).encode()]) for c in out[odd]]
            length[odd] = [len(c) for c in coded]
            start = np.cumsum(length) - length
            wide = np.repeat(out, length)
            for i, c in zip(odd, coded, strict=True):
                wide[start[i] : start[i] + len(c)] = c
            out = wide
        upto_unit = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], ends])]
        return out.astype(np.int32), upto_unit[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes end to end and their offsets; the blank put before every text goes again."""
        start, size = self.spoken_off[ids], np.diff(self.spoken_off)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.spoken[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        bounds = ends[offsets]
        led = np.flatnonzero(np.diff(bounds) > 0)
        led = led[out[bounds[led]] == 32]
        keep = np.ones(len(out), bool)
        keep[bounds[led]] = False
        lost = np.zeros(len(bounds), np.int64)
        lost[led + 1] = 1
        return out[keep], bounds - np.cumsum(lost)


#: One model in each worker.
MODELS: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in MODELS:
        MODELS[path, alpha] = Pieces(path, alpha)
    return MODELS[path, alpha]


def encode(text: Column, key: Column, alpha: float = 1.0, seed: int = 3, name: str = MODEL, folder: str | None = None) -> Column:
    """Column of piece ids, array<int>: a segmentation sampled by the row's key. Null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = pieces(tokenizer_file(name, folder), alpha)
        for texts, keys in batches:
            out, offsets = model.encode(texts.to_pylist(), keys.to_numpy(zero_copy_only=False))
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
        model.reset()  # a worker outlives its task, and the next stage needs the room

    return ids(text, F.xxhash64(F.lit(seed), key))


def decode(ids: Column, name: str = MODEL, folder: str | None = None) -> Column:
    """Column of the texts that piece ids stand for; no ids, an empty text."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int32()))
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        data, bounds = pieces(tokenizer_file(name, folder), 1.0).decode(flat, offsets - offsets[0])
        return pa.StringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))

    return texts(ids)


def segment(df: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 3) -> DataFrame:
    """df with `piece_ids`, `n_pieces` and `lossless` (decoding gives the text back); columns of those names are replaced.

    Whole texts, row by row, no shuffle. Null texts count as empty. Rows of one key and text get one segmentation.
    """
    out = df.withColumn("piece_ids", encode(F.col(text), F.col(key), alpha, seed))
    out = out.withColumn("lossless", decode(F.col("piece_ids")) == F.coalesce(F.col(text), F.lit("")))
    return out.withColumn("n_pieces", F.size("piece_ids").cast("long"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segment(docs).select("doc_id", "n_pieces", "lossless", "piece_ids")


__all__ = ["Pieces", "decode", "encode", "op3_sentencepiece", "segment", "utf8"]
