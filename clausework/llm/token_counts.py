"""Token counts of byte-level BPE, without identifiers.

Each pre-token is a list of byte symbols joined by links. A heap holds the adjacent pairs that can
merge; the pair of lowest rank is popped, leftmost first, its neighbours get new pairs, stale
entries are skipped. A text's count is its initial symbols minus its merges. Counts of pre-tokens
are kept in a cache of bounded size, as the same ones come again and again.
"""

from __future__ import annotations

import heapq
import json
import re
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import table

#: Fixed value: the pre-token pattern of byte-level BPE, white space named by its property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of printable ASCII, line ends and Latin letters alone, where the standard library's faster matcher agrees.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_WORDS = rf" ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens in the cache, and the longest that it takes.
CACHE, CACHED_CHARS = 800_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain, spare = [*range(33, 127), *range(161, 173), *range(174, 256)], iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Token counts by pre-token."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        vocab = model["model"]["vocab"]
        self.first = [vocab[c] for c in byte_alphabet()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.other = re.compile(rf"[^ -~\n\r\t{LATIN}]")
        self.words, self.shortened = re.compile(LATIN_WORDS), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|" + LATIN_WORDS)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, token: str) -> int:
        n = self.merged(token)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[token] = n
        return n

    def merged(self, token: str) -> int:
        """Symbols left of one pre-token."""
        get, made, first = self.ranks.get, self.made, self.first
        sym = [first[b] for b in token.encode()]
        left = n = len(sym)
        pair = [get(x << 32 | y, -1) for x, y in zip(sym, sym[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        pair.append(-1)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            rank = top >> 32
            if pair[i] != rank:
                continue
            j = nxt[i]
            sym[i] = new = made[rank]
            nxt[i] = after = nxt[j]
            pair[j] = -1
            left -= 1
            if after < n:
                prev[after] = i
                pair[i] = r = get(new << 32 | sym[after], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            before = prev[i]
            if before >= 0:
                pair[before] = r = get(sym[before] << 32 | new, -1)
                if r >= 0:
                    heappush(heap, r << 32 | before)
        return left

    def count(self, text: str) -> int:
        """Tokens of a text. Strings of added tokens in it are one token each, as the library takes them by default."""
        if self.cut is not None and any(s in text for s in self.special):
            pieces = self.cut.split(text)
            return len(pieces) - 1 + sum(self.plain(p) for p in pieces)
        return self.plain(text)

    def plain(self, text: str) -> int:
        pattern = self.pattern if self.other.search(text) else self.shortened if "'" in text else self.words
        return sum(map(self.__getitem__, pattern.findall(text)))


#: One counter in each worker.
COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in COUNTERS:
        COUNTERS[path] = Counter(path)
    return COUNTERS[path]


def tokenizer_file(name: str, folder: str | None) -> str:
    """A vocabulary file in the folder given, else where the installed package has it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k.json", folder: str | None = None, into: str = "n_tokens") -> DataFrame:
    """df with the token count of its text column; null and empty texts have 0. A column of that name is replaced.

    Every text is counted whole, row by row; memory is one Arrow batch, the merges and the bounded cache.
    """

    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        c = counter(tokenizer_file(name, folder))
        return pa.array([c.count(t) if t else 0 for t in (x.as_py() for x in texts)], pa.int64())

    return df.withColumn(into, counts(F.col(text)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


__all__ = ["Counter", "token_counts", "op2_token_counts"]
