"""Token counts by byte-pair merging with a heap over a linked list (operator 7).

The counter never makes identifiers: a pre-token of ``n`` bytes starts as ``n``
symbols, every merge removes one, and the count is symbols minus merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: White space as the tokenizer's pattern takes it (Unicode's White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Entries that a worker's caches hold at most; a full cache is emptied.
CACHE = 600_000
#: No symbol: what a merged-away place of the list holds.
DEAD = 0x1FFFF


def byte_symbols() -> list[str]:
    """The printable stand-in that byte-level vocabularies have for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return out


class HeapCounter:
    """Counts the tokens of a text under a byte-level BPE file of ``tokenizers``.

    ``merges``: pair of symbol numbers, 17 bits each -> rank and merged symbol.
    Special strings inside a text count as one token each, which is the
    library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 17 | vocab[b]] = rank << 17 | vocab[a + b]
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        special.sort(key=len, reverse=True)
        self.names, self.special = special, re.compile("|".join(map(re.escape, special)))
        self.words = regex.compile(SPLIT).findall
        if max(vocab.values()) >= DEAD:
            raise ValueError("the vocabulary has too many symbols")
        self.two_spaces = re.compile(r"\s\s").search  # Python's \s has all of WHITE
        counter = self

        class Pieces(dict):
            """Tokens of a pre-token."""

            def __missing__(self, piece: str) -> int:
                if len(self) >= CACHE:
                    self.clear()
                n = counter.merged(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 200:
                    self[piece] = n
                return n

        class Chunks(dict):
            """Tokens of a space and what follows it up to the next space."""

            def __missing__(self, chunk: str) -> int:
                if len(self) >= CACHE:
                    self.clear()
                n = sum(map(counter.pieces.__getitem__, counter.words(" " + chunk)))
                if len(chunk) < 200:
                    self[chunk] = n
                return n

        self.pieces, self.chunks = Pieces(), Chunks()

    def merged(self, data: bytes) -> int:
        """Symbols left when no adjacent pair of ``data`` can be merged any more.

        The symbols are a doubly linked list. The heap has, as one integer, a
        pair's rank, what it merges to and where it starts; an entry whose pair
        has changed meanwhile is passed over.
        """
        sym = list(map(self.first.__getitem__, data))
        n = left = len(sym)
        if n < 2:
            return n
        get = self.merges.get
        heap = []
        for i in range(n - 1):
            if v := get(sym[i] << 17 | sym[i + 1]):
                heap.append(v << 32 | i)
        if not heap:
            return n
        heapify(heap)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            v = entry >> 32
            j = nxt[i]
            if j >= n or get(sym[i] << 17 | sym[j]) != v:
                continue
            new = sym[i] = v & 0x1FFFF
            sym[j] = DEAD
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if v := get(new << 17 | sym[k]):
                    heappush(heap, v << 32 | i)
            h = prv[i]
            if h >= 0 and (v := get(sym[h] << 17 | new)):
                heappush(heap, v << 32 | h)
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if self.two_spaces(text):
            return sum(map(self.pieces.__getitem__, self.words(text)))
        # No two white-space characters meet, so no pre-token crosses the point before a space.
        head, *rest = text.split(" ")
        n = sum(map(self.pieces.__getitem__, self.words(head))) if head else 0
        return n + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str) -> int:
        if not any(map(text.__contains__, self.names)):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, HeapCounter] = {}


def counter(path: str) -> HeapCounter:
    """The counter of this process; a reused Python worker keeps it with its caches."""
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, column: str = "text", outputs: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``df`` without ``column``, with bytes, tokens and ``tokens > limit`` of each text.

    A null text counts as empty: 0 bytes, 0 tokens. Every row gives one row, so
    repeated rows stay repeated; null values of other columns pass through.
    Output names that clash with a column of ``df`` replace it. The work is a
    map over Arrow batches: no shuffle, memory of one batch and two bounded
    caches per worker, and the cost of a long pre-token is n log n.
    """
    others = [c for c in df.columns if c != column and c not in outputs]
    schema = df.select(*others).schema.add(outputs[0], "long").add(outputs[1], "long").add(outputs[2], "boolean")
    names = [*others, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(0)
            tokens, size = [], []
            for k in range(len(texts)):
                t = texts[k].as_py() or ""
                tokens.append(count(t))
                size.append(len(t.encode()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=names
            )

    return df.select(F.col(column).alias("__text"), *others).mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
