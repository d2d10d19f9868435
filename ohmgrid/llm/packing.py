"""Vector best-fit packing of documents into token sequences (operator 10).

Three capacities bind a bin: tokens, documents, and attention cost (the sum of
squared piece lengths). Pieces that have the same length are alike to the
packer, so it works on the histogram of lengths, whose size the token capacity
bounds whatever the number of documents. Bins with the same residual vector are
handled as one group. The resulting plan (runs of bins for runs of equal pieces)
is broadcast; each piece finds its place by its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import documents, text_or_empty, written

CACHE = 400_000


def little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary is a rank file of ``tiktoken``; with its special strings it
    gives the ids that ``tokenizers`` gives with the JSON file of the same
    vocabulary and ``add_special_tokens=False``. Where no two white-space
    characters meet, no pre-token crosses the point before a space, so a text is
    encoded chunk by chunk from a bounded cache.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.two_spaces = re.compile(r"\s\s").search
        encoder = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                ids = little(encoder.encoding.encode_ordinary(" " + chunk))
                if len(chunk) < 200:
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.two_spaces(text) or any(map(text.__contains__, self.special)):
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        head, *rest = text.split(" ")
        start = little(self.encoding.encode_ordinary(head))
        return start + b"".join(map(self.chunks.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, pattern: str, special: dict[str, int]) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, pattern, special)
    return _encoders[path]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``most``."""
    head = n % most if n > most else n
    pieces = [(0, head)] if head else []
    return pieces + [(at, most) for at in range(head, n, most)]


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


@dataclass
class Plan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on, ``each`` to a bin, from ``bin`` on at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces with these lengths and ranks."""
        # a length's runs follow each other by rank; the last run whose (length, rank) is not above
        key = self.length.astype(np.int64) << 44 | self.rank
        k = np.searchsorted(key, length.astype(np.int64) << 44 | rank, side="right") - 1
        at = rank - self.rank[k]
        return self.bin[k] + at // self.each[k], self.offset[k] + at % self.each[k] * self.length[k]


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity = Capacity(), measure: str = "dot", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> Plan:
    """Best-fit decreasing over a histogram of lengths, longest first.

    ``measure="dot"``: among the bins that have room in every capacity, the one
    whose residual vector has the smallest weighted dot-product with the piece's
    demand (each relative to capacity), so the tightest bin. ``"norm"``: the one
    whose residual vector after the piece has the smallest weighted norm. Ties go
    to the group that was opened first.
    """
    if measure not in ("dot", "norm"):
        raise ValueError(measure)
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    w = np.array(weights)
    left = np.zeros((64, 3))  # residual vector of each group of bins
    open_bins = np.zeros(64, np.int64)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(64)]
    used = bins = 0
    out: list[tuple[int, int, int, int, int, int]] = []

    def group(vector: np.ndarray, where: list[tuple[int, int]], n: int) -> None:
        nonlocal used, left, open_bins
        if vector[0] < 1 or vector[1] < 1 or vector[2] < 1:
            return  # full
        free = np.flatnonzero(open_bins[:used] == 0)
        if len(free):
            g = int(free[0])
        else:
            if used == len(open_bins):
                left, open_bins = np.vstack([left, np.zeros_like(left)]), np.concatenate([open_bins, np.zeros_like(open_bins)])
                ranges.extend([] for _ in range(used))
            g, used = used, used + 1
        left[g], open_bins[g], ranges[g] = vector, n, where

    for size, count in sorted(zip(map(int, lengths), map(int, counts), strict=True), reverse=True):
        need = np.array([size, 1, size * size], np.float64)
        if (need > cap).any() or size < 1:
            raise ValueError(f"a piece of {size} tokens fits no bin")
        share, rank = need / cap, 0
        while count:
            fits = (open_bins[:used] > 0) & (left[:used] >= need).all(axis=1)
            if fits.any():
                rest = left[:used] / cap
                score = rest @ (w * share) if measure == "dot" else (w * (rest - share) ** 2).sum(axis=1)
                g = int(np.where(fits, score, np.inf).argmin())
                room, where, n = left[g].copy(), ranges[g], int(open_bins[g])
                each = int((room // need).min())
                # as best fit would: a bin that has taken one is the tightest for the next of the same length
                full = min(n, count // each)
                take = full if full else 1
                per = each if full else count
                offset = int(cap[0] - room[0])
                moved, rest_of = [], []
                todo = take
                for start, m in where:
                    now = min(m, todo)
                    if now:
                        out.append((size, rank, now * per, start, per, offset))
                        rank += now * per
                        moved.append((start, now))
                        todo -= now
                    if m > now:
                        rest_of.append((start + now, m - now))
                count -= take * per
                open_bins[g], ranges[g] = n - take, rest_of
                group(room - per * need, moved, take)
            else:
                each = int((cap // need).min())
                for per, n in ((each, count // each), (count % each, 1)):
                    if n and per:
                        out.append((size, rank, n * per, bins, per, 0))
                        rank += n * per
                        group(cap - per * need, [(bins, n)], n)
                        bins += n
                count = 0
    runs = np.array(sorted(out), np.int64).reshape(-1, 6)
    return Plan(*runs.T, bins=bins)


def pieces(df: DataFrame, vocabulary: str, pattern: str, special: dict[str, int], most: int = 2048, end: int = 0, text: str = "text") -> DataFrame:
    """A row for each piece: ``df`` without its text, piece, start, length, ids_crc32.

    A null or empty text gives one piece with the end id alone; a very long one
    is encoded whole and cut by ids. Rows that repeat each give their pieces, and
    an empty table none. Columns of ``df`` with these names are replaced.
    """
    made = ("piece", "start", "length", "ids_crc32")
    others = [c for c in df.columns if c != text and c not in made]
    schema = df.select(*others).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary, pattern, special).ids
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(0)):
                data = ids(t.as_py() or "") + tail
                for i, (at, n) in enumerate(cut(len(data) // 4, most)):
                    row.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
            index = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(index) for c in batch.columns[1:]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*others, *made]
            )

    return df.select(F.col(text).alias("__text"), *others).mapInArrow(run, schema)


def best_fit(parts: DataFrame, capacity: Capacity = Capacity(), measure: str = "dot") -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length, ids_crc32).

    The histogram of lengths (at most ``capacity.tokens`` rows) goes to the
    driver, nothing else. The rank of a piece among those of its length comes
    from a window over (length, bucket), where the buckets split every length by
    a hash of the piece, and from a running sum of the buckets' sizes; no task
    holds a whole length. Rows that are equal in all columns take
    interchangeable places; of bins that fit equally well the first is taken.
    Null ids are ranked like any other value, a piece longer than a bin is
    refused, columns named as a result are replaced, and an empty table gives an
    empty result.
    """
    spark = parts.sparkSession
    parts = written(parts.drop("sequence_id", "offset"), "pieces")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = parts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("length", "__bucket", (F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    histogram = parts.groupBy("length").count().collect()
    plan = pack(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), capacity, measure)
    shared = spark.sparkContext.broadcast(plan)
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1).join(before, ["length", "__bucket"])
    ranked = ranked.select(*parts.columns, (F.col("__before") + F.col("__rank")).alias("__rank"))
    names = parts.columns
    schema = ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("length")
            bins, offsets = shared.value.place(batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def vocabulary() -> dict:
    """The public byte-level vocabulary that the queries use.

    The ids are those of ``tokenizers`` with the JSON file, special strings
    among them; texts are encoded by the faster library with the same vocabulary
    as ranks, once both files are seen to hold the same tokens.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {"vocabulary": ranks, "pattern": public_tokenizers.PATTERN, "special": same_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), ranks)}


def same_vocabulary(path: str, ranks: str) -> dict[str, int]:
    """Special tokens of a byte-level JSON file, whose other tokens and ids must be those of the file of ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    byte = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
    theirs = {b"".join(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    with open(ranks, "rb") as f:
        ours = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if theirs != ours:
        raise ValueError(f"{path} and {ranks} do not hold the same tokens")
    return special


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    return best_fit(pieces(docs, **vocabulary()))
