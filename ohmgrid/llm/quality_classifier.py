"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 1).

P(grade > k | text) = sigmoid(w . x(text) - t_k): one weight vector for all
grades, thresholds t_0 < t_1 < ... The expected grade is the sum of those
probabilities, and the last of them is the tail probability for selection.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, table

BUCKETS = 1 << 17
#: Labelled rows that the fit takes at most (by hash order of the id).
MOST_ROWS = 8_000
_word = re.compile(r"\S+")
_runs = re.compile(r"[^\W_]+")
#: Starts of longer words that are features as well, so that inflected forms share weights.
STARTS = (5, 7)
_hash: dict[str, tuple[int, ...]] = {}


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % (BUCKETS - 64) + 64


def _tokens(word: str) -> tuple[int, ...]:
    """Buckets of a word's runs of letters and digits, lower-cased, and of their starts; of the whole word where it has none."""
    if (h := _hash.get(word)) is None:
        h = tuple(x for w in [r.lower() for r in _runs.findall(word)] or [word] for x in (_bucket(w), *(_bucket(f"{w[:n]}-") for n in STARTS if len(w) > n)))
        if len(_hash) > 300_000:
            _hash.clear()
        if len(word) < 100:
            _hash[word] = h
    return h


def shape(words: list[str]) -> list[tuple[int, float]]:
    """Shares of word shapes of a whole text, in the first 64 buckets."""
    n = len(words)
    upper = sum(map(str.isupper, words)) / n
    signs = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'") / n
    bare = sum(1 for w in words if not _runs.search(w)) / n
    same = sum(map(str.__eq__, words, words[1:])) / n
    distinct = len(set(words)) / n
    return [(0, 1.0), (1, min(1.0, 2 * upper)), (2, min(1.0, 2 * signs)), (3, min(1.0, 4 * bare)), (4, min(1.0, 2 * same)), (5, 1 - distinct), (6 + min(9, n.bit_length()), 1.0)]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text.

    A word's value is 1 + log of its count, so one telling word weighs as much
    in a long text as in a short one; the shape shares describe the whole.
    """
    words = _word.findall(text or "")
    if not words:
        return np.array([0, 16]), np.array([1.0, 1.0])
    ids, n = np.unique(np.fromiter(chain.from_iterable(map(_tokens, words)), np.int64), return_counts=True)
    extra = shape(words)
    return np.concatenate([[i for i, _ in extra], ids]), np.concatenate([[v * 4 for _, v in extra], (1 + np.log(n)) * 0.5])


class Model:
    """Weights, thresholds and prediction."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        i, v = vector(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - v @ self.weights[i], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = 2_500, rate: float = 0.15, l2: float = 1e-3) -> Model:
    """Mini-batch AdaGrad on the cumulative-link likelihood, about ``steps`` batches of 64.

    The result is the mean of the parameters over the second half of the passes.

    Thresholds are kept in order by their gaps' logarithms. Without rows, all
    grades are equally likely.
    """
    w = np.zeros(BUCKETS)
    first, gaps = -1.0, np.zeros(levels - 2)
    if not len(rows):
        return Model(w, -np.log(np.arange(levels - 1, 0, -1) / np.arange(1, levels)))
    square, square_t = np.full(BUCKETS, 1e-3), np.full(levels - 1, 1e-3)
    random = np.random.default_rng(7)
    passes, mean, kept = -(-steps * 64 // max(len(rows), 64)), [np.zeros(BUCKETS), 0.0, np.zeros(levels - 2)], 0
    for k in range(passes):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 64)):
            t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            ids = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            score = np.bincount(of, values * w[ids], len(batch))
            y = grades[batch]
            low = np.where(y > 0, t[np.maximum(y - 1, 0)], -np.inf)
            high = np.where(y < levels - 1, t[np.minimum(y, levels - 2)], np.inf)
            a, b = 1 / (1 + np.exp(-np.clip(score - low, -40, 40))), 1 / (1 + np.exp(-np.clip(score - high, -40, 40)))
            a, b = np.where(np.isinf(low), 1.0, a), np.where(np.isinf(high), 0.0, b)
            # d log(a - b) / d score, and the parts that each threshold takes
            p = np.maximum(a - b, 1e-12)
            da, db = a * (1 - a) / p, b * (1 - b) / p
            grad = np.bincount(ids, values * (db - da)[of], BUCKETS) / len(batch) + l2 * w
            hit = np.flatnonzero(grad)
            square[hit] += grad[hit] ** 2
            w[hit] -= rate * grad[hit] / np.sqrt(square[hit])
            gt = (np.bincount(np.maximum(y - 1, 0), np.where(y > 0, da, 0.0), levels - 1) - np.bincount(np.minimum(y, levels - 2), np.where(y < levels - 1, db, 0.0), levels - 1)) / len(batch)
            own = np.concatenate([[gt.sum()], np.array([gt[i + 1 :].sum() * np.exp(gaps[i]) for i in range(levels - 2)])])
            square_t += own**2
            step = rate * own / np.sqrt(square_t)
            first, gaps = first - step[0], gaps - step[1:]
        if 2 * k >= passes - 1:
            kept += 1
            mean = [m + (x - m) / kept for m, x in zip(mean, (w, first, gaps), strict=True)]
    w, first, gaps = mean
    return Model(w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 poor, 2 good; rows with a null that matters are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rows = labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` rated documents, those with the smallest hash of the id.

    ``ratings``: doc_id, grade (0 to ``levels`` - 1); others, null ones too, are
    left out. Only their hashed features reach the driver, never texts: all
    features of whole texts, at most one for each of the ``BUCKETS``, 12 bytes
    each. A null text has the features of an empty one, rows that repeat count
    each, and no rated rows give a model for which all grades are equally likely.
    """
    chosen = ratings.where(F.col("grade").between(0, levels - 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, values = [], []
            for t in batch.column(1):
                i, v = vector(t.as_py())
                ids.append(i.astype(np.int32).tobytes())
                values.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["grade", "ids", "values"])

    # in a fixed order, as float sums depend on it
    got = sorted((bytes(r[1]), bytes(r[2]), r[0]) for r in rows.mapInArrow(run, "grade int, ids binary, values binary").collect())
    data = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for i, v, _ in got]
    return fit(data, np.array([g for *_, g in got], dtype=np.int64), levels)


def score(df: DataFrame, model: Model, tail: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` without its text, with expected_grade, tail_probability and selected.

    ``selected``: the probability of the highest grade is at least ``tail``, so
    one of just ``tail`` is taken. A null or empty text has the features of an
    empty one, and a very long one all its own. Every row gives one row, rows
    that repeat the same one, and an empty table none; a column of ``df`` named
    as an output is replaced.
    """
    made = ("expected_grade", "tail_probability", "selected")
    others = [c for c in df.columns if c != text and c not in made]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            p = np.array([shared.value.above(t.as_py()) for t in batch.column(0)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= tail)], names=[*others, *made])

    schema = df.select(*others).schema.add(made[0], "double").add(made[1], "double").add(made[2], "boolean")
    return df.select(F.col(text).alias("__text"), *others).mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model)
