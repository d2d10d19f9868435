"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 3).

Texts of a batch become one sparse matrix, document by bucket, that is scored
against the broadcast matrix of log probabilities, language by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters that are hashed at once; a longer text is taken in such steps.
STEP = 1 << 20
#: Languages of one broadcast matrix: 256 x 32,768 floats are 32 MB. More make further matrices and passes.
BLOCK = 256
#: Languages that a task sums up before it passes its sums on.
MOST_SUMS = 64
#: Bytes of text that make one sparse matrix.
PART = 1 << 19
_letter = regex.compile(r"\p{L}").search


def grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, lower-cased, with a space at either end."""
    text = f" {text.lower()} "
    most = max(ORDERS)
    for at in range(0, len(text), STEP):
        part = text[max(0, at - most + 1) : at + STEP]
        seen = min(at, most - 1)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(code), np.uint32)
        for n in range(1, most + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint32(0x01000193)) ^ code[n - 1 :] * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                yield h[max(0, seen - n + 1) :] % np.uint32(buckets)


def sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of the n-grams of the texts, in that order; a null has none."""
    keys, long = [np.zeros(0, np.int64)], []
    for k, t in enumerate(texts):
        if t is None:
            continue
        if len(t) <= STEP:
            keys += [h.astype(np.int64) + k * BUCKETS for h in grams(t)]
        else:
            total = sum(np.bincount(h, minlength=BUCKETS) for h in grams(t))
            at = np.flatnonzero(total)
            long.append((at + k * BUCKETS, total[at]))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    if long:
        key, count = np.concatenate([key, *[x for x, _ in long]]), np.concatenate([count, *[n for _, n in long]])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    return key // BUCKETS, key % BUCKETS, count


class Model:
    """Languages, and log probabilities in matrices of at most ``BLOCK`` languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        prior = np.log((docs + 1.0) / (docs + 1.0).sum())
        self.blocks = []
        for at in range(0, len(langs), BLOCK):
            smooth = counts[at : at + BLOCK] + alpha
            self.blocks.append((langs[at : at + BLOCK], prior[at : at + BLOCK], np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)))

    @property
    def logp(self) -> np.ndarray:
        return np.concatenate([logp for _, _, logp in self.blocks])


def totals(block: tuple[list[str], np.ndarray, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Log of prior times likelihood, text by language of the block.

    A text's sum runs over its buckets in order, so it does not depend on the
    other texts of the batch.
    """
    doc, bucket, count = sparse(texts)
    langs, prior, logp = block
    out = np.empty((len(texts), len(langs)))
    for k in range(len(langs)):
        out[:, k] = prior[k] + np.bincount(doc, count * logp[k].take(bucket).astype(np.float64), len(texts))
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over every row of ``df`` whose language is known.

    Each task sums its rows into one array per language and sends only those;
    Spark adds them up by (language, block of buckets). A null text counts as
    empty, very long texts are taken whole in steps, repeated rows count each,
    rows without a language are left out, and no rows give a model that answers
    ``und``. Any number of languages is taken; each is 128 KB of the model.
    """
    width = 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        blocks = BUCKETS // width

        def made() -> Iterator[pa.RecordBatch]:
            for name, a in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * blocks), pa.array(range(blocks), pa.int32()), pa.array(a.reshape(blocks, width).tolist(), pa.list_(pa.int64()))], names=["lang", "block", "counts"])

        for batch in slices(batches, 0, PART):
            doc, bucket, n = sparse(batch.column(0).to_pylist())
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                own = code[doc] == k
                found = np.bincount(bucket[own], n[own], BUCKETS).astype(np.int64)
                sums[name] = sums[name] + found if name in sums else found
            if len(sums) > MOST_SUMS:
                yield from made()
                sums = {}
        yield from made()

    known = df.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = known.mapInArrow(count, "lang string, block int, counts array<long>")
    rows = (
        parts.select("lang", "block", F.posexplode("counts").alias("i", "c"))
        .where("c > 0")
        .groupBy("lang", "block", "i")
        .agg(F.sum("c").alias("c"))
        .groupBy("lang", "block")
        .agg(F.collect_list("i").alias("i"), F.collect_list("c").alias("c"))
    )
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    at = {name: k for k, name in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS), np.float32 if len(langs) > BLOCK else np.float64)
    for r in rows.toLocalIterator():
        counts[at[r["lang"]], r["block"] * width + np.array(r["i"])] = r["c"]
    return Model(langs, counts, np.array([float(sizes[x]) for x in langs]))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without its text, with lang_pred and score, the probability of that language.

    A text that is null or has no letter gives ``und`` and 0, as all texts do
    with a model of no languages. Of languages equally likely the first by name
    is taken. Very long texts are scored whole. Every row gives one row, repeated
    ones too, and an empty table none; a column of ``df`` named as an output is
    replaced. Each matrix of the model is a pass of its own, which keeps the best
    language and the sum of probabilities so far.
    """
    made = ("lang_pred", "score")
    others = [c for c in df.columns if c not in (text, *made)]
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = kept.select("row", "text", F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("others"))
    for block in model.blocks:
        shared = df.sparkSession.sparkContext.broadcast(block)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, PART):
                texts = batch.column(1).to_pylist()
                spoken = np.array([t is not None and bool(_letter(t)) for t in texts])
                total = totals(shared.value, [t if ok else None for t, ok in zip(texts, spoken, strict=True)])
                at = total.argmax(axis=1)
                top, best = total[np.arange(len(at)), at], batch.column(3).to_numpy()
                with np.errstate(invalid="ignore"):
                    high = np.maximum(best, top)
                    # probabilities of all languages so far, over that of the best one
                    odds = np.where(np.isinf(best), 0.0, batch.column(4).to_numpy() * np.exp(best - high)) + np.exp(total - high[:, None]).sum(axis=1)
                names = [shared.value[0][k] if ok and t > b else old for k, ok, t, b, old in zip(at, spoken, top, best, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(spoken, high, -np.inf)), pa.array(np.where(spoken, odds, 0.0))], names=["row", "text", "lang_pred", "best", "others"]
                )

        rows = rows.mapInArrow(score, rows.schema)
    share = F.when(F.col("others") > 0, F.least(F.lit(1.0), 1 / F.col("others"))).otherwise(0.0)
    return rows.select(*[F.col("row")[c].alias(c) for c in others], "lang_pred", share.alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
