"""Personal data by weak supervision (operator 6). DataFrame functions only.

Base spans come from fixed patterns. Beyond them, every run of code-like
characters that has a digit is a candidate: regex, gazetteer and context
labelers vote on it, expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a logistic span classifier trained
on the resulting posteriors decides. Only the table of (votes, features) counts,
whose size the definitions below bound, goes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, once, text_or_empty, using, written

# The patterns start a match only where a run of their characters starts or the
# last match ended, and take runs possessively: the same leftmost matches as the
# plain patterns, in linear time and without deep recursion on very long texts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must stand in a text for the pattern to match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CANDIDATE = r"(?<![A-Za-z0-9_+/.@=-])(?=[A-Za-z_+/.@=-]*+[0-9])[A-Za-z0-9_+/.@=-]{8,}+"
ADDED = ("secret", "number")
KINDS = (*PATTERNS, *ADDED)
SPAN = "array<struct<kind:string,start:int,end:int>>"

SENSITIVE = ("password", "passwd", "pwd", "passwort", "kennwort", "contraseña", "token", "secret", "key", "apikey", "api_key", "bearer", "credential", "iban", "ssn", "passport", "account", "konto")
ORDINARY = ("version", "page", "chapter", "section", "figure", "table", "volume", "isbn", "seite", "página", "chapitre")
LABELERS = ("shape", "known", "gazetteer", "context", "mixture")


def found(text: Column, kind: str) -> Column:
    m = F.regexp_extract_all(text, F.lit(PATTERNS.get(kind, CANDIDATE)), F.lit(0))
    hint = HINTS.get(kind)
    empty = F.array().cast("array<string>")
    return m if hint is None else F.when(F.contains(text, F.lit(hint)), m).otherwise(empty)


def with_spans(df: DataFrame, kind: str, text: str = "__text") -> DataFrame:
    """Add __m_<kind>: matches with start and end in code points, and the 48 characters before.

    Gaps between matches come from a split by the same pattern. The running
    positions are made from sums over blocks of about the square root of the
    number of matches, so a text with very many of them stays affordable.
    """
    t = F.col(text)
    df = df.withColumn("__m", once(found(t, kind)))
    some = F.size("__m") > 0
    df = df.withColumn("__gap", once(F.when(some, F.split(t, PATTERNS.get(kind, CANDIDATE), -1))))
    df = df.withColumn("__len", once(F.when(some, F.transform("__m", lambda m, i: F.char_length(m) + F.char_length(F.get("__gap", i))))))
    df = df.withColumn("__b", F.when(some, F.ceil(F.sqrt(F.size("__m"))).cast("int")))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__m") - 1) / F.col("__b")).cast("int")), lambda k: total(F.slice("__len", k * F.col("__b") + 1, F.col("__b"))))
    df = df.withColumn("__sum", once(F.when(some, blocks)))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / F.col("__b")).cast("int")
        end = total(F.slice("__sum", F.lit(1), block)) + total(F.slice("__len", block * F.col("__b") + 1, i - block * F.col("__b") + 1))
        return F.struct(m.alias("m"), (end - F.char_length(m)).alias("start"), end.alias("end"), F.right(F.get("__gap", i), F.lit(48)).alias("before"))

    spans = F.when(some, F.transform("__m", span)).otherwise(F.array().cast("array<struct<m:string,start:int,end:int,before:string>>"))
    return df.withColumn(f"__m_{kind}", once(spans)).drop("__m", "__gap", "__len", "__b", "__sum")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in 0."""
    back = F.split(F.reverse(d), "", -1)

    def worth(x: Column, i: Column) -> Column:
        v = F.coalesce(F.try_to_number(x, F.lit("9")).cast("int"), F.lit(0))
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(back, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.char_length(digits(m))
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str = "__text") -> DataFrame:
    """Add __base: array of (kind, start, end), by kind as listed, then start."""
    for kind in PATTERNS:
        df = with_spans(df, kind, text)
    def kept(kind: str) -> Column:
        good = F.filter(f"__m_{kind}", lambda x: valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    parts = [kept(k) for k in PATTERNS]
    return df.withColumn("__base", once(F.concat(*parts))).drop(*[f"__m_{k}" for k in PATTERNS])


def votes(m: Column, before: Column) -> list[Column]:
    """What each labeler says: 1 personal, 0 not, -1 abstains."""
    word = F.lower(F.regexp_extract(before, r"([\p{L}_]+)[^\p{L}]{0,6}$", 1))
    name = F.lower(F.regexp_extract(m, r"^([A-Za-z_]+)=", 1))
    value = F.regexp_replace(m, r"^[A-Za-z_]+=", "")
    size = F.char_length(value)
    sensitive, ordinary = list(SENSITIVE), list(ORDINARY)
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    shape = F.when(value.rlike(r"^[0-9a-f]{16,}$") | value.rlike(r"^[A-Z0-9]{16,}$") | value.rlike(r"^[A-Za-z0-9_-]{24,}$"), 1).when(value.rlike(r"^[0-9]{1,4}(?:[.-][0-9]{1,4})*$") | value.rlike(r"^[A-Za-z]+[-.]?[0-9]{1,4}\.?$"), 0).otherwise(-1)
    known = F.when(value.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$") | value.rlike(r"^(?:ghp|gho|xox[bap]|sk|pk)[_-][A-Za-z0-9_-]{16,}$") | value.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), 1).otherwise(-1)
    gazetteer = F.when(name.isin(sensitive) | word.isin(sensitive), 1).when(word.isin(ordinary), 0).otherwise(-1)
    context = F.when((name != "") | before.rlike(r"[=:#]\s{0,3}[\"']?$"), 1).when(value.rlike(r"\.[A-Za-z]{2,4}$") | value.startswith("/"), 0).otherwise(-1)
    mixture = F.when(mixed & (size >= 14) & (F.char_length(digits(value)) * 5 >= size), 1).when((size < 10) | (F.char_length(digits(value)) * 10 < size), 0).otherwise(-1)
    return [c.cast("int") for c in (shape, known, gazetteer, context, mixture)]


def features(m: Column, before: Column) -> list[tuple[str, Column, int]]:
    """Name, value and number of values of the classifier's categorical inputs."""
    size = F.char_length(m)
    length = F.when(size < 10, 0).when(size < 14, 1).when(size < 18, 2).when(size < 24, 3).when(size < 40, 4).otherwise(5)
    letters = F.when(~m.rlike("[A-Za-z]"), 0).when(~m.rlike("[a-z]"), 1).when(~m.rlike("[A-Z]"), 2).otherwise(3)
    sign = F.when(m.contains("="), 1).when(m.contains("/") | m.contains("@"), 2).when(m.contains("."), 3).when(m.contains("-") | m.contains("+"), 4).otherwise(0)
    share = F.least(F.floor(F.char_length(digits(m)) * 4 / size), F.lit(3))
    last = F.right(before, F.lit(1))
    lead = F.when(last.isin('"', "'"), 1).when(last.isin("=", ":", "#"), 2).when(last == "", 3).otherwise(0)
    return [(n, c.cast("int"), k) for n, c, k in (("length", length, 6), ("letters", letters, 4), ("sign", sign, 5), ("share", share, 4), ("lead", lead, 4))]


def candidates(df: DataFrame, text: str = "__text") -> DataFrame:
    """Add __cand: candidates that overlap no base span, with votes and features."""
    df = with_spans(df, "candidate", text)

    def row(x: Column) -> Column:
        kind = F.when(x["m"].rlike("[A-Za-z]"), ADDED[0]).otherwise(ADDED[1])
        return F.struct(
            kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            F.concat_ws(",", *[v.cast("string") for v in votes(x["m"], x["before"])]).alias("votes"),
            F.concat_ws(",", *[v.cast("string") for _, v, _ in features(x["m"], x["before"])]).alias("features"),
        )

    free = F.filter("__m_candidate", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.withColumn("__cand", once(F.transform(free, row))).drop("__m_candidate")


@dataclass
class SpanModel:
    """Reliabilities of the labelers, and the probability by (votes, features)."""

    sensitivity: list[float]
    specificity: list[float]
    prior: float
    weights: list[float]
    threshold: float = 0.5


def estimate(rows: list[tuple[str, str, int]], rounds: int = 50) -> SpanModel:
    """EM over counts of vote patterns, then a logistic classifier on the posteriors.

    ``rows``: (votes, features, count). Votes of one labeler are taken to depend
    on the class alone; abstentions say nothing. The start trusts each labeler
    at 0.8. Without rows every candidate gets probability 0.
    """
    n = len(LABELERS)
    sizes = [k for _, _, k in features(F.lit(""), F.lit(""))] if rows else []
    if not rows:
        return SpanModel([0.8] * n, [0.8] * n, 0.0, [])
    v = np.array([list(map(int, r[0].split(","))) for r in rows])
    f = np.array([list(map(int, r[1].split(","))) for r in rows])
    c = np.array([r[2] for r in rows], float)
    sens, spec, prior = np.full(n, 0.8), np.full(n, 0.8), 0.5
    for _ in range(rounds):
        on = np.where(v == 1, np.log(sens), np.where(v == 0, np.log1p(-sens), 0.0)).sum(axis=1) + math.log(prior)
        off = np.where(v == 0, np.log(spec), np.where(v == 1, np.log1p(-spec), 0.0)).sum(axis=1) + math.log1p(-prior)
        post = 1 / (1 + np.exp(np.clip(off - on, -500, 500)))
        w1, w0 = c * post, c * (1 - post)
        # two pseudo-votes each way keep the estimates off 0 and 1, and better than chance
        sens = np.clip([(w1[v[:, k] == 1].sum() + 2) / (w1[v[:, k] >= 0].sum() + 4) for k in range(n)], 0.5, 0.999)
        spec = np.clip([(w0[v[:, k] == 0].sum() + 2) / (w0[v[:, k] >= 0].sum() + 4) for k in range(n)], 0.5, 0.999)
        prior = float(np.clip((w1.sum() + 1) / (c.sum() + 2), 0.001, 0.999))
    width = 1 + sum(sizes) + 3 * n
    x = np.zeros((len(rows), width))
    x[:, 0] = 1
    at = 1
    for k, size in enumerate(sizes):
        x[np.arange(len(rows)), at + f[:, k]] = 1
        at += size
    for k in range(n):
        x[np.arange(len(rows)), at + v[:, k] + 1] = 1
        at += 3
    w = np.zeros(width)
    scale = c / c.sum()
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - post)) + 1e-4 * w
        hessian = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return SpanModel(sens.tolist(), spec.tolist(), prior, w.tolist())


def accepted(model: SpanModel, cand: Column) -> Column:
    """Whether the classifier takes a candidate: its weights summed by column expressions."""
    if not model.weights:
        return F.lit(False)
    sizes = [k for _, _, k in features(F.lit(""), F.lit(""))]
    f, v = F.split(cand["features"], ","), F.split(cand["votes"], ",")
    score, at = F.lit(model.weights[0]), 1
    for k, size in enumerate(sizes):
        score = score + F.get(F.array(*[F.lit(x) for x in model.weights[at : at + size]]), F.get(f, k).cast("int"))
        at += size
    for k in range(len(LABELERS)):
        score = score + F.get(F.array(*[F.lit(x) for x in model.weights[at : at + 3]]), F.get(v, k).cast("int") + 1)
        at += 3
    return score >= math.log(model.threshold / (1 - model.threshold))


def count_patterns(df: DataFrame) -> list[tuple[str, str, int]]:
    """Counts of (votes, features) over all candidates; at most 3^5 x 1,920 kinds, whatever the input."""
    one = df.select(F.explode("__cand").alias("c")).groupBy("c.votes", "c.features").count()
    return sorted((r[0], r[1], r[2]) for r in one.collect())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_all_spans(df: DataFrame, model: SpanModel) -> DataFrame:
    """Add __spans: the base spans, then the accepted candidates, by kind and start."""

    def taken(kind: str) -> Column:
        good = F.filter("__cand", lambda x: (x["kind"] == kind) & accepted(model, x))
        return F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    more = [taken(k) for k in ADDED]
    return df.withColumn("__spans", once(F.concat("__base", *more)))


def find_pii(df: DataFrame, text: str = "text") -> tuple[DataFrame, SpanModel]:
    """doc_id, counts of the base kinds, base_sha256, spans and n_added per row; and the model.

    A null text counts as empty, and a very long one is looked through whole.
    Every row gives one row, repeated ones too, and an empty table none. Spans of
    different kinds may overlap; candidates that overlap a base span are no
    candidates, and a probability of just the threshold counts as personal.
    Other columns are not read, whatever their names. The spans of all rows (no
    texts) are written to the shared folder once, between fitting and use.
    """
    spans = candidates(base_spans(df.select("doc_id", text_or_empty(text).alias("__text")))).select("doc_id", "__base", "__cand")
    spans = written(spans, "pii-spans")
    model = estimate(count_patterns(spans))
    out = with_all_spans(spans, model)
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    out = out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"),
        (F.size("__spans") - F.size("__base")).cast("long").alias("n_added"),
    )
    return out, model


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping ones merge."""
    ends = F.transform(spans, lambda s: s["end"])

    def part(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.slice(ends, F.lit(1), i)))
        gap = F.when(s["start"] > before, F.substring(text, before + 1, s["start"] - before)).otherwise(F.lit(""))
        mark = F.when(s["start"] >= before, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.concat(gap, mark)

    tail = F.substring(text, F.array_max(ends) + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, part), ""), tail))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in its text replaced; a null text stays null.

    Other columns stay as they are, whatever their names, except ``n_chars``
    (the new text's length) where there is one. Texts are analysed once, whole,
    and written beside their spans; the model comes from all rows before any is
    replaced. Spans that overlap are replaced as one, by the kind that starts
    first, of equal starts the shorter. Repeated rows each give a row, and an
    empty table an empty one.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    spans = candidates(base_spans(row.withColumn("__text", F.coalesce(F.col("__row")[text], F.lit("")))))
    spans = written(spans.select("__row", "__base", "__cand"), "pii-texts")
    model = estimate(count_patterns(spans.select("__cand")))
    out = with_all_spans(spans, model).withColumn("__text", F.coalesce(F.col("__row")[text], F.lit(""))).withColumn("__sorted", once(F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    out = out.withColumn("__new", F.when(F.col("__row")[text].isNotNull(), redacted(F.col("__text"), F.col("__sorted"))))

    def value(c: str) -> Column:
        if c == text:
            return F.col("__new").alias(c)
        if c == "n_chars":
            return F.when(F.col("__new").isNull(), F.col("__row")[c]).otherwise(F.char_length("__new")).cast(df.schema[c].dataType).alias(c)
        return F.col("__row")[c].alias(c)

    return using(out.select(*[value(c) for c in df.columns]), spans)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))[0]
