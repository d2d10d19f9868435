"""Quality rules with robust multivariate outliers per language and source (operator 9).

Only DataFrame functions: the statistics are column expressions, and the
minimum-covariance-determinant estimate is a chain of grouped aggregates whose
group table (a few rows per group) never leaves the executors. Four starts per
group are concentrated until their determinants stay, and the lowest one wins.
Statistics are taken as fixed-point integers, so the sums and with them the
verdicts do not depend on the order of rows or on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, once, text_or_empty, using, word_array, written

#: Transformed statistics, in fixed point with ``SCALE`` steps to one.
VECTOR = ("z0", "z1", "z2", "z3")
SCALE = 1024
#: Steps of the squared distance in the histogram that the subset is cut from, and its last bin.
BIN, LAST = 32, 1 << 15
#: Standard deviation that is added to the scatter, by coordinate, in groups whose rows are all alike there.
FLOOR = (0.05, 0.04, 0.1, 0.1)
#: Concentration steps at most, and by how much each must lower the determinant's logarithm.
MOST_STEPS, STILL = 20, 1e-4
#: Groups up to which their table is broadcast (under 300 bytes each); beyond, the join shuffles.
MOST_GROUPS = 100_000
#: Rows that the estimate of the group above counts for.
PRIOR = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def chi2_cdf(x: float, p: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return low


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base statistics of each whole text (null: no words).

    Three-word windows are compared by 64-bit hashes within a text. A text whose
    windows are all different is done after one hash-set pass; otherwise the
    windows are sorted, so a text of n words costs n log n. Columns of ``df``
    named as a statistic are replaced.
    """
    txt = text_or_empty(text)
    df = df.drop(*BASE)
    out = df.withColumn("__txt", txt).withColumn("__w", once(word_array(F.col("__txt"))))
    out = out.withColumn("__lines", once(F.filter(F.split("__txt", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    w = F.col("__w")
    n = F.size(w)
    out = out.withColumn("__h", once(F.when(n >= 3, F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))))
    h = F.col("__h")
    out = out.withColumn(
        "__sorted", once(F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    )
    s = F.col("__sorted")
    # a window counts if the one before or after it in the sorted order is equal
    again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("__at", once(F.array_sort(F.transform(again, lambda x: x["i"]))))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = out.select(
        *df.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length("__txt") - F.char_length(F.regexp_replace("__txt", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add the transformed vector and the group's names; null names are a group of their own."""

    def fixed(c: Column) -> Column:
        return F.round(c * SCALE).cast("long")

    chars, words = F.col("word_chars") + 1, F.col("n_words") + 1
    return stats.withColumns(
        {
            "z0": fixed(F.log(chars / words)),
            "z1": fixed(F.sqrt(F.col("n_symbols") / chars)),
            "z2": fixed(F.sqrt(F.col("n_dup_lines") / (F.col("__n_lines") + 1))),
            "z3": fixed(F.sqrt(F.col("n_repeat_words") / words)),
            "__lang": F.concat(F.lit("l:"), F.coalesce(F.col(lang).cast("string"), F.lit("?"))),
            "__source": F.concat(F.lit("s:"), F.coalesce(F.col(source).cast("string"), F.lit("?"))),
        }
    ).drop("__n_lines")


def levels() -> list[Column]:
    """Names of a row's groups: its language and source, its language, all rows."""
    pair = F.concat(F.lit("2:"), F.char_length("__lang").cast("string"), F.lit(":"), F.col("__lang"), F.col("__source"))
    return [pair, F.concat(F.lit("1:"), F.col("__lang")), F.lit("0")]


def squared_distance(mean: list[Column], inverse_root: dict[tuple[int, int], Column], x: list[Column]) -> Column:
    """|L^-1 (x - mean)|^2 by forward substitution; ``inverse_root`` has L by row and column."""
    solved: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - mean[i]
        for j in range(i):
            rest = rest - inverse_root[i, j] * solved[j]
        solved.append(rest / inverse_root[i, i])
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def cholesky(frame: DataFrame, cov: dict[tuple[int, int], Column], p: int) -> DataFrame:
    """Add columns l00, l10, l11, ... of the lower root of a positive definite matrix."""
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            frame = frame.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return frame


def distance(p: int) -> Column:
    x = [F.col(f"z{k}") / SCALE for k in range(p)]
    return squared_distance([F.col(f"m{k}") for k in range(p)], {(i, j): F.col(f"l{i}{j}") for i in range(p) for j in range(i + 1)}, x)


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def small(groups: DataFrame) -> DataFrame:
    """A written table of groups, to be broadcast if it is small: rows of a hot group then stay where they are."""
    return F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups


def starts(rows: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """__g, start, rows, location m and scatter c of four deterministic starts per group.

    Median and quartile ranges; moments; median and scatter of hyperbolic
    tangents; median and scatter of directions, the last two of coordinates over
    their quartile ranges.
    """
    p = len(VECTOR)
    quarters = rows.groupBy("__g").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in VECTOR])
    quarters = quarters.select("__g", *[(F.col(c)[1] / SCALE).alias(f"med{k}") for k, c in enumerate(VECTOR)], *[((F.col(c)[2] - F.col(c)[0]) / SCALE / 1.349).alias(f"q{k}") for k, c in enumerate(VECTOR)])
    quarters = written(quarters.select("*", *[F.sqrt(F.col(f"q{k}") ** 2 + floor[k] ** 2).alias(f"s{k}") for k in range(p)]), "mcd-quarters")
    wide = rows.join(small(quarters), "__g").select("__g", *VECTOR, *[((F.col(c) / SCALE - F.col(f"med{k}")) / F.col(f"s{k}")).alias(f"y{k}") for k, c in enumerate(VECTOR)])
    length = F.sqrt(sum((F.col(f"y{k}") ** 2 for k in range(1, p)), F.col("y0") ** 2))
    fixed = lambda c: F.round(c * SCALE).cast("long")
    wide = wide.select("__g", *VECTOR, *[fixed(F.tanh(f"y{k}")).alias(f"t{k}") for k in range(p)], *[fixed(F.when(length > 0, F.col(f"y{k}") / length).otherwise(0.0)).alias(f"u{k}") for k in range(p)])
    sums = [F.sum(f"{x}{i}").alias(f"{x}_{i}") for x in "ztu" for i in range(p)] + [F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}_{i}{j}") for x in "ztu" for i, j in pairs(p)]
    found = wide.groupBy("__g").agg(F.count("*").alias("rows"), *sums).join(quarters, "__g")
    n = F.col("rows")
    mean = lambda x, i: F.col(f"{x}_{i}") / n / SCALE
    second = lambda x, i, j: F.col(f"{x}_{i}{j}") / n / SCALE**2
    cov = lambda x, i, j: second(x, i, j) - mean(x, i) * mean(x, j)
    spread = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    median = [F.col(f"med{k}") for k in range(p)]
    scatters = [
        (median, lambda i, j: F.col(f"q{i}") ** 2 if i == j else F.lit(0.0)),
        ([mean("z", i) for i in range(p)], lambda i, j: cov("z", i, j)),
        (median, lambda i, j: spread(i, j) * cov("t", i, j)),
        (median, lambda i, j: spread(i, j) * second("u", i, j) * p),
    ]
    made = []
    for k, (at, c) in enumerate(scatters):
        scatter = [(c(i, j) + F.lit(floor[i] ** 2 if i == j else 0.0)).cast("double").alias(f"c{i}{j}") for i, j in pairs(p)]
        made.append(F.struct(F.lit(k).alias("start"), *[m.cast("double").alias(f"m{i}") for i, m in enumerate(at)], *scatter))
    return found.select("__g", "rows", F.explode(F.array(*made)).alias("x")).select("__g", "rows", "x.*")


def rooted(params: DataFrame) -> DataFrame:
    """Add the root of the scatter and the logarithm of its determinant."""
    p = len(VECTOR)
    out = cholesky(params, {(i, j): F.col(f"c{i}{j}") for i, j in pairs(p)}, p)
    return out.withColumn("logdet", 2 * sum((F.log(f"l{k}{k}") for k in range(1, p)), F.log("l00")))


def fit(stats: DataFrame, support: float = 0.75, floor: tuple[float, ...] = FLOOR, most_steps: int = MOST_STEPS, prior: float = PRIOR) -> DataFrame:
    """Robust location and root of the scatter of each language and source (columns __lang, __source).

    ``stats``: rows with the vector; those that pass the base rules count. The
    estimate is made for each language and source, each language, and all rows.
    A concentration step takes the ``support`` share of the rows nearest to the
    present estimate and estimates anew; every start takes steps as long as they
    lower its determinant (by ``STILL``), ``most_steps`` at most, and of a
    group's starts the lowest determinant is taken, of equal ones the first. A
    group's location and scatter are then averaged with those of its language,
    and these with those of all rows, where the group above counts as ``prior``
    rows: a large group stands by itself, a row that is alone is judged by its
    language. ``floor`` is a standard deviation per coordinate that is added to
    the scatter, as coordinates that are 0 for most rows make it singular.
    """
    p = len(VECTOR)
    good = stats.where(~F.col("base_failed"))
    rows = good.select(F.explode(F.array(*levels())).alias("__g"), *VECTOR)
    values = ["rows", *[f"m{k}" for k in range(p)], *[f"c{i}{j}" for i, j in pairs(p)], *[f"l{i}{j}" for i, j in pairs(p)], "logdet"]
    params = written(rooted(starts(rows, floor)).select("__g", "start", F.struct(*values).alias("x"), F.lit(True).alias("open")), "mcd")
    # the nearest share of a normal sample has too small a scatter, by this factor
    narrow = support / chi2_cdf(chi2_quantile(support, p), p + 2)
    for step in range(most_steps):
        near = rows.join(small(params.where("open").select("__g", "start", "x.*")), "__g").withColumn("__b", F.least(F.floor(distance(p) * BIN), F.lit(LAST)).cast("int"))
        bins = near.groupBy("__g", "start", "__b").agg(
            F.count("*").alias("n"),
            *[F.sum(f"z{i}").alias(f"a{i}") for i in range(p)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"a{i}{j}") for i, j in pairs(p)],
        )
        # a start has at most LAST + 1 bins, each with its own sums: one pass gives cut and moments
        bins = written(bins, "mcd-bins")
        cuts = bins.groupBy("__g", "start").agg(F.percentile("__b", F.lit(support), F.col("n")).alias("__cut"), F.sum("n").alias("rows"))
        sums = bins.join(cuts, ["__g", "start"]).where(F.col("__b") <= F.ceil("__cut"))
        sums = sums.groupBy("__g", "start", "rows").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in ("__g", "start", "__b")])
        mean = sums.select("*", *[(F.col(f"a{k}") / F.col("n") / SCALE).alias(f"m{k}") for k in range(p)])
        scatter = [((F.col(f"a{i}{j}") / F.col("n") / SCALE**2 - F.col(f"m{i}") * F.col(f"m{j}")) * narrow + F.lit(floor[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs(p)]
        new = rooted(mean.select("__g", "start", "rows", *[f"m{k}" for k in range(p)], *scatter)).select("__g", "start", F.struct(*values).alias("y"))
        # a start is no estimate yet, so its first step is taken whatever its determinant
        lower = F.coalesce(F.lit(step == 0) | (F.col("y.logdet") < F.col("x.logdet") - STILL), F.lit(False))
        both = params.join(new, ["__g", "start"], "left").withColumn("open", F.col("open") & F.col("y").isNotNull() & lower)
        both = written(both.select("__g", "start", F.when(F.col("open"), F.col("y")).otherwise(F.col("x")).alias("x"), "open"), "mcd")
        forget(bins, params)
        params = both
        if params.where("open").isEmpty():
            break
    names = ["rows", *[f"m{k}" for k in range(p)], *[f"c{i}{j}" for i, j in pairs(p)]]
    best = params.groupBy("__g").agg(F.min_by("x", F.struct("x.logdet", "start")).alias("x")).select("__g", "x.*")
    best = written(best, "mcd-best")
    forget(params)
    out = good.select("__lang", "__source").distinct()
    for k, g in enumerate(levels()):
        out = out.withColumn("__g", g).join(best.select("__g", *[F.col(c).alias(f"{c}_{k}") for c in names]), "__g").drop("__g")
    for c in names[1:]:
        mixed = F.col(f"{c}_2")
        for k in (1, 0):
            mixed = (F.col(f"rows_{k}") * F.col(f"{c}_{k}") + prior * mixed) / (F.col(f"rows_{k}") + prior)
        out = out.withColumn(c, mixed)
    done = written(rooted(out).select("__lang", "__source", *[f"m{k}" for k in range(p)], *[f"l{i}{j}" for i, j in pairs(p)]), "mcd-groups")
    forget(best)
    return done


def judged(stats: DataFrame, params: DataFrame, cutoff: float) -> DataFrame:
    """Add ``distance2`` (null where no row of the group passes the base rules) and ``kept``."""
    out = stats.join(small(params), ["__lang", "__source"], "left").withColumn("distance2", distance(len(VECTOR)))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))


#: Squared distance above which a document is an outlier: the tail of a chi-square
#: with four degrees of freedom beyond it is 1e-9, as transformed statistics of
#: short texts have heavier tails than a normal sample. Of the test tables' labelled
#: documents that pass the base rules it takes 9 of 14,858 good ones and leaves 1 of
#: 1,345 poor ones; a limit of 1e-6 would take 74 good ones.
CUTOFF = chi2_quantile(1 - 1e-9, len(VECTOR))


def quality_rules(df: DataFrame, cutoff: float = CUTOFF, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Statistics and verdict for every row of ``df`` (columns doc_id, text, lang, source).

    Null and empty texts: no words, so they fail the base rules; very long ones
    are analysed whole. Null language or source form groups of their own. Rows
    that repeat each count and get the same verdict, also for a null doc_id; a
    row just at the limit is kept. An empty table gives an empty result. Other
    columns are not read, whatever their names. The statistic table (no texts) is
    written to the shared folder once; all passes of the estimate read that.
    """
    stats = written(vectors(statistics(df.select("doc_id", F.col(text).alias("__text0"), F.col(lang).alias("__lang0"), F.col(source).alias("__source0")), "__text0"), "__lang0", "__source0").drop("__text0", "__lang0", "__source0"), "quality-stats")
    return judged(stats, fit(stats), cutoff).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(df: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df`` whatever their names.

    Texts are analysed once, and the rows that pass the base rules are written
    with their vectors; see ``quality_rules`` for nulls, repeats and long texts.
    An empty table gives an empty one.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    stats = vectors(statistics(row.select("__row", "__row.text", "__row.lang", "__row.source")).where("not base_failed"))
    stats = written(stats.select("__row", "base_failed", *VECTOR, "__lang", "__source"), "quality-stats")
    params = fit(stats)
    return using(judged(stats, params, cutoff).where("kept").select("__row.*"), stats, params)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
