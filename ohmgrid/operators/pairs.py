"""Pairwise operators on sites. Sites are few, pairs are i > j."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def site_pairs(sites: DataFrame, cols: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """i > j with each column at both ends; of ``pairs`` (i > j and any columns) only, where given, by lookups of their ends."""
    a = sites.select(F.col("site").alias("i"), *[F.col(c).alias(f"{c}_i") for c in cols])
    b = sites.select(F.col("site").alias("j"), *[F.col(c).alias(f"{c}_j") for c in cols])
    if pairs is not None:
        return pairs.join(a, "i").join(b, "j").where("i > j")
    return a.join(b, F.col("i") > F.col("j"))


def standardized(sites: DataFrame, cols: list[str]) -> DataFrame:
    """Columns centred and scaled, by one aggregate of one row."""
    one = F.broadcast(sites.agg(*[x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__d_{c}"))]))
    return sites.join(one).select(*[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}")).alias(c) if c in cols else F.col(c) for c in sites.columns])


def endpoint_covariates(sites: DataFrame, cols: list[str], transform: str = "absdiff", pairs: DataFrame | None = None) -> DataFrame:
    """absdiff and sqdiff per column, euclidean and manhattan over all; of ``pairs`` only, with their columns, where given."""
    d = [F.col(f"{c}_i") - F.col(f"{c}_j") for c in cols]
    if transform == "absdiff":
        made = [F.abs(x).alias(f"absdiff_{c}") for x, c in zip(d, cols, strict=True)]
    elif transform == "sqdiff":
        made = [(x * x).alias(f"sqdiff_{c}") for x, c in zip(d, cols, strict=True)]
    elif transform in ("euclidean", "manhattan"):
        total = F.lit(0.0)
        for x in d:
            total = total + (x * x if transform == "euclidean" else F.abs(x))
        made = [(F.sqrt(total) if transform == "euclidean" else total).alias(transform)]
    else:
        raise ValueError(transform)
    kept = [c for c in (pairs.columns if pairs is not None else []) if c not in ("i", "j")]
    return site_pairs(sites, cols, pairs).select("i", "j", *kept, *made)


def selected_pairs(pairs: DataFrame, chosen: DataFrame, refuse: bool = False) -> DataFrame:
    """Pairs named in ``chosen`` (a, b in either order). Pairs of equal ends or named twice are left out or, with ``refuse``, an error."""
    if refuse:
        named = chosen.groupBy(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j")).count()
        bad = named.where("i = j OR count > 1").orderBy("i", "j").limit(10).collect()
        if bad:
            raise ValueError(f"pairs of equal ends or named twice: {[(r.i, r.j) for r in bad]}")
    keys = chosen.where("a <> b").select(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j")).distinct()
    return pairs.join(keys, ["i", "j"], "left_semi")


def lower(matrix: DataFrame) -> DataFrame:
    """The lower triangle with its place in column-major order."""
    rows = matrix.where("i > j")
    before = F.sum("count").over(Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1))  # one row a column
    starts = rows.groupBy("j").count().select("j", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy("j").orderBy("i")))
    return ranked.join(starts, "j").select("i", "j", "value", (F.col("__before") + F.col("__k")).alias("k"))


def distance_from_covariance(cov: DataFrame) -> DataFrame:
    """i > j, value = C_ii + C_jj - 2 C_ij."""
    d = cov.where("i = j").select(F.col("i").alias("k"), F.col("value").alias("v"))
    di, dj = d.select(F.col("k").alias("i"), F.col("v").alias("vi")), d.select(F.col("k").alias("j"), F.col("v").alias("vj"))
    return cov.where("i > j").join(di, "i").join(dj, "j").select("i", "j", (F.col("vi") + F.col("vj") - 2 * F.col("value")).alias("value"))


def site_kernel(sites: DataFrame, col: str) -> DataFrame:
    """i, j, value: product of the centred, scaled covariate, over the mean of the diagonal."""
    z = standardized(sites.select("site", col), [col])
    a = z.select(F.col("site").alias("i"), F.col(col).alias("zi"))
    b = z.select(F.col("site").alias("j"), F.col(col).alias("zj"))
    raw = a.join(b, F.col("i") >= F.col("j")).select("i", "j", (F.col("zi") * F.col("zj")).alias("value"))
    one = F.broadcast(z.agg(F.avg(F.col(col) * F.col(col)).alias("__mean")))
    return raw.join(one).select("i", "j", (F.col("value") / F.col("__mean")).alias("value"))


def drift_design(sites: DataFrame, cols: list[str]) -> DataFrame:
    """site, one, and the standardised covariates."""
    return standardized(sites.select("site", *cols), cols).select("site", F.lit(1.0).alias("one"), *cols)
