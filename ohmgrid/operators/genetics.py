"""Genetic covariances and distances from long tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centroids(features: DataFrame) -> DataFrame:
    """grp, feature, mean."""
    return features.groupBy("grp", "feature").agg(F.avg("value").alias("mean"))


def centroid_distance(features: DataFrame) -> DataFrame:
    """i > j (groups) and the squared distance of their centroids."""
    c = centroids(features)
    a = c.select(F.col("grp").alias("i"), "feature", F.col("mean").alias("mi"))
    b = c.select(F.col("grp").alias("j"), "feature", F.col("mean").alias("mj"))
    joined = a.join(b, "feature").where("i > j")
    return joined.groupBy("i", "j").agg(F.sum((F.col("mi") - F.col("mj")) * (F.col("mi") - F.col("mj"))).alias("value"))


def gower(distance: DataFrame) -> DataFrame:
    """i, j, value = -1/2 (d - row mean - column mean + grand mean) over all pairs, both ways."""
    ids = distance.select("i").union(distance.select("j")).distinct()
    full = distance.unionByName(distance.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("value")))
    row, col, everything = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy()
    m = F.col("value") - F.avg("value").over(row) - F.avg("value").over(col) + F.avg("value").over(everything)
    return full.select("i", "j", (-m / 2).alias("value"))


def within_variance(features: DataFrame) -> DataFrame:
    """grp and its sample variances summed over features."""
    return features.groupBy("grp", "feature").agg(F.var_samp("value").alias("v")).groupBy("grp").agg(F.sum("v").alias("value"))


def scaled_features(features: DataFrame) -> DataFrame:
    """Features centred and scaled over all units; constant ones are dropped."""
    stats = features.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s")).where("__s > 0")
    return features.join(stats, "feature").select("unit", "grp", "feature", ((F.col("value") - F.col("__m")) / F.col("__s")).alias("value"))


def covariance_from_features(features: DataFrame, scale: bool = True) -> DataFrame:
    """Population covariance per feature: Gower's off the diagonal, within-group variance on it."""
    rows = scaled_features(features) if scale else features
    n = rows.select("feature").distinct().agg(F.count("*").alias("__n"))
    off = gower(centroid_distance(rows)).where("i <> j")
    on = within_variance(rows).select(F.col("grp").alias("i"), F.col("grp").alias("j"), "value")
    return off.unionByName(on).join(F.broadcast(n)).select("i", "j", (F.col("value") / F.col("__n")).alias("value"))


def allele_dosage(calls: DataFrame) -> DataFrame:
    """unit, locus, allele, dosage from calls (unit, locus, allele); null alleles take the locus's most frequent one.

    Of equally frequent alleles the smallest counts.
    """
    seen = calls.where("allele is not null").groupBy("locus", "allele").count()
    modal = seen.groupBy("locus").agg(F.min_by("allele", F.struct(-F.col("count"), "allele")).alias("__modal"))
    full = calls.join(modal, "locus").withColumn("allele", F.coalesce("allele", "__modal"))
    return full.groupBy("unit", "locus", "allele").agg(F.count("*").alias("dosage"))


def biallelic_covariance(counts: DataFrame, n: int = 2) -> DataFrame:
    """pop_i, pop_j, value: n G G' / L, G = (f - p) / sqrt(p (1 - p)); counts (pop, locus, y) out of uniform ``n``.

    Loci with one allele only are dropped.
    """
    f = counts.withColumn("f", F.col("y") / n)
    p = f.groupBy("locus").agg(F.avg("f").alias("p")).where((F.col("p") > 0) & (F.col("p") < 1))
    g = f.join(p, "locus").select("pop", "locus", ((F.col("f") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")))).alias("g"))
    loci = F.broadcast(p.agg(F.count("*").alias("__l")))
    a, b = g.select(F.col("pop").alias("i"), "locus", F.col("g").alias("gi")), g.select(F.col("pop").alias("j"), "locus", F.col("g").alias("gj"))
    sums = a.join(b, "locus").where("i >= j").groupBy("i", "j").agg(F.sum(F.col("gi") * F.col("gj")).alias("s"))
    return sums.join(loci).select("i", "j", (F.col("s") * n / F.col("__l")).alias("value"))


def pca_distance(features: DataFrame, axes: int = 64) -> DataFrame:
    """i > j and Euclidean distances on the leading axes, scaled to 0..1 over all pairs.

    The units' Gram matrix comes from a join by feature; its eigenvectors are
    taken on the driver, so the number of units is that of sites.
    """
    mean = features.groupBy("feature").agg(F.avg("value").alias("__m"))
    c = features.join(mean, "feature").select("unit", "feature", (F.col("value") - F.col("__m")).alias("v"))
    a, b = c.select(F.col("unit").alias("i"), "feature", F.col("v").alias("vi")), c.select(F.col("unit").alias("j"), "feature", F.col("v").alias("vj"))
    gram = a.join(b, "feature").where("i >= j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("s")).collect()
    ids = sorted({r["i"] for r in gram})
    at = {u: k for k, u in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in gram:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["s"]
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[:axes]
    x = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    low = d[np.tril_indices(len(ids), -1)]
    span = low.max() - low.min() if len(low) else 0.0
    rows = [(int(ids[i]), int(ids[j]), float((d[i, j] - low.min()) / span) if span else 0.0) for i in range(len(ids)) for j in range(i)]
    return features.sparkSession.createDataFrame(rows, "i long, j long, value double")
