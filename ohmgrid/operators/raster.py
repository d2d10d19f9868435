"""Operators on long rasters: one row a cell, one column a layer."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_present(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))


def mask_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cells with a value in every layer."""
    return df.where(all_present(cols))


def partly_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: cells in all, missing in all layers, and missing in some only."""
    none = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in cols))
    some = ~all_present(cols) & ~none
    return df.agg(F.count("*").alias("n_cells"), F.count(F.when(none, 1)).alias("n_missing"), F.count(F.when(some, 1)).alias("n_partly"))


def scale_covariates(df: DataFrame, cols: list[str], method: str | Callable[[str], tuple[Column, Column]] = "zscore") -> DataFrame:
    """Centre and scale layers; a zero scale counts as one. One global aggregate, joined as one row.

    ``method``: zscore, minmax, or a function from a layer to the aggregates of its centre and scale.
    """
    if callable(method):
        stats = [(a.alias(f"__c_{c}"), b.alias(f"__s_{c}")) for c in cols for a, b in [method(c)]]
    elif method not in ("zscore", "minmax"):
        raise ValueError(method)
    elif method == "zscore":
        stats = [(F.avg(c).alias(f"__c_{c}"), F.stddev_samp(c).alias(f"__s_{c}")) for c in cols]
    else:
        stats = [(F.min(c).alias(f"__c_{c}"), (F.max(c) - F.min(c)).alias(f"__s_{c}")) for c in cols]
    one = df.agg(*[x for pair in stats for x in pair])
    wide = df.join(F.broadcast(one))  # a global aggregate has exactly one row
    scale = {c: F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in cols}
    return wide.select(*[((F.col(c) - F.col(f"__c_{c}")) / scale[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def scale_to_0_1(df: DataFrame, cols: list[str]) -> DataFrame:
    """One range over all layers; a constant raster becomes 0."""
    low = F.least(*[F.min(c) for c in cols]) if len(cols) > 1 else F.min(cols[0])
    high = F.greatest(*[F.max(c) for c in cols]) if len(cols) > 1 else F.max(cols[0])
    one = F.broadcast(df.agg(low.alias("__low"), high.alias("__high")))
    span = F.col("__high") - F.col("__low")
    wide = df.join(one)
    return wide.select(*[F.when(F.col(c).isNotNull(), F.when(span == 0, 0.0).otherwise((F.col(c) - F.col("__low")) / span)).alias(c) if c in cols else F.col(c) for c in df.columns])


def crop_to_focal_buffer(df: DataFrame, sites: DataFrame, buffer: float | tuple[float, float], resolution: float = 1.0) -> DataFrame:
    """Cells within the sites' bounding box, widened by ``buffer`` and half a cell. Columns row and col."""
    by, bx = (buffer, buffer) if isinstance(buffer, int | float) else buffer
    if by < 0 or bx < 0:
        raise ValueError("the buffer must not be negative")
    box = F.broadcast(sites.agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1")))
    half = resolution / 2
    inside = F.col("row").between(F.col("__r0") - by - half, F.col("__r1") + by + half) & F.col("col").between(F.col("__c0") - bx - half, F.col("__c1") + bx + half)
    return df.join(box, inside).select(*df.columns)


def coarsen(df: DataFrame, cols: list[str], factor: int, aggregate: Callable[[str], Column] = F.avg) -> DataFrame:
    """Mean, or another aggregate, of the present values in blocks of ``factor`` cells on a side."""
    return df.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(*[aggregate(c).alias(c) for c in cols])


def sample_points(df: DataFrame, sites: DataFrame, cols: list[str]) -> DataFrame:
    """Layer values at the sites' cells; null where the cell is missing."""
    return sites.join(df.select("cell", *cols), "cell", "left").select("site", "cell", *cols)


def clamp_to_focal(df: DataFrame, sites: DataFrame, cols: list[str], probs: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Limit layers to exact quantiles over the sites' cells."""
    focal = sites.select("cell").join(df.select("cell", *cols), "cell")
    one = F.broadcast(focal.agg(*[F.percentile(c, F.lit(p)).alias(f"__{c}_{k}") for c in cols for k, p in enumerate(probs)]))
    wide = df.join(one)

    def within(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}_0")), F.col(f"__{c}_1"))).alias(c)

    return wide.select(*[within(c) if c in cols else F.col(c) for c in df.columns])


def smooth_gaussian(df: DataFrame, layer: str, sigma: float, reach: int) -> DataFrame:
    """Normalised Gaussian mean of the present cells within ``reach`` rows and columns.

    The kernel is separable: a pass along columns, then one along rows. Each
    spreads a cell to its 2 reach + 1 neighbours and sums by cell, so no group
    grows with the raster.
    """
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(math.exp(-d * d / (2 * sigma * sigma)))).alias("k")) for d in range(-reach, reach + 1)])

    def spread(rows: DataFrame, axis: str) -> DataFrame:
        e = rows.withColumn("__o", F.explode(offsets)).withColumn(axis, F.col(axis) + F.col("__o.d"))
        return e.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("__o.k")).alias("v"), F.sum(F.col("w") * F.col("__o.k")).alias("w"))

    start = df.where(F.col(layer).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(layer).alias("v"), F.lit(1.0).alias("w"))
    done = spread(spread(start, "col"), "row")
    return df.join(done, ["row", "col"], "left").select(*df.columns, (F.col("v") / F.col("w")).alias("smooth"))
