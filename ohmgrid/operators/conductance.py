"""Conductance models: design columns and parameters to one positive value per cell."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_predictor(theta: list[float], cols: list[str]) -> Column:
    total = F.lit(0.0)
    for t, c in zip(theta, cols, strict=True):
        total = total + F.lit(float(t)) * F.col(c)
    return total


def loglinear(df: DataFrame, theta: list[float], cols: list[str]) -> DataFrame:
    """Add c = exp(X theta)."""
    return df.withColumn("c", F.exp(linear_predictor(theta, cols)))


def linear(df: DataFrame, theta: list[float], cols: list[str]) -> DataFrame:
    """Add c = X theta; a value that is not positive fails the query."""
    c = linear_predictor(theta, cols)
    return df.withColumn("c", F.when(c > 0, c).otherwise(F.raise_error(F.lit("conductance must be positive")).cast("double")))


def derivatives(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add dc_k = c x_k of the log-linear model."""
    return df.withColumns({f"dc_{x}": F.col("c") * F.col(x) for x in cols})


def second_derivatives(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ddc_k_l = c x_k x_l of the log-linear model, for every k up to l."""
    return df.withColumns({f"ddc_{x}_{z}": F.col("c") * F.col(x) * F.col(z) for k, x in enumerate(cols) for z in cols[k:]})


def interval(df: DataFrame, theta: list[float], cols: list[str], cov: list[list[float]], level: float = 0.95) -> DataFrame:
    """Add est, lower and upper of the log-linear model, from the parameters' covariance."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    quad = F.lit(0.0)
    for a, ca in enumerate(cols):
        for b, cb in enumerate(cols):
            quad = quad + F.col(ca) * F.col(cb) * float(cov[a][b])
    eta, half = linear_predictor(theta, cols), F.sqrt(F.greatest(quad, F.lit(0.0))) * z
    return df.withColumns({"est": F.exp(eta), "lower": F.exp(eta - half), "upper": F.exp(eta + half)})


def on_raster(cells: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """Values back on all cells; null where a cell is inactive."""
    return cells.select("cell", "row", "col").join(values.select("cell", *cols), "cell", "left")


def scale_summary(sigma: float, probabilities: list[float], resolution: float = 1.0) -> list[tuple[float, float, float, float]]:
    """(probability, axis distance, radial distance, radial cells) of a Gaussian kernel."""
    import math

    out = []
    for p in probabilities:
        radial = math.sqrt(-2 * math.log(1 - p)) * sigma
        out.append((p, NormalDist().inv_cdf((1 + p) / 2) * sigma, radial, radial / resolution))
    return out
