"""Products with the sites' right-hand sides and with derivatives of the Laplacian; neither matrix is formed.

Column k of the right-hand side is -1 / n at every vertex, plus 1 at the vertex
of site k. Vertices are numbered from 1; the last is held at 0 and has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import laplacian_matvec, weighted_edges


def _baseline(rows: DataFrame, vertices: DataFrame, cols: list[str]) -> DataFrame:
    """One row: n and minus each column's sum over n."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"__s_{c}") for c in cols])
    one = sums.join(F.broadcast(vertices.agg(F.count("*").alias("__n"))))  # a global aggregate has exactly one row
    return F.broadcast(one.select("__n", *[(-F.col(f"__s_{c}") / F.col("__n")).alias(f"__b_{c}") for c in cols]))


def rhs_product(vertices: DataFrame, focal: DataFrame, m: DataFrame, cols: list[str]) -> DataFrame:
    """v and columns of right-hand side times ``m`` (site, columns); ``focal``: site, v. Sites may share a vertex."""
    own = focal.join(m, "site").groupBy("v").agg(*[F.sum(c).alias(c) for c in cols])
    wide = vertices.select("v").join(own, "v", "left").join(_baseline(m, vertices, cols))
    return wide.where(F.col("v") < F.col("__n")).select("v", *[(F.coalesce(c, F.lit(0.0)) + F.col(f"__b_{c}")).alias(c) for c in cols])


def rhs_crossprod(vertices: DataFrame, focal: DataFrame, x: DataFrame, cols: list[str]) -> DataFrame:
    """site and columns of the transposed right-hand side times ``x`` (v, columns); a row of the last vertex takes no part."""
    one = vertices.agg(F.max("v").alias("__last"))
    rows = x.join(F.broadcast(one), F.col("v") < F.col("__last")).select("v", *cols)
    wide = focal.select("site", "v").join(rows, "v", "left").join(_baseline(rows, vertices, cols))
    return wide.select("site", *[(F.coalesce(c, F.lit(0.0)) + F.col(f"__b_{c}")).alias(c) for c in cols])


def derivative_product(edges: DataFrame, dc: DataFrame, x: DataFrame, cols: list[str], ground: Column | int | None = None) -> DataFrame:
    """v and, per column, the Laplacian's derivative times ``x`` (v, columns).

    ``dc``: cell, dc, the conductances' derivative by one parameter. With
    ``ground``, x is 0 there and the row is left out.
    """
    if ground is not None:
        x = x.select("v", *[F.when(F.col("v") == ground, 0.0).otherwise(F.col(c)).alias(c) for c in cols])
    out = laplacian_matvec(weighted_edges(edges, dc, value="dc"), x, cols)
    return out if ground is None else out.where(F.col("v") != ground)
