"""From rasters, points and level tables to a numbered graph with sites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, raster


@dataclass(frozen=True)
class Surface:
    """vertices: v, cell, row, col, layers; edges: i < j by vertex number; sites: site, v."""

    vertices: DataFrame
    edges: DataFrame
    sites: DataFrame


def site_vertices(sites: DataFrame, vertices: DataFrame) -> DataFrame:
    """site, v; a site (column cell) that is no vertex raises ``ValueError``."""
    bad = [r[0] for r in sites.join(vertices.select("cell"), "cell", "left_anti").select("site").orderBy("site").limit(10).collect()]
    if bad:
        raise ValueError(f"sites outside the largest component or on a missing cell: {bad}")
    return sites.join(vertices.select("cell", "v"), "cell").select("site", "v")


def conductance_surface(df: DataFrame, layers: list[str], sites: DataFrame, directions: int = 8) -> Surface:
    """Cells with all layers, of the largest component, numbered; their edges; the sites' vertices."""
    active = raster.mask_missing(df, layers)
    edges = graph.grid_edges(active, directions)
    kept = graph.checkpointed(graph.vertices(graph.largest_component(active, edges)))
    ends = [kept.select(F.col("cell").alias(c), F.col("v").alias(f"__{c}")) for c in "ij"]
    numbered = edges.join(ends[0], "i").join(ends[1], "j").select(F.least("__i", "__j").alias("i"), F.greatest("__i", "__j").alias("j"))
    return Surface(kept.select("v", "cell", "row", "col", *layers), numbered, site_vertices(sites, kept))


def coordinates(points: DataFrame) -> DataFrame:
    """x and y as doubles, then the other columns; without columns of these names, the first two are taken."""
    if len(points.columns) < 2:
        raise ValueError("points need at least two columns")
    x, y = ("x", "y") if {"x", "y"} <= set(points.columns) else points.columns[:2]
    rest = [c for c in points.columns if c not in (x, y)]
    return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *rest)


def locate(points: DataFrame, left: float, top: float, rows: int, cols: int, resolution: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Add row and col of the cell below each point, null outside; the outer edges belong to the last cells."""
    at = {"row": ((F.lit(float(top)) - F.col("y")) / resolution[0], rows), "col": ((F.col("x") - float(left)) / resolution[1], cols)}
    inside = reduce(lambda a, b: a & b, ((d >= 0) & (d <= n) for d, n in at.values()))
    return points.withColumns({c: F.when(inside, F.least(F.floor(d), F.lit(n - 1)).cast("long")) for c, (d, n) in at.items()})


def sample_coordinates(df: DataFrame, located: DataFrame, layers: list[str]) -> DataFrame:
    """The points with the layers' values; null outside and on missing cells."""
    return located.join(df.select("row", "col", *layers), ["row", "col"], "left").select(*located.columns, *layers)


def level_labels(levels: DataFrame) -> DataFrame:
    """ID and label of a level table: column VALUE, else the first one that is not ID."""
    named = "VALUE" if "VALUE" in levels.columns else next(c for c in levels.columns if c != "ID")
    return levels.select("ID", F.col(named).cast("string").alias("label"))


def decode_levels(df: DataFrame, layer: str, levels: DataFrame) -> DataFrame:
    """The layer's codes replaced by their labels; unknown codes are null."""
    labels = level_labels(levels).select(F.col("ID").alias("__id"), F.col("label").alias("__label"))
    wide = df.join(labels, F.col(layer) == F.col("__id"), "left")
    return wide.select(*[F.col("__label").alias(c) if c == layer else F.col(c) for c in df.columns])


def coarse_stages(df: DataFrame, layers: list[str], sites: DataFrame, factors: list[int], directions: int = 8, aggregate: Callable[[str], Column] = F.avg) -> dict[int, Surface]:
    """A surface for each factor above 1, the largest first; ``sites``: site, row, col. Sites may share a coarse cell."""
    stages = {}
    for f in sorted({f for f in factors if f > 1}, reverse=True):
        coarse = raster.coarsen(df, layers, f, aggregate).withColumn("cell", F.col("row") * F.lit(1 << 31) + F.col("col"))
        at = sites.select("site", (F.floor(F.col("row") / f) * F.lit(1 << 31) + F.floor(F.col("col") / f)).alias("cell"))
        stages[f] = conductance_surface(coarse, layers, at, directions)
    return stages


def stage_summary(stages: dict[int, Surface]) -> DataFrame:
    """factor, coarse_vertices, unique_sites and duplicate_sites of each stage."""
    parts = []
    for f, s in stages.items():
        n = s.vertices.agg(F.lit(f).cast("long").alias("factor"), F.count("*").alias("coarse_vertices"))
        m = s.sites.agg(F.countDistinct("v").alias("unique_sites"), (F.count("*") - F.countDistinct("v")).alias("duplicate_sites"))
        parts.append(n.join(F.broadcast(m)))
    return reduce(DataFrame.unionByName, parts)
