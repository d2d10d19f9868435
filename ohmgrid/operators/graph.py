"""Grid graphs: vertices, edges, Laplacians, components, tiles and directed edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.solve import component_labels

#: Cells that one block of the vertex numbering spans.
BLOCK = 1 << 16


def vertices(active: DataFrame) -> DataFrame:
    """Add v: 1-based rank by cell.

    Ranks run within blocks of cells; a running sum over the blocks' sizes (one
    row a block) moves them. No window holds more than a block of cells.
    """
    blocks = active.groupBy(F.floor(F.col("cell") / BLOCK).alias("__b")).count()
    before = F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("__b", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = active.withColumn("__b", F.floor(F.col("cell") / BLOCK)).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("cell")))
    return ranked.join(starts, "__b").select(*active.columns, (F.col("__before") + F.col("__r")).alias("v"))


def grid_edges(active: DataFrame, directions: int = 8) -> DataFrame:
    """i < j (cells) of neighbouring active cells; every edge once, by forward offsets and an equality join."""
    if directions not in (4, 8):
        raise ValueError("directions must be 4 or 8")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if directions == 8 else [])
    ahead = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    a = active.select(F.col("cell").alias("i"), "row", "col").withColumn("__s", ahead)
    a = a.select("i", (F.col("row") + F.col("__s.r")).alias("row"), (F.col("col") + F.col("__s.c")).alias("col"))
    return a.join(active.select("row", "col", F.col("cell").alias("j")), ["row", "col"]).select("i", "j")


def weighted_edges(edges: DataFrame, conductance: DataFrame, key: str = "cell", value: str = "c") -> DataFrame:
    """i, j, w: the sum of the conductances at both ends."""
    ci = conductance.select(F.col(key).alias("i"), F.col(value).alias("__ci"))
    cj = conductance.select(F.col(key).alias("j"), F.col(value).alias("__cj"))
    return edges.join(ci, "i").join(cj, "j").select("i", "j", (F.col("__ci") + F.col("__cj")).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: a, b and the other columns."""
    rest = [c for c in edges.columns if c not in ("i", "j")]
    there = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), *rest)
    return there.unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b"), *rest))


def laplacian_degree(weighted: DataFrame) -> DataFrame:
    return both_ways(weighted).groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("degree"))


def laplacian_coo(weighted: DataFrame, ground: Column | int | None = None) -> DataFrame:
    """i, j, value of the Laplacian, without the row and column of ``ground``."""
    both = both_ways(weighted)
    out = both.select(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("w")).alias("value"))
    out = out.unionByName(both.groupBy(F.col("a").alias("i")).agg(F.sum("w").alias("value")).select("i", F.col("i").alias("j"), "value"))
    return out if ground is None else out.where((F.col("i") != ground) & (F.col("j") != ground))


def laplacian_matvec(weighted: DataFrame, x: DataFrame, cols: list[str]) -> DataFrame:
    """v and, per column, the sum over its edges of w (x_v - x_neighbour)."""
    both = both_ways(weighted)
    at_a = x.select(F.col("v").alias("a"), *[F.col(c).alias(f"__a_{c}") for c in cols])
    at_b = x.select(F.col("v").alias("b"), *[F.col(c).alias(f"__b_{c}") for c in cols])
    wide = both.join(at_a, "a").join(at_b, "b")
    return wide.groupBy(F.col("a").alias("v")).agg(*[F.sum(F.col("w") * (F.col(f"__a_{c}") - F.col(f"__b_{c}"))).alias(c) for c in cols])


def adjoint(edges: DataFrame, g: DataFrame, de: list[list[float]], cols: list[str]) -> DataFrame:
    """v, dc: gradient by conductance, from the gradient ``de`` by focal covariance.

    ``g``: v and one solution column per site. Per edge, minus the quadratic
    form of the difference of the two solution rows; each edge adds it to both ends.
    """
    at_i = g.select(F.col("v").alias("i"), *[F.col(c).alias(f"__i_{c}") for c in cols])
    at_j = g.select(F.col("v").alias("j"), *[F.col(c).alias(f"__j_{c}") for c in cols])
    d = [F.col(f"__i_{c}") - F.col(f"__j_{c}") for c in cols]
    total = F.lit(0.0)
    for a in range(len(cols)):
        for b in range(len(cols)):
            if de[a][b]:
                total = total - d[a] * d[b] * F.lit(float(de[a][b]))
    per = edges.join(at_i, "i").join(at_j, "j").select("i", "j", total.alias("w"))
    return both_ways(per).groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("dc"))


def components(nodes: DataFrame, edges: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, comp (smallest cell reachable), by star contraction on checkpointed edge tables.

    The number of rounds grows with the logarithm of a component's size.
    """
    work = edges.select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct()
    last = None
    while True:
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        work = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        work = checkpointed(work)
        now = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    return nodes.select(F.col(cell).alias("a")).join(work, "a", "left").select(F.col("a").alias(cell), F.coalesce("b", "a").alias("comp"))


def grid_components(active: DataFrame, edges: DataFrame, tile: int = 256) -> DataFrame:
    """cell, comp as ``components`` gives them, for vertices with row and col.

    Square tiles are labelled in one task each (at most ``tile`` squared cells);
    only the labels that edges between tiles join go through star contraction.
    """
    square = (F.floor(F.col("row") / tile) * F.lit(1 << 31) + F.floor(F.col("col") / tile)).cast("long")
    at = active.select(F.col("cell").cast("long").alias("cell"), square.alias("tile"))
    ends = [at.select(F.col("cell").alias(c), F.col("tile").alias(f"t{c}")) for c in "ij"]
    tiled = edges.select("i", "j").join(ends[0], "i").join(ends[1], "j")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        return pd.DataFrame({"cell": ids, "part": ids[component_labels(len(ids), code[: len(pdf)], code[len(pdf) :])]})

    inside = tiled.where("ti = tj").select("ti", "i", "j").groupBy("ti").applyInPandas(label, "cell long, part long")
    parts = checkpointed(at.select("cell").join(inside, "cell", "left").select("cell", F.coalesce("part", "cell").alias("part")))
    ends = [parts.select(F.col("cell").alias(c), F.col("part").alias(f"p{c}")) for c in "ij"]
    across = tiled.where("ti <> tj").join(ends[0], "i").join(ends[1], "j").select(F.col("pi").alias("i"), F.col("pj").alias("j")).distinct()
    whole = components(parts.select("part").distinct(), checkpointed(across), "part")
    return parts.join(whole, "part").select("cell", "comp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder; a temporary one only where none is set and the master is local."""
    import tempfile

    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ohmgrid-"))
    return df.checkpoint()


def largest_component(active: DataFrame, edges: DataFrame) -> DataFrame:
    """Active cells of the component with most cells; of equal ones, the one with the smallest cell."""
    comp = grid_components(active, edges)
    best = comp.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1)
    return active.join(comp.join(F.broadcast(best.select("comp")), "comp").select("cell"), "cell")


def tiles(active: DataFrame, n: int) -> DataFrame:
    """Add tile: quantile bins of row and col, ``n`` along each axis."""
    probs = [k / n for k in range(1, n)]
    one = F.broadcast(active.agg(F.percentile("row", F.array(*map(F.lit, probs))).alias("__r"), F.percentile("col", F.array(*map(F.lit, probs))).alias("__c")))
    rank = lambda c, cuts: F.size(F.filter(F.col(cuts), lambda q: F.col(c) > q))
    return active.join(one).select(*active.columns, (rank("row", "__r") * n + rank("col", "__c")).cast("long").alias("tile"))


def separators(edges: DataFrame, tiled: DataFrame) -> DataFrame:
    """Cells with a neighbour in another tile."""
    ti = tiled.select(F.col("cell").alias("i"), F.col("tile").alias("__ti"))
    tj = tiled.select(F.col("cell").alias("j"), F.col("tile").alias("__tj"))
    cross = edges.join(ti, "i").join(tj, "j").where("__ti <> __tj")
    return both_ways(cross.select("i", "j")).select(F.col("a").alias("cell")).distinct()


def field_bins(active: DataFrame, size: int) -> DataFrame:
    """Add the coarse field's bin of each cell (fr, fc)."""
    return active.withColumns({"fr": F.floor(F.col("row") / size), "fc": F.floor(F.col("col") / size)})


def field_precision(binned: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Precision D - A + ridge I over occupied bins: ar, ac, br, bc, q. Neighbours by equality joins."""
    bins = binned.select("fr", "fc").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    a = bins.select(F.col("fr").alias("ar"), F.col("fc").alias("ac")).withColumn("s", steps)
    a = a.select("ar", "ac", (F.col("ar") + F.col("s.r")).alias("br"), (F.col("ac") + F.col("s.c")).alias("bc"))
    near = a.join(bins.select(F.col("fr").alias("br"), F.col("fc").alias("bc")), ["br", "bc"]).select("ar", "ac", "br", "bc", F.lit(-1.0).alias("q"))
    degree = near.groupBy("ar", "ac").agg((F.count("*") + ridge).alias("q"))
    alone = bins.select(F.col("fr").alias("ar"), F.col("fc").alias("ac")).join(degree, ["ar", "ac"], "left")
    diagonal = alone.select("ar", "ac", F.col("ar").alias("br"), F.col("ac").alias("bc"), F.coalesce("q", F.lit(ridge)).alias("q"))
    return near.unionByName(diagonal)


def edge_gradient(edges: DataFrame, df: DataFrame, layer: str) -> DataFrame:
    """a, b, d = x_a - x_b over directed edges, both ways."""
    xa = df.select(F.col("cell").alias("a"), F.col(layer).alias("__xa"))
    xb = df.select(F.col("cell").alias("b"), F.col(layer).alias("__xb"))
    return both_ways(edges).join(xa, "a").join(xb, "b").select("a", "b", (F.col("__xa") - F.col("__xb")).alias("d"))


def directed_generator(gradient: DataFrame, eta: DataFrame, gamma: float) -> DataFrame:
    """a, b, rate = exp((eta_a + eta_b) / 2 + gamma d)."""
    ea = eta.select(F.col("cell").alias("a"), F.col("eta").alias("__ea"))
    eb = eta.select(F.col("cell").alias("b"), F.col("eta").alias("__eb"))
    wide = gradient.join(ea, "a").join(eb, "b")
    return wide.select("a", "b", "d", F.exp((F.col("__ea") + F.col("__eb")) / 2 + F.col("d") * gamma).alias("rate"))


def directed_rates(generator: DataFrame, se: float | None = None, level: float = 0.95) -> DataFrame:
    """Per undirected edge (a < b): both rates, means, log ratio, favoured direction and a delta-method test.

    ``se``: standard error of gamma; the log ratio is 2 gamma d.
    """
    from statistics import NormalDist

    back = generator.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rate").alias("rate_ba"))
    rows = generator.where("a < b").select("a", "b", "d", F.col("rate").alias("rate_ab")).join(back, ["a", "b"])
    ratio = F.log(F.col("rate_ab")) - F.log(F.col("rate_ba"))
    rows = rows.select("*", F.sqrt(F.col("rate_ab") * F.col("rate_ba")).alias("geometric"), ((F.col("rate_ab") + F.col("rate_ba")) / 2).alias("arithmetic"), ratio.alias("log_ratio"))
    rows = rows.withColumn("favored", F.when(F.col("log_ratio") > 0, "ab").when(F.col("log_ratio") < 0, "ba").otherwise("none"))
    if se is None:
        return rows
    z = F.when(F.col("d") != 0, F.col("log_ratio") / F.abs(2 * F.col("d") * se))
    limit = NormalDist().inv_cdf((1 + level) / 2)
    return rows.withColumn("se", F.abs(2 * F.col("d") * se)).withColumn("z", z).withColumn("significant", F.coalesce(F.abs(z) > limit, F.lit(False)))
