"""Tiled elimination, conjugate gradients and components as DataFrame programs, against numpy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgrid.functions import likelihood, solve
from ohmgrid.operators import conductance as C
from ohmgrid.operators import graph as G
from ohmgrid.operators import solve as S


def cells(spark, rows, cols, hole=None):
    data = [(r * cols + c, r, c, 0.1 * ((7 * r + 3 * c) % 11)) for r in range(rows) for c in range(cols) if hole is None or not hole(r, c)]
    return spark.createDataFrame(data, "cell long, row long, col long, x double")


@pytest.mark.parametrize("dense", [20, 5000])
def test_tiled_resistance(spark, dense):
    a = cells(spark, 9, 10)
    w = G.weighted_edges(G.grid_edges(a, 8), C.loglinear(a, [0.5], ["x"]))
    sites = spark.createDataFrame([(0, 3), (1, 47), (2, 88)], "site long, cell long")
    got = {(r.i, r.j): r.resistance for r in S.resistance_distance(w, sites, a, one_task=0, tile=3, dense=dense).collect()}
    e = w.toPandas()
    q = solve.dense_laplacian(90, e["i"].to_numpy(), e["j"].to_numpy(), e["w"].to_numpy())
    r = likelihood.resistance(np.linalg.pinv(q)[np.ix_([3, 47, 88], [3, 47, 88])])
    assert len(got) == 3 and all(np.isclose(v, r[i, j]) for (i, j), v in got.items())


def test_pcg(spark):
    a = cells(spark, 4, 4)
    w = G.weighted_edges(G.grid_edges(a, 4), C.loglinear(a, [0.5], ["x"]))
    b = a.select(F.col("cell").alias("v"), (F.col("cell") % 3 - 1).cast("double").alias("b"))
    got = {r.v: r.x for r in S.pcg(w, b, ground=15, steps=30).collect()}
    e = w.toPandas()
    q = solve.dense_laplacian(16, e["i"].to_numpy(), e["j"].to_numpy(), e["w"].to_numpy())[:15, :15]
    x = np.linalg.solve(q, [float(v % 3 - 1) for v in range(15)])
    assert np.allclose([got[v] for v in range(15)], x, atol=1e-6)


def test_components_and_errors(spark):
    a = cells(spark, 5, 6, hole=lambda r, c: c == 4)
    found = G.components(a, G.grid_edges(a, 8)).groupBy("comp").count().collect()
    assert sorted(r["count"] for r in found) == [5, 20]
    assert G.largest_component(a, G.grid_edges(a, 8)).count() == 20
    with pytest.raises(ValueError):
        G.grid_edges(a, 6)
    empty = a.where("false")
    assert G.components(empty, G.grid_edges(empty, 8)).count() == 0


@pytest.mark.parametrize("tile", [2, 3, 100])
def test_components_by_tiles(spark, tile):
    a = cells(spark, 9, 11, hole=lambda r, c: (r * 7 + c * 5) % 3 == 0 or c == 6)
    e = G.grid_edges(a, 4)
    got = sorted(map(tuple, G.grid_components(a, e, tile).collect()))
    assert got == sorted(map(tuple, G.components(a, e).collect())) and len({c for _, c in got}) > 2
    empty = a.where("false")
    assert G.grid_components(empty, G.grid_edges(empty, 4), tile).count() == 0


def test_components_of_the_whole_raster(spark):
    from ohmgrid.plans.queries import QUERIES

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    parts = [r.p_partkey for r in spark.read.parquet(f"{data}/part.parquet").select("p_partkey").collect()]
    root = {c: c for c in parts if c % 17 and c % 40 != 37}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for c in root:
        for down, right in ((0, 1), (1, -1), (1, 0), (1, 1)):
            near = c + 40 * down + right
            if near in root and near // 40 == c // 40 + down:
                low, high = sorted((find(c), find(near)))
                root[high] = low
    got = [(r.cell, r.comp) for r in QUERIES["connected_components"](spark, data).collect()]
    assert len(got) == len(root) > 1500 and dict(got) == {c: find(c) for c in root}


@pytest.mark.parametrize("one_task", [0, 10**7])
def test_resistance_without_a_path(spark, one_task):
    cells = spark.createDataFrame([(k, k // 4, k % 4) for k in range(16) if k % 4 != 2], "cell long, row long, col long")
    edges = G.grid_edges(cells, 4)
    w = edges.withColumn("w", F.lit(2.0))
    sites = spark.createDataFrame([(0, 0), (1, 4), (2, 3), (3, 15)], "site long, cell long")
    got = {(r.i, r.j): r.resistance for r in S.resistance_distance(w, sites, cells, one_task=one_task).collect()}
    assert all(math.isinf(got[i, j]) for i, j in ((2, 0), (2, 1), (3, 0), (3, 1))) and math.isclose(got[3, 2], 1.5) and 0 < got[1, 0] < 0.5
    with pytest.raises(ValueError, match="missing cell"):
        S.resistance_distance(w, sites.union(spark.createDataFrame([(9, 2)], sites.schema)), cells, one_task=one_task)


def test_more_sites_than_one_task_eliminates(spark):
    a = spark.createDataFrame([(k, k // 6, k % 6) for k in range(24)], "cell long, row long, col long")
    w = G.grid_edges(a, 8).withColumn("w", 1.0 + F.col("i") % 3)
    sites = spark.createDataFrame([(s, c) for s, c in enumerate([0, 5, 9, 14, 18, 23])], "site long, cell long")
    few = {(r.i, r.j): r.value for r in S.kron_reduce(w, sites, a, tile=3, dense=4).collect()}
    one = {(r.i, r.j): r.value for r in S.kron_reduce(w, sites, a, tile=3).collect()}
    assert few.keys() == one.keys() and all(math.isclose(few[k], one[k], rel_tol=1e-9) for k in one)


def test_landscape_of_the_largest_component(spark):
    a = cells(spark, 4, 7, hole=lambda r, c: c == 4)
    sites = spark.createDataFrame([(0, 0), (1, 24)], "site long, cell long")
    land = S.landscape(a, G.grid_edges(a, 8), sites, ["x"])
    assert land.n == 16 and len(land.i) == 42 and land.focal.tolist() == [0, 15]
    with pytest.raises(ValueError, match="largest component"):
        S.landscape(a, G.grid_edges(a, 8), sites.union(spark.createDataFrame([(2, 6)], sites.schema)), ["x"])
