"""Surfaces, points, products, derivatives and likelihoods on chosen pairs, against small dense computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgrid.functions.derivative import as_column, derive, parse
from ohmgrid.operators import graph as G
from ohmgrid.operators import pairs as P
from ohmgrid.operators import products as M
from ohmgrid.operators import solve as S
from ohmgrid.operators import surface as U
from ohmgrid.operators import tables as T


def test_products_equal_the_matrices(spark):
    n, at = 5, {7: 2, 8: 5, 9: 2}
    z = np.full((n, 3), -1 / n)
    for k, v in enumerate(at.values()):
        z[v - 1, k] += 1
    z = z[:-1]
    vertices = spark.createDataFrame([(v,) for v in range(1, n + 1)], "v long")
    focal = spark.createDataFrame(list(at.items()), "site long, v long")
    m = spark.createDataFrame([(7, 1.0), (8, 2.5), (9, -4.0)], "site long, a double")
    got = {r.v: r.a for r in M.rhs_product(vertices, focal, m, ["a"]).collect()}
    assert np.allclose([got[v] for v in range(1, n)], z @ [1.0, 2.5, -4.0]) and len(got) == n - 1
    x = spark.createDataFrame([(v, float(v * v)) for v in range(1, n + 1)], "v long, a double")
    got = {r.site: r.a for r in M.rhs_crossprod(vertices, focal, x, ["a"]).collect()}
    assert np.allclose([got[s] for s in at], z.T @ [1.0, 4.0, 9.0, 16.0])


def test_surface_leaves_the_smaller_part_out(spark):
    rows = [(r * 4 + c, r, c, 1.0 if c != 1 else None) for r in range(3) for c in range(4)]
    df = spark.createDataFrame(rows, "cell long, row long, col long, x double")
    s = U.conductance_surface(df, ["x"], spark.createDataFrame([(1, 11)], "site long, cell long"), 4)
    assert [(r.v, r.cell) for r in s.vertices.orderBy("v").collect()] == [(1, 2), (2, 3), (3, 6), (4, 7), (5, 10), (6, 11)]
    assert sorted((r.i, r.j) for r in s.edges.collect()) == [(1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 6), (5, 6)]
    assert [tuple(r) for r in s.sites.collect()] == [(1, 6)]
    for cell in (0, 1):
        with pytest.raises(ValueError, match="sites outside"):
            U.conductance_surface(df, ["x"], spark.createDataFrame([(1, cell)], "site long, cell long"), 4)


def test_coordinates_and_edges(spark):
    p = U.coordinates(spark.createDataFrame([(0.0, 2.0, "a"), (2.0, 0.0, "b"), (2.1, 1.0, "c"), (None, 1.0, "d")], "lon double, lat double, n string"))
    got = {r.n: (r.row, r.col) for r in U.locate(p, 0, 2, 2, 2).collect()}
    assert got == {"a": (0, 0), "b": (1, 1), "c": (None, None), "d": (None, None)}
    named = U.coordinates(spark.createDataFrame([("q", 1.0, 2.0)], "n string, y double, x double"))
    assert named.columns == ["x", "y", "n"] and named.first().x == 2.0
    with pytest.raises(ValueError, match="two columns"):
        U.coordinates(named.select("x"))


def test_levels_prefer_value(spark):
    levels = spark.createDataFrame([(1, "one", "eins")], "ID int, name string, VALUE string")
    assert [r.label for r in U.level_labels(levels).collect()] == ["eins"]
    assert [r.label for r in U.level_labels(levels.drop("VALUE")).collect()] == ["one"]
    assert [r.k for r in U.decode_levels(spark.createDataFrame([(2,), (None,)], "k int"), "k", levels).collect()] == [None, None]


@pytest.mark.parametrize("term", ["x", "I(x^3)", "x:z", "exp(x * z) / z", "log(x^2 + z)", "sqrt(x) - x / z", "x^z", "2^x", "-x * 3"])
def test_derivatives_equal_differences(spark, term):
    points = [(1.3, 0.7), (2.0, 1.5)]

    def values(node, pts):
        return [r[0] for r in spark.createDataFrame(pts, "x double, z double").coalesce(1).select(as_column(node)).collect()]

    tree, h = parse(term), 1e-5
    for v, step in (("x", (h, 0)), ("z", (0, h))):
        up, down = (values(tree, [(x + s * step[0], z + s * step[1]) for x, z in points]) for s in (1, -1))
        assert np.allclose(values(derive(tree, v), points), (np.array(up) - down) / (2 * h), atol=1e-6)


def test_underivable_term():
    with pytest.raises(ValueError, match="derivative"):
        derive(parse("abs(x)"), "x")


def test_mlpe_on_chosen_pairs(spark):
    rng = np.random.default_rng(1)
    full = [(i, j, float(rng.normal()), float(rng.normal())) for i in range(7) for j in range(i)]
    for rows in (full, full[::2]):
        df = spark.createDataFrame(rows, "i long, j long, x double, y double")
        got = T.mlpe_subset_loglik(df, "x", "y", 0.2, 0.4, 0.3, 0.15).first()[0]
        e = np.array([y - 0.2 - 0.4 * x for _, _, x, y in rows])
        u = np.zeros((len(rows), 7))
        for k, (i, j, _, _) in enumerate(rows):
            u[k, [i, j]] = 1
        cov = 0.7 * np.eye(len(rows)) + 0.15 * u @ u.T
        want = -0.5 * math.exp(0.3) * e @ np.linalg.solve(cov, e) + 0.15 * len(rows) - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.isclose(got, want)
    assert np.isclose(T.mlpe_loglik(spark.createDataFrame(full, "i long, j long, x double, y double"), "x", "y", 0.2, 0.4, 0.3, 0.15).first()[0], T.mlpe_subset_loglik(spark.createDataFrame(full, "i long, j long, x double, y double"), "x", "y", 0.2, 0.4, 0.3, 0.15).first()[0])
    assert T.mlpe_subset_loglik(spark.createDataFrame([], "i long, j long, x double, y double"), "x", "y", 0.2, 0.4, 0.3, 0.15).collect() == []


def test_refused_pairs(spark):
    pairs = P.site_pairs(spark.createDataFrame([(1,), (2,), (3,)], "site long"), [])
    with pytest.raises(ValueError, match="named twice"):
        P.selected_pairs(pairs, spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), refuse=True)
    with pytest.raises(ValueError, match="equal ends"):
        P.selected_pairs(pairs, spark.createDataFrame([(3, 3)], "a long, b long"), refuse=True)


def test_pcg_says_when_it_ends_too_early(spark):
    a = spark.createDataFrame([(r * 6 + c, r, c) for r in range(6) for c in range(6)], "cell long, row long, col long")
    w = G.grid_edges(a, 4).withColumn("w", F.lit(1.0))
    b = a.select(F.col("cell").alias("v"), F.when(F.col("cell") == 0, 1.0).otherwise(0.0).alias("b"))
    with pytest.raises(RuntimeError, match="residual"):
        S.pcg(w, b, ground=35, steps=2)
    assert S.pcg(w, b, ground=35, steps=2, fixed=True).count() == 35
