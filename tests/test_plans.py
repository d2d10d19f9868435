"""Scale search, profiles, timing, result folders."""

import numpy as np
import pytest

from ohmgrid.plans import fit as M
from ohmgrid.plans import scale
from ohmgrid.sources import results

from .test_kernels import grid, response


def test_profile_peaks_at_the_fit():
    land = grid(6, 6, m=8)
    s = response(land, [0.8, -0.5], noise=0.01)
    got = M.fit(land, s, ["a", "b"])
    values = scale.profile(land, s, got.theta, 0, [got.theta[0] - 0.3, got.theta[0], got.theta[0] + 0.3])
    assert values[1][1] >= max(values[0][1], values[2][1]) and np.isclose(values[1][1], got.loglik, atol=1e-4)
    curve = scale.marginal_response(land, got, 0)
    assert all(low <= est <= high for _, est, low, high in curve) and curve[-1][1] > curve[0][1]


def test_mean_resistance_gradient():
    from ohmgrid.functions.likelihood import lower_pairs, resistance

    m = 5
    a = np.random.default_rng(0).standard_normal((m, m))
    e = a @ a.T
    i, j = lower_pairs(m)
    g = scale.mean_resistance_gradient(m)
    d = np.random.default_rng(1).standard_normal((m, m))
    d = d + d.T
    h = 1e-6
    numeric = (resistance(e + h * d)[i, j].mean() - resistance(e - h * d)[i, j].mean()) / (2 * h)
    assert np.isclose((g * d).sum(), numeric) and np.allclose(g.sum(axis=1), 0)


def test_benchmark_and_settings(spark):
    land = grid(6, 6, m=6)
    rows = scale.solver_benchmark(spark, land, np.array([0.3, 0.1]), 1).collect()
    assert {r.solver for r in rows} == {"direct", "block_cg"} and all(r.difference < 1e-6 for r in rows)
    assert scale.assess_settings(land, response(land, [0.5, 0.2]), ["a", "b"])["optimizer"] in ("bfgs", "newton")
    assert scale.theta_grid(spark, {"a": [0, 1], "b": [2, 3, 4]}).count() == 6


def test_scale_search(spark):
    rows = [(r * 8 + c, r, c, float((3 * r + 5 * c) % 7)) for r in range(8) for c in range(8)]
    cells = spark.createDataFrame(rows, "cell long, row long, col long, x double")
    base = grid(8, 8, m=8)
    design, names = scale.smoothed_design(cells, {"x": 1.0})
    x = design.orderBy("cell").toPandas()[names].to_numpy(float)
    base.x = x
    s = response(base, [0.7], noise=0.003)
    table, best = scale.scale_search(cells, base, s, {"x": [0.0, 1.0]})
    assert len(table) == 2 and best["x"] == 1.0


def test_result_folder(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/m1_AllResults.parquet")
    assert results.all_results(spark, str(tmp_path)).count() == 3
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "dims.csv").write_text("nx,ny,nu\n4,5,100\n")
    (tmp_path / "s" / "COV.csv").write_text("1.0,0.5\n0.5,2.0\n")
    got = results.scenario(spark, str(tmp_path / "s"))
    assert got["dims"].first().ny == 5 and {(r.i, r.j, r.value) for r in got["covariance"].collect()} == {(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0)}
    with pytest.raises(ValueError):
        results.all_results(spark, str(tmp_path / "s"))
    assert results.match_model(["a_slope.rds", "b_water.rds"], "slope") == "a_slope.rds"
    with pytest.raises(ValueError):
        results.match_model(["a", "ab"], "a")


def test_average_ranks_share_ties(spark):
    from ohmgrid.operators.tables import average_ranks

    values = [3.0, -1.0, 3.0, 7.5, 0.0, 3.0, -1.0]
    got = average_ranks(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x double"), "x", "rank")
    mean = lambda v: sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2
    assert {r["k"]: r["rank"] for r in got.collect()} == {k: mean(v) for k, v in enumerate(values)}
    assert average_ranks(spark.createDataFrame([], "x double"), "x", "rank").count() == 0
