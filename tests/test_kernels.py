"""Linear kernels, likelihoods, optimisers and fits against direct formulas and finite differences."""

import numpy as np
import pytest

from ohmgrid.functions import likelihood, optimize, solve
from ohmgrid.plans import fit as F


def grid(rows, cols, m=5, seed=1, queen=True):
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if queen else [])
    i, j = [], []
    for r in range(rows):
        for c in range(cols):
            for a, b in steps:
                if 0 <= r + a < rows and 0 <= c + b < cols:
                    i.append(r * cols + c)
                    j.append((r + a) * cols + c + b)
    rng = np.random.default_rng(seed)
    n = rows * cols
    x = rng.standard_normal((n, 2)) * 0.5
    return solve.Landscape(np.array(i), np.array(j), x, np.sort(rng.choice(n, m, replace=False)), np.repeat(np.arange(rows), cols))


def exact(land, c):
    q = solve.dense_laplacian(land.n, land.i, land.j, solve.weights(land, c))
    return np.linalg.pinv(q)[np.ix_(land.focal, land.focal)]


def response(land, theta, noise=0.02, seed=3):
    r = likelihood.resistance(exact(land, np.exp(land.x @ theta)))
    e = np.random.default_rng(seed).standard_normal(r.shape) * noise
    s = 0.3 + 2 * r + (e + e.T) / 2
    np.fill_diagonal(s, 0)
    return s


def test_covariance_is_the_pseudoinverse_block():
    land = grid(6, 7)
    c = np.exp(land.x @ [0.4, -0.3])
    assert np.allclose(solve.solve(land, c)[1], exact(land, c), atol=1e-10)


def test_block_elimination_equals_dense():
    land = grid(28, 25, m=6)
    c = np.exp(land.x @ [0.4, -0.3])
    g, e = solve.solve(land, c)
    dense = solve.Landscape(land.i, land.j, land.x, land.focal)
    g2, e2 = solve.solve(dense, c)
    assert land.n > 600 and np.allclose(e, e2, atol=1e-9) and np.allclose(g, g2, atol=1e-9)


def test_block_cg_equals_direct():
    land = grid(8, 9, m=4)
    q = solve.dense_laplacian(land.n, land.i, land.j, solve.weights(land, np.exp(land.x[:, 0])))[:-1, :-1]
    b = np.random.default_rng(0).standard_normal((land.n - 1, 4))
    x, steps = solve.block_cg(lambda p: q @ p, b, np.diag(q))
    assert np.allclose(x, np.linalg.solve(q, b), atol=1e-7) and steps < land.n


def test_schur_keeps_resistances():
    land = grid(5, 6)
    q = solve.dense_laplacian(land.n, land.i, land.j, solve.weights(land, np.ones(land.n)))
    small = np.linalg.pinv(solve.schur(q, land.focal))
    assert np.allclose(likelihood.resistance(small), likelihood.resistance(exact(land, np.ones(land.n))))


def test_directed_without_direction_is_scaled_resistance():
    land = grid(4, 5)
    a, b = np.concatenate([land.i, land.j]), np.concatenate([land.j, land.i])
    r = solve.directed_commute(land.n, a, b, np.ones(len(a)), land.focal)
    q = solve.dense_laplacian(land.n, land.i, land.j, np.ones(len(land.i)))
    assert np.allclose(r, land.n * likelihood.resistance(np.linalg.pinv(q)[np.ix_(land.focal, land.focal)]))


def test_mlpe_closed_form():
    m, rho = 6, 0.2
    i, j = likelihood.lower_pairs(m)
    u = np.zeros((len(i), m))
    u[np.arange(len(i)), i] = u[np.arange(len(i)), j] = 1
    sigma = (1 - 2 * rho) * np.eye(len(i)) + rho * u @ u.T
    v = np.random.default_rng(1).standard_normal(len(i))
    assert np.allclose(likelihood._mlpe_weight(v, m, rho), np.linalg.solve(sigma, v))
    assert np.isclose(likelihood._mlpe_logdet(m, rho), np.linalg.slogdet(sigma)[1])


@pytest.mark.parametrize("measurement", sorted(likelihood.MODELS))
def test_gradient_by_finite_differences(measurement):
    land = grid(6, 6, m=6)
    theta = np.array([0.3, -0.2])
    s = response(land, [0.6, -0.4])
    if measurement == "wishart_covariance":
        s = F.simulate_covariance(exact(land, np.exp(land.x @ [0.6, -0.4])), 1.0, 0.1, 200, np.random.default_rng(2))
    value, g, _ = F.evaluate(land, theta, s, measurement, 100)
    h = 1e-5
    numeric = [(F.evaluate(land, theta + h * e, s, measurement, 100)[0] - F.evaluate(land, theta - h * e, s, measurement, 100)[0]) / (2 * h) for e in np.eye(2)]
    assert np.allclose(g, numeric, rtol=2e-3, atol=2e-3)


@pytest.mark.parametrize("search", sorted(optimize.SEARCHES))
@pytest.mark.parametrize("method", [optimize.bfgs, optimize.newton])
def test_optimisers_find_the_minimum(method, search):
    def f(x):
        return float((x[0] - 1) ** 2 + 5 * (x[1] + 2) ** 2 + 0.1 * x[0] ** 4), np.array([2 * (x[0] - 1) + 0.4 * x[0] ** 3, 10 * (x[1] + 2)])

    r = method(f, np.array([3.0, 3.0]), search=search)
    assert r.converged and abs(f(r.x)[1]).max() < 1e-3
    r = method(f, np.array([3.0, 3.0]), lower=np.array([-5.0, -1.0]), upper=np.array([5.0, 5.0]), search=search)
    assert np.isclose(r.x[1], -1.0)


def test_fit_recovers_theta_and_beats_the_null():
    land = grid(8, 8, m=10)
    s = response(land, [0.8, -0.5], noise=0.005)
    got = F.fit(land, s, ["a", "b"])
    assert got.converged and np.allclose(got.theta, [0.8, -0.5], atol=0.1)
    x, k, p = F.likelihood_ratio(F.isolation_by_distance(land, s), got)
    assert k == 2 and x > 10 and p < 0.01


def test_grid_cv_and_power(spark):
    from ohmgrid.operators import solve as S

    land = grid(6, 6, m=10)
    s = response(land, [0.8, -0.5], noise=0.005)
    rows = S.grid_loglik(spark, [[0.0, 0.0], [0.8, -0.5], [400.0, 400.0]], land, s).orderBy("grid_id").collect()
    assert rows[1].loglik > rows[0].loglik
    cv = F.cross_validate(spark, land, s, ["a", "b"], [[0, 2, 4, 6], [1, 3, 5, 7]]).collect()
    assert len(cv) == 2 and all(r.error is None for r in cv)
    power = F.power_study(spark, land, [0.8, -0.5], ["a", "b"], [8], 2).collect()
    assert len(power) == 4


def test_space_filling_starts_at_the_centre():
    xy = np.array([[0, 0], [1, 1], [2, 2], [0, 2], [2, 0]], float)
    assert F.space_filling(xy, 3)[0] == 1 and len(set(F.space_filling(xy, 5))) == 5


def test_directed_fit_runs():
    land = grid(5, 5, m=6)
    land.x = land.x[:, :1]
    d = (land.x[land.i] - land.x[land.j]).reshape(-1, 1)
    got = F.fit_directed(land, response(grid(5, 5, m=6), [0.5, 0.0]), d, ["a", "gamma"])
    assert np.isfinite(got.theta).all()
