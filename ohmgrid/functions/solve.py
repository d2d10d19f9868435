"""Linear kernels on grid graphs, for one task or the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Landscape:
    """Arrays of a graph: edges (from 0), design, focal vertices, and a block label that edges cross by one at most."""

    i: np.ndarray
    j: np.ndarray
    x: np.ndarray
    focal: np.ndarray
    block: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.x)


def weights(land: Landscape, c: np.ndarray) -> np.ndarray:
    return c[land.i] + c[land.j]


def dense_laplacian(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    q = np.zeros((n, n))
    np.add.at(q, (i, j), -w)
    np.add.at(q, (j, i), -w)
    np.add.at(q, (i, i), w)
    np.add.at(q, (j, j), w)
    return q


def solve(land: Landscape, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """G (all vertices by sites, the last vertex grounded) and E = centred Z'G.

    With block labels (grid rows), by block-tridiagonal elimination: cost
    blocks x width^3; without them, dense.
    """
    return solve_weighted(land, weights(land, c))


def solve_weighted(land: Landscape, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``solve``, for the weights of the edges. The graph must be connected."""
    n, m = land.n, len(land.focal)
    z = np.full((n, m), -1.0 / n)
    z[land.focal, np.arange(m)] += 1
    g = np.zeros((n, m))
    if land.block is None or n <= 600:
        g[:-1] = np.linalg.solve(dense_laplacian(n, land.i, land.j, w)[:-1, :-1], z[:-1])
    else:
        g = _block_tridiagonal(land, w, z)
    return g, z.T @ g


def _block_tridiagonal(land: Landscape, w: np.ndarray, z: np.ndarray) -> np.ndarray:
    n, m = z.shape
    labels, block = np.unique(land.block, return_inverse=True)
    order = np.argsort(block, kind="stable")
    place = np.empty(n, np.int64)
    starts = np.searchsorted(block[order], np.arange(len(labels) + 1))
    place[order] = np.arange(n) - starts[block[order]]
    sizes = np.diff(starts)
    degree = np.bincount(land.i, w, n) + np.bincount(land.j, w, n)
    bi, bj = block[land.i], block[land.j]
    if (abs(bi - bj) > 1).any():
        raise ValueError("an edge crosses more than one block")
    by_diag = np.argsort(bi, kind="stable")
    within = [by_diag[a:b] for a, b in zip(*_ranges(bi[by_diag], len(labels)), strict=True)]
    ground = n - 1
    factors: list[tuple[np.ndarray, np.ndarray | None]] = []
    right = []
    last_b = None
    for k, size in enumerate(sizes):
        d = np.zeros((size, size))
        own = order[starts[k] : starts[k + 1]]
        d[np.arange(size), np.arange(size)] = degree[own]
        e = within[k]
        e = np.concatenate([e, last_b]) if last_b is not None else e
        same = e[(bi[e] == k) & (bj[e] == k)]
        a, b = place[land.i[same]], place[land.j[same]]
        np.add.at(d, (a, b), -w[same])
        np.add.at(d, (b, a), -w[same])
        up = np.zeros((sizes[k - 1], size)) if k else None
        r = z[own].copy()
        if k:
            cross = e[((bi[e] == k - 1) & (bj[e] == k)) | ((bi[e] == k) & (bj[e] == k - 1))]
            first = np.where(bi[cross] == k - 1, land.i[cross], land.j[cross])
            second = np.where(bi[cross] == k - 1, land.j[cross], land.i[cross])
            np.add.at(up, (place[first], place[second]), -w[cross])
        if block[ground] == k:  # the grounded vertex: a unit row
            p = place[ground]
            d[p], d[:, p], d[p, p], r[p] = 0, 0, 1, 0
            if k:
                up[:, p] = 0
        if k and block[ground] == k - 1:
            up[place[ground]] = 0
        if k:
            prev = factors[-1][0]
            t = np.linalg.solve(prev, np.hstack([up, right[-1]]))
            d -= up.T @ t[:, :size]
            r -= up.T @ t[:, size:]
        factors.append((d, up))
        right.append(r)
        last_b = within[k]
    g = np.zeros((n, m))
    after = None
    for k in range(len(sizes) - 1, -1, -1):
        r = right[k] if after is None else right[k] - factors[k + 1][1] @ after
        after = np.linalg.solve(factors[k][0], r)
        g[order[starts[k] : starts[k + 1]]] = after
    return g


def _ranges(sorted_keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    return np.searchsorted(sorted_keys, at, "left"), np.searchsorted(sorted_keys, at, "right")


def component_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each vertex the smallest one that edges reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def resistances(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, focal: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
    """Effective resistances between the focal vertices; infinite between those that no path joins."""
    there = w > 0
    i, j, w = i[there], j[there], w[there]
    label, m = component_labels(n, i, j), len(focal)
    out = np.full((m, m), np.inf)
    np.fill_diagonal(out, 0.0)
    for c in np.unique(label[focal]):
        here, own = np.flatnonzero(label[focal] == c), np.flatnonzero(label == c)
        if len(own) < 2:
            continue
        at, edge = np.full(n, -1), label[i] == c
        at[own] = np.arange(len(own))
        land = Landscape(at[i[edge]], at[j[edge]], np.empty((len(own), 0)), at[focal[here]], None if block is None else block[own])
        e = solve_weighted(land, w[edge])[1]
        d = np.diag(e)
        out[np.ix_(here, here)] = d[:, None] + d[None] - 2 * e
    return out


def gradient(land: Landscape, c: np.ndarray, g: np.ndarray, de: np.ndarray) -> np.ndarray:
    """Gradient by conductance: per edge minus the quadratic form of the solutions' difference."""
    d = g[land.i] - g[land.j]
    per = -np.einsum("em,mk,ek->e", d, (de + de.T) / 2, d)
    return np.bincount(land.i, per, land.n) + np.bincount(land.j, per, land.n)


def schur(q: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """q on ``keep`` after eliminating the other rows."""
    drop = np.setdiff1d(np.arange(len(q)), keep)
    if not len(drop):
        return q[np.ix_(keep, keep)]
    return q[np.ix_(keep, keep)] - q[np.ix_(keep, drop)] @ np.linalg.solve(q[np.ix_(drop, drop)], q[np.ix_(drop, keep)])


def block_cg(matvec, b: np.ndarray, diagonal: np.ndarray, tol: float = 1e-10, most: int = 1000) -> tuple[np.ndarray, int]:
    """Conjugate gradients with one Krylov space for all right-hand sides, Jacobi-preconditioned."""
    x = np.zeros_like(b)
    r = b.copy()
    inverse = 1 / diagonal[:, None]
    z = inverse * r
    p = z.copy()
    rz = r.T @ z
    limit = tol * max(np.linalg.norm(b), 1.0)
    for k in range(most):
        if np.linalg.norm(r) <= limit:
            return x, k
        q = matvec(p)
        a = np.linalg.pinv(p.T @ q) @ rz
        x += p @ a
        r -= q @ a
        z = inverse * r
        new = r.T @ z
        p = z + p @ (np.linalg.pinv(rz) @ new)
        rz = new
    return x, most


def directed_commute(n: int, a: np.ndarray, b: np.ndarray, rate: np.ndarray, focal: np.ndarray) -> np.ndarray:
    """R = H + H' with H the expected hitting times between focal vertices under the rates a -> b."""
    q = np.zeros((n, n))
    np.add.at(q, (a, b), rate)
    np.add.at(q, (a, a), -rate)
    m = len(focal)
    h = np.zeros((m, m))
    for k, t in enumerate(focal):
        rest = np.delete(np.arange(n), t)
        times = np.zeros(n)
        times[rest] = np.linalg.solve(q[np.ix_(rest, rest)], -np.ones(n - 1))
        h[:, k] = times[focal]
    return h + h.T
