"""Eigenvalues and eigenvectors of a symmetric matrix: tridiagonal form, then divide and conquer.

The tridiagonal matrix is torn into two of half the size and a correction of rank one; the
halves' eigenvectors turn the whole into a diagonal plus rank one, whose eigenvalues are the
roots of a secular equation between the diagonal's entries.  Entries that the correction
can't move by more than rounding are split off first, and the correction's vector is computed anew
from the roots that were found, which keeps the eigenvectors orthogonal to working precision.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q' for a symmetric matrix, by reflections."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    least = _EPS / 64 * np.abs(a).max()  # far within rounding
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        long_ = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= least:
            a[k + 2 :, k] = 0
            continue
        v[0] += np.copysign(long_, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z**2 / (d - x)) for ascending d, and d - root for every pair, to full relative precision."""
    k = len(d)
    z2, j = z * z, np.arange(k)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (upper - d) / 2
    at_half = 1 + rho * (z2[:, None] / ((d[:, None] - d) - half)).sum(axis=0)
    left = (at_half >= 0) | (j == k - 1)
    origin = np.where(left, d, upper)
    low = np.where(left, 0, -half)
    high = np.where(left, np.where(j == k - 1, 2 * half, half), 0)
    shifted = d[:, None] - origin
    for _ in range(1200):  # halving ends when no double lies between
        mid = (low + high) / 2
        open_ = (mid != low) & (mid != high)
        if not open_.any():
            break
        with np.errstate(divide="ignore"):
            f = 1 + rho * (z2[:, None] / (shifted - mid)).sum(axis=0)
        low, high = np.where(open_ & (f < 0), mid, low), np.where(open_ & (f >= 0), mid, high)
    mu = np.where(left, high, low)  # the end that isn't zero
    return origin + mu, shifted - mu


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q', ascending, up to ``tol``; rho is positive."""
    norm = np.linalg.norm(z)
    rho, z = rho * norm * norm, z / norm
    order = np.argsort(d, kind="stable")
    d, z, q = d[order].copy(), z[order].copy(), q[:, order].copy()
    keep = np.abs(rho * z) > tol
    last = -1
    for i in np.flatnonzero(keep).tolist():
        if last >= 0:  # two entries so close that a rotation leaves one of them alone
            r = np.hypot(z[i], z[last])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tol:
                z[i], z[last] = r, 0.0
                q[:, last], q[:, i] = c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                keep[last] = False
        last = i
    at = np.flatnonzero(keep)
    if len(at):
        at = at[np.argsort(d[at], kind="stable")]
        dk, zk = d[at], z[at]
        if len(at) == 1:
            roots, vectors = dk + rho * zk * zk, np.ones((1, 1))
        else:
            roots, minus = _secular(dk, zk, rho)
            k = len(at)
            apart = dk[:, None] - dk
            below, above = np.tril(np.ones((k, k), bool), -1), np.triu(np.ones((k, k), bool))[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratios = np.where(below, minus / apart, 1.0)
                ratios[:, :-1] *= np.where(above, minus[:, :-1] / apart[:, 1:], 1.0)
            again = np.sqrt(np.abs(ratios.prod(axis=1) * minus[:, -1] / rho)) * np.sign(zk)
            vectors = again[:, None] / minus
            vectors /= np.linalg.norm(vectors, axis=0)
        d[at], q[:, at] = roots, q[:, at] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray, tol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and the eigenvectors, as columns, of the tridiagonal matrix of diagonal d and off-diagonal e."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    if tol is None:  # rounding of the whole, for its parts too
        tol = 8 * _EPS * max(np.abs(d).max(), np.abs(e).max())
    m = n // 2
    rho = abs(e[m - 1])
    one, two = d[:m].copy(), d[m:].copy()
    one[-1] -= rho
    two[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(one, e[: m - 1], tol), divide_and_conquer(two, e[m:], tol)
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    d = np.concatenate([d1, d2])
    if rho <= tol / 8:
        order = np.argsort(d, kind="stable")
        return d[order], q[:, order]
    z = np.concatenate([q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]])
    return _rank_one(d, z, rho, q, tol)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix, and unit eigenvectors as columns."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(a)
    values, vectors = divide_and_conquer(d, e)
    return values[::-1], (q @ vectors)[:, ::-1]
