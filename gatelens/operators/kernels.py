"""Numeric kernels on small arrays: covariances, distances, ridge regression, kernel features, and the fusion of members."""

from __future__ import annotations

import numpy as np

EPS = 1e-12
LARGEST = 1e6


def shrunk_covariance(centred: np.ndarray, weights: np.ndarray | None = None, least: float = 0.20) -> np.ndarray:
    """Covariance pulled to its mean variance, the more the fewer rows (or their effective number) there are for the columns."""
    n, p = centred.shape
    w = np.full(n, 1 / n) if weights is None else weights / weights.sum()
    effective = n if weights is None else 1 / (w * w).sum()
    a = max(least, min(0.95, p / max(effective - 1, 1)))
    c = (centred * w[:, None]).T @ centred
    return (1 - a) * c + a * np.trace(c) / p * np.eye(p)


def mahalanobis(near: np.ndarray, point: np.ndarray, weights: np.ndarray | None = None, least: float = 0.20) -> float:
    """Distance of a point from its neighbours under their shrunk covariance; root mean square of z for fewer than three.

    Solved in the space of the neighbours, which are fewer than the columns, not in that of the columns.
    """
    k, p = near.shape
    if k < 3:
        return float(np.sqrt(np.mean(((point - near.mean(0)) / (near.std(0) + 1e-6)) ** 2)))
    w = np.full(k, 1 / k) if weights is None else weights / weights.sum()
    mean = w @ near
    r, c = point - mean, near - mean
    a = max(least, min(0.95, p / max(1 / (w * w).sum() - 1, 1)))
    t = a * (w @ (c * c).sum(1)) / p + 1e-6
    c = c * np.sqrt((1 - a) * w)[:, None]
    y = c @ r
    return float(np.sqrt(max(0.0, (r @ r - y @ np.linalg.solve(t * np.eye(k) + c @ c.T, y)) / t)))


def weighted_ridge(x: np.ndarray, y: np.ndarray, alpha: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercept of the least weighted squares with a penalty on coefficients; weights that aren't positive count as zero."""
    w = np.ones(len(x)) if weights is None else np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    if not w.sum():
        w = np.ones(len(x))
    mx, my = (w @ v / max(w.sum(), EPS) for v in (x, y))
    root = np.sqrt(w)[:, None]
    a, b = (x - mx) * root, (y - my) * root
    return solve_ridge(a.T @ a, a.T @ b, mx, my, alpha)


def solve_ridge(gram: np.ndarray, cross: np.ndarray, mx: np.ndarray, my: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The same from sums of products about the means."""
    coef = np.clip(np.nan_to_num(np.linalg.solve(gram + max(alpha, EPS) * np.eye(len(gram)), cross)), -LARGEST, LARGEST)
    return coef, my - mx @ coef


def low_rank(coef: np.ndarray, rank: int) -> np.ndarray:
    if rank >= min(coef.shape):
        return coef
    u, s, v = np.linalg.svd(coef, full_matrices=False)
    return (u[:, :rank] * np.clip(s[:rank], 0, LARGEST)) @ v[:rank]


def projection(dim: int, dims: int, seed: int) -> np.ndarray | None:
    """Gaussian directions of unit length over the root of their number; none where the rows are no wider."""
    if dims >= dim:
        return None
    r = np.random.default_rng(seed).standard_normal((dim, dims))
    return r / np.maximum(np.linalg.norm(r, axis=0), EPS) / np.sqrt(dims)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-max(gamma, EPS) * np.maximum(d, 0))


def gamma_of(x: np.ndarray) -> float:
    """One over twice the median squared distance of a sample's rows."""
    if len(x) < 2:
        return 1 / max(x.shape[1], 1)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    m = float(np.median(d[np.triu_indices(len(x), 1)]))
    return 1 / (2 * m + EPS) if m > EPS else 1 / max(x.shape[1], 1)


def nystroem(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """What takes kernel values against landmarks to features whose products are kernel values."""
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma) + 1e-6 * np.eye(len(landmarks)))
    return (vectors / np.sqrt(np.maximum(values, 1e-9))) @ vectors.T


def cosine_residual(y: np.ndarray, to: np.ndarray) -> np.ndarray:
    n, m = np.linalg.norm(y, axis=1), np.linalg.norm(to, axis=1)
    both = n * m
    out = 1 - np.clip((y * to).sum(1) / np.where(both > 0, both, 1), -1, 1)
    return np.where(both > 0, out, np.where((n == 0) & (m == 0), 0.0, 1.0))


def fuse(scores: np.ndarray, medians: np.ndarray, mads: np.ndarray, how: str = "weighted") -> np.ndarray:
    """Members' scores (member, row) as positive robust z against their training scores; mean weighted by reliability, plain mean, or the largest."""
    z = np.maximum(np.nan_to_num((scores - medians[:, None]) / (1.4826 * mads[:, None] + EPS)), 0)
    if how == "max":
        return z.max(axis=0)
    w = np.maximum(1 / (mads + EPS), 1e-6) if how == "weighted" else np.ones(len(z))
    return w @ z / w.sum()


def variance_dims(cov: np.ndarray, share: float = 0.90, least: int = 8, most: int = 64) -> np.ndarray:
    """The main axes that hold a share of the variance, within bounds."""
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    held = np.cumsum(np.maximum(values[order], 0)) / max(np.maximum(values, 0).sum(), EPS)
    k = min(len(cov), max(least, min(most, int(np.searchsorted(held, share - 1e-12) + 1))))
    axes = axes[:, order[:k]]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
