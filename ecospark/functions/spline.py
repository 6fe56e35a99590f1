"""Cubic B-splines on equally spaced knots and the penalised fits built on them.

These helpers see one Arrow batch or one small cross-product matrix at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Basis:
    """k cubic B-splines over [lo, hi]; outside, the functions continue as straight lines."""

    lo: float
    hi: float
    k: int = 10

    def __call__(self, x: np.ndarray) -> np.ndarray:
        segments = self.k - 3
        width = (self.hi - self.lo) / segments or 1.0
        inside = np.clip(x, self.lo, self.hi)
        t = (inside - self.lo) / width
        first = np.clip(np.floor(t).astype(int), 0, segments - 1)
        u = t - first
        value = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], 1) / 6
        slope = np.stack([-((1 - u) ** 2), 3 * u**2 - 4 * u, -3 * u**2 + 2 * u + 1, u**2], 1) / (2 * width)
        value = value + slope * (x - inside)[:, None]
        out = np.zeros((len(x), self.k))
        np.put_along_axis(out, first[:, None] + np.arange(4), value, axis=1)
        return out

    def penalty(self) -> np.ndarray:
        d = np.diff(np.eye(self.k), 2, axis=0)
        return d.T @ d


@dataclass(frozen=True)
class Fit:
    """A penalised fit: coefficients on the raw bases, their covariance, and its summary."""

    beta: np.ndarray
    cov: np.ndarray
    n: int
    edf: float
    term_edf: tuple[float, ...]
    lambdas: tuple[float, ...]
    scale: float
    r2_adj: float
    score: float


def penalised_fit(
    gram: np.ndarray, sizes: list[int], penalties: list[np.ndarray], select: bool = True, method: str = "REML"
) -> Fit:
    """Fit an additive model from the cross-products of [1, B1, ..., Bp, y].

    Each smooth sums to zero over the data. With ``select`` the straight-line part of a
    smooth has a penalty of its own, so a smooth can vanish. The smoothing parameters
    minimise the restricted likelihood criterion (REML) or generalised cross-validation
    (GCV), one parameter at a time on a refining log grid.
    """
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    n = float(xx[0, 0])
    blocks, pens, owner, at = [np.ones((1, 1))], [], [], 1
    for j, (size, pen) in enumerate(zip(sizes, penalties)):
        total = xx[0, at : at + size]
        z = np.linalg.svd(total[None, :], full_matrices=True)[2][1:].T
        s = z.T @ pen @ z
        s /= np.trace(s)
        pens.append(s)
        owner.append(j)
        blocks.append(z)
        if select:
            value, vector = np.linalg.eigh(s)
            null = vector[:, value < 1e-9]
            pens.append(null @ null.T)
            owner.append(j)
        at += size
    rows = np.cumsum([0, *[b.shape[0] for b in blocks]])
    cols = np.cumsum([0, *[b.shape[1] for b in blocks]])
    zz = np.zeros((rows[-1], cols[-1]))
    for i, b in enumerate(blocks):
        zz[rows[i] : rows[i + 1], cols[i] : cols[i + 1]] = b
    g, c = zz.T @ xx @ zz, zz.T @ xy
    mean_y = c[0] / n
    tss = yy - n * mean_y**2
    ranks = [int((np.linalg.eigvalsh(s) > 1e-9).sum()) for s in pens]
    scale_of = [np.trace(g[cols[o + 1] : cols[o + 2], cols[o + 1] : cols[o + 2]]) for o in owner]
    unpenalised = cols[-1] - sum(ranks)

    def solve(log_lambda):
        s = np.zeros_like(g)
        for o, pen, size, ll in zip(owner, pens, scale_of, log_lambda):
            s[cols[o + 1] : cols[o + 2], cols[o + 1] : cols[o + 2]] += np.exp(ll) * size * pen
        a = g + s + 1e-10 * n * np.eye(len(g))
        chol = np.linalg.cholesky(a)
        inv = np.linalg.inv(chol)
        inv = inv.T @ inv
        beta = inv @ c
        fit_ss = yy - 2 * beta @ c + beta @ g @ beta
        return s, chol, inv, beta, max(fit_ss, 1e-12 * max(yy, 1e-300))

    def score(log_lambda):
        s, chol, inv, beta, rss = solve(log_lambda)
        if method == "GCV":
            edf = np.sum(inv * g)
            return n * rss / max(n - edf, 1e-9) ** 2
        penalised = rss + beta @ s @ beta
        log_s = sum(r * (ll + np.log(size)) for r, ll, size in zip(ranks, log_lambda, scale_of))
        dof = n - unpenalised
        return 0.5 * dof * np.log(penalised / dof) + np.log(np.diag(chol)).sum() - 0.5 * log_s

    current = np.zeros(len(pens))
    best = score(current)
    for step in (4.0, 4.0, 2.0, 1.0, 0.5, 0.25):
        for _ in range(2):
            for j in range(len(pens)):
                for delta in (-3 * step, -2 * step, -step, step, 2 * step, 3 * step):
                    trial = current.copy()
                    trial[j] = np.clip(trial[j] + delta, -16.0, 16.0)
                    value = score(trial)
                    if value < best - 1e-12:
                        best, current = value, trial
    _, _, inv, beta, rss = solve(current)
    hat = inv @ g
    edf = float(np.trace(hat))
    sigma2 = rss / (n - edf)
    per_term = [float(np.trace(hat[cols[j] : cols[j + 1], cols[j] : cols[j + 1]])) for j in range(1, len(cols) - 1)]
    lambdas = [float(np.exp(current[owner.index(j)])) for j in range(len(sizes))]
    r2_adj = 1 - sigma2 / (tss / (n - 1)) if tss > 0 else 0.0
    return Fit(
        zz @ beta, zz @ (inv * sigma2) @ zz.T, int(n), edf, tuple(per_term), tuple(lambdas), float(sigma2),
        float(r2_adj), float(best),
    )
