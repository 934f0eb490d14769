"""Elastic nets on small dense panels: coordinate descent in numpy, run inside Spark tasks.

Objective: loss + lambda * sum of penalty factors * ((1 - alpha)/2 b**2 + alpha |b|), on columns scaled by their
deviation (1/n unless ``ddof`` says otherwise) and, for the gaussian family, on a response scaled likewise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Least squared change of a cycle, and cycles at most.
TOLERANCE, ROUNDS = 1e-14, 2000


@dataclass
class Path:
    """Fits along falling lambdas: coefficients (lambda x classes x columns) and intercepts (lambda x classes); one class for gaussian and binomial."""

    lambdas: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray


def _soft(z: float, t: float) -> float:
    return z - t if z > t else z + t if z < -t else 0.0


def _descend(gram: np.ndarray, corr: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimises b'Gb/2 - c'b + sum l1|b| + sum l2 b**2/2 from b on: cycles over the columns, then an exact solution for those left in."""
    diag = np.diag(gram)
    usable = np.flatnonzero(diag > 1e-14)
    if not l1[usable].any() and (l2[usable] > 0).all():
        b[:] = 0
        b[usable] = np.linalg.solve(gram[np.ix_(usable, usable)] + np.diag(l2[usable]), corr[usable])
        return b
    grad = corr - gram @ b

    def cycle(which: Sequence[int]) -> float:
        worst = 0.0
        for j in which:
            old = b[j]
            new = _soft(grad[j] + diag[j] * old, l1[j]) / (diag[j] + l2[j])
            if new != old:
                grad[:] -= gram[:, j] * (new - old)
                b[j] = new
                worst = max(worst, diag[j] * (new - old) ** 2)
        return worst

    for _ in range(ROUNDS):
        worst = cycle(usable)
        active = [j for j in usable if b[j] != 0]
        for _ in range(10):
            if cycle(active) < TOLERANCE:
                break
        if _exact(gram, corr, b, l1, l2, usable) or worst < TOLERANCE:
            break
        grad[:] = corr - gram @ b
    return b


def _exact(gram: np.ndarray, corr: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray, usable: np.ndarray) -> bool:
    """Solves for the columns in b with their signs; takes the solution if it meets the conditions of optimality."""
    at = np.flatnonzero(b)
    x = np.zeros(len(b))
    if len(at):
        try:
            x[at] = np.linalg.solve(gram[np.ix_(at, at)] + np.diag(l2[at]), corr[at] - l1[at] * np.sign(b[at]))
        except np.linalg.LinAlgError:
            return False
    slope = corr - gram @ x - l2 * x
    out = np.setdiff1d(usable, at)
    if (np.sign(x[at]) != np.sign(b[at])).any() or np.abs(slope[at] - l1[at] * np.sign(b[at])).max(initial=0) > 1e-8 or (np.abs(slope[out]) > l1[out] + 1e-10).any():
        return False
    b[:] = x
    return True


def _standard(x: np.ndarray, intercept: bool, ddof: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    spread = np.sqrt(((x - mean) ** 2).sum(axis=0) / max(len(x) - ddof, 1))
    spread = np.where(spread > 1e-12, spread, 1.0)
    centre = mean if intercept else np.zeros(x.shape[1])
    return (x - centre) / spread, centre, spread


def _factors(penalty: np.ndarray | None, p: int) -> np.ndarray:
    f = np.ones(p) if penalty is None else np.asarray(penalty, float)
    return f * p / f.sum() if f.sum() > 0 else f


def _lambda_path(top: float, n: int, p: int, count: int = 100) -> np.ndarray:
    least = 0.01 if n < p else 1e-4
    return top * least ** (np.arange(count) / (count - 1))


def gaussian(x: np.ndarray, y: np.ndarray, alpha: float, lambdas: Sequence[float] | None = None, penalty: np.ndarray | None = None, intercept: bool = True, ddof: int = 0) -> Path:
    """Least squares.  Without lambdas: 100 from the least that leaves nothing, until the fit is no longer better."""
    n, p = x.shape
    xs, centre, spread = _standard(x, intercept, ddof)
    y0 = y.mean() if intercept else 0.0
    ys = np.sqrt(((y - y.mean()) ** 2).sum() / max(n - ddof, 1)) or 1.0
    f, yc = _factors(penalty, p), (y - y0) / ys
    gram, corr = xs.T @ xs / n, xs.T @ yc / n
    b, own = np.zeros(p), lambdas is None
    if own:
        base = corr if (f > 0).all() else corr - gram @ _descend(gram, corr, np.zeros(p), np.where(f > 0, 1e30, 0.0), np.zeros(p))
        lams = _lambda_path(max(np.abs(base[f > 0] / f[f > 0]).max(initial=1e-9), 1e-9) / max(alpha, 1e-3) * ys, n, p)
    else:
        lams = np.sort(np.asarray(lambdas, float))[::-1]
    null, explained, coefs, icepts = float(yc @ yc) / n or 1.0, 0.0, [], []
    for k, lam in enumerate(lams):
        s = lam / ys if not (own and k == 0 and alpha == 0) else 9.9e30
        s *= 1 + 1e-9 * (own and k == 0)  # the first one leaves nothing, however its bound was rounded
        b = _descend(gram, corr, b.copy(), s * alpha * f, s * (1 - alpha) * f)
        beta = b * ys / spread
        coefs.append(beta[None, :])
        icepts.append([y0 - centre @ beta if intercept else 0.0])
        now = 1 - (null - 2 * corr @ b + b @ gram @ b) / null
        if own and k > 4 and (now > 0.999 or now - explained < 1e-5 * now):
            break
        explained = now
    return Path(lams[: len(coefs)], np.array(coefs), np.array(icepts))


def logistic(x: np.ndarray, y: np.ndarray, alpha: float, lambdas: Sequence[float] | None = None, penalty: np.ndarray | None = None, intercept: bool = True, classes: int = 2) -> Path:
    """Logistic regression for labels 0..classes-1 by reweighted coordinate descent; beyond two classes one row of coefficients for each, fitted in turn."""
    n, p = x.shape
    xs, centre, spread = _standard(x, intercept, 0)
    f = _factors(penalty, p)
    rows = 1 if classes == 2 else classes
    hot = (y[:, None] == (np.arange(classes) if rows > 1 else np.array([1]))).astype(float)
    share = np.clip(hot.mean(axis=0), 1e-5, 1 - 1e-5)
    b0 = (np.log(share / (1 - share)) if rows == 1 else np.log(share) - np.log(share).mean()) if intercept else np.zeros(rows)
    b = np.zeros((rows, p))
    if lambdas is None:
        top = np.abs((xs.T @ (hot - hot.mean(axis=0)) / n) / np.maximum(f, 1e-12)[:, None])[f > 0].max(initial=1e-9)
        lams = _lambda_path(top / max(alpha, 1e-3), n, p)
    else:
        lams = np.sort(np.asarray(lambdas, float))[::-1]

    def probabilities() -> np.ndarray:
        z = np.clip(xs @ b.T + b0, -30, 30)
        if rows == 1:
            return 1 / (1 + np.exp(-z))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    coefs, icepts = [], []
    for lam in lams:
        for _ in range(50):
            old, old0 = b.copy(), b0.copy()
            for k in range(rows):
                pr = np.clip(probabilities()[:, k], 1e-5, 1 - 1e-5)
                w = pr * (1 - pr)
                z = xs @ b[k] + b0[k] + (hot[:, k] - pr) / w
                mean_x, mean_z = (w @ xs / w.sum(), w @ z / w.sum()) if intercept else (np.zeros(p), 0.0)
                xc = xs - mean_x
                gram, corr = (xc * w[:, None]).T @ xc / n, (xc * w[:, None]).T @ (z - mean_z) / n
                b[k] = _descend(gram, corr, b[k].copy(), lam * alpha * f, lam * (1 - alpha) * f)
                if intercept:
                    b0[k] = mean_z - mean_x @ b[k]
            if rows > 1 and intercept:
                b0 -= b0.mean()
            if max(np.abs(b - old).max(initial=0), np.abs(b0 - old0).max()) < 1e-7:
                break
        beta = b / spread
        coefs.append(beta.copy())
        icepts.append(b0 - beta @ centre)
    return Path(lams, np.array(coefs), np.array(icepts))


def degrees_of_freedom(x: np.ndarray, coef: np.ndarray, alpha: float, lam: float) -> float:
    """Of a gaussian fit, from its active columns scaled to sample deviation 1; 1 without any."""
    at = np.flatnonzero(coef)
    if not len(at):
        return 1.0
    if alpha == 1:
        return float(len(at))
    spread = x.std(axis=0, ddof=1)
    a = ((x - x.mean(axis=0)) / np.where(spread > 0, spread, 1))[:, at]
    d2 = np.linalg.svd(a, compute_uv=False) ** 2
    # the trace of X (X'X + cI)^-1 X' is the same sum for both kinds
    return float((d2 / (d2 + (lam if alpha == 0 else (1 - alpha) * lam))).sum())


def criterion(kind: str, n: int, df: np.ndarray, rss: np.ndarray, sigma2: float) -> np.ndarray:
    """BIC, AIC or Cp of fits with df degrees of freedom."""
    if kind == "Cp":
        return rss / n + 2 / n * df * sigma2
    return rss / (n * sigma2) + (np.log(n) if kind == "BIC" else 2) / n * df
