"""Dense algebra on small groups: shrinkage and repair of covariance matrices, recursions, optimisation, resampling and
simulation. Each runs as one grouped kernel; a group is one panel, series or universe of bounded width.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.series import DAYS


def panel_of(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    """Names and complete rows of a group in long form (id, t, x)."""
    wide = pdf.pivot_table(index="t", columns="id", values="x", aggfunc="first").sort_index().dropna()
    return list(wide.columns), wide.to_numpy(float)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance per row shrunk towards constant correlation, and the intensity; the sample's with under 3 rows or 2 series."""
    t, n = x.shape
    if t < 3 or n < 2:
        return np.atleast_2d(np.cov(x, rowvar=False)), 0.0
    y = x - x.mean(axis=0)
    s = y.T @ y / t
    sd = np.sqrt(np.diag(s))
    outer = np.outer(sd, sd)
    r = (np.divide(s, outer, out=np.zeros_like(s), where=outer > 0).sum() - n) / (n * (n - 1))
    target = r * outer
    np.fill_diagonal(target, np.diag(s))
    spread = (y**2).T @ (y**2) / t - s**2
    pi = spread.sum()
    third = ((y**3).T @ y) / t - np.diag(s)[:, None] * s
    np.fill_diagonal(third, 0)
    rho = np.trace(spread) + r * (np.divide(sd[None, :], sd[:, None], out=np.zeros_like(s), where=sd[:, None] > 0) * third).sum()
    gamma = ((target - s) ** 2).sum()
    delta = float(np.clip((pi - rho) / gamma / t, 0, 1)) if gamma > 0 else 0.0
    return (delta * target + (1 - delta) * s) * t / (t - 1), delta


def ewma_matrix(x: np.ndarray, half_life: float) -> np.ndarray:
    w = 0.5 ** (np.arange(len(x))[::-1] / half_life)
    w /= w.sum()
    y = x - w @ x
    return (y * w[:, None]).T @ y / max(1 - float(w @ w), 1e-12)


def repaired(c: np.ndarray) -> np.ndarray:
    """Nearest by clipped eigenvalues at the given variances; untouched if none is below 1e-8 of the largest."""
    v, q = np.linalg.eigh((c + c.T) / 2)
    floor = max(v[-1], 0) * 1e-8
    if v[0] >= floor:
        return c
    fixed = (q * np.maximum(v, floor)) @ q.T
    scale = np.sqrt(np.divide(np.diag(c), np.diag(fixed), out=np.ones(len(c)), where=np.diag(fixed) > 0))
    return fixed * np.outer(scale, scale)


def ewma_path(r: np.ndarray, half_life: float, seed: int = 60) -> np.ndarray:
    """Annual volatility by a recursion on squares from the mean of the first `seed` finite ones; a missing return holds it."""
    lam, out, v, first = 0.5 ** (1 / half_life), np.full(len(r), math.nan), None, []
    for k, x in enumerate(r):
        if math.isfinite(x):
            if v is None:
                first.append(x * x)
                v = float(np.mean(first)) if len(first) == seed else None
            else:
                v = lam * v + (1 - lam) * x * x
        if v is not None:
            out[k] = math.sqrt(v * DAYS)
    return out


def ewma_volatility(rows: DataFrame, half_life: float, seed: int = 60, x: str = "ret") -> DataFrame:
    """(id, t, sigma) of each series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s = ewma_path(pdf["x"].to_numpy(float), half_life, seed)
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "sigma": [None if math.isnan(v) else v for v in s]})

    return rows.selectExpr("id", "t", f"{x} AS x").groupBy("id").applyInPandas(one, "id string, t date, sigma double")


def surprise(rows: DataFrame, half_life: float = 21.0, least: int = 21, x: str = "ret") -> DataFrame:
    """(id, t, value): size of a return over the volatility before it, less the mean of that ratio for a normal, from the least-th value on."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        lam, v, n, out = 0.5 ** (1 / half_life), None, 0, []
        for r in pdf["x"].to_numpy(float):
            out.append(abs(r) / math.sqrt(v) - math.sqrt(2 / math.pi) if math.isfinite(r) and v and n >= least else None)
            if math.isfinite(r):
                v, n = (r * r if v is None else lam * v + (1 - lam) * r * r), n + 1
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "value": out})

    return rows.selectExpr("id", "t", f"{x} AS x").groupBy("id").applyInPandas(one, "id string, t date, value double")


def t_degrees(z: np.ndarray) -> float | None:
    """Degrees of freedom of a t of unit variance by likelihood on [3, 30], golden section; None under 100 values."""
    z = z[np.isfinite(z)]
    if len(z) < 100:
        return None
    z2 = (z / z.std()) ** 2

    def loss(v: float) -> float:
        return -len(z) * (math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2))) + (v + 1) / 2 * float(np.log1p(z2 / (v - 2)).sum())

    low, high, g = 3.0, 30.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2


def tails(rows: DataFrame, x: str = "ret") -> DataFrame:
    """(id, df)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "df": [t_degrees(pdf["x"].to_numpy(float))]})

    return rows.selectExpr("id", f"{x} AS x").groupBy("id").applyInPandas(one, "id string, df double")


def onto_simplex(v: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Nearest weights between 0 and cap that sum to one, by bisection on the shift."""
    low, high = v.min() - 1.0, v.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - (low + high) / 2, 0, cap)


def best_weights(cov: np.ndarray, mean: np.ndarray, aversion: float, cap: float = 1.0, start: np.ndarray | None = None, steps: int = 4000) -> np.ndarray:
    """Long-only weights of least aversion / 2 w'Sw - m'w by accelerated projected gradients."""
    n = len(cov)
    w = np.full(n, 1 / n) if start is None else start
    rate = 1 / max(aversion * float(np.linalg.eigvalsh(cov)[-1]), 1e-12)
    u, k = w.copy(), 1.0
    for _ in range(steps):
        new = onto_simplex(u - rate * (aversion * cov @ u - mean), cap)
        k2 = (1 + math.sqrt(1 + 4 * k * k)) / 2
        u, w, k, moved = new + (k - 1) / k2 * (new - w), new, k2, float(np.abs(new - w).max())
        if moved < 1e-12:
            break
    return w


def frontier(universe: DataFrame, points: int = 15) -> DataFrame:
    """(universe, point, mean, vol, sharpe, id, weight) of universes (universe, id, mean, row array<double>) with long-only
    portfolios from the least variance to the largest mean; every point starts from the one before."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        cov, mean = np.array(pdf["row"].tolist(), dtype=float), pdf["mean"].to_numpy(float)
        out, w = [], None
        for p in range(points):
            aversion = 10 ** (4 - 5 * p / max(1, points - 1))
            w = best_weights(cov, mean if p else np.zeros_like(mean), aversion, start=w)
            m, v = float(w @ mean), math.sqrt(max(float(w @ cov @ w), 0))
            out += [(key[0], p, m, v, m / v if v > 0 else None, n, x) for n, x in zip(pdf["id"], w, strict=True)]
        return pd.DataFrame(out, columns=["universe", "point", "mean", "vol", "sharpe", "id", "weight"])

    return universe.groupBy("universe").applyInPandas(one, "universe string, point int, mean double, vol double, sharpe double, id string, weight double")


def confidence_set(losses: np.ndarray, alpha: float = 0.10, draws: int = 2000, seed: int = 20260101) -> np.ndarray:
    """p-value of each model (columns) in the set that holds the best one, by eliminating on the largest t of its mean loss
    against the others', resampled in moving blocks. Block sums come from running sums, so memory is draws times models."""
    n, m = losses.shape
    size = max(2, round(n ** (1 / 3)))
    rng = np.random.default_rng(seed)
    total = np.concatenate([np.zeros((1, m)), np.cumsum(losses, axis=0)])
    blocks = -(-n // size)
    starts = rng.integers(0, n - size + 1, size=(draws, blocks))
    means = (total[starts + size] - total[starts]).sum(axis=1) / (blocks * size) - losses.mean(axis=0)
    left, p, worst = list(range(m)), np.ones(m), 0.0
    while len(left) > 1:
        own, boot = losses[:, left].mean(axis=0), means[:, left]
        d, bd = own - own.mean(), boot - boot.mean(axis=1, keepdims=True)
        sd = np.sqrt((bd**2).mean(axis=0))
        t = np.divide(d, sd, out=np.zeros_like(d), where=sd > 0)
        bt = np.divide(bd, sd, out=np.zeros_like(bd), where=sd > 0)
        worst = max(worst, float((bt.max(axis=1) >= t.max()).mean()))
        p[left[int(t.argmax())]] = worst
        del left[int(t.argmax())]
    return p


def model_sets(losses: DataFrame, alpha: float = 0.10) -> DataFrame:
    """(id, model, mean_loss, p, kept) of losses (id, t, model, loss): the dates that all of a series' models have."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="model", values="loss", aggfunc="first").sort_index().dropna()
        if len(wide) < 10:
            return pd.DataFrame(columns=["id", "model", "mean_loss", "p", "kept"])
        p = confidence_set(wide.to_numpy(float), alpha)
        return pd.DataFrame({"id": key[0], "model": wide.columns, "mean_loss": wide.mean().to_numpy(), "p": p, "kept": p >= alpha})

    return losses.groupBy("id").applyInPandas(one, "id string, model string, mean_loss double, p double, kept boolean")


def simulated(assets: DataFrame, years: int = 10, paths: int = 20_000, seed: int = 20260102) -> DataFrame:
    """(portfolio, mean, p5, p25, p50, p75, p95) of annualised returns over `years` of normal years, drawn once at the variance of
    their mean; portfolios (portfolio, mean, vol)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, v = float(pdf["mean"].iloc[0]), float(pdf["vol"].iloc[0])
        draw = np.expm1(np.random.default_rng(seed).normal(math.log1p(m) - 0.5 * v * v, v / math.sqrt(years), paths))
        return pd.DataFrame([[key[0], float(draw.mean()), *np.quantile(draw, [0.05, 0.25, 0.5, 0.75, 0.95])]], columns=["portfolio", "mean", "p5", "p25", "p50", "p75", "p95"])

    return assets.groupBy("portfolio").applyInPandas(one, "portfolio string, mean double, p5 double, p25 double, p50 double, p75 double, p95 double")


def tail_path(rows: DataFrame, window: int = 756, step: int = 63, x: str = "ret") -> DataFrame:
    """(id, t, df): degrees of freedom from the last `window` values, every `step` rows, in force until the next."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v, out, held = pdf["x"].to_numpy(float), [], None
        for k in range(len(v)):
            if k % step == 0:
                got = t_degrees(v[max(0, k - window) : k])
                held = held if got is None else got
            out.append(held)
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "df": out})

    return rows.selectExpr("id", "t", f"{x} AS x").groupBy("id").applyInPandas(one, "id string, t date, df double")
