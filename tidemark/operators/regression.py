"""Rolling regressions: windows are dealt out as groups of rows, and each group is fitted by one small dense kernel.

One row goes to as many windows as hold it. A group is (series, window end): thousands of rows at most, whatever the
corpus, so a task's memory is bounded by the window and the number of regressors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.specfun import f_tail, t_two_sided
from tidemark.operators.series import DAYS


@dataclass(frozen=True)
class Spec:
    """How to fit: estimator ols, huber or ridge; window, step and least rows; lags of each factor; half-life of weights; clip quantile of y."""

    window: int = 252
    step: int = 21
    least: int = 60
    estimator: str = "ols"
    ridge: float = 0.0
    half_life: float | None = None
    lags: int = 0
    clip: float | None = None
    coverage: float = 0.9

    def __post_init__(self):
        if self.estimator not in ("ols", "huber", "ridge"):
            raise ValueError(f"no estimator named {self.estimator}")


def hac_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def hac_cov(x: np.ndarray, e: np.ndarray, lags: int, penalty: np.ndarray | None = None) -> np.ndarray:
    """Bartlett-weighted sandwich about the (penalised) normal matrix."""
    u = x * e[:, None]
    meat = u.T @ u
    for k in range(1, min(lags, len(e) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    bread = np.linalg.pinv(x.T @ x + (penalty if penalty is not None else 0))
    return bread @ meat @ bread


def fit(y: np.ndarray, factors: np.ndarray, spec: Spec = Spec(), weights: np.ndarray | None = None) -> dict | None:
    """Coefficients with robust errors and the fit's diagnostics; None with fewer than k + 2 complete rows."""
    ok = np.isfinite(y) & np.isfinite(factors).all(axis=1)
    y, f = y[ok], factors[ok]
    n, k = f.shape
    if n < k + 2:
        return None
    w = np.ones(n) if weights is None else weights[ok] / weights[ok].mean()
    x = np.column_stack([np.ones(n), f])
    penalty = np.zeros((k + 1, k + 1))
    if spec.estimator == "ridge":
        penalty[1:, 1:] = np.diag(spec.ridge * n * f.var(axis=0, ddof=1))

    def solve(v: np.ndarray) -> np.ndarray:
        r = np.sqrt(v)[:, None]
        if penalty.any():
            return np.linalg.solve((x * r).T @ (x * r) + penalty, (x * r).T @ (y * r[:, 0]))
        return np.linalg.lstsq(x * r, y * r[:, 0], rcond=None)[0]

    b, v = solve(w), w
    if spec.estimator == "huber":
        for _ in range(5):
            e = y - x @ b
            scale = np.median(np.abs(e - np.median(e))) / 0.6745 or 1e-12
            v = w * np.minimum(1, 1.345 / np.maximum(np.abs(e / scale), 1e-12))
            b = solve(v)
    r = np.sqrt(v)[:, None]
    e = y - x @ b
    cov = hac_cov(x * r, e * r[:, 0], hac_lags(n), penalty)
    h = (x * r).T @ (x * r)
    edf = float(np.trace(np.linalg.pinv(h + penalty) @ h)) - 1
    dof = max(n - k - 1, 1)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    t = np.divide(b, se, out=np.zeros_like(b), where=se > 0)
    ss = float(((y - y.mean()) ** 2).sum())
    r2 = 1 - float((e**2).sum()) / ss if ss > 0 else math.nan
    fstat = (r2 / k) / ((1 - r2) / dof) if k and 0 <= r2 < 1 else math.nan
    return {
        "beta": b, "se": se, "t": t, "p": np.array([t_two_sided(z, dof) for z in t]), "cov": cov, "n": n, "edf": edf, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof,
        "f_p": f_tail(fstat, k, dof) if math.isfinite(fstat) else math.nan, "resid_vol": float(e.std(ddof=min(k + 1, n - 1)) * math.sqrt(DAYS)), "dw": float((np.diff(e) ** 2).sum() / (e**2).sum()) if (e**2).sum() > 0 else math.nan,
        "cond": condition(f), "vif": inflation(f),
    }


def condition(f: np.ndarray) -> float:
    """Condition number of the standardised columns; infinite with a constant one."""
    sd = f.std(axis=0, ddof=1)
    return float(np.linalg.cond((f - f.mean(axis=0)) / sd)) if (sd > 0).all() else math.inf


def inflation(f: np.ndarray) -> np.ndarray:
    """Variance inflation factors: the diagonal of the inverse correlation matrix; infinite where it can't be inverted."""
    if f.shape[1] < 2:
        return np.ones(f.shape[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.corrcoef(f, rowvar=False)
    if not np.isfinite(c).all() or np.linalg.matrix_rank(c) < len(c):
        return np.full(f.shape[1], math.inf)
    return np.diag(np.linalg.inv(c)).copy()


def with_lags(f: np.ndarray, lags: int) -> np.ndarray:
    """Columns followed by each one's lags, k by k."""
    out = [f]
    for k in range(1, lags + 1):
        late = np.full_like(f, math.nan)
        late[k:] = f[:-k]
        out.append(late)
    return np.concatenate(out, axis=1)


def collapsed(b: np.ndarray, cov: np.ndarray, k: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each factor's slopes over its lags, with their covariance."""
    a = np.concatenate([np.zeros((k, 1)), np.tile(np.eye(k), lags + 1)], axis=1)
    return a @ b, a @ cov @ a.T


def windows(rows: DataFrame, spec: Spec) -> DataFrame:
    """rows (id, t, ...) once for each window that holds them, with window_end. Windows of spec.window rows end at the last row and
    every spec.step rows before it."""
    back = F.row_number().over(W.partitionBy("id").orderBy(F.desc("t"))) - 1
    size = F.count(F.lit(1)).over(W.partitionBy("id"))
    d = rows.withColumns({"__back": back, "__size": size})
    # Window j covers the rows j * step to j * step + window - 1 from the end; the first ones may be short.
    low = F.greatest(F.ceil((F.col("__back") - spec.window + 1) / spec.step), F.lit(0)).cast("int")
    high = F.floor(F.col("__back") / spec.step).cast("int")
    enough = F.col("__size") - F.col("j") * spec.step >= spec.least
    # With steps longer than a window some rows are in none.
    d = d.where(low <= high).withColumn("j", F.explode(F.sequence(low, high))).where(enough)
    ends = d.groupBy("id", "j").agg(F.max("t").alias("window_end"))
    return d.join(ends, ["id", "j"]).drop("__back", "__size", "j")


#: What `rolling` adds to a loading in detail: the window's factors in their order, the factor's slope at each lag, and its row of the covariance of the slopes at each lag.
DETAIL = "names array<string>, lag_betas array<double>, lag_cov_rows array<array<double>>"


def rolling(rows: DataFrame, factors: list[str], spec: Spec = Spec(), y: str = "y", detail: bool = False) -> DataFrame:
    """Loadings in long form: id, window_end, factor, beta, se, t_stat, p_value, vif, n, r2, adj_r2, resid_vol, cond, cov_row.

    rows: id, t, y and a column for each factor. A factor that has values on under spec.coverage of a window's rows is left
    out of that window. cov_row is the factor's row of the slopes' covariance, in the order of the window's factors. With
    spec.lags a factor's slope is the sum over its lags, which are looked up inside the window. detail adds DETAIL.
    """
    used = windows(rows.select("id", "t", F.col(y).alias("y"), *factors), spec)
    schema = "id string, window_end date, factor string, beta double, se double, t_stat double, p_value double, vif double, n int, r2 double, adj_r2 double, resid_vol double, cond double, cov_row array<double>" + f", {DETAIL}" * detail

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        held = [f for f in factors if np.isfinite(pdf[f].to_numpy(float)).mean() >= spec.coverage]
        x, v = pdf[held].to_numpy(float), pdf["y"].to_numpy(float)
        if spec.clip and np.isfinite(v).sum() >= 10:
            v = np.clip(v, *np.nanquantile(v, [spec.clip, 1 - spec.clip]))
        w = 0.5 ** (np.arange(len(v))[::-1] / spec.half_life) if spec.half_life else None
        got = fit(v, with_lags(x, spec.lags), spec, w) if held and len(v) >= spec.least else None
        if got is None:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        b, cov = (collapsed(got["beta"], got["cov"], len(held), spec.lags)) if spec.lags else (got["beta"][1:], got["cov"][1:, 1:])
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        t = np.divide(b, se, out=np.zeros_like(b), where=se > 0)
        p = [t_two_sided(z, max(got["n"] - len(got["beta"]), 1)) for z in t]
        vif = [x if math.isfinite(x) else None for x in got["vif"][: len(held)]]
        cond = got["cond"] if math.isfinite(got["cond"]) else None
        out = pd.DataFrame({"id": key[0], "window_end": key[1], "factor": held, "beta": b, "se": se, "t_stat": t, "p_value": p, "vif": vif, "n": got["n"], "r2": got["r2"], "adj_r2": got["adj_r2"], "resid_vol": got["resid_vol"], "cond": cond, "cov_row": [r.tolist() for r in cov]})
        if detail:
            k, blocks = len(held), range(spec.lags + 1)
            slopes, spread = got["beta"][1:].reshape(-1, k), got["cov"][1:, 1:]
            out["names"] = [held] * k
            out["lag_betas"] = slopes.T.tolist()
            out["lag_cov_rows"] = [[spread[m * k + i, m * k : (m + 1) * k].tolist() for m in blocks] for i in range(k)]
        return out

    return used.groupBy("id", "window_end").applyInPandas(one, schema)


def residual_path(y: np.ndarray, x: np.ndarray, window: int | None, least: int, refit: int) -> np.ndarray:
    """y less its fit on x from rows strictly before each refit; the last `window` rows, or all so far if None. The intercept
    serves the fit only. A refit with too few complete rows keeps the coefficients before."""
    out, slope = np.full(len(y), math.nan), None
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    for t in range(least, len(y), refit):
        low = 0 if window is None else max(0, t - window)
        held = np.flatnonzero(ok[low:t]) + low
        if len(held) >= max(least, x.shape[1] + 2):
            slope = np.linalg.lstsq(np.column_stack([np.ones(len(held)), x[held]]), y[held], rcond=None)[0][1:]
        if slope is not None:
            out[t : t + refit] = y[t : t + refit] - x[t : t + refit] @ slope
    return out


def residuals(rows: DataFrame, on: list[str], mode: str = "rolling", window: int = 504, least: int = 252, refit: int = 21, y: str = "y") -> DataFrame:
    """(id, t, resid): of a series on others: `full` by one fit, intercept and all, `expanding` or `rolling` by causal refits."""
    if mode not in ("full", "expanding", "rolling"):
        raise ValueError(f"no mode named {mode}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v, x = pdf["y"].to_numpy(float), pdf[on].to_numpy(float)
        if mode == "full":
            ok = np.isfinite(v) & np.isfinite(x).all(axis=1)
            r = np.full(len(v), math.nan)
            if ok.sum() >= len(on) + 2:
                a = np.column_stack([np.ones(ok.sum()), x[ok]])
                r[ok] = v[ok] - a @ np.linalg.lstsq(a, v[ok], rcond=None)[0]
        else:
            r = residual_path(v, x, window if mode == "rolling" else None, least, refit)
        return pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "resid": [None if math.isnan(z) else z for z in r]})

    return rows.select("id", "t", F.col(y).alias("y"), *on).groupBy("id").applyInPandas(one, "id string, t date, resid double")
