"""Unit-root and stationarity tests of each series over chosen windows, with a joint verdict and flags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.specfun import chi2_tail, normal_two_sided
from tidemark.operators.unitroots import unit_root_p_of

#: Critical values at 1, 5 and 10 % of the unit-root t with a constant (asymptotic value and its 1/n, 1/n^2 terms), of the
#: stationarity test about a level, and of the test with a break in the level (fixed values from the published tables).
DF_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786), 0.05: (-2.86154, -2.8903, -4.234), 0.10: (-2.56677, -1.5384, -2.809)}
KPSS_CRITICAL = [(0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739)]
BREAK_CRITICAL = {0.01: -5.34, 0.05: -4.80, 0.10: -4.58}


def _t_of(y: np.ndarray, x: np.ndarray, at: int) -> tuple[float, np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = float(e @ e) / max(1, len(y) - x.shape[1])
    v = s2 * np.linalg.pinv(x.T @ x)[at, at]
    return (float(b[at] / math.sqrt(v)) if v > 0 else 0.0), e, s2


def _design(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    y = d[skip:]
    cols = [np.ones(len(y)), x[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)]
    return y, np.column_stack(cols)


def adf(x: np.ndarray) -> tuple[float, int]:
    """t of the level with a constant; lags by the information criterion up to 12 (n/100)^(1/4), all on the same rows.

    One factorisation of the longest design has the residual sums of all shorter ones: a column takes its own part of y.
    """
    most = min(int(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 3)
    y, z = _design(x, most, most)
    parts = np.linalg.qr(z)[0].T @ y
    left = np.maximum(float(y @ y) - np.cumsum(parts**2), 1e-300)[1:]
    best = int(np.argmin(len(y) * np.log(left / len(y)) + 2 * np.arange(2, most + 3)))
    y, z = _design(x, best, best)
    return _t_of(y, z, 1)[0], best


def df_level(t: float, n: int) -> float:
    """The smallest of 1, 5 and 10 % at which t rejects a unit root; one if none."""
    return next((p for p, (a, b, c) in DF_CRITICAL.items() if t < a + b / n + c / n**2), 1.0)


def long_run(e: np.ndarray, lags: int) -> float:
    v = float(e @ e)
    for k in range(1, lags + 1):
        v += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:-k])
    return v / len(e)


def kpss(x: np.ndarray) -> tuple[float, float]:
    """Statistic about a level with a data-driven bandwidth, and its p-value between 0.01 and 0.10 by interpolation."""
    n, e = len(x), x - x.mean()
    start = int(n ** (2 / 9))
    g = [float(e[k:] @ e[: n - k]) / n for k in range(start + 1)]
    s0, s1 = g[0] + 2 * sum(g[1:]), 2 * sum(k * v for k, v in enumerate(g))
    lags = min(n - 1, int(1.1447 * abs((s1 / s0) ** 2 * n) ** (1 / 3)) if s0 else 0)
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / max(long_run(e, lags), 1e-300)
    p, c = zip(*KPSS_CRITICAL, strict=True)
    return stat, float(np.interp(stat, c, p))


def phillips_perron(x: np.ndarray) -> float:
    """The unit-root t with a correction for serial correlation in place of lags."""
    y, z = x[1:], np.column_stack([np.ones(len(x) - 1), x[:-1]])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ b
    n = len(y)
    s2 = float(e @ e) / (n - 2)
    se = math.sqrt(s2 * np.linalg.pinv(z.T @ z)[1, 1])
    lam2, g0 = long_run(e, int(12 * (n / 100) ** 0.25)), float(e @ e) / n
    return math.sqrt(g0 / lam2) * (b[1] - 1) / se - 0.5 * (lam2 - g0) / math.sqrt(lam2) * n * se / math.sqrt(s2) if lam2 > 0 and se > 0 else 0.0


def zivot_andrews(x: np.ndarray, trim: float = 0.15) -> tuple[float, int]:
    """The smallest unit-root t over all breaks in the level between the trims, and the row of that break.

    All fits share the columns but the break's, so they are factored once; a break's own sums are sums from its row on.
    """
    lags = min(int(12 * (len(x) / 100) ** 0.25) // 2, len(x) // 10)
    y, z = _design(x, lags, lags)
    trend = np.arange(len(y), dtype=float)
    x0 = np.column_stack([z, trend])
    n, scale = len(y), np.linalg.norm(x0, axis=0)
    q, r = np.linalg.qr(x0 / np.where(scale > 0, scale, 1.0))
    breaks = np.arange(int(trim * n), int((1 - trim) * n))
    t, sure = np.zeros(len(breaks)), np.zeros(len(breaks), dtype=bool)
    if np.abs(r.diagonal()).min() > 1e-8:
        row = np.linalg.inv(r)[1]
        e = y - q @ (q.T @ y)
        after = lambda v: np.cumsum(v[::-1], axis=0)[::-1][breaks]
        s = after(q)
        own = (n - breaks) - (s * s).sum(axis=1)
        sure = own > 1e-8 * n
        own = np.where(sure, own, 1.0)
        step = after(e) / own
        s2 = (float(e @ e) - step * step * own) / max(1, n - x0.shape[1] - 1)
        sure &= s2 > 1e-10 * float(e @ e) / n
        v = np.where(sure, s2, 1.0) * (row @ row + (s @ row) ** 2 / own)
        t = (row @ (q.T @ y) - step * (s @ row)) / np.sqrt(v)
    # Where columns depend on each other, the fit by itself.
    for i in np.flatnonzero(~sure):
        t[i] = _t_of(y, np.column_stack([x0, (trend >= breaks[i]).astype(float)]), 1)[0]
    best = int(t.argmin())
    return float(t[best]), int(breaks[best]) + lags + 1


def portmanteau(x: np.ndarray, lags: int) -> float:
    e, n = x - x.mean(), len(x)
    d = float(e @ e)
    q = n * (n + 2) * sum((float(e[k:] @ e[:-k]) / d) ** 2 / (n - k) for k in range(1, lags + 1)) if d > 0 else 0.0
    return chi2_tail(q, lags)


def arch_lm(x: np.ndarray, lags: int = 10) -> float:
    s = (x - x.mean()) ** 2
    y = s[lags:]
    z = np.column_stack([np.ones(len(y))] + [s[lags - k : len(s) - k] for k in range(1, lags + 1)])
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    tot = float(((y - y.mean()) ** 2).sum())
    return chi2_tail(len(y) * (1 - float(e @ e) / tot), lags) if tot > 0 else 1.0


def ratio_p(x: np.ndarray, q: int) -> tuple[float, float]:
    """Variance ratio of q-row sums and its p-value, robust to changing variance."""
    n = len(x)
    if n <= 10 * q:
        return math.nan, math.nan
    e = x - x.mean()
    s = np.convolve(e, np.ones(q), "valid")
    vr = float(s @ s) / (q * (n - q + 1) * (1 - q / n)) / (float(e @ e) / (n - 1))
    theta = sum((2 * (q - k) / q) ** 2 * float((e[k:] ** 2) @ (e[:-k] ** 2)) / float(e @ e) ** 2 for k in range(1, q))
    return vr, normal_two_sided((vr - 1) / math.sqrt(theta)) if theta > 0 else 1.0


def analyse(x: np.ndarray) -> dict:
    """All tests of one series of finite values, with the joint state, verdict and flags."""
    n = len(x)
    sd = x.std(ddof=1)
    out: dict = {"n": n, "mean": float(x.mean()), "sd": float(sd), "zero_share": float((x == 0).mean())}
    if n < 60 or not sd > 0:
        return out | {"verdict": "insufficient", "flags": ["short" if n < 60 else "constant"]}
    t, lag = adf(x)
    stat, kp = kpss(x)
    adf_p, pp = unit_root_p_of(t), phillips_perron(x)
    root, level = adf_p < 0.05, kp >= 0.05
    state = {(True, True): "stationary", (True, False): "break", (False, True): "weak", (False, False): "unit_root"}[root, level]
    z = (x - x.mean()) / x.std()
    out |= {"adf_t": t, "adf_lags": lag, "adf_p": adf_p, "pp_p": unit_root_p_of(pp), "kpss": stat, "kpss_p": kp, "pp_t": pp, "lb_p": portmanteau(x, 10), "lb2_p": portmanteau(x * x, 10), "arch_p": arch_lm(x), "state": state}
    out |= {"skew": float((z**3).mean()), "kurt": float((z**4).mean() - 3), "ac1": float(((x[1:] - x.mean()) @ (x[:-1] - x.mean())) / ((x - x.mean()) @ (x - x.mean())))}
    out["jb_p"] = chi2_tail(n / 6 * (out["skew"] ** 2 + out["kurt"] ** 2 / 4), 2)
    for q in (2, 5, 10):
        out[f"vr{q}"], out[f"vr{q}_p"] = ratio_p(x, q)
    flags = []
    if state == "break" and n >= 100:
        out["za_t"], out["za_row"] = zivot_andrews(x)
        out["za_p"] = float(np.interp(out["za_t"], sorted(BREAK_CRITICAL.values()), sorted(BREAK_CRITICAL)))
        flags.append("break")
    peak = int(np.abs(x).argmax())
    near = [x[i] for i in (peak - 1, peak + 1) if 0 <= i < n]
    if abs(x[peak]) > 6 * sd and any(v * x[peak] < 0 and abs(v + x[peak]) <= 0.25 * abs(x[peak]) for v in near):
        flags.append("price_spike")
    flags += [k for k, bad in (("impossible_return", abs(x[peak]) > 2), ("large_return", 0.5 < abs(x[peak]) <= 2), ("arch_effects", out["arch_p"] < 0.01), ("autocorrelated", out["lb_p"] < 0.01), ("stale", out["zero_share"] > 0.2)) if bad]
    fail = state == "unit_root" or {"price_spike", "impossible_return"} & set(flags)
    return out | {"verdict": "fail" if fail else "warn" if {"break", "stale", "large_return"} & set(flags) or state == "weak" else "pass", "flags": flags}


NUMBERS = ["mean", "sd", "zero_share", "skew", "kurt", "ac1", "adf_t", "adf_p", "kpss", "kpss_p", "pp_t", "pp_p", "za_t", "za_p", "lb_p", "lb2_p", "arch_p", "jb_p", "vr2", "vr2_p", "vr5", "vr5_p", "vr10", "vr10_p"]


def battery(rows: DataFrame, windows: tuple[int, ...] = (0, 252), x: str = "ret") -> DataFrame:
    """One row for each series and window (the last that many values, 0 for all): the tests, state, verdict and flags."""
    back = F.row_number().over(W.partitionBy("id").orderBy(F.desc("t")))
    d = rows.where(F.col(x).isNotNull()).select("id", "t", F.col(x).alias("x")).withColumn("back", back)
    d = d.withColumn("window", F.explode(F.array(*(F.lit(w) for w in windows)))).where("window = 0 OR back <= window").drop("back")
    schema = "id string, window int, n int, " + ", ".join(f"{c} double" for c in NUMBERS) + ", state string, verdict string, flags array<string>"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = analyse(pdf.sort_values("t")["x"].to_numpy(float))
        row = {"id": key[0], "window": key[1], "n": got["n"], "state": got.get("state"), "verdict": got["verdict"], "flags": got["flags"]}
        return pd.DataFrame([row | {c: got[c] if c in got and math.isfinite(got[c]) else None for c in NUMBERS}])[[c.split()[0] for c in schema.split(", ")]]

    return d.groupBy("id", "window").applyInPandas(one, schema)
