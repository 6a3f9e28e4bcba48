"""Portfolio weights without short positions, exactly: an active-set method whose optimality can be read off its result.

A universe is one small group; what its size is on the number of its dates is summed before, in Spark. Each result carries
`kkt`, by how much the conditions of an optimum are missed: the gradient where a weight is positive, a gain from a weight
that is zero, the budget, a negative weight; relative to the size of the gradient.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.covariance import quadratic
from tidemark.operators.longrun import interpolated
from tidemark.sources.stored import materialised


def held_at_zero(s: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The w >= 0 with a w = b of least w's w / 2 - c'w, and its kkt; starts from a feasible w. s is positive definite.

    Weights at zero are held there. The others move to their own optimum, or until one of them is zero, which joins the
    held. Where no move is left, the held weight with the largest gain is let go, until none has one.
    """
    n, m = len(c), len(b)
    w, free = w.astype(float).copy(), w > 1e-14
    scale = max(1.0, float(np.abs(c).max(initial=0)), float(np.abs(s).max()))
    for _ in range(50 * n + 100):
        f = np.flatnonzero(free)
        system = np.block([[s[np.ix_(f, f)], a[:, f].T], [a[:, f], np.zeros((m, m))]])
        x = np.linalg.lstsq(system, np.concatenate([c[f], b]), rcond=None)[0]
        move = x[: len(f)] - w[f]
        falls = np.flatnonzero(x[: len(f)] < -1e-13)
        if len(falls):
            ratio = w[f][falls] / np.maximum(-move[falls], 1e-300)
            step = min(1.0, float(ratio.min()))
            w[f] += step * move
            out = f[falls[int(ratio.argmin())]]
            w[out], free[out] = 0.0, False
            continue
        w[f] = np.maximum(x[: len(f)], 0.0)
        gain = c - s @ w - a.T @ x[len(f) :]
        held = np.flatnonzero(~free)
        if not len(held) or gain[held].max() <= 1e-12 * scale:
            break
        free[held[int(gain[held].argmax())]] = True
    gain = c - s @ w - a.T @ x[len(f) :]
    missed = max(float(np.abs(gain[w > 0]).max(initial=0)), float(gain.max(initial=0)), float(np.abs(a @ w - b).max(initial=0)), float(-w.min()))
    return w, missed / scale


def least_variance(s: np.ndarray) -> tuple[np.ndarray, float]:
    n = len(s)
    start = np.zeros(n)
    start[int(np.diag(s).argmin())] = 1.0
    scale = float(np.abs(s).max())
    return held_at_zero(s / scale, np.zeros(n), np.ones((1, n)), np.ones(1), start)


def best_sharpe(mean: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
    """The tangency portfolio: the optimum without a budget, scaled to one; without a positive mean, that of least variance."""
    if not (mean > 0).any():
        return least_variance(s)
    scale = float(np.abs(s).max())
    w, kkt = held_at_zero(s / scale, mean / float(np.abs(mean).max()), np.zeros((0, len(mean))), np.zeros(0), np.zeros(len(mean)))
    return w / w.sum(), kkt


def at_mean(mean: np.ndarray, s: np.ndarray, target: float, low: np.ndarray) -> tuple[np.ndarray, float]:
    """Least variance at a mean between that of `low`, a portfolio, and the largest."""
    top = np.zeros(len(mean))
    top[int(mean.argmax())] = 1.0
    span = float(mean.max() - low @ mean)
    share = min(1.0, max(0.0, (target - float(low @ mean)) / span)) if span > 0 else 0.0
    start = (1 - share) * low + share * top
    size = max(float(np.abs(mean).max()), 1e-300)
    return held_at_zero(s / float(np.abs(s).max()), np.zeros(len(mean)), np.vstack([np.ones(len(mean)), mean / size]), np.array([1.0, float(start @ mean) / size]), start)


def style(cross: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
    """The mix whose return is nearest a target's in squares, from the sums of products with the target and with each other."""
    n, scale = len(cross), float(np.abs(s).max())
    return held_at_zero(s / scale, cross / scale, np.ones((1, n)), np.ones(1), np.full(n, 1.0 / n))


def of_universes(universes: DataFrame, points: int = 0) -> DataFrame:
    """(universe, portfolio, point, mean, vol, id, weight, kkt) of universes (universe, id, mean, row array<double>, cross double):
    min_variance, max_sharpe, style where cross (sums of products with a target) is there, and `points` of the frontier.

    row is the id's row of a covariance (or of sums of products), in the order of the ids. A universe with a null mean or a
    row that isn't finite gives nothing; one of a single id holds all of it.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        s, mean, cross = np.array(pdf["row"].tolist(), dtype=float), pdf["mean"].to_numpy(float), pdf["cross"].to_numpy(float)
        out = []

        def add(name: str, point: int, found: tuple[np.ndarray, float]) -> None:
            w, kkt = found
            out.extend((key[0], name, point, float(w @ mean), math.sqrt(max(float(w @ s @ w), 0.0)), i, float(x), kkt) for i, x in zip(pdf["id"], w, strict=True))

        if np.isfinite(s).all() and np.isfinite(mean).all():
            low = least_variance(s)
            add("min_variance", 0, low)
            add("max_sharpe", 0, best_sharpe(mean, s))
            if np.isfinite(cross).all():
                add("style", 0, style(cross, s))
            for p in range(points):
                add("frontier", p, at_mean(mean, s, float(low[0] @ mean) + (float(mean.max()) - float(low[0] @ mean)) * p / max(1, points - 1), low[0]))
        return pd.DataFrame(out, columns=["universe", "portfolio", "point", "mean", "vol", "id", "weight", "kkt"])

    return universes.groupBy("universe").applyInPandas(one, "universe string, portfolio string, point int, mean double, vol double, id string, weight double, kkt double")


def frontier_points(universes: DataFrame, points: int = 40) -> DataFrame:
    """(id, tenor, yield), a curve as longrun.interpolated takes it: each universe's long-only frontier as mean by risk, the efficient part."""
    d = of_universes(universes, points).where("portfolio = 'frontier'").groupBy("universe", "point").agg(F.first("vol").alias("vol"), F.first("mean").alias("mean"))
    before = W.partitionBy("universe").orderBy("vol", "mean").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("best", F.max("mean").over(before)).where(F.col("mean") >= F.col("best") - 1e-10)
    return d.groupBy(F.col("universe").alias("id"), F.col("vol").alias("tenor")).agg(F.max("mean").alias("yield"))


def perspectives(portfolios: DataFrame, vectors: DataFrame, cov: DataFrame, points: int = 40) -> DataFrame:
    """(portfolio, vector, excess, risk, sharpe, gap): every portfolio (portfolio, id, weight) under every vector of expected excess
    returns (vector, id, excess), given all pairs (i, j, cov).

    gap is how far the portfolio's excess lies below the vector's own long-only frontier at the same risk, flat beyond its
    ends: zero for the vector's optimum, negative where short positions reach above it. A holding without an expectation or
    a covariance counts as nothing; without risk there is no ratio.
    """
    risk = quadratic(cov, portfolios.select("portfolio", "id", F.col("weight").alias("beta")), "portfolio").select("portfolio", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("risk"))
    d = portfolios.join(vectors, "id").groupBy("portfolio", "vector").agg(F.sum(F.col("weight") * F.col("excess")).alias("excess")).join(risk, "portfolio")
    rows = cov.groupBy(F.col("i").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"]).alias("row"))
    universes = vectors.select(F.col("vector").alias("universe"), "id", F.col("excess").alias("mean")).join(rows, "id").withColumn("cross", F.lit(None).cast("double"))
    at = interpolated(d.select(F.col("vector").alias("id"), F.col("risk").alias("tenor")).distinct(), materialised(frontier_points(universes, points)))
    best = at.select(F.col("id").alias("vector"), F.col("tenor").alias("risk"), F.col("yield").alias("best"))
    return d.join(best, ["vector", "risk"], "left").select("portfolio", "vector", "excess", "risk", F.try_divide("excess", "risk").alias("sharpe"), (F.col("best") - F.col("excess")).alias("gap"))
