"""Algebra of a whole panel from sums over its pairs of series: shrinkage, blends, components, orthogonal series, stress.

What grows with the dates is summed in Spark, pair by pair with partial sums; only the matrix of the pairs, as many rows
as series squared, meets a kernel, for its eigenvalues or its inverse. Results by date are weighted sums of the panel again.
Panels are (id, t, x) with every series on every date (covariance.complete).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.covariance import ewma, full, pairs, sample
from tidemark.operators.kernels import repaired
from tidemark.operators.series import DAYS
from tidemark.sources.stored import materialised


def centred(d: DataFrame) -> DataFrame:
    return d.select("id", "t", (F.col("x") - F.avg("x").over(W.partitionBy("id"))).alias("x"))


def shrunk(d: DataFrame, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov, shrinkage), i <= j: the covariance drawn towards constant correlation by the intensity that is best for it.

    With under two series or three dates there is nothing to draw to: the intensity is zero.
    """
    a, b = F.col("a"), F.col("b")
    m = pairs(centred(d)).groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(a * b).alias("s"), F.avg(a * a).alias("vi"), F.avg(b * b).alias("vj"), F.avg(a * a * b * b).alias("q"), F.avg(a * a * a * b).alias("ab"), F.avg(b * b * b * a).alias("ba"))
    m = m.withColumns({"scale": F.sqrt(F.col("vi") * F.col("vj")), "spread": F.col("q") - F.col("s") * F.col("s"), "off": F.col("i") != F.col("j")})
    # What follows reads the pairs, as many rows as series squared, for sums over all of them.
    m = materialised(m)
    m = m.crossJoin(F.broadcast(m.agg(F.avg(F.when(F.col("off"), F.coalesce(F.try_divide("s", "scale"), F.lit(0.0)))).alias("r"))))
    m = m.withColumn("target", F.when(F.col("off"), F.col("r") * F.col("scale")).otherwise(F.col("s")))
    # A pair off the diagonal stands for two.
    slope = lambda x, y, third: F.coalesce(F.sqrt(F.try_divide(y, x)), F.lit(0.0)) * (F.col(third) - x * F.col("s"))
    pi = F.sum(F.when(F.col("off"), 2 * F.col("spread")).otherwise(F.col("spread")))
    rho = F.sum(F.when(F.col("off"), F.col("r") * (slope(F.col("vi"), F.col("vj"), "ab") + slope(F.col("vj"), F.col("vi"), "ba"))).otherwise(F.col("spread")))
    gamma = 2 * F.sum(F.pow(F.col("target") - F.col("s"), F.lit(2.0)))
    m = m.crossJoin(F.broadcast(m.agg((pi - rho).alias("pull"), gamma.alias("gamma"))))
    best = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("pull"), F.col("gamma") * F.col("n"))))
    m = m.withColumn("shrinkage", F.coalesce(F.when(F.col("n") >= 3, best), F.lit(0.0)))
    cov = (F.col("shrinkage") * F.coalesce("target", "s") + (1 - F.col("shrinkage")) * F.col("s")) * F.try_divide("n", F.col("n") - 1) * per_year
    return m.select("i", "j", cov.alias("cov"), "shrinkage")


def matrix_of(pdf: pd.DataFrame, value: str = "cov") -> tuple[list, np.ndarray]:
    """Names and the full matrix of pairs i <= j."""
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {n: k for k, n in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for i, j, v in zip(pdf["i"], pdf["j"], pdf[value], strict=True):
        c[at[i], at[j]] = c[at[j], at[i]] = v
    return names, c


def on_matrix(half: DataFrame, schema: str, kernel) -> DataFrame:
    """kernel(names, matrix) of pairs (i, j, cov), i <= j: one group, of as many rows as pairs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [] if pdf["cov"].isna().any() else kernel(*matrix_of(pdf))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return half.select(F.lit(0).alias("matrix"), "i", "j", "cov").groupBy("matrix").applyInPandas(one, schema)


def positive(half: DataFrame) -> DataFrame:
    """The nearest pairs (i, j, cov) without negative eigenvalues, at the same variances."""

    def kernel(names: list, c: np.ndarray) -> list:
        c = repaired(c)
        return [(names[a], names[b], c[a, b]) for a in range(len(names)) for b in range(a, len(names))]

    return on_matrix(half, "i string, j string, cov double", kernel)


def blended(d: DataFrame, half_life: float = 60.0, share: float = 0.6, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov): `share` of exponential weights and the rest of shrinkage, without negative eigenvalues."""
    both = ewma(d, half_life, per_year).join(shrunk(d, per_year).withColumnRenamed("cov", "drawn"), ["i", "j"])
    return positive(both.select("i", "j", (share * F.col("cov") + (1 - share) * F.col("drawn")).alias("cov")))


def described(half: DataFrame) -> DataFrame:
    """(series, smallest, largest, condition, psd, first_share, three_share, eigenvalues), the eigenvalues from the largest."""

    def kernel(names: list, c: np.ndarray) -> list:
        v = np.linalg.eigvalsh(c)[::-1]
        return [(len(names), v[-1], v[0], v[0] / v[-1] if v[-1] > 0 else None, bool(v[-1] >= -1e-8 * max(v[0], 0)), v[0] / v.sum(), v[:3].sum() / v.sum(), v.tolist())]

    return on_matrix(half, "series long, smallest double, largest double, condition double, psd boolean, first_share double, three_share double, eigenvalues array<double>", kernel)


def components(d: DataFrame, count: int = 5) -> DataFrame:
    """(component, share, id, loading) of the correlation matrix; each component's loading of largest size is positive. A series that doesn't move gives nothing."""

    def kernel(names: list, c: np.ndarray) -> list:
        v, q = np.linalg.eigh(c)
        v, q = v[::-1], q[:, ::-1]
        q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(v))])
        return [(k + 1, v[k] / v.sum(), n, q[a, k]) for k in range(min(count, len(v))) for a, n in enumerate(names)]

    return on_matrix(sample(d).select("i", "j", F.col("corr").alias("cov")), "component int, share double, id string, loading double", kernel)


def component_scores(d: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, t, score): the standardised panel weighted by each component's loadings."""
    own = W.partitionBy("id")
    z = d.withColumn("z", F.try_divide(F.col("x") - F.avg("x").over(own), F.stddev_pop("x").over(own)))
    return z.join(parts, "id").groupBy("component", "t").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


def stress_days(d: DataFrame, window: int = 21, share: float = 0.8) -> DataFrame:
    """(t, pc1_vol, stress): trailing volatility of the first component and whether it is in the upper 1 - share; a panel of
    under two windows has no stress."""
    s = component_scores(d, components(d, 1))
    w = W.partitionBy("component").orderBy("t").rowsBetween(1 - window, 0)
    full_window = F.count("score").over(w) == window
    s = s.withColumns({"pc1_vol": F.when(full_window, F.stddev_samp("score").over(w)), "n": F.count(F.lit(1)).over(W.partitionBy("component"))})
    s = s.withColumn("pc1_vol", F.when(F.col("n") >= 2 * window, F.col("pc1_vol")))
    cut = F.percentile("pc1_vol", F.lit(share)).over(W.partitionBy("component"))
    return s.select("t", "pc1_vol", F.coalesce(F.col("pc1_vol") >= cut, F.lit(False)).alias("stress"))


def gram_schmidt(d: DataFrame, order: list[str]) -> DataFrame:
    """(id, t, x): each series in `order` less its fit, with a constant, on the ones before."""

    def kernel(names: list, c: np.ndarray) -> list:
        known = [n for n in order if n in names]
        at = [names.index(n) for n in known]
        out = []
        for k, n in enumerate(known):
            fit = np.linalg.lstsq(c[np.ix_(at[:k], at[:k])], c[at[:k], at[k]], rcond=None)[0] if k else []
            out += [(n, n, 1.0, k > 0), *((n, known[m], -float(b), True) for m, b in enumerate(fit))]
        return out

    rows = d.where(F.col("id").isin(order))
    weights = on_matrix(sample(rows).select("i", "j", "cov"), "of string, id string, weight double, centre boolean", kernel)
    x = rows.withColumn("m", F.avg("x").over(W.partitionBy("id"))).join(weights, "id")
    moved = F.col("weight") * (F.col("x") - F.when(F.col("centre"), F.col("m")).otherwise(0.0))
    return x.groupBy(F.col("of").alias("id"), "t").agg(F.sum(moved).alias("x"))


def asset_covariance(loadings: DataFrame, half: DataFrame, specific: DataFrame) -> DataFrame:
    """(i, j, cov), i <= j, of assets: loadings (id, factor, beta) on both sides of the factors' pairs, plus specific variance (id, specific) on the diagonal."""
    c = full(half.select("i", "j", "cov"))
    a = loadings.select(F.col("id").alias("one"), F.col("factor").alias("i"), F.col("beta").alias("bi"))
    b = loadings.select(F.col("id").alias("two"), F.col("factor").alias("j"), F.col("beta").alias("bj"))
    # The factors' side is summed out first, so that assets meet each other once a factor.
    left = c.join(a, "i").groupBy("one", "j").agg(F.sum(F.col("bi") * F.col("cov")).alias("v"))
    both = left.join(b, "j").where("one <= two").groupBy(F.col("one").alias("i"), F.col("two").alias("j")).agg(F.sum(F.col("v") * F.col("bj")).alias("cov"))
    own = specific.select(F.col("id").alias("i"), "specific")
    return both.join(own, "i", "left").select("i", "j", (F.col("cov") + F.when(F.col("i") == F.col("j"), F.coalesce(F.col("specific") * F.col("specific"), F.lit(0.0))).otherwise(0.0)).alias("cov"))


def reverted(half: DataFrame, long_run: DataFrame, weight: float | Column) -> DataFrame:
    """(i, j, cov): `weight` of today's pairs, the rest of the long run's."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return half.join(long_run.select("i", "j", F.col("cov").alias("far")), ["i", "j"]).select("i", "j", (w * F.col("cov") + (1 - w) * F.col("far")).alias("cov"))


def block_structure(half: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, size, pc1_share, id, vol, loading, centrality) of each block's own correlations: the first component's share of the
    block, its loadings (the first of the largest is positive) and each member's mean correlation with the others.

    half: pairs (i, j, cov), i <= j; blocks: (id, block). One group a block, of as many rows as its pairs. A block of one has
    share and loading one and no centrality; a member that doesn't move correlates with nothing; a block with a missing
    covariance gives nothing.
    """
    a = half.join(blocks.select(F.col("id").alias("i"), "block"), "i").join(blocks.select(F.col("id").alias("j"), F.col("block").alias("other")), "j").where("block = other").select("block", "i", "j", "cov")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = matrix_of(pdf)
        k, out = len(names), []
        if not pdf["cov"].isna().any():
            sd = np.sqrt(np.maximum(np.diag(c), 0))
            r = np.clip(np.divide(c, np.outer(sd, sd), out=np.zeros_like(c), where=np.outer(sd, sd) > 0), -1, 1)
            np.fill_diagonal(r, 1.0)
            v, q = np.linalg.eigh(r)
            first = q[:, -1]
            size = np.abs(first)
            first = first * np.sign(first[int(np.flatnonzero(size >= size.max() - 1e-9)[0])])
            near = (r.sum(axis=1) - 1) / (k - 1) if k > 1 else np.zeros(1)
            out = [(key[0], k, float(np.clip(v[-1] / k, 0, 1)), n, float(sd[m]), float(first[m]), float(near[m])) for m, n in enumerate(names)]
        return pd.DataFrame(out, columns=["block", "size", "pc1_share", "id", "vol", "loading", "centrality"])

    return a.groupBy("block").applyInPandas(one, "block string, size long, pc1_share double, id string, vol double, loading double, centrality double")
