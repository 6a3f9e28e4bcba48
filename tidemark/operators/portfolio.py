"""Portfolios over time: exponentially weighted covariances of pairs, forecasts of many portfolios, families, scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import daily_loss
from tidemark.operators.covariance import pairs
from tidemark.operators.series import DAYS

#: Half-lives and shares of the covariance that mixes speeds (fixed values).
SPEEDS = ((5.0, 0.8), (63.0, 0.1), (252.0, 0.1))


def pair_path(x: np.ndarray, half_life: float, least: int) -> np.ndarray:
    """Mean of products by weights that halve every half_life rows and sum to one, known at the row's end; missing products hold it."""
    lam, top, bottom, n, out = 0.5 ** (1 / half_life), 0.0, 0.0, 0, np.full(len(x), math.nan)
    for t, v in enumerate(x):
        if math.isfinite(v):
            top, bottom, n = lam * top + v, lam * bottom + 1, n + 1
        if n >= least:
            out[t] = top / bottom
    return out


def cov_paths(panel: DataFrame, speeds=SPEEDS, least: int = 60) -> DataFrame:
    """(i, j, t, cov) a year for i <= j at each date, from rows before it: pairs don't depend on each other, so each is a group."""
    # Every date of the panel for every pair, so that a missing product holds the path.
    p = pairs(panel).select("i", "j", "t", (F.col("a") * F.col("b")).alias("x"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf["x"].to_numpy(float)
        c = sum(s * pair_path(x, h, least) for h, s in speeds) * DAYS
        before = np.concatenate([[math.nan], c[:-1]])
        ok = np.isfinite(before)
        return pd.DataFrame({"i": key[0], "j": key[1], "t": pdf["t"][ok], "cov": before[ok]})

    return p.groupBy("i", "j").applyInPandas(one, "i string, j string, t date, cov double")


def portfolio_forecasts(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, t, sigma): volatility of each portfolio (portfolio, id, weight) under the pairs in force at each date."""
    a = weights.select("portfolio", F.col("id").alias("i"), F.col("weight").alias("wi"))
    b = weights.select(F.col("portfolio").alias("p2"), F.col("id").alias("j"), F.col("weight").alias("wj"))
    d = paths.join(a, "i").join(b, (paths["j"] == b["j"]) & (F.col("portfolio") == F.col("p2")))
    twice = F.when(paths["i"] == paths["j"], 1).otherwise(2)
    return d.groupBy("portfolio", "t").agg(F.sqrt(F.greatest(F.sum(twice * F.col("wi") * F.col("cov") * F.col("wj")), F.lit(0.0))).alias("sigma"))


def portfolio_returns(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, t, ret) on the dates on which every holding has a return."""
    n = weights.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"))
    d = panel.join(weights, "id").groupBy("portfolio", "t").agg(F.sum(F.col("weight") * F.col("x")).alias("ret"), F.count(F.lit(1)).alias("held"))
    return d.join(n, "portfolio").where("held = n").select("portfolio", "t", "ret")


def score(d: DataFrame, family: str = "family") -> DataFrame:
    """(family, portfolio, n, bias, z_std, loss, benchmark_loss, hits, in_band) of rows (family, portfolio, t, ret, sigma, benchmark)."""
    root = F.sqrt(F.lit(float(DAYS)))
    z = F.col("ret") / (F.col("sigma") / root)
    ok = d.where("ret IS NOT NULL AND sigma > 0 AND benchmark > 0")
    g = ok.groupBy(family, "portfolio").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(z).alias("z_std"), F.avg(daily_loss("ret", "sigma")).alias("loss"), F.avg(daily_loss("ret", "benchmark")).alias("benchmark_loss"), F.avg((z < -1.6448536).cast("double")).alias("hits"))
    return g.withColumn("in_band", F.abs(F.col("z_std") - 1) <= F.sqrt(2 / F.col("n")))


def family_summary(scores: DataFrame, family: str = "family") -> DataFrame:
    """(family, portfolios, in_band, median_z, beats): what can't be computed counts as out of band."""
    return scores.groupBy(family).agg(F.count(F.lit(1)).alias("portfolios"), F.avg(F.coalesce(F.col("in_band"), F.lit(False)).cast("double")).alias("in_band"), F.median("z_std").alias("median_z"), F.avg(F.coalesce(F.col("loss") < F.col("benchmark_loss"), F.lit(False)).cast("double")).alias("beats"))


def residual_structure(residuals: DataFrame, groups: DataFrame) -> DataFrame:
    """(within, pairs, mean_corr): mean correlation of residuals of pairs in one group and across groups."""
    d = pairs(residuals).where("i < j").groupBy("i", "j").agg(F.corr("a", "b").alias("c"))
    a, b = groups.select(F.col("id").alias("i"), F.col("group").alias("gi")), groups.select(F.col("id").alias("j"), F.col("group").alias("gj"))
    return d.join(a, "i").join(b, "j").groupBy((F.col("gi") == F.col("gj")).alias("within")).agg(F.count("c").alias("pairs"), F.avg("c").alias("mean_corr"))


def families(spark, names: list[str], groups: dict[str, str], baskets: int = 5, seed: int = 20260103) -> DataFrame:
    """(family, portfolio, id, weight): single names, equal weights, each group, spreads of neighbouring groups, seeded baskets."""
    rng = np.random.default_rng(seed)
    by_group = {g: [n for n in names if groups[n] == g] for g in sorted(set(groups.values()))}
    rows = [("single", n, n, 1.0) for n in names] + [("equal", "all", n, 1 / len(names)) for n in names]
    rows += [("group", g, n, 1 / len(m)) for g, m in by_group.items() for n in m]
    for (g, m), (h, k) in zip(list(by_group.items()), list(by_group.items())[1:], strict=False):
        rows += [("spread", f"{g}-{h}", n, 1 / len(m)) for n in m] + [("spread", f"{g}-{h}", n, -1 / len(k)) for n in k]
    for i in range(baskets):
        held = rng.choice(names, size=max(2, len(names) // 3), replace=False)
        rows += [("basket", f"basket {i}", str(n), 1 / len(held)) for n in held]
    return spark.createDataFrame(rows, "family string, portfolio string, id string, weight double")


def cluster_order(corr: DataFrame) -> DataFrame:
    """(panel, id, place) by average linkage on 1 - correlation, of full pairs (panel, i, j, corr): like next to like."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="i", columns="j", values="corr").sort_index().sort_index(axis=1)
        groups, dist = [[k] for k in range(len(c))], 1 - c.to_numpy(float)
        while len(groups) > 1:
            best = min(((float(dist[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
            groups[best[1]] = groups[best[1]] + groups[best[2]]
            del groups[best[2]]
        return pd.DataFrame({"panel": key[0], "id": [c.index[k] for k in groups[0]], "place": range(len(c))})

    return corr.groupBy("panel").applyInPandas(one, "panel string, id string, place int")


def track_record(df: DataFrame, actual: str, forecast: str, benchmark: str) -> DataFrame:
    """(id, n, corr, mean_error, rmse, oos_r2): null but for n under five rows."""
    d = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull() & F.col(benchmark).isNotNull())
    e, b = F.col(actual) - F.col(forecast), F.col(actual) - F.col(benchmark)
    sd = F.stddev_samp(actual) * F.stddev_samp(forecast)
    g = d.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.when(sd > 0, F.covar_samp(actual, forecast) / F.when(sd > 0, sd)).alias("corr"), F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.sum(b * b))).alias("oos_r2"))
    return g.select("id", "n", *(F.when(F.col("n") >= 5, F.col(c)).alias(c) for c in ("corr", "mean_error", "rmse", "oos_r2")))


def spot_return(rows: DataFrame, span: int = 252) -> DataFrame:
    """(id, t, value): a total currency return less its drift over spot across the last `span` rows, known the row before; the
    spot's own return until then. rows: (id, t, total, spot) of returns."""
    w = W.partitionBy("id").orderBy("t").rowsBetween(-span, -1)
    drift = F.when(F.count(F.lit(1)).over(w) == span, F.avg(F.col("total") - F.col("spot")).over(w))
    return rows.select("id", "t", F.coalesce(F.col("total") - drift, F.col("spot")).alias("value"))
