"""Scores of risk forecasts and of return forecasts: bias, coverage, losses and equal accuracy, from sums over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import qlike
from tidemark.operators.series import by


def chi2_1_tail(x: Column) -> Column:
    """P(chi-squared with one degree > x), from the normal tail by a rational approximation good to 1e-7."""
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z)


def kupiec(df: DataFrame, hit: str, p: float) -> DataFrame:
    """(id, n, hits, lr, p_value): likelihood ratio of the hit rate against p. Where no or every row is a hit there is no
    ratio, and the p-value is the exact binomial one, two-sided: twice the chance of so few or so many."""
    g = df.where(F.col(hit).isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    inside = (F.col("hits") > 0) & (F.col("hits") < F.col("n"))
    x, n = F.col("hits").cast("double"), F.col("n").cast("double")
    pi = F.when(inside, x / n)
    lr = -2 * ((n - x) * F.ln(F.lit(1 - p)) + x * F.ln(F.lit(p)) - (n - x) * F.ln(1 - pi) - x * F.ln(pi))
    edge = F.least(F.lit(1.0), 2 * F.when(F.col("hits") == 0, F.pow(F.lit(1 - p), n)).otherwise(F.pow(F.lit(p), n)))
    return g.withColumn("lr", lr).withColumn("p_value", F.when(inside, chi2_1_tail(F.col("lr"))).otherwise(edge))


def newey_west_lags(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2.0 / 9))).cast("int")


def overlap_lags(n: Column, horizon: int, step: int) -> Column:
    """Lags for outcomes of `horizon` rows taken every `step`: those that share rows, or the usual number if that is more."""
    return F.greatest(newey_west_lags(n), F.lit(-(-max(horizon, 1) // max(step, 1)) - 1))


def transitions(df: DataFrame, hit: str) -> DataFrame:
    """(id, n00, n01, n10, n11) of hits in neighbouring rows."""
    d = df.where(F.col(hit).isNotNull()).withColumn("h", F.col(hit).cast("int")).withColumn("b", F.lag("h").over(by()))
    n = lambda a, b: F.count_if((F.col("b") == a) & (F.col("h") == b)).alias(f"n{a}{b}")
    return d.groupBy("id").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


def christoffersen(df: DataFrame, hit: str, p: float) -> DataFrame:
    """(id, lr_ind, lr_cc, p_cc): independence and joint tests; with a kind of transition missing the joint test is the coverage test alone."""
    t = transitions(df, hit)
    n = lambda k: F.col(k).cast("double")
    total = n("n00") + n("n01") + n("n10") + n("n11")
    full = (F.col("n01") > 0) & (F.col("n00") > 0) & (F.col("n10") > 0) & (F.col("n11") > 0)
    p01, p11, pi = F.when(full, n("n01") / (n("n00") + n("n01"))), F.when(full, n("n11") / (n("n10") + n("n11"))), F.when(full, (n("n01") + n("n11")) / total)
    null = (n("n00") + n("n10")) * F.ln(1 - pi) + (n("n01") + n("n11")) * F.ln(pi)
    alt = n("n00") * F.ln(1 - p01) + n("n01") * F.ln(p01) + n("n10") * F.ln(1 - p11) + n("n11") * F.ln(p11)
    d = t.withColumn("lr_ind", -2 * (null - alt)).join(kupiec(df, hit, p).select("id", "lr", "p_value"), "id")
    joint = F.col("lr") + F.col("lr_ind")
    return d.select("id", "n00", "n01", "n10", "n11", "lr_ind", joint.alias("lr_cc"), F.coalesce(F.exp(-joint / 2), F.col("p_value")).alias("p_cc"))


def bias(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(id, n, bias, median_bias, rmse_log, qlike): ratio of actual to predicted volatility, the root mean square of its log, and the mean loss."""
    d = df.where((F.col(actual) > 0) & (F.col(predicted) > 0))
    ratio = F.col(actual) / F.col(predicted)
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("bias"), F.median(ratio).alias("median_bias"), F.sqrt(F.avg(F.pow(F.ln(ratio), F.lit(2.0)))).alias("rmse_log"), F.avg(qlike(actual, predicted)).alias("qlike"))


def diebold_mariano(df: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """(id, n, mean, t, p_value): mean loss difference over its long-run standard error with Bartlett weights, and the two-sided
    normal p-value; t is zero and p one where that isn't positive, both null under ten rows."""
    own = W.partitionBy("id")
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("x", F.col(a) - F.col(b))
    d = d.withColumns({"m": F.avg("x").over(own), "n": F.count("x").over(own)}).withColumn("u", F.col("x") - F.col("m"))
    d = d.withColumns({f"u{k}": F.lag("u", k).over(by()) for k in range(1, lags + 1)})
    lrv = F.sum(F.col("u") * F.col("u"))
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    g = d.groupBy("id").agg(F.first("n").alias("n"), F.first("m").alias("mean"), (lrv / F.first("n")).alias("v"))
    t = F.when(F.col("n") >= 10, F.when(F.col("v") > 0, F.col("mean") / F.sqrt(F.when(F.col("v") > 0, F.col("v")) / F.col("n"))).otherwise(0.0))
    return g.select("id", "n", "mean", t.alias("t")).withColumn("p_value", F.when(F.col("t") == 0, 1.0).otherwise(chi2_1_tail(F.col("t") * F.col("t"))))


def mincer_zarnowitz(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(id, n, slope, intercept, r2) of realised on predicted variance."""
    y, x = F.pow(F.col(actual), F.lit(2.0)), F.pow(F.col(predicted), F.lit(2.0))
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select("id", y.alias("y"), x.alias("x"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def mincer_zarnowitz_test(df: DataFrame, actual: str, predicted: str, lags: int) -> DataFrame:
    """(id, n, intercept, slope, se_intercept, se_slope, wald, p_joint): the same regression with Bartlett standard errors, and
    the Wald test of intercept zero and slope one. Everything is sums by series; null under ten rows."""
    own = W.partitionBy("id")
    y, x = F.pow(F.col(actual), F.lit(2.0)), F.pow(F.col(predicted), F.lit(2.0))
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select("id", "t", y.alias("y"), x.alias("x"))
    d = d.withColumns({"b": F.regr_slope("y", "x").over(own), "a": F.regr_intercept("y", "x").over(own)}).withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    d = d.withColumns({"g": F.col("e"), "h": F.col("e") * F.col("x")})
    d = d.withColumns({f"{c}{k}": F.lag(c, k).over(by()) for k in range(1, lags + 1) for c in ("g", "h")})
    s = {"gg": F.sum(F.col("g") * F.col("g")), "gh": F.sum(F.col("g") * F.col("h")), "hh": F.sum(F.col("h") * F.col("h"))}
    for k in range(1, lags + 1):
        w = 1 - k / (lags + 1)
        s["gg"] += 2 * w * F.coalesce(F.sum(F.col("g") * F.col(f"g{k}")), F.lit(0.0))
        s["hh"] += 2 * w * F.coalesce(F.sum(F.col("h") * F.col(f"h{k}")), F.lit(0.0))
        s["gh"] += w * F.coalesce(F.sum(F.col("g") * F.col(f"h{k}") + F.col("h") * F.col(f"g{k}")), F.lit(0.0))
    m = d.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("a").alias("intercept"), F.first("b").alias("slope"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), *(v.alias(k) for k, v in s.items()))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    # The inverse of X'X on either side of the middle.
    p, q, r = F.col("sxx") / det, -F.col("sx") / det, F.col("n") / det
    gg, gh, hh = F.col("gg"), F.col("gh"), F.col("hh")
    m = m.withColumns({"v00": p * p * gg + 2 * p * q * gh + q * q * hh, "v01": p * q * gg + (p * r + q * q) * gh + q * r * hh, "v11": q * q * gg + 2 * q * r * gh + r * r * hh})
    one, two = F.col("intercept"), F.col("slope") - 1
    wald = F.try_divide(F.col("v11") * one * one - 2 * F.col("v01") * one * two + F.col("v00") * two * two, F.col("v00") * F.col("v11") - F.col("v01") * F.col("v01"))
    out = m.select("id", F.col("n").cast("long").alias("n"), "intercept", "slope", F.sqrt(F.greatest("v00", F.lit(0.0))).alias("se_intercept"), F.sqrt(F.greatest("v11", F.lit(0.0))).alias("se_slope"), wald.alias("wald"), F.exp(-wald / 2).alias("p_joint"))
    return out.select("id", "n", *(F.when(F.col("n") >= 10, F.col(c)).alias(c) for c in out.columns[2:]))


def oos_r2(df: DataFrame, actual: str, forecast: str, benchmark: str) -> DataFrame:
    """(id, n, r2): one minus squared errors over those of the benchmark."""
    ok = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull() & F.col(benchmark).isNotNull())
    e = lambda c: F.sum(F.pow(F.col(actual) - F.col(c), F.lit(2.0)))
    return ok.groupBy("id").agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(e(forecast), e(benchmark))).alias("r2"))


def beta_stability(loadings: DataFrame) -> DataFrame:
    """(id, window_end, overlap, l1, corr) of loadings (id, window_end, factor, beta) against the window before, over the factors in both."""
    ends = loadings.select("id", "window_end").distinct().withColumn("before", F.lag("window_end").over(W.partitionBy("id").orderBy("window_end"))).where("before IS NOT NULL")
    a = loadings.join(ends, ["id", "window_end"])
    b = loadings.select("id", F.col("window_end").alias("before"), "factor", F.col("beta").alias("beta_before"))
    g = a.join(b, ["id", "before", "factor"]).groupBy("id", "window_end")
    sd = F.stddev_samp("beta") * F.stddev_samp("beta_before")
    return g.agg(F.count(F.lit(1)).alias("overlap"), F.sum(F.abs(F.col("beta") - F.col("beta_before"))).alias("l1"), F.when(sd > 0, F.covar_samp("beta", "beta_before") / F.when(sd > 0, sd)).alias("corr"))
