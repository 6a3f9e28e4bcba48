"""Out-of-sample risk of single series and of portfolios from rolling loadings and factor covariances."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import reversion_weight, value_at_risk
from tidemark.functions.specfun import normal_quantile, t_quantile
from tidemark.operators.joins import asof_backward
from tidemark.operators.kernels import ewma_matrix, ledoit_wolf, repaired
from tidemark.operators.recursions import exponential_means
from tidemark.operators.series import DAYS, by
from tidemark.sources.stored import materialised

#: Condition number and variance inflation from which a forecast isn't relied on; the least specific volatility a year.
MOST_CONDITION, MOST_INFLATION, LEAST_SPECIFIC = 200.0, 100.0, 0.02


@dataclass(frozen=True)
class RiskSpec:
    """How a forecast is put together: rows, half-life and share of weights of the factors' covariance, half-life of specific
    variance; for the forecast of `horizon` rows the lags whose covariance joins in and the half-life of the way back to the
    long run; debias takes the variance out that the loadings' own errors add."""

    window: int = 504
    half_life: float = 60.0
    share: float = 0.6
    specific_half_life: float = 42.0
    horizon: int = 21
    lags: int = 0
    revert_half_life: float | None = None
    debias: bool = False


def loading_sets(loadings: DataFrame) -> DataFrame:
    """A row for each (id, window_end): names (sorted) and beta, lag_betas (by lag, by name), resid_vol, and by lag the covariance
    of the slopes (row by row), empty where the loadings come without that detail."""
    has = lambda *c: all(x in loadings.columns for x in c)
    detail = ["names", "lag_betas", "cov_row", "lag_cov_rows"] if has("names", "lag_betas", "cov_row", "lag_cov_rows") else []
    g = loadings.groupBy("id", "window_end").agg(F.sort_array(F.collect_list(F.struct("factor", "beta", *detail))).alias("s"), (F.max("resid_vol") if has("resid_vol") else F.lit(None).cast("double")).alias("resid_vol"))
    names, beta = F.transform("s", lambda x: x["factor"]), F.transform("s", lambda x: x["beta"])
    if not detail:
        none = F.array().cast("array<array<double>>")
        return g.select("id", "window_end", "resid_vol", names.alias("names"), beta.alias("beta"), F.array(beta).alias("lag_betas"), F.array().cast("array<double>").alias("cov"), none.alias("lag_cov"))
    # The rows of the covariances are in the order of the regression's factors, not by name.
    in_order = lambda row, x: F.transform("s", lambda y: F.get(row, F.array_position(x["names"], y["factor"]).cast("int") - 1))
    lags = F.sequence(F.lit(0), F.size(F.get("s", 0)["lag_betas"]) - 1)
    return g.select(
        "id", "window_end", "resid_vol", names.alias("names"), beta.alias("beta"),
        F.transform(lags, lambda m: F.transform("s", lambda x: F.get(x["lag_betas"], m))).alias("lag_betas"),
        F.flatten(F.transform("s", lambda x: in_order(x["cov_row"], x))).alias("cov"),
        F.transform(lags, lambda m: F.flatten(F.transform("s", lambda x: in_order(F.get(x["lag_cov_rows"], m), x)))).alias("lag_cov"),
    )


def lag_moment(x: np.ndarray, lag: int, half_life: float | None = None) -> np.ndarray:
    """Mean product of a row's deviations with those `lag` rows before, over the rows where both are complete, about the
    (weighted) mean of the complete ones. Rows stay where they are, so that a gap isn't closed."""
    n, k = x.shape
    whole = np.isfinite(x).all(axis=1)
    both = whole[lag:] & whole[: n - lag]
    if lag >= n or whole.sum() < 2 or both.sum() < 2:
        return np.zeros((k, k))
    w = np.ones(n) if half_life is None else 0.5 ** (np.arange(n)[::-1] / half_life)
    y = x - (w[whole] @ x[whole]) / w[whole].sum()
    v = w[lag:][both]
    return (y[lag:][both] * (v / v.sum())[:, None]).T @ y[: n - lag][both]


def horizon_matrix(x: np.ndarray, today: np.ndarray, long_run: np.ndarray, spec: RiskSpec) -> np.ndarray:
    """Covariance per row of the sum of spec.horizon rows, a year: today's on its way to the long run, and what neighbouring
    rows share, a lag as often as the sum has two rows so far apart."""
    g = reversion_weight(spec.revert_half_life, spec.horizon)
    out = long_run + g * (today - long_run)
    for lag in range(1, min(spec.lags, spec.horizon - 1) + 1):
        m = (spec.share * lag_moment(x, lag, spec.half_life) + (1 - spec.share) * lag_moment(x, lag)) * DAYS
        out = out + (1 - lag / spec.horizon) * (m + m.T)
    return repaired(out) if spec.lags and spec.horizon > 1 else out


def window_covariances(sets: DataFrame, factors: DataFrame, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """(window_end, names, cov, cov_h), both a year and row by row: the covariance of each set of factors over the complete rows
    of the spec.window dates up to each window's end, a blend of exponential weights and shrinkage, and that of the horizon.

    Each factor row is dealt to the windows it is in by its date's place, so a group holds one window of one set, whatever
    the panel's length. sets: (window_end, names).
    """
    used = sets.select("window_end", "names").distinct()
    # Dates are as many as the calendar has.
    dates = factors.select("t").distinct().withColumn("pos", F.row_number().over(W.orderBy("t")))
    ends = used.select(F.lit(0).alias("one"), F.col("window_end").alias("t")).distinct()
    last = asof_backward(ends, dates.withColumn("one", F.lit(0)), "one", "t", "pos").where("pos IS NOT NULL")
    places = last.select(F.col("t").alias("window_end"), F.explode(F.sequence(F.greatest(F.col("pos") - spec.window + 1, F.lit(1)), F.col("pos"))).alias("pos"))
    rows = factors.select(F.col("id").alias("factor"), "t", "x").join(dates, "t").join(places, "pos")
    wanted = used.select("window_end", "names", F.explode("names").alias("factor"))
    d = rows.join(wanted, ["window_end", "factor"]).select("window_end", "names", F.col("factor").alias("id"), "t", "x")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="t", columns="id", values="x", aggfunc="first", dropna=False).sort_index().reindex(columns=list(key[1])).to_numpy(float)
        whole = x[np.isfinite(x).all(axis=1)]
        if len(whole) < max(60, x.shape[1] + 5):
            return pd.DataFrame(columns=["window_end", "names", "cov", "cov_h"])
        drawn = ledoit_wolf(whole)[0] * DAYS
        c = repaired(spec.share * ewma_matrix(whole, spec.half_life) * DAYS + (1 - spec.share) * drawn)
        return pd.DataFrame({"window_end": [key[0]], "names": [list(key[1])], "cov": [c.ravel().tolist()], "cov_h": [horizon_matrix(x, c, drawn, spec).ravel().tolist()]})

    return d.groupBy("window_end", "names").applyInPandas(one, "window_end date, names array<string>, cov array<double>, cov_h array<double>")


def quadratic(b: Column, m: Column, k: Column) -> Column:
    """b'Mb with M row by row."""
    return F.aggregate(F.sequence(F.lit(0), k * k - 1), F.lit(0.0), lambda at, p: at + F.get(b, F.floor(p / k).cast("int")) * F.get(m, p) * F.get(b, p % k))


def product_trace(a: Column, b: Column) -> Column:
    """The sum of the products of two symmetric matrices' entries, the trace of their product; zero where one is missing."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda at, x: at + x), F.lit(0.0))


def window_variances(sets: DataFrame, covariances: DataFrame, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """(id, window_end, factor_var, dimson_var, horizon_var, n_factors), a year.

    factor_var is that of the summed slopes; dimson_var that of one row's return, to which each lag's slopes bring the
    variance of another row, so lags add up without cross terms; horizon_var that of the summed slopes under the horizon's
    covariance. With spec.debias each is less the trace of its covariance with that of the slopes.
    """
    d = sets.join(covariances, ["window_end", "names"])
    k = F.size("names")
    by_lag = F.zip_with("lag_betas", F.when(F.size("lag_cov") > 0, F.col("lag_cov")).otherwise(F.transform("lag_betas", lambda _: F.array().cast("array<double>"))), lambda b, v: F.struct(b.alias("b"), v.alias("v")))
    noise = lambda m, v: product_trace(m, v) if spec.debias else F.lit(0.0)
    held = F.lit(None).cast("array<double>") if not spec.debias else F.when(F.size("cov_of_slopes") > 0, F.col("cov_of_slopes"))
    d = d.select("id", "window_end", "names", "beta", "lag_betas", "lag_cov", sets["cov"].alias("cov_of_slopes"), covariances["cov"].alias("c"), "cov_h")
    dimson = F.aggregate(by_lag, F.lit(0.0), lambda at, x: at + quadratic(x["b"], F.col("c"), k) - noise(F.col("c"), F.when(F.size(x["v"]) > 0, x["v"])))
    least = lambda x: F.greatest(x, F.lit(0.0))
    return d.select(
        "id", "window_end", least(quadratic(F.col("beta"), F.col("c"), k) - noise(F.col("c"), held)).alias("factor_var"), least(dimson).alias("dimson_var"),
        least(quadratic(F.col("beta"), F.col("cov_h"), k) - noise(F.col("cov_h"), held)).alias("horizon_var"), k.alias("n_factors"),
    )


def in_force(windows: DataFrame, days: DataFrame) -> DataFrame:
    """(id, t, window_end): for each day of a series (id, t) its last window (id, window_end) that ended before it."""
    ends = windows.select("id", F.col("window_end").alias("t"), "window_end").distinct()
    return asof_backward(days.select("id", "t"), ends, "id", "t", "window_end", strict=True).where("window_end IS NOT NULL").select("id", "t", "window_end")


def days_of(factors: DataFrame, lags: int) -> DataFrame:
    """(t, days): the factors' values of each date and of the `lags` dates before it, each a map."""
    d = factors.where("x IS NOT NULL").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("id", "x"))).alias("day"))
    # One row a date of the calendar.
    w = W.orderBy("t")
    return d.select("t", F.array("day", *(F.lag("day", k).over(w) for k in range(1, lags + 1))).alias("days"))


def out_of_sample(sets: DataFrame, series: DataFrame, factors: DataFrame, lags: int = 0, debias: bool = False) -> DataFrame:
    """(id, t, window_end, resid, e2): each row of series (id, t, ret) after its first window, less what the loadings in force
    explain, lag by lag; e2 is its square, less with debias the variance that the slopes' errors bring. Both are null where a
    factor of the window is missing on a day."""
    days = in_force(sets, series).join(series.select("id", "t", "ret"), ["id", "t"])
    d = days.join(sets.select("id", "window_end", "names", "lag_betas", "lag_cov"), ["id", "window_end"]).join(days_of(factors, lags), "t", "left")
    values = F.transform("days", lambda day: F.transform("names", lambda n: F.get(F.array(day[n]), 0)))
    d = d.withColumn("x", values)
    fit = F.aggregate(F.zip_with(F.slice("x", 1, F.size("lag_betas")), "lag_betas", lambda x, b: F.aggregate(F.zip_with(x, b, lambda p, q: p * q), F.lit(0.0), lambda at, v: at + v)), F.lit(0.0), lambda at, v: at + v)
    resid = F.col("ret") - F.when(F.col("days").isNotNull(), fit)
    noise = F.aggregate(F.zip_with(F.slice("x", 1, F.size("lag_cov")), "lag_cov", lambda x, v: quadratic(x, v, F.size("names"))), F.lit(0.0), lambda at, v: at + v) if debias else F.lit(0.0)
    return d.withColumn("resid", resid).select("id", "t", "window_end", "ret", "resid", (F.col("resid") * F.col("resid") - noise).alias("e2"))


def mean_before(rows: DataFrame, half_life: float, x: str) -> DataFrame:
    """(id, t, value): the exponential mean of the series' values before the row, from its first one; a missing value holds it."""
    return exponential_means(rows, "id", "t", x, half_life).select("id", "t", F.col("before").alias("value"))


def forecasts(loadings: DataFrame, series: DataFrame, factors: DataFrame, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """(id, t, window_end, sigma_factor, sigma_specific, sigma, sigma_dimson, sigma_horizon, n_factors, floored), volatilities a
    year, for each row of series (id, t, ret) after its first window.

    The factor variance is that of the loadings in force under the covariance of their window; specific variance is an
    exponential mean of squared out-of-sample residuals up to the day before, LEAST_SPECIFIC at least (floored). sigma_dimson
    is that of a day whose return answers to several days' factors (loadings with lags), sigma_horizon that of the sum of
    spec.horizon days, per day: lagged covariances and the way back to the long run join in, for specific variance to the
    window's own resid_vol.

    Loadings (regression.rolling, with detail for lags and errors) are computed once and stored, as three branches read them.
    """
    sets = materialised(loading_sets(loadings))
    lags = max(0, (sets.agg(F.max(F.size("lag_betas"))).first()[0] or 1) - 1)
    variances = window_variances(sets, window_covariances(sets, factors, spec), spec)
    e = materialised(out_of_sample(sets, series, factors, lags, spec.debias))
    own = mean_before(e, spec.specific_half_life, "e2")
    d = e.select("id", "t", "window_end").join(variances, ["id", "window_end"]).join(own, ["id", "t"]).join(sets.select("id", "window_end", "resid_vol"), ["id", "window_end"])
    least = F.lit(LEAST_SPECIFIC**2)
    s = F.greatest(F.coalesce(F.col("value") * DAYS, least), least)
    g = reversion_weight(spec.revert_half_life, spec.horizon)
    far = F.greatest(F.coalesce(F.col("resid_vol") * F.col("resid_vol"), s), least)
    ahead = F.greatest(far + g * (s - far), least)
    return d.select(
        "id", "t", "window_end", F.sqrt("factor_var").alias("sigma_factor"), F.sqrt(s).alias("sigma_specific"), F.sqrt(F.col("factor_var") + s).alias("sigma"), F.sqrt(F.col("dimson_var") + s).alias("sigma_dimson"),
        F.sqrt(F.col("horizon_var") + ahead).alias("sigma_horizon"), "n_factors", F.coalesce(F.col("value") * DAYS < least, F.lit(True)).alias("floored"),
    )


def shortfall_factor(level: float, df: float | None = None) -> float:
    """Mean of a variable of unit variance beyond its quantile at `level`, as a loss: normal, or Student's with df degrees."""
    a = 1 - level
    if df is None:
        q = normal_quantile(a)
        return math.exp(-q * q / 2) / math.sqrt(2 * math.pi) / a
    q = t_quantile(a, df)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + q * q / df) ** (-(df + 1) / 2)
    return density * (df + q * q) / (df - 1) / a / math.sqrt(df / (df - 2))


def quantile_factor(level: float, df: float | None = None) -> float:
    return abs(normal_quantile(1 - level)) if df is None else abs(t_quantile(1 - level, df)) / math.sqrt(df / (df - 2))


def tail_losses(d: DataFrame, sigma: str = "sigma", df: float | None = None) -> DataFrame:
    """d with var_95, var_99 and es_975 of one period, from annual volatility: normal, or Student's with df degrees at the same variance."""
    return d.withColumns({"var_95": value_at_risk(sigma, quantile_factor(0.95, df)), "var_99": value_at_risk(sigma, quantile_factor(0.99, df)), "es_975": value_at_risk(sigma, shortfall_factor(0.975, df))})


def horizon_sigma(sigma: str, long_run: str, half_life: float | None, h: int) -> Column:
    """Annual volatility of the mean of the next h days when variance goes back to its long run with that half-life."""
    w = reversion_weight(half_life, h)
    return F.sqrt(w * F.pow(F.col(sigma), F.lit(2.0)) + (1 - w) * F.pow(F.col(long_run), F.lit(2.0)))


def debiased(d: DataFrame, ret: str, sigma: str, window: int = 252, least: int = 60) -> DataFrame:
    """d with `sigma_debiased`: sigma times the root mean square of the standardised returns of the `window` rows before."""
    z2 = F.pow(F.col(ret) / (F.col(sigma) / F.sqrt(F.lit(float(DAYS)))), F.lit(2.0))
    w = by().rowsBetween(-window, -1)
    return d.withColumn("__z2", z2).withColumn("sigma_debiased", F.col(sigma) * F.when(F.count("__z2").over(w) >= least, F.sqrt(F.avg("__z2").over(w))).otherwise(1.0)).drop("__z2")


def reliability(loadings: DataFrame, orthogonal: bool = True) -> DataFrame:
    """(id, window_end, is_reliable, reason): the window's condition number, and on an orthogonal panel its factors' variance inflation."""
    g = loadings.groupBy("id", "window_end").agg(F.max("cond").alias("cond"), F.max("vif").alias("vif"), F.bool_or(F.col("cond").isNull()).alias("no_cond"))
    ill = F.when(F.col("no_cond") | (F.col("cond") > MOST_CONDITION), F.lit("condition"))
    inflated = F.when(F.col("vif") > MOST_INFLATION, F.lit("inflation")) if orthogonal else F.lit(None).cast("string")
    return g.select("id", "window_end", (ill.isNull() & inflated.isNull()).alias("is_reliable"), F.nullif(F.concat_ws(", ", ill, inflated), F.lit("")).alias("reason"))


def capm(rows: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """(id, t, beta_before): the trailing slope on mkt known the row before."""
    from tidemark.operators.series import rolling_beta

    d = rows.withColumn("beta", rolling_beta("ret", "mkt", window, least))
    return d.select("id", "t", F.lag("beta").over(by()).alias("beta_before"))
