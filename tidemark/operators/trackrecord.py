"""Long-horizon forecasts rebuilt at each date from what was known then, and their record from each start on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.backtests import equal_losses
from tidemark.operators.series import by, so_far


@dataclass(frozen=True)
class Build:
    """Rows of the earnings' mean, of the horizon and of the way back to the norm, of a year; rows that reports come late; the
    fewest rows of a norm, of the growth and of the mean return before they count."""

    smooth: int = 120
    horizon: int = 120
    reversion: int = 180
    year: int = 12
    late: int = 3
    least_norm: int = 120
    least_growth: int = 240
    least_mean: int = 240


def known_then(panel: DataFrame, b: Build = Build()) -> DataFrame:
    """(id, t, income, growth, valuation, forecast, realised, benchmark) of panel (id, t, price, dividend, earnings, total), an
    index with payments put back in: income is the dividend over the price, growth that of smoothed earnings since their first
    value, valuation the way of the price over smoothed earnings to its own norm so far, the geometric mean of all values up
    to the date. realised is the growth a year of `total` over the horizon to come, benchmark that from its start to the date.

    Nothing looks ahead: reports count `late` rows after their own, norms and means end at the row. A series with too few
    rows has nulls; values that aren't positive have no logarithm and are left out.
    """
    w = by()
    e, dividend = F.lag("earnings", b.late).over(w), F.lag("dividend", b.late).over(w)
    d = panel.select("id", "t", "price", "total", e.alias("e"), dividend.alias("paid"), (F.row_number().over(w) - 1).alias("pos"))
    last = w.rowsBetween(1 - b.smooth, 0)
    d = d.withColumn("smooth", F.when(F.count("e").over(last) == b.smooth, F.avg("e").over(last)))
    ratio = F.ln(F.when((F.col("price") > 0) & (F.col("smooth") > 0), F.col("price") / F.col("smooth")))
    d = d.withColumns({"ratio": ratio, "log_e": F.ln(F.when(F.col("smooth") > 0, F.col("smooth")))})
    first = F.min_by("log_e", F.when(F.col("log_e").isNotNull(), F.col("pos"))).over(so_far())
    begin = F.min(F.when(F.col("log_e").isNotNull(), F.col("pos"))).over(so_far())
    d = d.withColumns({"norm": F.when(F.count("ratio").over(so_far()) >= b.least_norm, F.avg("ratio").over(so_far())), "first": first, "begin": begin})
    age = F.col("pos") - F.col("begin")
    years, horizon = b.horizon / b.year, min(b.horizon, b.reversion) / b.reversion
    growth = F.when(age >= b.least_growth, (F.col("log_e") - F.col("first")) / F.when(age > 0, age / b.year))
    valuation = (F.col("norm") - F.col("ratio")) * (horizon / years)
    income = F.try_divide("paid", "price")
    ahead, start = F.lead("total", b.horizon).over(w), F.first("total").over(so_far())
    grown = lambda x, y: F.when((x > 0) & (y > 0), x / F.when(y > 0, y))
    realised = F.pow(grown(ahead, F.col("total")), F.lit(1 / years)) - 1
    mean = F.when(F.col("pos") >= b.least_mean, F.pow(grown(F.col("total"), start), b.year / F.when(F.col("pos") > 0, F.col("pos")))) - 1
    d = d.withColumns({"income": income, "growth": growth, "valuation": valuation, "realised": realised, "benchmark": mean})
    return d.select("id", "t", "income", "growth", "valuation", (F.col("income") + F.col("growth") + F.col("valuation")).alias("forecast"), "realised", "benchmark")


def record(forecasts: DataFrame, starts: list[str], lags: int, least: int = 5) -> DataFrame:
    """(id, start, n, corr, mean_error, rmse, rmse_benchmark, oos_r2, dm_t, dm_p, first_t, last_t) of forecasts from each start on, where
    forecast, realised and benchmark are all there; under `least` rows only n. The test compares squared errors (negative: the
    forecast is better) with Bartlett weights of `lags`, as outcomes overlap."""
    d = forecasts.where("forecast IS NOT NULL AND realised IS NOT NULL AND benchmark IS NOT NULL")
    begins = F.explode(F.array(*(F.lit(x).cast("date") for x in starts)))
    d = d.select("id", "t", "forecast", "realised", "benchmark", begins.alias("start")).where("t >= start")
    e, o = F.col("forecast") - F.col("realised"), F.col("benchmark") - F.col("realised")
    g = d.groupBy("id", "start").agg(
        F.count(F.lit(1)).alias("n"), F.corr("forecast", "realised").alias("corr"), F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(o * o)).alias("rmse_benchmark"),
        (1 - F.try_divide(F.sum(e * e), F.sum(o * o))).alias("oos_r2"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    t = equal_losses(d.select("id", F.col("start").cast("string").alias("test"), "t", (e * e - o * o).alias("x"), F.lit(lags).alias("lags")))
    t = t.select("id", F.col("test").cast("date").alias("start"), F.col("t_stat").alias("dm_t"), F.col("p_value").alias("dm_p"))
    out = g.join(t, ["id", "start"], "left")
    enough = F.col("n") >= least
    return out.select("id", "start", "n", *(F.when(enough, F.col(c)).alias(c) for c in ("corr", "mean_error", "rmse", "rmse_benchmark", "oos_r2", "dm_t", "dm_p", "first_t", "last_t")))


def pooled(forecasts: DataFrame) -> DataFrame:
    """(start, n, oos_r2): over all series together, one row a series and start, the decades' first rows."""
    d = forecasts.where("forecast IS NOT NULL AND realised IS NOT NULL AND benchmark IS NOT NULL")
    decade = F.floor(F.year("t") / 10) * 10
    first = d.withColumn("start", decade.cast("int")).withColumn("k", F.row_number().over(W.partitionBy("id", "start").orderBy("t"))).where("k = 1")
    e, o = F.col("forecast") - F.col("realised"), F.col("benchmark") - F.col("realised")
    return first.groupBy("start").agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(e * e), F.sum(o * o))).alias("oos_r2"))
