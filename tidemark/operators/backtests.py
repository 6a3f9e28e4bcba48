"""Scores of volatility forecasts against what came after: a backtest of a model's forecasts and a portfolio's daily score.

Every outcome comes from one ordering of a series' rows: the forecast in force on a day, the days that follow a forecast,
and blocks of h days that don't overlap. The rows that result are stored once; means, coverage and tests of equal losses are
then sums over them, the latter for all comparisons of all series in one pass.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import daily_loss, qlike, value_at_risk
from tidemark.functions.specfun import t_two_sided
from tidemark.operators.risk import quantile_factor
from tidemark.operators.scores import chi2_1_tail, christoffersen, kupiec, newey_west_lags
from tidemark.operators.series import DAYS, by, forward_realised, horizon_return, in_force
from tidemark.sources.stored import materialised

ROOT = float(DAYS) ** 0.5


def t_tails(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; of one row a series."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, d) if x == x and d == d else None for x, d in zip(t, df, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(t, df)


def most_lags(d: DataFrame) -> int:
    """The largest of the column `lags`: one number, which says how many earlier rows a window looks at."""
    return int(d.agg(F.max("lags")).first()[0] or 0)


def bartlett(k: int) -> Column:
    """The weight of lag k among a row's `lags`."""
    return F.greatest(1 - F.lit(float(k)) / (F.col("lags") + 1), F.lit(0.0))


def equal_losses(losses: DataFrame) -> DataFrame:
    """(id, test, n, mean, t_stat, p_value) of loss differences (id, test, t, x, lags): their mean over its long-run standard
    error with Bartlett weights, against a normal. t is zero and p one where that isn't positive, both null under ten rows."""
    own = W.partitionBy("id", "test")
    d = losses.where("x IS NOT NULL").withColumn("u", F.col("x") - F.avg("x").over(own))
    most = most_lags(d)
    d = d.withColumns({f"u{k}": F.lag("u", k).over(own.orderBy("t")) for k in range(1, most + 1)})
    v = reduce(lambda a, k: a + 2 * bartlett(k) * F.coalesce(F.col("u") * F.col(f"u{k}"), F.lit(0.0)), range(1, most + 1), F.col("u") * F.col("u"))
    g = d.groupBy("id", "test").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg(v).alias("v"))
    t = F.when(F.col("n") >= 10, F.when(F.col("v") > 0, F.col("mean") / F.sqrt(F.when(F.col("v") > 0, F.col("v")) / F.col("n"))).otherwise(0.0))
    return g.withColumn("t_stat", t).select("id", "test", "n", "mean", "t_stat", F.when(F.col("t_stat") == 0, 1.0).otherwise(chi2_1_tail(F.col("t_stat") * F.col("t_stat"))).alias("p_value"))


def calibration(rows: DataFrame) -> DataFrame:
    """(id, mz_alpha, mz_beta, mz_alpha_p, mz_beta_p, mz_joint_p, mz_r2) of y on x in rows (id, t, y, x, lags): the regression of
    realised on predicted variance with Bartlett errors, against zero and one; null under ten rows."""
    own = W.partitionBy("id")
    d = rows.withColumns({"b": F.regr_slope("y", "x").over(own), "a": F.regr_intercept("y", "x").over(own)}).withColumn("g", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("h", F.col("g") * F.col("x"))
    most = most_lags(d)
    d = d.withColumns({f"{c}{k}": F.coalesce(F.lag(c, k).over(by()), F.lit(0.0)) for k in range(1, most + 1) for c in ("g", "h")})
    g, h = F.col("g"), F.col("h")
    sums = {"gg": g * g, "gh": g * h, "hh": h * h}
    for k in range(1, most + 1):
        w, gk, hk = bartlett(k), F.col(f"g{k}"), F.col(f"h{k}")
        sums = {"gg": sums["gg"] + 2 * w * g * gk, "gh": sums["gh"] + w * (g * hk + h * gk), "hh": sums["hh"] + 2 * w * h * hk}
    x = F.col("x")
    m = d.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.regr_r2("y", "x").alias("r2"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), *(F.sum(v).alias(k) for k, v in sums.items()))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    p, q, r = F.try_divide(F.col("sxx"), det), F.try_divide(-F.col("sx"), det), F.try_divide(F.col("n"), det)
    gg, gh, hh = F.col("gg"), F.col("gh"), F.col("hh")
    m = m.withColumns({"v00": p * p * gg + 2 * p * q * gh + q * q * hh, "v01": p * q * gg + (p * r + q * q) * gh + q * r * hh, "v11": q * q * gg + 2 * q * r * gh + r * r * hh})
    a, b = F.col("a"), F.col("b") - 1
    wald = F.try_divide(F.col("v11") * a * a - 2 * F.col("v01") * a * b + F.col("v00") * b * b, F.col("v00") * F.col("v11") - F.col("v01") * F.col("v01"))
    tail = lambda x, v: t_tails(F.abs(x) / F.sqrt(F.when(F.col(v) > 0, F.col(v))), F.col("n") - 2)
    m = m.where("n >= 10")
    return m.select("id", F.col("a").alias("mz_alpha"), F.col("b").alias("mz_beta"), tail(a, "v00").alias("mz_alpha_p"), tail(b, "v11").alias("mz_beta_p"), F.exp(-wald / 2).alias("mz_joint_p"), F.col("r2").alias("mz_r2"))


def coverage(rows: DataFrame, level: float, hit: str, name: str) -> DataFrame:
    """(id, exceptions, expected, kupiec_stat, kupiec_p, christoffersen_stat, christoffersen_p), each with the suffix `name`, of hits in rows (id, t, hit); null under ten rows."""
    d = kupiec(rows, hit, 1 - level).join(christoffersen(rows, hit, 1 - level).select("id", "lr_cc", "p_cc"), "id").where("n >= 10")
    values = {"exceptions": F.col("hits"), "expected": F.col("n") * (1 - level), "kupiec_stat": F.col("lr"), "kupiec_p": F.col("p_value"), "christoffersen_stat": F.col("lr_cc"), "christoffersen_p": F.col("p_cc")}
    return d.select("id", *(v.alias(f"{k}_{name}") for k, v in values.items()))


def scored_rows(forecasts: DataFrame, series: DataFrame, horizon: int, start=None, end=None) -> DataFrame:
    """The rows of series with their forecasts, and what a backtest needs to know of each; see backtest for the inputs.

    scored: a reliable forecast on the grid, in the span, with an outcome. force: the reliable forecast in force on the day.
    """
    f = forecasts.select("id", "t", "sigma", "sigma_horizon", "on_grid", "is_reliable", F.lit(True).alias("issued"))
    d = series.select("id", "t", "ret", "own", "capm").join(f, ["id", "t"], "left")
    inside = F.coalesce("issued", F.lit(False))
    inside = inside & (F.col("t") >= F.lit(start)) if start is not None else inside
    inside = inside & (F.col("t") <= F.lit(end)) if end is not None else inside
    own = W.partitionBy("id")
    d = d.withColumns({"span": inside, "pos": F.row_number().over(by())}).withColumn("usable", F.col("span") & F.coalesce("is_reliable", F.lit(False)))
    d = d.withColumns({
        "real": forward_realised("ret", horizon) * ROOT, "r_h": horizon_return("ret", horizon), "own_before": F.lag("own").over(by()), "known": F.when(F.col("usable"), F.col("sigma")),
        "first_t": F.min(F.when(F.col("span"), F.col("t"))).over(own), "last_t": F.max(F.when(F.col("span"), F.col("t"))).over(own), "last_pos": F.max(F.when(F.col("span"), F.col("pos"))).over(own),
    }).withColumn("force", in_force("known"))
    d = d.withColumn("scored", F.col("usable") & F.coalesce("on_grid", F.lit(False)) & F.col("real").isNotNull())
    after = F.col("t") > F.col("first_t")
    # Days that a forecast answers for: to 1.5 horizons in days after the last, or to a horizon in rows.
    d = d.withColumns({"covered": after & (F.col("t") <= F.date_add("last_t", int(horizon * 1.5))) & F.col("ret").isNotNull() & F.col("force").isNotNull(), "paired": after & (F.col("pos") <= F.col("last_pos") + horizon)})
    step = F.when(F.col("scored"), F.col("pos") - F.last(F.when(F.col("scored"), F.col("pos")), ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, -1)))
    return d.withColumn("step", step)


def backtest(forecasts: DataFrame, series: DataFrame, horizon: int, start=None, end=None) -> DataFrame:
    """A row of 47 figures for each series.

    forecasts: (id, t, sigma, sigma_horizon, on_grid, is_reliable), volatilities a year made at the end of day t;
    series: (id, t, ret, own, capm), with two rival forecasts made at the end of each day. Counts of forecasts; bias (actual
    over predicted, its median, the spread of h-day returns over their forecast and of daily ones, their kurtosis); the
    regression of realised on predicted variance; losses with tests against the rivals on the forecasts' own dates, by day
    on the forecast in force, and by h-day return; coverage of the losses at 95 and 99 %; the days covered.

    start and end bound the dates of the forecasts. Forecasts that aren't reliable count as excluded only. Null outcomes and
    missing rivals leave their own figures out; a series without forecasts gives no row; an empty input gives none.
    """
    d = materialised(scored_rows(forecasts, series, horizon, start, end).where("first_t IS NOT NULL"))
    n_scored = d.where("scored").groupBy("id").agg(F.count(F.lit(1)).alias("n_forecasts"), F.median("step").alias("step"))
    lags = F.greatest(newey_west_lags(F.col("n_forecasts")), F.ceil(F.lit(float(max(horizon, 1))) / F.greatest(F.floor(F.coalesce("step", F.lit(1.0))), F.lit(1))).cast("int") - 1)
    n_scored = n_scored.select("id", "n_forecasts", lags.alias("mz_hac_lags"))
    ahead = F.coalesce("sigma_horizon", "sigma")
    on, z = F.col("scored"), F.col("ret") / (F.col("force") / ROOT)
    zb = F.when(on & (ahead > 0), F.col("r_h") / (ahead * (horizon / DAYS) ** 0.5))
    h_loss = lambda s: daily_loss("r_h", s * float(horizon) ** 0.5)
    ratio = F.when(on & (F.col("sigma") > 0), F.col("real") / F.col("sigma"))
    day = F.when(F.col("covered"), z)
    pair = {"own_ewma": (qlike("real", "sigma"), qlike("real", "own"), on), "capm": (qlike("real", "sigma"), qlike("real", "capm"), on), "daily": (daily_loss("ret", "force"), daily_loss("ret", "own_before"), F.col("paired")), "horizon": (h_loss(ahead), h_loss(F.col("own")), on)}
    both = {k: w & a.isNotNull() & b.isNotNull() for k, (a, b, w) in pair.items()}
    mean = lambda k, i: F.avg(F.when(both[k], pair[k][i]))
    issued, usable = F.col("span"), F.col("usable")
    g = d.groupBy("id").agg(
        F.count_if(issued & ~usable).alias("n_excluded"), (F.count_if(issued & F.col("sigma").isNotNull()) / F.count_if(issued)).alias("finite_share"), (F.count_if(issued & ~F.coalesce("is_reliable", F.lit(False))) / F.count_if(issued)).alias("unreliable_share"),
        F.count_if(issued & F.coalesce("on_grid", F.lit(False))).alias("n_grid"), F.avg(ratio).alias("mean_bias"), F.median(ratio).alias("median_bias"), F.when(F.count(zb) > 2, F.stddev_samp(zb)).alias("bias_stat"),
        F.when(F.count(day) > 2, F.stddev_samp(day)).alias("z_std"), F.when(F.count(day) > 2, F.kurtosis(day)).alias("z_kurtosis"), F.avg(F.when(on, pair["own_ewma"][0])).alias("qlike"), mean("own_ewma", 1).alias("qlike_own_ewma"), mean("capm", 1).alias("qlike_capm"),
        mean("daily", 0).alias("daily_loss"), mean("daily", 1).alias("daily_loss_own_ewma"), F.count_if(both["daily"]).alias("n_days"), mean("horizon", 0).alias("horizon_loss"), mean("horizon", 1).alias("horizon_loss_own_ewma"),
        F.min(F.when(F.col("covered"), F.col("t"))).alias("sample_start"), F.max(F.when(F.col("covered"), F.col("t"))).alias("sample_end"),
    )
    losses = d.select("id", "t", F.explode(F.array(*(F.struct(F.lit(k).alias("test"), F.when(both[k], a - b).alias("x")) for k, (a, b, _) in pair.items()))).alias("v")).select("id", "t", "v.test", "v.x").where("x IS NOT NULL")
    losses = losses.join(n_scored, "id").withColumn("lags", F.when(F.col("test") == "daily", newey_west_lags(F.count("x").over(W.partitionBy("id", "test")))).otherwise(F.col("mz_hac_lags")))
    tests = equal_losses(losses.select("id", "test", "t", "x", "lags"))
    named = {"own_ewma": "own_ewma", "capm": "capm", "daily": "daily_own_ewma", "horizon": "horizon_own_ewma"}
    tests = tests.groupBy("id").agg(*(F.max(F.when(F.col("test") == k, F.col(c))).alias(f"dm_{short}_{v}") for k, v in named.items() for c, short in (("t_stat", "t"), ("p_value", "p"))))
    square = lambda c: F.pow(F.col(c), F.lit(2.0))
    mz = calibration(d.where(on & F.col("sigma").isNotNull()).join(n_scored, "id").select("id", "t", square("real").alias("y"), square("sigma").alias("x"), F.col("mz_hac_lags").alias("lags")))
    covered = d.where("covered").select("id", "t", *((F.col("ret") < -value_at_risk("force", quantile_factor(level))).alias(f"hit_{name}") for level, name in ((0.95, "95"), (0.99, "99"))))
    out = g.join(n_scored, "id", "left").fillna(0, ["n_forecasts"])
    for other in (tests, mz, coverage(covered, 0.95, "hit_95", "95"), coverage(covered, 0.99, "hit_99", "99")):
        out = out.join(other, "id", "left")
    return out


def portfolio_score(rows: DataFrame, horizon: int) -> DataFrame:
    """A row of 22 figures for each portfolio of rows (id, t, ret, sigma, sigma_horizon, own), forecasts a year made at the end of
    day t for the day after; sigma_horizon may be null, then sigma serves for the horizon too.

    Daily: spread of returns over their forecast, losses of the forecast and of `own` with a test, coverage at 95 and 99 %.
    By blocks of `horizon` scored days that don't overlap: the spread of a block's return over its forecast from the day
    before it, its band, its worst block, and the spread without that one. Null returns and days without both forecasts are
    left out, a last block that isn't full too; portfolios without scored days give no row.
    """
    d = rows.select("id", "t", "ret", F.lag("sigma").over(by()).alias("s"), F.lag("own").over(by()).alias("o"), F.lag(F.coalesce("sigma_horizon", "sigma")).over(by()).alias("ahead"))
    d = d.where("ret IS NOT NULL AND s > 0 AND o IS NOT NULL").withColumn("k", F.row_number().over(by()) - 1)
    d = materialised(d.withColumns({"block": F.floor(F.col("k") / horizon), "loss": daily_loss("ret", "s"), "loss_own": daily_loss("ret", "o"), "z": F.col("ret") / (F.col("s") / ROOT)}))
    g = d.groupBy("id").agg(F.count(F.lit(1)).alias("n_days"), F.when(F.count(F.lit(1)) > 2, F.stddev_samp("z")).alias("z_std"), F.avg("loss").alias("loss"), F.avg("loss_own").alias("loss_own_ewma"), F.avg("s").alias("mean_sigma_ann"), F.when(F.count(F.lit(1)) > 2, F.stddev_samp("ret") * ROOT).alias("realized_vol_ann"))
    n = F.count("x").over(W.partitionBy("id", "test"))
    tests = equal_losses(d.select("id", F.lit("own").alias("test"), "t", (F.col("loss") - F.col("loss_own")).alias("x")).withColumn("lags", newey_west_lags(n))).select("id", F.col("t_stat").alias("dm_t_own_ewma"), F.col("p_value").alias("dm_p_own_ewma"))
    b = d.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"), F.min_by("ahead", "t").alias("ahead"), F.min("t").alias("begin")).where((F.col("n") == horizon) & (F.col("ahead") > 0))
    b = b.withColumn("zb", F.col("total") / (F.col("ahead") * (horizon / DAYS) ** 0.5))
    m = b.groupBy("id").agg(F.count(F.lit(1)).alias("n_blocks"), F.stddev_samp("zb").alias("sd"), F.sum("zb").alias("sum"), F.sum(F.col("zb") * F.col("zb")).alias("squares"), F.max_by(F.struct("zb", "begin"), F.struct(F.abs("zb"), -F.unix_date("begin"))).alias("worst"))
    count = F.col("n_blocks")
    rest = F.when(count > 3, count - 2)
    left, left2 = F.col("sum") - F.col("worst.zb"), F.col("squares") - F.col("worst.zb") * F.col("worst.zb")
    band = F.when(count > 2, F.sqrt(2.0 / count))
    m = m.select("id", "n_blocks", F.when(count > 2, F.col("sd")).alias("bias_stat"), band.alias("bias_band"), F.when(count > 2, F.abs(F.col("sd") - 1) <= band).alias("bias_in_band"), F.when(count > 3, F.col("worst.zb")).alias("bias_worst_z"),
                 F.when(count > 3, F.col("worst.begin")).alias("bias_worst_date"), F.sqrt(F.greatest((left2 - left * left / (count - 1)) / rest, F.lit(0.0))).alias("bias_stat_ex_worst"))
    hits = d.select("id", "t", *((F.col("ret") < -value_at_risk("s", quantile_factor(level))).alias(f"hit_{name}") for level, name in ((0.95, "95"), (0.99, "99"))))
    c95 = coverage(hits, 0.95, "hit_95", "95").drop("kupiec_stat_95", "christoffersen_stat_95")
    c99 = coverage(hits, 0.99, "hit_99", "99").drop("kupiec_stat_99", "christoffersen_stat_99", "christoffersen_p_99")
    out = g
    for other in (tests, c95, c99, m):
        out = out.join(other, "id", "left")
    return out
