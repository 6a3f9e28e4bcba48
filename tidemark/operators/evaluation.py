"""Candidate models scored out of sample: a forecast grid with validation, embargo and test by date, all candidates of all
series fitted in one grouped pass, and their losses and replication on each part from one join of days to windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import daily_loss
from tidemark.operators.joins import asof_backward
from tidemark.operators.regression import Spec, fit
from tidemark.operators.selection import Candidate
from tidemark.operators.series import DAYS, by
from tidemark.sources.stored import materialised

#: Share of the grid that tests, and the fewest rows of a test and days of a replication.
TEST_SHARE, LEAST_TEST, LEAST_DAYS = 0.30, 24, 50


def grid(series: DataFrame, horizon: int, step: int, first: int, most_test: int = 36, least_test: int = LEAST_TEST) -> DataFrame:
    """(id, t, part): the rows of each series on which forecasts are made: every `step` rows back from the last one whose horizon is
    complete, not before row `first`. The last TEST_SHARE of them, least_test to most_test, are `test`; the ones before are
    `validation`, or `embargo` where their horizon reaches the first test row. Series with under twice least_test give nothing."""
    own = W.partitionBy("id")
    d = series.select("id", "t").withColumns({"pos": F.row_number().over(by()) - 1, "n": F.count(F.lit(1)).over(own)})
    back = F.col("n") - 1 - horizon - F.col("pos")
    d = d.where((back >= 0) & (back % step == 0) & (F.col("pos") >= first)).withColumns({"size": F.count(F.lit(1)).over(own), "from_end": F.row_number().over(own.orderBy(F.desc("t")))})
    d = d.where(F.col("size") >= 2 * least_test).withColumn("k", F.least(F.lit(most_test), F.greatest(F.lit(least_test), F.round(F.col("size") * TEST_SHARE).cast("int"))))
    d = d.withColumn("first_test", F.min(F.when(F.col("from_end") <= F.col("k"), F.col("pos"))).over(own))
    part = F.when(F.col("pos") >= F.col("first_test"), "test").when(F.col("pos") + horizon < F.col("first_test"), "validation").otherwise("embargo")
    return d.select("id", "t", part.alias("part"))


def fitted(rows: DataFrame, ends: DataFrame, candidates: list[Candidate], least: int = 60) -> DataFrame:
    """(id, candidate, window_end, names, betas, n, r2, edf, resid_vol, factor_var) of rows (id, t, y, a column a factor) at each of ends (id, t).

    A row goes to the windows of the longest candidate that hold it; there all candidates are fitted on their own last
    rows, so that a row is dealt once, however many candidates there are. factor_var is a year's, of the slopes under the
    window's own covariance. A window with under `least` complete rows gives no fit.
    """
    names = sorted({f for c in candidates for f in c.factors})
    longest = max(c.window for c in candidates)
    d = rows.select("id", "t", "y", *names).withColumn("pos", F.row_number().over(by()))
    at = d.select("id", "t", "pos").join(ends.select("id", "t"), ["id", "t"])
    places = at.select("id", F.col("t").alias("window_end"), F.explode(F.sequence(F.greatest(F.col("pos") - longest + 1, F.lit(1)), F.col("pos"))).alias("pos"))
    schema = "id string, candidate string, window_end date, names array<string>, betas array<double>, n int, r2 double, edf double, resid_vol double, factor_var double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("t"), []
        for c in candidates:
            part = pdf.tail(c.window)
            y, x = part["y"].to_numpy(float), part[list(c.factors)].to_numpy(float)
            whole = np.isfinite(y) & np.isfinite(x).all(axis=1)
            if whole.sum() < least:
                continue
            w = 0.5 ** (np.arange(len(y))[::-1] / c.half_life) if c.half_life else None
            got = fit(y, x, Spec(window=c.window, estimator=c.estimator), w)
            if got is not None:
                b = got["beta"][1:]
                v = float(b @ np.atleast_2d(np.cov(x[whole], rowvar=False)) @ b) * DAYS
                out.append((key[0], c.key(), key[1], list(c.factors), b.tolist(), got["n"], got["r2"], got["edf"], got["resid_vol"], v))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return d.join(places, ["id", "pos"]).drop("pos").groupBy("id", "window_end").applyInPandas(one, schema)


def evaluated(rows: DataFrame, candidates: list[Candidate], horizon: int, step: int, first: int, least: int = 60, most_test: int = 36, least_test: int = LEAST_TEST) -> DataFrame:
    """(id, candidate, part, n_windows, n_days, oos_r2, loss, r2, complexity) of each candidate on validation and test of each series.

    rows: (id, t, y, a column a factor). A day answers to the last window of its part that ended before it, up to 1.5
    horizons in days after the part's last one; a window sees nothing after its own end, and validation days end before the
    first test row. oos_r2 is the share of the days' squares about their mean that slopes fixed in advance explain (null
    under LEAST_DAYS days), loss the mean of r2 / s2 + ln s2 with s2 the window's forecast variance.

    Nulls in y or a factor leave the day out; a series too short for a grid, or a candidate that fits no window, gives no
    row. No candidate's result passes through the driver.
    """
    parts = materialised(grid(rows, horizon, step, first, most_test, least_test))
    fits = materialised(fitted(rows, parts.where("part <> 'embargo'"), candidates, least).join(parts.withColumnRenamed("t", "window_end"), ["id", "window_end"]))
    spans = parts.where("part <> 'embargo'").groupBy("id", "part").agg(F.min("t").alias("low"), F.max("t").alias("last"))
    cut = spans.groupBy("id").agg(F.min(F.when(F.col("part") == "test", F.col("low"))).alias("cut"))
    spans = spans.join(cut, "id")
    inside = (F.col("t") > F.col("low")) & (F.col("t") <= F.date_add("last", int(horizon * 1.5))) & ((F.col("part") == "test") | (F.col("t") < F.col("cut")))
    names = sorted({f for c in candidates for f in c.factors})
    values = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.col(n) for n in names)))
    days = rows.select("id", "t", "y", values.alias("x")).join(spans, "id").where(inside).withColumn("key", F.concat_ws("/", "id", "part"))
    ends = fits.select(F.concat_ws("/", "id", "part").alias("key"), F.col("window_end").alias("t"), "window_end").distinct()
    held = asof_backward(days.select("key", "t", "id", "part", "y", "x"), ends, "key", "t", "window_end", strict=True).where("window_end IS NOT NULL")
    d = held.join(fits.select("id", "part", "window_end", "candidate", "names", "betas", "resid_vol", "factor_var"), ["id", "part", "window_end"])
    fit_ = F.aggregate(F.zip_with("names", "betas", lambda n, b: F.get(F.array(F.col("x")[n]), 0) * b), F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("fit", fit_).where("y IS NOT NULL AND fit IS NOT NULL")
    sigma = F.sqrt(F.col("factor_var") + F.col("resid_vol") * F.col("resid_vol"))
    e = F.col("y") - F.col("fit")
    g = d.groupBy("id", "candidate", "part").agg(F.count(F.lit(1)).alias("n_days"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst"), F.avg(daily_loss("y", sigma)).alias("loss"))
    g = g.withColumn("oos_r2", F.when(F.col("n_days") >= LEAST_DAYS, 1 - F.try_divide("sse", "sst"))).drop("sse", "sst")
    own = fits.groupBy("id", "candidate", "part").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("r2").alias("r2"), F.avg("edf").alias("complexity"))
    return own.join(g, ["id", "candidate", "part"], "left").select("id", "candidate", "part", "n_windows", "n_days", "oos_r2", "loss", "r2", "complexity")
