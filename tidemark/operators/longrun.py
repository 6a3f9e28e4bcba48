"""Long-horizon expected returns: building blocks, implied returns, blends, curves and track records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.series import by


def income_yield(total: str, price: str, span: int = 252) -> Column:
    """Growth of the total-return index over that of the price index across `span` rows, less one: what was paid out."""
    w = by()
    return F.exp(F.ln(F.col(total) / F.lag(total, span).over(w)) - F.ln(F.col(price) / F.lag(price, span).over(w))) - 1


def smoothed(df: DataFrame, x: str, n: int = 756) -> DataFrame:
    """(id, value): median of the last n values."""
    back = F.row_number().over(W.partitionBy("id").orderBy(F.desc("t")))
    return df.where(F.col(x).isNotNull()).withColumn("__b", back).where(F.col("__b") <= n).groupBy("id").agg(F.median(x).alias("value"))


def valuation_target(df: DataFrame, x: str) -> DataFrame:
    """(id, geometric, median, target): the target is the geometric mean of the two, over positive values."""
    g = df.where(F.col(x) > 0).groupBy("id").agg(F.exp(F.avg(F.ln(x))).alias("geometric"), F.median(x).alias("median"))
    return g.withColumn("target", F.sqrt(F.col("geometric") * F.col("median")))


def multiple_drift(now, target, years: float) -> Column:
    """Return a year from a multiple that goes to its target."""
    return F.pow(target / now, F.lit(1.0 / years)) - 1


def yield_drift(duration, now, target, years: float) -> Column:
    return -duration * (target - now) / years


def bond_income(y, roll, drift, loss=None) -> Column:
    out = y + roll + drift
    return out - loss if loss is not None else out


def arithmetic(geometric, vol) -> Column:
    """The one-year mean of a simple return whose compound rate is `geometric` and whose logarithm has volatility `vol`."""
    return (1 + geometric) * F.exp(vol * vol / 2) - 1


def interpolated(points: DataFrame, curve: DataFrame) -> DataFrame:
    """points (id, tenor) with the yield of the curve (id, tenor, yield) at it: linear between neighbours, flat beyond the ends."""
    c = curve.withColumnRenamed("tenor", "ct").withColumnRenamed("yield", "cy")
    d = points.join(c, "id").groupBy("id", points["tenor"])
    below = F.max(F.when(F.col("ct") <= F.col("tenor"), F.struct("ct", "cy")))
    above = F.min(F.when(F.col("ct") >= F.col("tenor"), F.struct("ct", "cy")))
    g = d.agg(below.alias("a"), above.alias("b"))
    t0, y0, t1, y1 = F.col("a.ct"), F.col("a.cy"), F.col("b.ct"), F.col("b.cy")
    between = y0 + (y1 - y0) * F.coalesce(F.try_divide(F.col("tenor") - t0, t1 - t0), F.lit(0.0))
    return g.select("id", "tenor", F.coalesce(between, y0, y1).alias("yield"))


def implied_returns(cov: DataFrame, weights: DataFrame, aversion: float) -> DataFrame:
    """(id, implied): aversion times the covariances with the portfolio (id, weight) under full pairs (i, j, cov)."""
    w = weights.select(F.col("id").alias("j"), "weight")
    return cov.join(w, "j").groupBy(F.col("i").alias("id")).agg((aversion * F.sum(F.col("cov") * F.col("weight"))).alias("implied"))


def blended(views: DataFrame, shares: dict[str, float], x: str = "value") -> DataFrame:
    """(id, value): mean of the sources' values by their shares, over the sources that have one."""
    w = F.create_map(*(v for k, s in shares.items() for v in (F.lit(k), F.lit(float(s)))))[F.col("source")]
    d = views.where(F.col(x).isNotNull()).withColumn("__w", w)
    return d.groupBy("id").agg(F.try_divide(F.sum(F.col("__w") * F.col(x)), F.sum("__w")).alias("value"))


def latest_curve(levels: DataFrame, stale_days: int = 10) -> DataFrame:
    """The newest value of each tenor (id, tenor, t, value), without tenors more than stale_days behind the newest of their curve."""
    w = W.partitionBy("id")
    d = levels.where("value IS NOT NULL").withColumn("rn", F.row_number().over(W.partitionBy("id", "tenor").orderBy(F.desc("t")))).where("rn = 1")
    return d.withColumn("newest", F.max("t").over(w)).where(F.datediff("newest", "t") <= stale_days).drop("rn", "newest")


def decade_growth(df: DataFrame, x: str, years: int = 10) -> DataFrame:
    """(id, growth, se, decades): mean and standard error of log growth a year over decades that don't overlap; annual rows."""
    d = df.withColumn("rn", F.row_number().over(by()) - 1).where(F.col("rn") % years == 0)
    d = d.withColumn("g", F.ln(F.col(x) / F.lag(x).over(by())) / years).where("g IS NOT NULL")
    return d.groupBy("id").agg(F.avg("g").alias("growth"), F.try_divide(F.stddev_samp("g"), F.sqrt(F.count("g"))).alias("se"), F.count("g").alias("decades"))


def rolldown(points: DataFrame, curve: DataFrame) -> DataFrame:
    """(id, tenor, rolldown) of points (id, tenor, duration): a year on, a bond is priced a year shorter on an unchanged curve
    (id, tenor, yield), a gain of duration times the yield's slope there; nothing up to one year."""
    here = interpolated(points.select("id", "tenor").distinct(), curve).withColumnRenamed("yield", "high")
    low = interpolated(points.select("id", (F.col("tenor") - 1).alias("tenor")).distinct(), curve).select("id", (F.col("tenor") + 1).alias("tenor"), F.col("yield").alias("low"))
    d = points.join(here, ["id", "tenor"]).join(low, ["id", "tenor"])
    return d.select("id", "tenor", F.when(F.col("tenor") <= 1, 0.0).otherwise(F.col("duration") * (F.col("high") - F.col("low"))).alias("rolldown"))


def hedged_yield(foreign, domestic_short, foreign_short):
    """A foreign yield to an investor who hedges the currency: the forward points are the difference of the short rates."""
    return F.col(foreign) + (F.col(domestic_short) - F.col(foreign_short))
