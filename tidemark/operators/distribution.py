"""Shape of a series: robust scale, Freedman-Diaconis histogram, kernel density and quantile points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def scales(df: DataFrame, x: str = "x") -> DataFrame:
    """(id, n, low, high, sd, iqr, robust, bins, bandwidth)."""
    d = df.where(F.col(x).isNotNull()).groupBy("id").agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_samp(x).alias("sd"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"))
    d = d.withColumn("robust", F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.349)).otherwise(F.col("sd")))
    width = 2 * F.col("iqr") / F.pow("n", F.lit(1 / 3))
    bins = F.when(width > 0, F.ceil((F.col("high") - F.col("low")) / F.when(width > 0, width))).otherwise(20)
    return d.withColumns({"bins": F.least(F.greatest(bins, F.lit(20)), F.lit(220)).cast("int"), "bandwidth": 0.9 * F.col("robust") / F.pow("n", F.lit(0.2))})


def histogram(df: DataFrame, x: str = "x") -> DataFrame:
    """(id, bin, from_x, count, density): every bin of the range, empty ones too; the density is over all n."""
    s = scales(df, x).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    spine = s.select("id", "n", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    at = F.least(F.floor(F.try_divide(F.col(x) - F.col("low"), F.col("width"))), F.col("bins") - 1).cast("int")
    c = df.where(F.col(x).isNotNull()).join(s, "id").groupBy("id", at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    d = spine.join(c, ["id", "bin"], "left")
    return d.select("id", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from_x"), F.coalesce("count", F.lit(0)).alias("count"), F.try_divide(F.coalesce("count", F.lit(0)), F.col("n") * F.col("width")).alias("density"))


def kde(df: DataFrame, points: int, x: str = "x") -> DataFrame:
    """(id, point, at, density): Gaussian kernels on a grid. Values are counted on a fine grid of 8 cells a bandwidth first, so the
    work is grid times cells and doesn't grow with the rows."""
    s = scales(df, x).where("bandwidth > 0")
    cell = F.floor((F.col(x) - F.col("low")) / (F.col("bandwidth") / 8))
    c = df.where(F.col(x).isNotNull()).join(s, "id").groupBy("id", cell.alias("cell")).agg(F.count(F.lit(1)).alias("m"), F.avg(x).alias("x"))
    grid = s.select("id", "n", "bandwidth", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / (points - 1))).alias("point", "at"))
    d = grid.join(c, "id")
    z = (F.col("at") - F.col("x")) / F.col("bandwidth")
    return d.groupBy("id", "point").agg(F.first("at").alias("at"), F.sum(F.col("m") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))


def quantile_points(df: DataFrame, most: int, x: str = "x") -> DataFrame:
    """(id, p, x): probabilities (i + 0.5) / n and values, thinned evenly to `most` a series."""
    d = df.where(F.col(x).isNotNull()).withColumns({"i": F.row_number().over(W.partitionBy("id").orderBy(x)) - 1, "n": F.count(x).over(W.partitionBy("id"))})
    step = F.greatest(F.ceil(F.col("n") / most), F.lit(1))
    return d.where((F.col("i") % step == 0)).select("id", ((F.col("i") + 0.5) / F.col("n")).alias("p"), F.col(x).alias("x"))
