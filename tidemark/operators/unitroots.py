"""P-values of unit-root tests from published response surfaces, as column expressions, and the test with one lag from sums."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.scores import chi2_1_tail

#: The surface of the unit-root t with a constant: polynomials whose value is a normal quantile, left and right of SPLIT, and
#: the bounds beyond which the p-value is zero or one (fixed values from the published tables).
LEFT, RIGHT, SPLIT, LEAST, MOST = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74


def normal_share(z: Column) -> Column:
    """P(normal < z), good to 1e-7."""
    tail = chi2_1_tail(z * z) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def polynomial(x: Column, c: tuple) -> Column:
    return reduce(lambda a, b: a * x + b, reversed(c), F.lit(0.0))


def unit_root_p(t: Column) -> Column:
    """P-value of a unit-root t with a constant; the corrected t of Phillips and Perron has the same distribution."""
    return F.when(t > MOST, 1.0).when(t < LEAST, 0.0).otherwise(normal_share(F.when(t <= SPLIT, polynomial(t, LEFT)).otherwise(polynomial(t, RIGHT))))


def unit_root_p_of(t: float) -> float:
    """The same of a number, for the tests that run in a kernel."""
    if t > MOST or t < LEAST:
        return float(t > MOST)
    z = reduce(lambda a, b: a * t + b, reversed(LEFT if t <= SPLIT else RIGHT), 0.0)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def one_lag(rows: DataFrame, x: str = "x") -> DataFrame:
    """(id, n, t_stat, p_value) of the augmented test with a constant and one lagged difference, from sums by series.

    rows: (id, t, x); missing values are left out before differences are taken. Null under ten rows, or where the level or
    the lagged difference doesn't move.
    """
    w = W.partitionBy("id").orderBy("t")
    d = rows.where(F.col(x).isNotNull()).select("id", "t", F.col(x).alias("x")).withColumn("before", F.lag("x").over(w)).withColumn("d", F.col("x") - F.col("before")).withColumn("d1", F.lag("d").over(w)).where("d1 IS NOT NULL")
    c = lambda a, b: F.covar_pop(a, b)
    g = d.groupBy("id").agg(F.count(F.lit(1)).alias("n"), c("before", "before").alias("a"), c("d1", "d1").alias("b"), c("before", "d1").alias("c"), c("d", "before").alias("p"), c("d", "d1").alias("q"), c("d", "d").alias("v"))
    det = F.col("a") * F.col("b") - F.col("c") * F.col("c")
    level, other = F.try_divide(F.col("b") * F.col("p") - F.col("c") * F.col("q"), det), F.try_divide(F.col("a") * F.col("q") - F.col("c") * F.col("p"), det)
    left = F.greatest(F.col("v") - level * F.col("p") - other * F.col("q"), F.lit(0.0))
    # Sums are n times these moments; of the n rows three go to the constant and the two slopes.
    se = F.sqrt(left / (F.col("n") - 3) * F.try_divide(F.col("b"), det))
    t = F.when(F.col("n") >= 10, F.try_divide(level, se))
    return g.select("id", "n", t.alias("t_stat"), unit_root_p(t).alias("p_value"))
