"""Covariances in long form: pairs (i, j) of series over their common complete rows, and what follows from them.

A pair is an equi-join of the panel with itself by date, so its cost is series squared times dates and any Spark join
strategy serves; i <= j halves it. Dense algebra that pairs can't express is in kernels.py, one small matrix a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.series import DAYS
from tidemark.sources.stored import materialised


def complete(panel: DataFrame, x: str = "ret") -> DataFrame:
    """Rows (id, t, x) of the dates on which every series has a value; stored, as what follows pairs them with each other several times."""
    d = materialised(panel.where(F.col(x).isNotNull()).select("id", "t", F.col(x).alias("x")))
    k = d.agg(F.countDistinct("id").alias("k"))
    days = d.groupBy("t").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(k)).where("n = k").select("t")
    return materialised(d.join(days, "t", "left_semi"))


def pairs(d: DataFrame, lag: int = 0) -> DataFrame:
    """(i, j, t, a, b) for i <= j, b of `lag` rows earlier; with a lag all ordered pairs."""
    a = d.select(F.col("id").alias("i"), "t", F.col("x").alias("a"))
    if not lag:
        return a.join(d.select(F.col("id").alias("j"), "t", F.col("x").alias("b")), "t").where("i <= j")
    # The dates are one list: each is mapped to the one `lag` rows before.
    order = d.select("t").distinct().withColumn("before", F.lag("t", lag).over(W.orderBy("t")))
    b = order.where("before IS NOT NULL").join(d.select(F.col("t").alias("before"), F.col("id").alias("j"), F.col("x").alias("b")), "before").select("t", "j", "b")
    return a.join(b, "t")


def sample(d: DataFrame, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov, corr)."""
    g = pairs(d).groupBy("i", "j").agg(F.covar_samp("a", "b").alias("c"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    return g.select("i", "j", (F.col("c") * per_year).alias("cov"), F.try_divide("c", F.col("sa") * F.col("sb")).alias("corr"))


def weighted(d: DataFrame, half_life: float) -> DataFrame:
    """d with w, the weight of its date: halved every half_life rows back from the newest, summing to one over the dates."""
    order = d.select("t").distinct()
    age = order.withColumn("age", F.row_number().over(W.orderBy(F.desc("t"))) - 1).withColumn("raw", F.pow(F.lit(0.5), F.col("age") / half_life))
    total = age.agg(F.sum("raw").alias("total"))
    return d.join(age.crossJoin(F.broadcast(total)).select("t", (F.col("raw") / F.col("total")).alias("w")), "t")


def ewma(d: DataFrame, half_life: float, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov): weighted deviations from weighted means, over one minus the sum of squared weights."""
    x = weighted(d, half_life)
    p = x.select(F.col("id").alias("i"), "t", "w", F.col("x").alias("a")).join(x.select(F.col("id").alias("j"), "t", F.col("x").alias("b")), "t").where("i <= j")
    s = lambda c: F.sum(F.col("w") * c)
    g = p.groupBy("i", "j").agg(s(F.col("a") * F.col("b")).alias("ab"), s(F.col("a")).alias("ma"), s(F.col("b")).alias("mb"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    return g.select("i", "j", ((F.col("ab") - F.col("ma") * F.col("mb")) / F.greatest(1 - F.col("w2"), F.lit(1e-12)) * per_year).alias("cov"))


def lagged(d: DataFrame, lag: int, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov) of i today with j `lag` rows ago, about the means of all rows."""
    mean = d.groupBy("id").agg(F.avg("x").alias("m"))
    c = d.join(mean, "id").select("id", "t", (F.col("x") - F.col("m")).alias("x"))
    return pairs(c, lag).groupBy("i", "j").agg((F.avg(F.col("a") * F.col("b")) * per_year).alias("cov"))


def horizon(d: DataFrame, lags: int, h: int, per_year: int = DAYS) -> DataFrame:
    """(i, j, cov) of h-row returns per row: the covariance plus (1 - l/h) times each lag's and its transpose, i <= j."""
    out = sample(d, per_year).select("i", "j", "cov")
    for k in range(1, min(lags, h - 1) + 1):
        one = lagged(d, k, per_year)
        both = one.select("i", "j", "cov").unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "cov")).where("i <= j")
        out = out.unionByName(both.select("i", "j", (F.col("cov") * (1 - k / h)).alias("cov")))
    return out.groupBy("i", "j").agg(F.sum("cov").alias("cov"))


def full(half: DataFrame) -> DataFrame:
    """Both triangles of i <= j pairs."""
    return half.unionByName(half.where("i < j").withColumns({"i": F.col("j"), "j": F.col("i")}))


def quadratic(cov: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(keys, variance) of each set of weights (keys, id, beta) under full pairs (i, j, cov)."""
    a = weights.select(*keys, F.col("id").alias("i"), F.col("beta").alias("bi"))
    b = weights.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("id").alias("j"), F.col("beta").alias("bj"))
    on = [a[k] == b[f"__{k}"] for k in keys]
    d = cov.join(a, "i").join(b, [cov["j"] == b["j"], *on])
    return d.groupBy(*(a[k] for k in keys)).agg(F.sum(F.col("bi") * F.col("cov") * F.col("bj")).alias("variance"))


def contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, beta, mctr, ctr) of one set of weights: marginal and Euler contributions to volatility, which sum to it."""
    m = cov.join(weights.select(F.col("id").alias("j"), F.col("beta").alias("bj")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("cov") * F.col("bj")).alias("sb"))
    d = materialised(weights.join(m, "id"))
    total = d.agg(F.sqrt(F.sum(F.col("beta") * F.col("sb"))).alias("sigma"))
    return d.crossJoin(F.broadcast(total)).select("id", "beta", F.try_divide("sb", "sigma").alias("mctr"), F.try_divide(F.col("beta") * F.col("sb"), F.col("sigma")).alias("ctr"))


def block_variance(cov: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_i, block_j, variance, share): what each pair of blocks adds to the variance."""
    w = weights.join(blocks, "id")
    a = w.select(F.col("id").alias("i"), F.col("beta").alias("bi"), F.col("block").alias("block_i"))
    b = w.select(F.col("id").alias("j"), F.col("beta").alias("bj"), F.col("block").alias("block_j"))
    # As many rows as pairs of blocks.
    g = materialised(cov.join(a, "i").join(b, "j").groupBy("block_i", "block_j").agg(F.sum(F.col("bi") * F.col("cov") * F.col("bj")).alias("variance")))
    return g.crossJoin(F.broadcast(g.agg(F.sum("variance").alias("total")))).select("block_i", "block_j", "variance", F.try_divide("variance", "total").alias("share"))


def specific(residuals: DataFrame, half_life: float, floor: float = 0.02, shrink: float = 0.0, per_year: int = DAYS) -> DataFrame:
    """(id, specific): annual volatility of residuals by exponential weights, shrunk to the cross-section's mean variance, at least `floor`."""
    age = F.row_number().over(W.partitionBy("id").orderBy(F.desc("t"))) - 1
    d = residuals.where("x IS NOT NULL").withColumn("w", F.pow(F.lit(0.5), age / half_life))
    v = d.groupBy("id").agg((F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w") * per_year).alias("v"))
    m = v.agg(F.avg("v").alias("m"))
    return v.crossJoin(F.broadcast(m)).select("id", F.greatest(F.sqrt((1 - shrink) * F.col("v") + shrink * F.col("m")), F.lit(floor)).alias("specific"))


def block_summary(cov: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, standalone, contribution, share, within_share): each block's volatility on its own, its part of the total, that
    part's share, and the share of its own variance in what it adds."""
    g = block_variance(cov, weights, blocks)
    total = g.agg(F.sqrt(F.sum("variance")).alias("sigma"))
    own = g.where("block_i = block_j").select(F.col("block_i").alias("block"), F.col("variance").alias("own"))
    d = g.groupBy(F.col("block_i").alias("block")).agg(F.sum("variance").alias("part")).join(own, "block").crossJoin(F.broadcast(total))
    return d.select("block", F.sqrt(F.greatest("own", F.lit(0.0))).alias("standalone"), F.try_divide("part", "sigma").alias("contribution"), F.try_divide(F.col("part"), F.col("sigma") * F.col("sigma")).alias("share"), F.try_divide("own", "part").alias("within_share"))


def diversification(cov: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sigma, standalone, ratio): total volatility over the sum of the blocks' own."""
    d = block_summary(cov, weights, blocks)
    return d.agg(F.sum("contribution").alias("sigma"), F.sum("standalone").alias("standalone")).withColumn("ratio", F.try_divide("sigma", "standalone"))


def block_correlation(cov: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_i, block_j, corr) of the blocks' own return streams."""
    g = block_variance(cov, weights, blocks).select("block_i", "block_j", "variance")
    own = g.where("block_i = block_j")
    d = g.join(own.select("block_i", F.col("variance").alias("vi")), "block_i").join(own.select("block_j", F.col("variance").alias("vj")), "block_j")
    return d.select("block_i", "block_j", F.try_divide(F.col("variance"), F.sqrt(F.col("vi") * F.col("vj"))).alias("corr"))


def equal_exposure(cov: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_summary with every exposure set to one."""
    return block_summary(cov, blocks.select("id", F.lit(1.0).alias("beta")), blocks)


def centrality(corr: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, id, centrality, size): mean correlation of a factor with the others of its block, zero for one alone; corr has all pairs (i, j, corr)."""
    a = blocks.select(F.col("id").alias("i"), "block")
    b = blocks.select(F.col("id").alias("j"), F.col("block").alias("other"))
    d = a.join(corr, "i").join(b, "j").where("block = other").groupBy("block", F.col("i").alias("id"))
    return d.agg(F.coalesce(F.avg(F.when(F.col("i") != F.col("j"), F.col("corr"))), F.lit(0.0)).alias("centrality"), F.count(F.lit(1)).alias("size"))


def implied_aversion(cov: DataFrame, weights: DataFrame, excess: float) -> DataFrame:
    """(aversion): that under which the weights (id, beta) are worth `excess`; null without variance."""
    v = cov.join(weights.select(F.col("id").alias("i"), F.col("beta").alias("bi")), "i").join(weights.select(F.col("id").alias("j"), F.col("beta").alias("bj")), "j").agg(F.sum(F.col("bi") * F.col("cov") * F.col("bj")).alias("v"))
    return v.select(F.when(F.col("v") > 0, F.lit(excess) / F.when(F.col("v") > 0, F.col("v"))).alias("aversion"))


def coherent(explained: str, r2: str, width: float = 0.10) -> Column:
    """Whether the share of variance that the factors explain agrees with the regression's."""
    return F.abs(F.col(explained) - F.col(r2)) <= width
