"""Operators over panels of series in long form: rows (id, t) with value columns, windows by rows and never by dates.

A window counts rows, so a panel is aligned to its calendar first and keeps its empty cells as nulls. Every window is
partitioned by series; panel-wide scalars come from an aggregate that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

#: Trading days and weeks in a year.
DAYS, WEEKS = 252, 52


def by(id_col: str = "id", t_col: str = "t") -> WindowSpec:
    return W.partitionBy(id_col).orderBy(t_col)


def last_rows(n: int, id_col: str = "id", t_col: str = "t") -> WindowSpec:
    """The row and the n - 1 before it."""
    return by(id_col, t_col).rowsBetween(1 - n, 0)


def next_rows(n: int, id_col: str = "id", t_col: str = "t") -> WindowSpec:
    """The n rows after the row."""
    return by(id_col, t_col).rowsBetween(1, n)


def so_far(id_col: str = "id", t_col: str = "t") -> WindowSpec:
    return by(id_col, t_col).rowsBetween(W.unboundedPreceding, 0)


def finite_or_null(x: str | Column) -> Column:
    """NaN and the infinities become null, as tables store them."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log_return(price: str = "price", w: WindowSpec | None = None) -> Column:
    """ln of the ratio to the row before; null at the start and where either price isn't positive."""
    before = F.lag(price).over(w or by())
    return F.when((F.col(price) > 0) & (before > 0), F.ln(F.col(price) / before))


def guarded_log_return(price: str, source: str) -> Column:
    """As log_return, and null where the row before came from another source."""
    same = F.lag(source).over(by()).eqNullSafe(F.col(source))
    return F.when(same, log_return(price))


def rolling(agg: Column, x: str, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null with fewer than `least` values (half of n by default, two at least)."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= (max(2, n // 2) if least is None else least), agg.over(w))


def rolling_vol(x: str, n: int, per_year: int = DAYS) -> Column:
    return rolling(F.stddev_samp(x), x, n) * F.sqrt(F.lit(float(per_year)))


def rolling_corr(x: str, y: str, n: int) -> Column:
    """Correlation over complete rows of the last n; null with under half of them or a constant side."""
    w = last_rows(n)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return F.when((F.count(a).over(w) >= max(2, n // 2)) & (spread > 1e-18), F.covar_samp(a, b).over(w) / F.nullif(spread, F.lit(0.0)))


def rolling_beta(y: str, x: str, n: int, least: int) -> Column:
    w = last_rows(n)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(a).over(w) >= least, F.try_divide(F.covar_samp(b, a).over(w), F.var_samp(a).over(w)))


def with_drawdown(df: DataFrame, x: str = "ret") -> DataFrame:
    """Adds cum (running sum, a missing return is nothing) and drawdown from its running maximum, the start counting as zero."""
    d = df.withColumn("cum", F.sum(F.coalesce(x, F.lit(0.0))).over(so_far()))
    return d.withColumn("drawdown", F.col("cum") - F.greatest(F.max("cum").over(so_far()), F.lit(0.0)))


def forward_realised(x: str, h: int) -> Column:
    """Standard deviation of the next h rows; null in the last h and with under half of them."""
    w = next_rows(h)
    return F.when((F.count(F.lit(1)).over(w) == h) & (F.count(x).over(w) >= max(2, h // 2)), F.stddev_samp(x).over(w))


def centred_realised(x: str, n: int) -> Column:
    """Root mean square around the row; null at the ends and with fewer than n - 1 values."""
    half = n // 2
    w = by().rowsBetween(-half, half)
    return F.when((F.count(F.lit(1)).over(w) == 2 * half + 1) & (F.count(x).over(w) >= n - 1), F.sqrt(F.avg(F.col(x) * F.col(x)).over(w)))


def horizon_return(x: str, h: int) -> Column:
    """Sum of the next h rows, missing ones as zero; null in the last h."""
    w = next_rows(h)
    return F.when(F.count(F.lit(1)).over(w) == h, F.sum(F.coalesce(x, F.lit(0.0))).over(w))


def ffill(x: str, limit: int | None = None) -> Column:
    w = by().rowsBetween(W.unboundedPreceding if limit is None else -limit, 0)
    return F.last(x, ignorenulls=True).over(w)


def ffill_inside(x: str, limit: int | None = None) -> Column:
    """Forward fill that never passes the series' last value."""
    last = F.max(F.when(F.col(x).isNotNull(), F.col("t"))).over(W.partitionBy("id"))
    return F.when(F.col("t") <= last, ffill(x, limit))


def in_force(x: str) -> Column:
    """The value known before the row: filled forward, then one row later."""
    return F.last(x, ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, -1))


def rank_share(x: str) -> Column:
    """Average rank among the values of the same t, over their number; ties share their mean rank."""
    w = W.partitionBy("t")
    ties = F.count(x).over(W.partitionBy("t", x))
    rank = F.rank().over(w.orderBy(F.col(x).asc_nulls_last()))
    return F.when(F.col(x).isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(w))


def describe(df: DataFrame, x: str = "ret", per_year: int = DAYS) -> DataFrame:
    """One row for each series: size, mean, volatility, Sharpe ratio, shape, drawdown, tail, hit rate, extremes and total."""
    d = with_drawdown(df.where(F.col(x).isNotNull()), x)
    p5 = d.groupBy("id").agg(F.percentile(x, 0.05).alias("p5"))
    d = d.join(p5, "id")
    root = F.sqrt(F.lit(float(per_year)))
    out = d.groupBy("id").agg(
        F.count(x).alias("n"), (F.avg(x) * per_year).alias("mean_ann"), (F.stddev_samp(x) * root).alias("vol_ann"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
        F.min("drawdown").alias("max_drawdown"), F.first("p5").alias("p5"), F.avg(F.when(F.col(x) <= F.col("p5"), F.col(x))).alias("es95"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"),
        F.max(x).alias("best"), F.min(x).alias("worst"), F.sum(x).alias("total"), F.expm1(F.sum(x)).alias("total_simple"),
        F.when(F.count(F.when(F.col(x) < 0, 1)) > 2, F.stddev_samp(F.when(F.col(x) < 0, F.col(x))) * root).alias("downside_vol"),
    )
    return out.withColumn("sharpe", F.try_divide("mean_ann", "vol_ann"))


def sparkline(df: DataFrame, points: int, x: str = "ret") -> DataFrame:
    """(id, line): the running sum of the series in `points` buckets of equally many rows, as an array."""
    b = df.where(F.col(x).isNotNull()).withColumn("bucket", F.ntile(points).over(by()))
    s = b.groupBy("id", "bucket").agg(F.sum(x).alias("s")).withColumn("cum", F.sum("s").over(so_far("id", "bucket")))
    return s.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "cum"))), lambda p: F.round(p["cum"], 6)).alias("line"))


def blocks(df: DataFrame, h: int, x: str = "ret") -> DataFrame:
    """(id, block, from_t, to_t, total) of complete blocks of h rows that don't overlap, from each series' first row."""
    d = df.withColumn("block", F.floor((F.row_number().over(by()) - 1) / F.lit(h)))
    g = d.groupBy("id", "block").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.sum(F.coalesce(x, F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("rows"))
    return g.where(F.col("rows") == h).drop("rows")


def acf(df: DataFrame, lags: int, x: str = "ret") -> DataFrame:
    """(id, lag, acf, acf_sq, band): autocorrelations of the values and of their squares, and 1.96 over the root of their number."""
    d = df.where(F.col(x).isNotNull()).select("id", "t", F.col(x).alias("x"))
    own = W.partitionBy("id")
    d = d.withColumns({"n": F.count("x").over(own), "u": F.col("x") - F.avg("x").over(own), "v": F.col("x") * F.col("x") - F.avg(F.col("x") * F.col("x")).over(own)})
    d = d.withColumn("ps", F.array(*(F.struct(F.lit(k).alias("lag"), F.lag("u", k).over(by()).alias("lu"), F.lag("v", k).over(by()).alias("lv")) for k in range(1, lags + 1))))
    d = d.select("id", "n", "u", "v", F.explode("ps").alias("p"))
    g = d.groupBy("id", "p.lag").agg(F.try_divide(F.sum(F.col("u") * F.col("p.lu")), F.sum(F.col("u") * F.col("u"))).alias("acf"), F.try_divide(F.sum(F.col("v") * F.col("p.lv")), F.sum(F.col("v") * F.col("v"))).alias("acf_sq"), F.first("n").alias("n"))
    return g.withColumn("band", F.lit(1.96) / F.sqrt("n"))


def ljung_box(correlations: DataFrame, lags: int, column: str = "acf") -> DataFrame:
    """(id, q): n (n + 2) times the sum of squared autocorrelations over n - lag."""
    term = F.col(column) * F.col(column) / (F.col("n") - F.col("lag"))
    return correlations.where(F.col("lag") <= lags).groupBy("id").agg((F.first("n") * (F.first("n") + 2) * F.sum(term)).alias("q"))


def variance_ratio(df: DataFrame, q: int, x: str = "ret") -> DataFrame:
    """(id, vr): variance of overlapping q-row sums over q times that of single rows, with the usual corrections; null unless n > 10 q."""
    own = W.partitionBy("id")
    d = df.where(F.col(x).isNotNull()).select("id", "t", F.col(x).alias("x")).withColumns({"n": F.count("x").over(own), "mu": F.avg("x").over(own)})
    w = last_rows(q)
    d = d.withColumn("s", F.when(F.count("x").over(w) == q, F.sum("x").over(w)))
    one = F.sum((F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu"))) / (F.first("n") - 1)
    many = F.sum((F.col("s") - q * F.col("mu")) * (F.col("s") - q * F.col("mu"))) / (q * (F.first("n") - q + 1) * (1 - q / F.first("n")))
    return d.groupBy("id").agg(F.when(F.first("n") > 10 * q, F.try_divide(many, one)).alias("vr"))


def weekly_prices(spark: SparkSession, sf_dir: str, key: str = "p_brand", unit: str = "week") -> DataFrame:
    """(id, t, price, volume): value per unit sold each week (or day) of each brand (or type)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", key)
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col(key).alias("id"), F.date_trunc(unit, "l_shipdate").cast("date").alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))


def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, mkt): weekly log return of the price of everything sold."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = items.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    # One row a week: the market is a single series.
    return p.select(F.lit("market").alias("id"), "t", "price").select("t", log_return().alias("mkt"))


def broken_returns(df: DataFrame, ret: str = "ret", price: str = "price", tolerance: float = 1e-9) -> DataFrame:
    """(id, t, ret, implied) of the rows whose stored log return isn't that of the prices around it, by more than the tolerance."""
    d = df.withColumn("implied", F.ln(F.col(price) / F.lag(price).over(by())))
    return d.where(F.abs(F.col(ret) - F.col("implied")) > tolerance).select("id", "t", F.col(ret).alias("ret"), "implied")


def if_given(column: str, value) -> Column:
    """Equality with a parameter, or no condition where the parameter is null."""
    return F.lit(True) if value is None else F.col(column) == value
