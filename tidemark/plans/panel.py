"""Queries over the weekly brand panel, each with an independent SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import series as s

PRICES = """
p AS (SELECT p_brand AS id, date_trunc('week', l_shipdate)::DATE AS t, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RETURNS = f"""{PRICES},
r AS (SELECT id, t, price, volume, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS ret FROM p WINDOW w AS (PARTITION BY id ORDER BY t))"""
MARKET = f"""{RETURNS},
mp AS (SELECT date_trunc('week', l_shipdate)::DATE AS t, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1),
m AS (SELECT t, ln(price / lag(price) OVER (ORDER BY t)) AS mkt FROM mp),
rm AS (SELECT r.id, r.t, r.ret, m.mkt FROM r JOIN m USING (t))"""
CELLS = """
days AS (SELECT DISTINCT l_shipdate::DATE AS t FROM lineitem), ids AS (SELECT DISTINCT p_brand AS id FROM part),
c AS (SELECT p_brand AS id, l_shipdate::DATE AS t, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
g AS (SELECT ids.id, days.t, c.price FROM ids CROSS JOIN days LEFT JOIN c ON c.id = ids.id AND c.t = days.t)"""


def returns(spark, sf_dir) -> DataFrame:
    return s.weekly_prices(spark, sf_dir).withColumn("ret", s.log_return())


def with_market(spark, sf_dir) -> DataFrame:
    return returns(spark, sf_dir).join(s.market_returns(spark, sf_dir), "t").select("id", "t", "ret", "mkt")


def cells(spark, sf_dir) -> DataFrame:
    """Daily brand cells on the calendar of shipping days: many are empty."""
    p = s.weekly_prices(spark, sf_dir, unit="day")
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("t")).distinct()
    # The brands are a short list and the days a calendar: their product is the grid itself.
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("id")).distinct()
    return ids.crossJoin(days).join(p.select("id", "t", "price"), ["id", "t"], "left")


def rnd(*names: str, places: int = 6) -> list:
    return [F.round(n, places).alias(n) for n in names]


def sql_rnd(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None):
    """Register a query under its function's name with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


@query(f"WITH {RETURNS} SELECT id, t, round(price, 6) AS price, round(ret, 6) AS ret FROM r")
def brand_week_returns(spark, sf_dir):
    return returns(spark, sf_dir).select("id", "t", *rnd("price", "ret"))


_DESC = ["mean_ann", "vol_ann", "skew", "kurt", "max_drawdown", "p5", "es95", "hit_rate", "best", "worst", "total", "total_simple", "downside_vol", "sharpe"]


@query(f"""WITH {RETURNS}, v AS (SELECT * FROM r WHERE ret IS NOT NULL),
c AS (SELECT id, t, ret, sum(ret) OVER (PARTITION BY id ORDER BY t) AS cum FROM v),
d AS (SELECT *, cum - greatest(max(cum) OVER (PARTITION BY id ORDER BY t), 0) AS dd FROM c),
q AS (SELECT id, quantile_cont(ret, 0.05) AS p5, avg(ret) AS mu FROM d GROUP BY id),
x AS (SELECT d.id, count(*) AS n, avg(ret) * 52 AS mean_ann, stddev_samp(ret) * sqrt(52) AS vol_ann,
  avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5) AS skew, avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) - 3 AS kurt,
  min(dd) AS max_drawdown, any_value(p5) AS p5, avg(ret) FILTER (ret <= p5) AS es95, avg((ret > 0)::INT) AS hit_rate, max(ret) AS best, min(ret) AS worst, sum(ret) AS total,
  exp(sum(ret)) - 1 AS total_simple, CASE WHEN count(*) FILTER (ret < 0) > 2 THEN stddev_samp(ret) FILTER (ret < 0) * sqrt(52) END AS downside_vol
  FROM d JOIN q USING (id) GROUP BY d.id)
SELECT id, n, {sql_rnd(*_DESC[:-1])}, round(mean_ann / vol_ann, 6) AS sharpe FROM x""")
def return_summary(spark, sf_dir):
    return s.describe(returns(spark, sf_dir), per_year=s.WEEKS).select("id", "n", *rnd(*_DESC))


@query(f"""WITH {RETURNS} SELECT id, t, {', '.join(f"round(CASE WHEN count(ret) OVER w{n} >= {max(2, n // 2)} THEN stddev_samp(ret) OVER w{n} * sqrt(52) END, 6) AS vol_{n}" for n in (13, 26, 52))}
FROM r WINDOW {', '.join(f"w{n} AS (PARTITION BY id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (13, 26, 52))}""")
def rolling_vol_multi(spark, sf_dir):
    return returns(spark, sf_dir).select("id", "t", *(F.round(s.rolling_vol("ret", n, s.WEEKS), 6).alias(f"vol_{n}") for n in (13, 26, 52)))


@query(f"""WITH {RETURNS}, c AS (SELECT id, t, sum(coalesce(ret, 0)) OVER (PARTITION BY id ORDER BY t) AS cum FROM r)
SELECT id, t, round(cum, 6) AS cum, round(exp(cum) - 1, 6) AS simple, round(cum - greatest(max(cum) OVER (PARTITION BY id ORDER BY t), 0), 6) AS drawdown FROM c""")
def drawdown(spark, sf_dir):
    return s.with_drawdown(returns(spark, sf_dir)).select("id", "t", F.round("cum", 6).alias("cum"), F.round(F.expm1("cum"), 6).alias("simple"), F.round("drawdown", 6).alias("drawdown"))


@query(f"""WITH {MARKET}, k AS (SELECT id, t, CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN ret END AS a, CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN mkt END AS b FROM rm)
SELECT id, t, round(CASE WHEN count(a) OVER w >= 13 THEN corr(a, b) OVER w END, 6) AS corr, round(CASE WHEN count(a) OVER w >= 13 THEN covar_samp(a, b) OVER w / var_samp(b) OVER w END, 6) AS beta
FROM k WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def rolling_corr_beta(spark, sf_dir):
    return with_market(spark, sf_dir).select("id", "t", F.round(s.rolling_corr("ret", "mkt", 26), 6).alias("corr"), F.round(s.rolling_beta("ret", "mkt", 26, 13), 6).alias("beta"))


@query(f"""WITH {RETURNS} SELECT id, t, round(CASE WHEN count(*) OVER f = 8 AND count(ret) OVER f >= 4 THEN stddev_samp(ret) OVER f END, 6) AS forward_vol,
round(CASE WHEN count(*) OVER f = 8 THEN sum(coalesce(ret, 0)) OVER f END, 6) AS horizon_ret,
round(CASE WHEN count(*) OVER c = 9 AND count(ret) OVER c >= 8 THEN sqrt(avg(ret * ret) OVER c) END, 6) AS centred_vol
FROM r WINDOW f AS (PARTITION BY id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), c AS (PARTITION BY id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def forward_and_centred(spark, sf_dir):
    return returns(spark, sf_dir).select("id", "t", F.round(s.forward_realised("ret", 8), 6).alias("forward_vol"), F.round(s.horizon_return("ret", 8), 6).alias("horizon_ret"), F.round(s.centred_realised("ret", 9), 6).alias("centred_vol"))


@query(f"""WITH {CELLS}, l AS (SELECT id, max(t) AS last FROM g WHERE price IS NOT NULL GROUP BY id)
SELECT g.id, g.t, round(last_value(price IGNORE NULLS) OVER (PARTITION BY g.id ORDER BY g.t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS filled_3,
round(CASE WHEN g.t <= last THEN last_value(price IGNORE NULLS) OVER (PARTITION BY g.id ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 6) AS filled_inside,
round(last_value(price IGNORE NULLS) OVER (PARTITION BY g.id ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS in_force
FROM g LEFT JOIN l ON g.id = l.id""")
def forward_fills(spark, sf_dir):
    return cells(spark, sf_dir).select("id", "t", F.round(s.ffill("price", 3), 6).alias("filled_3"), F.round(s.ffill_inside("price"), 6).alias("filled_inside"), F.round(s.in_force("price"), 6).alias("in_force"))


@query(f"""WITH {RETURNS}, k AS (SELECT id, t, ret, rank() OVER (PARTITION BY t ORDER BY ret NULLS LAST) AS rk, count(ret) OVER (PARTITION BY t, ret) AS ties, count(ret) OVER (PARTITION BY t) AS n FROM r)
SELECT id, t, CASE WHEN ret IS NOT NULL THEN round((rk + (ties - 1) / 2.0) / n, 6) END AS share FROM k""")
def pct_rank_cross_section(spark, sf_dir):
    return returns(spark, sf_dir).select("id", "t", F.round(s.rank_share("ret"), 6).alias("share"))


@query(f"""WITH {RETURNS}, b AS (SELECT id, ret, ntile(24) OVER (PARTITION BY id ORDER BY t) AS bucket FROM r WHERE ret IS NOT NULL),
k AS (SELECT id, bucket, sum(sum(ret)) OVER (PARTITION BY id ORDER BY bucket) AS cum FROM b GROUP BY id, bucket) SELECT id, bucket, round(cum, 6) AS cum FROM k""")
def ntile_sparkline(spark, sf_dir):
    return s.sparkline(returns(spark, sf_dir), 24).select("id", F.posexplode("line").alias("i", "cum")).select("id", (F.col("i") + 1).alias("bucket"), "cum")


@query(f"""WITH {RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn FROM r)
SELECT id, min(t) AS anchor, round(arg_min(price, t), 6) AS price FROM k WHERE rn <= 5 GROUP BY id""")
def anchor_rows(spark, sf_dir):
    k = returns(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("t")))).where("rn <= 5")
    return k.groupBy("id").agg(F.min("t").alias("anchor"), F.round(F.min_by("price", "t"), 6).alias("price"))


@query(f"""WITH {RETURNS}, k AS (SELECT id, avg(ret) OVER (PARTITION BY id ORDER BY t) AS mu, count(ret) OVER (PARTITION BY id ORDER BY t) AS n, t,
 lead(price, 52) OVER (PARTITION BY id ORDER BY t) / price AS forward FROM r) SELECT id, t, CASE WHEN n >= 12 THEN round(mu, 6) END AS expanding_mean, round(forward, 6) AS forward_ratio FROM k""")
def expanding_and_lead(spark, sf_dir):
    r = returns(spark, sf_dir)
    return r.select("id", "t", F.round(F.when(F.count("ret").over(s.so_far()) >= 12, F.avg("ret").over(s.so_far())), 6).alias("expanding_mean"), F.round(F.lead("price", 52).over(s.by()) / F.col("price"), 6).alias("forward_ratio"))


@query(f"""WITH {RETURNS}, k AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY t) - 1) // 4 AS block FROM r)
SELECT id, block, min(t) AS from_t, max(t) AS to_t, round(sum(coalesce(ret, 0)), 6) AS total FROM k GROUP BY id, block HAVING count(*) = 4""")
def nonoverlapping_blocks(spark, sf_dir):
    return s.blocks(returns(spark, sf_dir), 4).select("id", "block", "from_t", "to_t", *rnd("total"))


@query(f"""WITH {RETURNS} SELECT id, last_day(t) AS month_end, round(arg_max(price, t), 6) AS close, CASE WHEN count(ret) >= 3 THEN round(sum(ret), 6) END AS ret FROM r GROUP BY 1, 2""")
def month_end_resample(spark, sf_dir):
    r = returns(spark, sf_dir)
    return r.groupBy("id", F.last_day("t").alias("month_end")).agg(F.round(F.max_by("price", "t"), 6).alias("close"), F.when(F.count("ret") >= 3, F.round(F.sum("ret"), 6)).alias("ret"))


@query("""WITH o AS (SELECT o_custkey AS id, o_orderdate::DATE AS t FROM orders), k AS (SELECT id, date_diff('day', lag(t) OVER (PARTITION BY id ORDER BY t), t) AS gap FROM o)
SELECT id, count(*) FILTER (gap > 90) AS gaps, max(gap) AS longest FROM k GROUP BY id""")
def gap_count(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("t"))
    k = o.withColumn("gap", F.datediff("t", F.lag("t").over(s.by())))
    return k.groupBy("id").agg(F.count_if(F.col("gap") > 90).alias("gaps"), F.max("gap").cast("long").alias("longest"))


@query(f"""WITH {RETURNS}, v AS (SELECT id, t, ret - avg(ret) OVER (PARTITION BY id) AS u, ret * ret - avg(ret * ret) OVER (PARTITION BY id) AS v, count(*) OVER (PARTITION BY id) AS n FROM r WHERE ret IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM v), l AS (SELECT unnest(range(1, 11)) AS lag),
z AS (SELECT id, sum(u * u) AS su, sum(v * v) AS sv FROM o GROUP BY id)
SELECT a.id, lag, round(sum(a.u * b.u) / any_value(su), 6) AS acf, round(sum(a.v * b.v) / any_value(sv), 6) AS acf_sq, round(1.96 / sqrt(any_value(a.n)), 6) AS band
FROM l, o a JOIN o b ON a.id = b.id AND b.i = a.i - lag JOIN z ON z.id = a.id GROUP BY a.id, lag""")
def acf_lags(spark, sf_dir):
    return s.acf(returns(spark, sf_dir), 10).select("id", "lag", *rnd("acf", "acf_sq", "band"))


@query(f"""WITH {RETURNS}, v AS (SELECT id, t, ret - avg(ret) OVER (PARTITION BY id) AS u, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM r WHERE ret IS NOT NULL),
k AS (SELECT a.id, a.i - b.i AS lag, sum(a.u * b.u) AS c, any_value(a.n) AS n FROM v a JOIN v b ON a.id = b.id AND a.i - b.i BETWEEN 1 AND 10 GROUP BY 1, 2),
z AS (SELECT id, sum(u * u) AS su FROM v GROUP BY id)
SELECT k.id, round(any_value(n) * (any_value(n) + 2) * sum(power(c / su, 2) / (n - lag)), 4) AS q FROM k JOIN z ON k.id = z.id GROUP BY k.id""")
def ljung_box_q(spark, sf_dir):
    return s.ljung_box(s.acf(returns(spark, sf_dir), 10), 10).select("id", *rnd("q", places=4))


@query(f"""WITH {RETURNS}, v AS (SELECT id, t, ret, avg(ret) OVER (PARTITION BY id) AS mu, count(*) OVER (PARTITION BY id) AS n FROM r WHERE ret IS NOT NULL),
k AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN sum(ret) OVER w END AS q FROM v WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN any_value(n) > 50 THEN round((sum(power(q - 5 * mu, 2)) / (5 * (any_value(n) - 4) * (1 - 5.0 / any_value(n)))) / (sum(power(ret - mu, 2)) / (any_value(n) - 1)), 6) END AS vr FROM k GROUP BY id""")
def variance_ratio(spark, sf_dir):
    return s.variance_ratio(returns(spark, sf_dir), 5).select("id", *rnd("vr"))


@query(f"""WITH {RETURNS}, k AS (SELECT id, t, ret, lag(ret) OVER w AS b, lead(ret) OVER w AS a FROM r WINDOW w AS (PARTITION BY id ORDER BY t)),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(ret) DESC NULLS LAST, t) AS rn FROM k)
SELECT id, t, round(ret, 6) AS ret, coalesce((a * ret < 0 AND abs(a + ret) <= 0.25 * abs(ret)), false) OR coalesce((b * ret < 0 AND abs(b + ret) <= 0.25 * abs(ret)), false) AS price_spike, abs(ret) > 2 AS impossible, abs(ret) > 0.5 AS large FROM x WHERE rn = 1""")
def spike_rule(spark, sf_dir):
    r = returns(spark, sf_dir).withColumns({"b": F.lag("ret").over(s.by()), "a": F.lead("ret").over(s.by())})
    x = r.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(F.abs("ret").desc_nulls_last(), "t"))).where("rn = 1")
    back = lambda c: F.coalesce((F.col(c) * F.col("ret") < 0) & (F.abs(F.col(c) + F.col("ret")) <= 0.25 * F.abs("ret")), F.lit(False))
    return x.select("id", "t", F.round("ret", 6).alias("ret"), (back("a") | back("b")).alias("price_spike"), (F.abs("ret") > 2).alias("impossible"), (F.abs("ret") > 0.5).alias("large"))


PANEL_QUERIES, PANEL_ORACLES = QUERIES, ORACLES
