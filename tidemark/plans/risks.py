"""Queries over risk, attribution, scores, calendars and long-run returns, each with an independent SQL oracle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import covariance as cv
from tidemark.operators import factors as fa
from tidemark.operators import longrun as lr
from tidemark.operators import panels as pn
from tidemark.operators import risk as rk
from tidemark.operators import scores as sc
from tidemark.operators import series as s
from tidemark.plans.panel import RETURNS, query, returns, rnd
from tidemark.plans.quant import FORECAST, TYPES, forecasts, read, type_returns
from tidemark.sources import calendars as cal

#: Pairs of types, both orders, a year; exposures that rise with the name; blocks by kind of name.
COV = f"{TYPES}, g AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) GROUP BY 1, 2)"
BLOCKS = f"""{COV}, n AS (SELECT DISTINCT id FROM d), b AS (SELECT id, row_number() OVER (ORDER BY id) / 10.0 - 0.25 AS beta, CASE WHEN id IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'size' ELSE 'other' END AS block FROM n),
v AS (SELECT p.block AS bi, q.block AS bj, sum(p.beta * c * q.beta) AS v FROM g JOIN b p ON p.id = i JOIN b q ON q.id = j GROUP BY 1, 2), z AS (SELECT sqrt(sum(v)) AS sigma FROM v)"""


def pairs_of_types(spark, sf_dir):
    return cv.full(cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", "cov"))


def exposures(spark):
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    rows = [(n, (k + 1) / 10 - 0.25, "size" if n in ("LARGE", "MEDIUM", "SMALL") else "other") for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, beta double, block string")


@query(f"""WITH {BLOCKS} SELECT a.bi AS block, round(sqrt(max(v) FILTER (bi = bj)), 6) AS standalone, round(sum(v) / any_value(sigma), 6) AS contribution, round(sum(v) / any_value(sigma * sigma), 6) AS share, round(max(v) FILTER (bi = bj) / sum(v), 6) AS within_share FROM v a, z GROUP BY 1""")
def block_summary(spark, sf_dir):
    b = exposures(spark)
    return cv.block_summary(pairs_of_types(spark, sf_dir), b.drop("block"), b.select("id", "block")).select("block", *rnd("standalone", "contribution", "share", "within_share"))


@query(f"""WITH {BLOCKS}, s AS (SELECT sum(sqrt(v)) AS alone FROM v WHERE bi = bj) SELECT round(sigma, 6) AS sigma, round(alone, 6) AS standalone, round(sigma / alone, 6) AS ratio FROM z, s""")
def diversification(spark, sf_dir):
    b = exposures(spark)
    return cv.diversification(pairs_of_types(spark, sf_dir), b.drop("block"), b.select("id", "block")).select(*rnd("sigma", "standalone", "ratio"))


@query(f"""WITH {BLOCKS} SELECT a.bi AS block_i, a.bj AS block_j, round(a.v / sqrt(p.v * q.v), 6) AS corr FROM v a JOIN v p ON p.bi = a.bi AND p.bj = a.bi JOIN v q ON q.bi = a.bj AND q.bj = a.bj""")
def block_correlation(spark, sf_dir):
    b = exposures(spark)
    return cv.block_correlation(pairs_of_types(spark, sf_dir), b.drop("block"), b.select("id", "block")).select("block_i", "block_j", *rnd("corr"))


@query(f"""WITH {BLOCKS}, e AS (SELECT p.block AS bi, q.block AS bj, sum(c) AS v FROM g JOIN b p ON p.id = i JOIN b q ON q.id = j GROUP BY 1, 2) SELECT bi AS block, round(sqrt(max(v) FILTER (bi = bj)), 6) AS standalone, round(sum(v) / (SELECT sum(v) FROM e), 6) AS share FROM e GROUP BY 1""")
def equal_exposure_blocks(spark, sf_dir):
    return cv.equal_exposure(pairs_of_types(spark, sf_dir), exposures(spark).select("id", "block")).select("block", *rnd("standalone", "share"))


@query(f"""WITH {BLOCKS}, r AS (SELECT a.id AS i, c.id AS j, corr(a.x, c.x) AS r FROM d a JOIN d c USING (t) GROUP BY 1, 2) SELECT p.block, i AS id, round(coalesce(avg(r) FILTER (i <> j), 0), 6) AS centrality, count(*) AS size FROM r JOIN b p ON p.id = i JOIN b q ON q.id = j AND q.block = p.block GROUP BY 1, 2""")
def block_centrality(spark, sf_dir):
    c = cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", F.col("corr").alias("cov"))
    return cv.centrality(cv.full(c).withColumnRenamed("cov", "corr"), exposures(spark).select("id", "block")).select("block", "id", *rnd("centrality"), "size")


@query(f"""WITH {BLOCKS} SELECT round(0.04 / (sigma * sigma), 6) AS aversion FROM z""")
def implied_aversion(spark, sf_dir):
    return cv.implied_aversion(pairs_of_types(spark, sf_dir), exposures(spark).drop("block"), 0.04).select(*rnd("aversion"))


@query(f"""WITH {COV}, l AS (SELECT p_brand AS id, p_type AS factor, count(*) / 100.0 AS beta FROM part GROUP BY 1, 2), sp AS (SELECT p_brand AS id, avg(p_size) / 1000 AS specific FROM part GROUP BY 1)
SELECT a.id AS i, b.id AS j, round(sum(a.beta * c * b.beta) + CASE WHEN a.id = b.id THEN power(any_value(specific), 2) ELSE 0 END, 6) AS cov FROM l a JOIN g ON g.i = a.factor JOIN l b ON b.factor = g.j JOIN sp ON sp.id = a.id WHERE a.id <= b.id GROUP BY 1, 2""")
def asset_covariance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    loadings = p.groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("factor")).agg((F.count(F.lit(1)) / F.lit(100.0)).alias("beta"))
    specific = p.groupBy(F.col("p_brand").alias("id")).agg((F.avg("p_size") / 1000).alias("specific"))
    half = cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", "cov")
    return pn.asset_covariance(loadings, half, specific).select("i", "j", *rnd("cov"))


@query(f"""WITH {COV}, wt AS (SELECT t, power(0.5, age / 26.0) / sum(power(0.5, age / 26.0)) OVER () AS w FROM o), ew AS (SELECT a.id AS i, b.id AS j, (sum(w * a.x * b.x) - sum(w * a.x) * sum(w * b.x)) / (1 - sum(w * w)) * 252 AS c FROM d a JOIN d b USING (t) JOIN wt USING (t) GROUP BY 1, 2), ph AS (SELECT power(0.5, 1 / 42.0) AS phi)
SELECT i, j, round((1 - power(phi, 21)) / (21 * (1 - phi)) * ew.c + (1 - (1 - power(phi, 21)) / (21 * (1 - phi))) * g.c, 6) AS cov FROM ew JOIN g USING (i, j), ph WHERE i <= j""")
def reverting_covariance(spark, sf_dir):
    """The mean covariance of the next 21 rows when today's goes back to the long run with a half-life of 42."""
    from tidemark.functions.bonds import reversion_weight

    d = cv.complete(type_returns(spark, sf_dir))
    return pn.reverted(cv.ewma(d, 26.0), cv.sample(d), reversion_weight(42.0, 21)).select("i", "j", *rnd("cov"))


@query(f"""WITH {FORECAST} SELECT id, t, round(1.6448536269514722 * sig / sqrt(252), 6) AS var_95, round(2.3263478740408408 * sig / sqrt(252), 6) AS var_99, round(2.3378027922014113 * sig / sqrt(252), 6) AS es_975,
round(2.0150483733330233 / sqrt(5 / 3.0) * sig / sqrt(252), 6) AS t_var_95, round(3.3649299989072185 / sqrt(5 / 3.0) * sig / sqrt(252), 6) AS t_var_99 FROM k WHERE sig IS NOT NULL""")
def tail_losses(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("sig IS NOT NULL")
    t = rk.tail_losses(d.select("id", "t", "sig"), "sig", 5.0).select("id", "t", F.col("var_95").alias("t_var_95"), F.col("var_99").alias("t_var_99"))
    return rk.tail_losses(d, "sig").join(t, ["id", "t"]).select("id", "t", *rnd("var_95", "var_99", "es_975", "t_var_95", "t_var_99"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, t, sig, power(ret / (sig / sqrt(252)), 2) AS z2 FROM k) SELECT id, t, round(sig * CASE WHEN count(z2) OVER w >= 20 THEN sqrt(avg(z2) OVER w) ELSE 1 END, 6) AS sigma FROM x WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)""")
def debiased_sigma(spark, sf_dir):
    return rk.debiased(forecasts(spark, sf_dir), "ret", "sig", 52, 20).select("id", "t", F.round("sigma_debiased", 6).alias("sigma"))


@query(f"""WITH {FORECAST}, ph AS (SELECT (1 - power(0.5, 10 / 20.0)) / (10 * (1 - power(0.5, 1 / 20.0))) AS w) SELECT id, t, round(sqrt(w * sig * sig + (1 - w) * slow * slow), 6) AS sigma FROM k, ph""")
def horizon_sigma(spark, sf_dir):
    return forecasts(spark, sf_dir).select("id", "t", F.round(rk.horizon_sigma("sig", "slow", 20.0, 10), 6).alias("sigma"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, ret < -9 * sig AS hit FROM k WHERE ret IS NOT NULL AND sig IS NOT NULL) SELECT id, count(*) AS n, sum(hit::INT)::BIGINT AS hits, round(least(1, 2 * power(0.95, count(*))), 9) AS p_value FROM x GROUP BY id HAVING sum(hit::INT) = 0""")
def coverage_at_the_edge(spark, sf_dir):
    """Without a single hit the p-value is the exact binomial one."""
    d = forecasts(spark, sf_dir).where("ret IS NOT NULL AND sig IS NOT NULL").withColumn("hit", F.col("ret") < -9 * F.col("sig"))
    return sc.kupiec(d, "hit", 0.05).where("hits = 0").select("id", "n", "hits", F.round("p_value", 9).alias("p_value"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, t, real * real AS y, sig * sig AS x FROM k WHERE real IS NOT NULL AND sig IS NOT NULL), f AS (SELECT id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x GROUP BY id),
e AS (SELECT x.id, t, x, a, b, y - a - b * x AS e FROM x JOIN f ON f.id = x.id), l AS (SELECT *, e * x AS h, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e * x, 1) OVER w AS h1, lag(e * x, 2) OVER w AS h2 FROM e WINDOW w AS (PARTITION BY id ORDER BY t)),
mo AS (SELECT id, count(*) AS n, any_value(a) AS a, any_value(b) AS b, sum(x) AS sx, sum(x * x) AS sxx, sum(e * e) + 2 * (2 / 3.0) * coalesce(sum(e * e1), 0) + 2 * (1 / 3.0) * coalesce(sum(e * e2), 0) AS gg, sum(h * h) + 2 * (2 / 3.0) * coalesce(sum(h * h1), 0) + 2 * (1 / 3.0) * coalesce(sum(h * h2), 0) AS hh,
sum(e * h) + (2 / 3.0) * coalesce(sum(e * h1 + h * e1), 0) + (1 / 3.0) * coalesce(sum(e * h2 + h * e2), 0) AS gh FROM l GROUP BY id), i AS (SELECT *, sxx / (n * sxx - sx * sx) AS p, -sx / (n * sxx - sx * sx) AS q, n / (n * sxx - sx * sx) AS r FROM mo),
v AS (SELECT *, p * (p * gg + q * gh) + q * (p * gh + q * hh) AS v00, q * (q * gg + r * gh) + r * (q * gh + r * hh) AS v11, p * (q * gg + r * gh) + q * (q * gh + r * hh) AS v01 FROM i)
SELECT id, n, round(a, 6) AS intercept, round(b, 6) AS slope, round(sqrt(v00), 6) AS se_intercept, round(sqrt(v11), 6) AS se_slope, round((v11 * a * a - 2 * v01 * a * (b - 1) + v00 * (b - 1) * (b - 1)) / (v00 * v11 - v01 * v01), 4) AS wald FROM v WHERE n >= 10""")
def mincer_zarnowitz_test(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("real IS NOT NULL AND sig IS NOT NULL")
    return sc.mincer_zarnowitz_test(d, "real", "sig", 2).where("n >= 10").select("id", "n", *rnd("intercept", "slope", "se_intercept", "se_slope"), F.round("wald", 4).alias("wald"))


@query("""SELECT n, greatest(floor(4 * power(n / 100.0, 2.0 / 9))::INT, 20) AS lags FROM (SELECT DISTINCT p_size * 100 AS n FROM part)""")
def overlap_lags(spark, sf_dir):
    n = read(spark, sf_dir, "part").select((F.col("p_size") * 100).alias("n")).distinct()
    return n.select("n", sc.overlap_lags(F.col("n"), 21, 1).alias("lags"))


@query("""SELECT * FROM (VALUES (1992, 254), (1993, 253), (1994, 252), (1995, 252), (1996, 254), (1997, 253), (1998, 252)) v(year, days)""")
def calendar_sessions(spark, sf_dir):
    """Sessions of the American calendar by year, which are known."""
    d = cal.sessions(spark, "us", date(1992, 1, 1), date(1998, 12, 31))
    return d.groupBy(F.year("t").alias("year")).agg(F.count(F.lit(1)).cast("int").alias("days"))


@query("""SELECT DISTINCT o_orderdate::DATE AS t, true AS closed FROM orders WHERE isodow(o_orderdate) > 5 OR (month(o_orderdate) = 12 AND day(o_orderdate) = 25) OR (month(o_orderdate) = 1 AND day(o_orderdate) = 1)""")
def closed_days(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("t")).distinct().withColumn("calendar", cal.calendar_of(F.lit("EURUSD=X")))
    return cal.closed(d, "t", "calendar", 1990, 2010).where("is_closed").select("t", F.col("is_closed").alias("closed"))


@query(f"""WITH {RETURNS}, b AS (SELECT id, t, ret + CASE WHEN month(t) = 3 THEN 0.000001 ELSE 0 END AS ret, price FROM r), i AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY id ORDER BY t)) AS implied FROM b) SELECT id, t, round(ret, 6) AS ret, round(implied, 6) AS implied FROM i WHERE abs(ret - implied) > 1e-9""")
def broken_returns(spark, sf_dir):
    d = returns(spark, sf_dir).withColumn("ret", F.col("ret") + F.when(F.month("t") == 3, 0.000001).otherwise(0.0))
    return s.broken_returns(d).select("id", "t", *rnd("ret", "implied"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def nullable_parameter(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(s.if_given("o_orderstatus", None) & s.if_given("o_orderpriority", "1-URGENT")).select("o_orderkey")


@query(f"""WITH {RETURNS}, a AS (SELECT x.t, x.price - y.price AS v FROM r x JOIN r y ON y.t = x.t WHERE x.id = 'Brand#1' AND y.id = 'Brand#2') SELECT t, round(v - lag(v) OVER (ORDER BY t), 4) AS value FROM a""")
def spread_of_levels(spark, sf_dir):
    r = returns(spark, sf_dir)
    p = fa.Panels(r.select("id", "t", "ret"), r.select("id", "t", F.col("price").alias("value")))
    return fa.spread_level(p, {"a": "Brand#1", "b": "Brand#2", "transform": "diff"}).select("t", F.round("value", 4).alias("value"))


@query(f"""WITH {RETURNS}, c AS (SELECT date_trunc('week', o_orderdate)::DATE AS t, avg(o_totalprice) / 50000 AS cash FROM orders GROUP BY 1), a AS (SELECT x.t, x.ret + y.ret AS ret, cash FROM r x JOIN r y ON y.t = x.t LEFT JOIN c ON c.t = x.t WHERE x.id = 'Brand#1' AND y.id = 'Brand#2')
SELECT t, round(-(ret - lag(cash) OVER (ORDER BY t) / 100 / 252), 8) AS value FROM a""")
def single_in_base(spark, sf_dir):
    cash = read(spark, sf_dir, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("t")).agg((F.avg("o_totalprice") / 50000).alias("cash"))
    p = fa.Panels(returns(spark, sf_dir).select("id", "t", "ret"), None, cash)
    return fa.single(p, {"id": "Brand#1", "fx": "Brand#2", "excess": True, "sign": -1}).select("t", F.round("value", 8).alias("value"))


@query("""WITH c AS (SELECT p_brand AS id, p_size::DOUBLE AS tenor, avg(p_retailprice) / 20000 AS y FROM part WHERE p_size % 10 = 0 GROUP BY 1, 2), p AS (SELECT DISTINCT p_brand AS id, p_size::DOUBLE AS tenor FROM part WHERE p_brand IN (SELECT id FROM c)), q AS (SELECT id, tenor, tenor AS z FROM p UNION ALL SELECT id, tenor, tenor - 1 FROM p),
a AS (SELECT q.id, q.tenor, z, max(c.tenor) FILTER (c.tenor <= z) AS lo, min(c.tenor) FILTER (c.tenor >= z) AS hi FROM q JOIN c ON c.id = q.id GROUP BY 1, 2, 3),
y AS (SELECT a.id, a.tenor, z, CASE WHEN lo IS NULL THEN ch.y WHEN hi IS NULL OR hi = lo THEN cl.y ELSE cl.y + (ch.y - cl.y) * (z - lo) / (hi - lo) END AS y FROM a LEFT JOIN c cl ON cl.id = a.id AND cl.tenor = lo LEFT JOIN c ch ON ch.id = a.id AND ch.tenor = hi)
SELECT h.id, h.tenor, round(CASE WHEN h.tenor <= 1 THEN 0 ELSE 0.8 * h.tenor * (h.y - l.y) END, 8) AS rolldown FROM y h JOIN y l ON l.id = h.id AND l.tenor = h.tenor AND h.z = h.tenor AND l.z = h.tenor - 1""")
def rolldown(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_size").cast("double").alias("tenor"), "p_retailprice")
    c = p.where("tenor % 10 = 0").groupBy("id", "tenor").agg((F.avg("p_retailprice") / 20000).alias("yield"))
    points = p.select("id", "tenor").distinct().withColumn("duration", 0.8 * F.col("tenor"))
    return lr.rolldown(points, c).select("id", "tenor", F.round("rolldown", 8).alias("rolldown"))


@query("""SELECT p_partkey, round(p_size / 1000.0 + (p_retailprice / 100000 - 0.01), 8) AS hedged, round((1 + p_size / 1000.0) * exp(power(p_retailprice / 10000, 2) / 2) - 1, 8) AS arithmetic FROM part""")
def hedged_and_arithmetic(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(1000.0)).alias("f"), (F.col("p_retailprice") / 100000).alias("ds"), F.lit(0.01).alias("fs"), (F.col("p_retailprice") / 10000).alias("vol"))
    return d.select("p_partkey", F.round(lr.hedged_yield("f", "ds", "fs"), 8).alias("hedged"), F.round(lr.arithmetic(F.col("f"), F.col("vol")), 8).alias("arithmetic"))
