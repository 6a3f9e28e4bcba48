"""Transforms, factors, covariances, attribution and scores over the driver's tables, each with a SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import bonds as bd
from tidemark.operators import covariance as cv
from tidemark.operators import distribution as ds
from tidemark.operators import factors as fa
from tidemark.operators import scores as sc
from tidemark.operators import series as s
from tidemark.plans.panel import MARKET, RETURNS, query, returns, rnd, sql_rnd, with_market
from tidemark.plans.relational import read

LEVELS = """
dl AS (SELECT p_type AS id, date_trunc('week', l_shipdate)::DATE AS t, avg(l_discount) * 100 AS value, avg(l_tax) * 100 AS cash FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def levels(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("p_type").alias("id"), F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.avg("l_discount") * 100).alias("value"), (F.avg("l_tax") * 100).alias("cash"))


@query("""SELECT p_partkey, round(CASE WHEN y = 0 THEN m ELSE (1 - power(1 + y / 2, -2 * m)) / y END, 8) AS duration,
round(CASE WHEN y = 0 THEN m * (m + 0.5) ELSE greatest(0, 2 * (1 - power(1 + y / 2, -2 * m)) / (y * y) - 2 * m * power(1 + y / 2, -2 * m - 1) / y) END, 8) AS convexity,
round(CASE WHEN y = 0 THEN m ELSE (1 - power(1 + y, -m)) / y END, 8) AS annual FROM (SELECT p_partkey, p_size::DOUBLE AS m, (p_partkey % 8) / 100.0::DOUBLE AS y FROM part)""")
def bond_arithmetic(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("m"), (F.col("p_partkey") % 8 / F.lit(100.0)).alias("y"))
    return p.select("p_partkey", F.round(bd.par_duration("m", "y"), 8).alias("duration"), F.round(bd.par_convexity("m", "y"), 8).alias("convexity"), F.round(bd.annual_duration("m", "y"), 8).alias("annual"))


@query(f"""WITH {LEVELS}, k AS (SELECT id, t, value / 100 AS y, lag(value / 100) OVER w AS b, lag(cash) OVER w AS c FROM dl WINDOW w AS (PARTITION BY id ORDER BY t)),
x AS (SELECT *, (1 - power(1 + b / 2, -20)) / b AS dur, 2 * (1 - power(1 + b / 2, -20)) / (b * b) - 20 * power(1 + b / 2, -21) / b AS cvx FROM k)
SELECT id, t, round(-dur * (y - b) + 0.5 * cvx * power(y - b, 2) + (b - c / 100) / 252, 8) AS ret, round(-5 * (y - b) + b / 252, 8) AS spread_ret FROM x""")
def yield_returns(spark, sf_dir):
    d = levels(spark, sf_dir).withColumn("y", F.col("value") / 100)
    return d.select("id", "t", F.round(bd.yield_change_return("y", 10.0, "cash"), 8).alias("ret"), F.round(bd.spread_change_return("y", 5.0), 8).alias("spread_ret"))


@query(f"""WITH {LEVELS}, k AS (SELECT id, t, value, value - lag(value) OVER w AS d, CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN ln(value) - ln(lag(value) OVER w) END AS ld FROM dl WINDOW w AS (PARTITION BY id ORDER BY t)),
z AS (SELECT *, CASE WHEN count(d) OVER f >= 12 AND stddev_samp(d) OVER f > 0 THEN d / stddev_samp(d) OVER f END AS z FROM k WINDOW f AS (PARTITION BY id ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
SELECT id, t, {sql_rnd('d', 'ld', 'z')} FROM z""")
def level_transforms(spark, sf_dir):
    d = levels(spark, sf_dir).withColumns({"d": bd.diff("value"), "ld": bd.log_diff("value")})
    return d.withColumn("z", bd.diff_standardised("d", 52, 12)).select("id", "t", *rnd("d", "ld", "z"))


@query(f"""WITH {RETURNS}, c AS (SELECT date_trunc('week', l_shipdate)::DATE AS t, avg(l_tax) * 100 AS cash FROM lineitem GROUP BY 1), j AS (SELECT r.id, r.t, ret, c.cash FROM r LEFT JOIN c USING (t)),
e AS (SELECT id, t, ret - lag(cash) OVER (PARTITION BY id ORDER BY t) / 100 / 252 AS x FROM j), q AS (SELECT id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM e GROUP BY id)
SELECT e.id, t, round(x, 8) AS excess, CASE WHEN x IS NOT NULL THEN round(least(greatest(x, lo), hi), 8) END AS clipped FROM e JOIN q ON e.id = q.id""")
def excess_and_winsorised(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.avg("l_tax") * 100).alias("cash"))
    e = returns(spark, sf_dir).join(c, "t", "left").select("id", "t", bd.excess_return("ret", "cash").alias("x"))
    q = e.groupBy("id").agg(F.percentile("x", 0.05).alias("lo"), F.percentile("x", 0.95).alias("hi"))
    # least and greatest skip nulls, a missing return stays missing.
    return e.join(q, "id").select("id", "t", F.round("x", 8).alias("excess"), F.when(F.col("x").isNotNull(), F.round(bd.winsorised("x", "lo", "hi"), 8)).alias("clipped"))


@query("""WITH c AS (SELECT p_brand AS id, l_shipdate::DATE AS t, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1, 2),
days AS (SELECT DISTINCT l_shipdate::DATE AS t FROM lineitem), g AS (SELECT i.id, d.t, c.v FROM (SELECT DISTINCT id FROM c) i CROSS JOIN days d LEFT JOIN c ON c.id = i.id AND c.t = d.t),
o AS (SELECT *, v - lag(v) OVER (PARTITION BY id ORDER BY t) AS d FROM g WHERE v IS NOT NULL),
z AS (SELECT id, t, CASE WHEN count(d) OVER f >= 12 AND stddev_samp(d) OVER f > 0 THEN d / stddev_samp(d) OVER f END AS z FROM o WINDOW f AS (PARTITION BY id ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
b AS (SELECT id, min(t) AS begun FROM z WHERE z IS NOT NULL GROUP BY id)
SELECT g.id, g.t, CASE WHEN g.t >= begun THEN round(coalesce(z, 0), 6) END AS value FROM g LEFT JOIN z ON g.id = z.id AND g.t = z.t LEFT JOIN b ON b.id = g.id""")
def sparse_release(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    c = li.join(read(spark, sf_dir, "part").where("p_size = 7"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("id"), F.to_date("l_shipdate").alias("t")).agg(F.sum("l_extendedprice").alias("value"))
    grid = c.select("id").distinct().crossJoin(F.broadcast(li.select(F.to_date("l_shipdate").alias("t")).distinct()))
    return fa.sparse_change(grid.join(c, ["id", "t"], "left")).select("id", "t", *rnd("value"))


_LEGS = "('Brand#1', 'Brand#2', 'Brand#3')", "('Brand#4', 'Brand#5')"


@query(f"""WITH {RETURNS}, f AS (SELECT 'basket' AS factor_id, t, avg(ret) FILTER (id IN {_LEGS[0]}) - avg(ret) FILTER (id IN {_LEGS[1]}) AS value FROM r WHERE id IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') GROUP BY t
UNION ALL SELECT 'spread', t, max(ret) FILTER (id = 'Brand#1') - max(ret) FILTER (id = 'Brand#2') FROM r WHERE id IN ('Brand#1', 'Brand#2') GROUP BY t UNION ALL SELECT 'single', t, -ret FROM r WHERE id = 'Brand#9'),
s AS (SELECT factor_id, stddev_samp(value) * sqrt(252) AS sd FROM f GROUP BY 1) SELECT factor_id, t, round(value * 0.1 / sd, 6) AS value FROM f JOIN s USING (factor_id)""")
def plain_factors(spark, sf_dir):
    p = fa.Panels(returns(spark, sf_dir).select("id", "t", "ret"))
    recipes = [fa.Recipe("spread", "spread", {"long": "Brand#1", "short": "Brand#2"}, 1), fa.Recipe("basket", "basket", {"long": ["Brand#1", "Brand#2", "Brand#3"], "short": ["Brand#4", "Brand#5"]}), fa.Recipe("single", "single", {"id": "Brand#9", "sign": -1})]
    return fa.rescaled(fa.build(p, recipes), 0.1).select("factor_id", "t", *rnd("value"))


@query(f"""WITH {RETURNS}, k AS (SELECT id, t, ret, CASE WHEN count(ret) OVER lk = 26 THEN sign(sum(ret) OVER lk) END AS s, CASE WHEN count(ret) OVER v >= 6 THEN stddev_samp(ret) OVER v END AS sd, CASE WHEN count(ret) OVER lk = 26 THEN sum(ret) OVER lk END AS m FROM r
WINDOW lk AS (PARTITION BY id ORDER BY t ROWS BETWEEN 29 PRECEDING AND 4 PRECEDING), v AS (PARTITION BY id ORDER BY t ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, CASE WHEN ret IS NOT NULL AND sd > 0 THEN s / sd END AS w FROM k), x AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY m NULLS LAST) AS rk, count(m) OVER (PARTITION BY t, m) AS ties, count(m) OVER (PARTITION BY t) AS n FROM w),
y AS (SELECT *, CASE WHEN m IS NOT NULL THEN (rk + (ties - 1) / 2.0) / n END AS share FROM x)
SELECT t, round(sum(w * ret) / nullif(sum(abs(w)), 0), 6) AS tsmom, round(avg(ret) FILTER (share > 2 / 3.0) - avg(ret) FILTER (share < 1 / 3.0), 6) AS xs FROM y GROUP BY t""")
def momentum_factors(spark, sf_dir):
    p = fa.Panels(returns(spark, sf_dir).select("id", "t", "ret"))
    a = fa.tsmom(p, {"skip": 4, "span": 26, "vol": 13}).withColumnRenamed("value", "tsmom")
    b = fa.xs_momentum(p, {"skip": 4, "span": 26}).withColumnRenamed("value", "xs")
    return a.join(b, "t").select("t", *rnd("tsmom", "xs"))


@query(f"""WITH {LEVELS}, d AS (SELECT id, t, -(value - lag(value) OVER (PARTITION BY id ORDER BY t)) / 100 AS d FROM dl), k AS (SELECT t, max(d) FILTER (id = 'ECONOMY') AS a, max(d) FILTER (id = 'SMALL') AS b, max(d) FILTER (id = 'LARGE') AS c FROM d WHERE id IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY t)
SELECT t, round((a + b + c) / 3 * 5, 8) AS level, round((c - a) * 5, 8) AS slope, round((2 * b - a - c) * 5, 8) AS curvature FROM k""")
def curve_shapes(spark, sf_dir):
    p = fa.Panels(None, levels(spark, sf_dir))
    out = None
    for shape in ("level", "slope", "curvature"):
        x = fa.curve(p, {"tenors": ["ECONOMY", "SMALL", "LARGE"], "shape": shape}).select("t", F.round("value", 8).alias(shape))
        out = x if out is None else out.join(x, "t")
    return out


@query(f"""WITH {MARKET}, v AS (SELECT date_trunc('week', l_shipdate)::DATE AS t, avg(l_discount) * 400 AS v FROM lineitem GROUP BY 1), l AS (SELECT t, lag(v) OVER (ORDER BY t) AS v FROM v) SELECT t, round(power(v / 100, 2) / 252 - power(mkt, 2), 10) AS value FROM m JOIN l USING (t)""")
def variance_premium(spark, sf_dir):
    m = s.market_returns(spark, sf_dir).select(F.lit("m").alias("id"), "t", F.col("mkt").alias("ret"))
    v = read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.avg("l_discount") * 400).alias("value")).withColumn("id", F.lit("v"))
    return fa.variance_premium(fa.Panels(m, v), {"id": "m", "implied": "v"}).select("t", F.round("value", 10).alias("value"))


@query(f"""WITH {RETURNS}, l AS (SELECT id, max(t) AS t FROM r WHERE ret IS NOT NULL AND NOT (id = 'Brand#3' AND t > DATE '2001-10-15') AND NOT (id = 'Brand#4' AND t > DATE '2000-01-01') GROUP BY id), c AS (SELECT t, row_number() OVER (ORDER BY t) AS pos FROM (SELECT DISTINCT t FROM r)), lp AS (SELECT l.id, c.t, pos FROM l JOIN c USING (t))
SELECT min(t) AS as_of FROM lp WHERE pos >= (SELECT max(pos) FROM lp) - 4""")
def common_as_of(spark, sf_dir):
    r = returns(spark, sf_dir)
    cut = F.when((F.col("id") == "Brand#3") & (F.col("t") > "2001-10-15") | (F.col("id") == "Brand#4") & (F.col("t") > "2000-01-01"), None).otherwise(F.col("ret"))
    return fa.common_as_of(r.select(F.col("id").alias("factor_id"), "t", cut.alias("value")), r.select("t"), 4)


@query(f"""WITH {MARKET}, b AS (SELECT id, regr_slope(ret, mkt) AS b FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY id), c AS (SELECT id, avg(ret) AS my, avg(mkt) AS mx FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY id)
SELECT rm.id, t, round(ret - my - b * (mkt - mx), 6) AS resid FROM rm JOIN b ON b.id = rm.id JOIN c ON c.id = rm.id""")
def residualise_one(spark, sf_dir):
    d = with_market(spark, sf_dir)
    both = d.where("ret IS NOT NULL AND mkt IS NOT NULL")
    k = both.groupBy("id").agg(F.regr_slope("ret", "mkt").alias("b"), F.regr_intercept("ret", "mkt").alias("a"))
    return d.join(k, "id").select("id", "t", F.round(F.col("ret") - F.col("a") - F.col("b") * F.col("mkt"), 6).alias("resid"))


@query(f"""WITH {MARKET} SELECT id, count(*) AS n, round(regr_slope(ret, mkt), 6) AS beta, round(regr_intercept(ret, mkt) * 52, 6) AS alpha, round(regr_r2(ret, mkt), 6) AS r2,
(count(*) >= 100)::INT + (regr_r2(ret, mkt) > 0.02)::INT + (abs(regr_slope(ret, mkt)) < 3)::INT AS quality FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY id""")
def regress_by_id(spark, sf_dir):
    g = with_market(spark, sf_dir).where("ret IS NOT NULL AND mkt IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "mkt").alias("beta"), (F.regr_intercept("ret", "mkt") * 52).alias("alpha"), F.regr_r2("ret", "mkt").alias("r2"))
    return g.select("id", "n", *rnd("beta", "alpha", "r2"), ((F.col("n") >= 100).cast("int") + (F.col("r2") > 0.02).cast("int") + (F.abs("beta") < 3).cast("int")).alias("quality"))


@query(f"""WITH {MARKET}, y AS (SELECT p_brand AS id, (extract(year FROM l_shipdate))::INT AS w, p_type AS f, avg(l_discount) * 10 AS beta FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
e AS (SELECT id, w, lag(w) OVER (PARTITION BY id ORDER BY w) AS b FROM (SELECT DISTINCT id, w FROM y))
SELECT a.id, a.w AS window_end, count(*) AS overlap, round(sum(abs(a.beta - c.beta)), 6) AS l1, round(corr(a.beta, c.beta), 6) AS corr FROM y a JOIN e ON e.id = a.id AND e.w = a.w JOIN y c ON c.id = a.id AND c.w = e.b AND c.f = a.f GROUP BY a.id, a.w""")
def beta_stability(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    y = d.groupBy(F.col("p_brand").alias("id"), F.year("l_shipdate").alias("window_end"), F.col("p_type").alias("factor")).agg((F.avg("l_discount") * 10).alias("beta"))
    return sc.beta_stability(y).select("id", "window_end", "overlap", *rnd("l1", "corr"))


_EMB = "e AS (SELECT vec_id AS t, generate_subscripts(embedding, 1) AS id, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def embedding_panel(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "v"))
    return e.select("t", (F.col("i") + 1).cast("long").alias("id"), F.col("v").cast("double").alias("x"))


@query(f"""WITH {_EMB} SELECT a.id AS i, b.id AS j, round(covar_samp(a.x, b.x) * 252, 6) AS cov, round(corr(a.x, b.x), 6) AS corr FROM e a JOIN e b ON a.t = b.t AND a.id <= b.id GROUP BY 1, 2""")
def cov_pairs(spark, sf_dir):
    return cv.sample(embedding_panel(spark, sf_dir)).select("i", "j", *rnd("cov", "corr"))


def type_returns(spark, sf_dir):
    p = s.weekly_prices(spark, sf_dir, "p_type")
    return p.withColumn("ret", s.log_return()).select("id", "t", "ret")


TYPES = """
tp AS (SELECT p_type AS id, date_trunc('week', l_shipdate)::DATE AS t, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
tr AS (SELECT id, t, ln(price / lag(price) OVER (PARTITION BY id ORDER BY t)) AS x FROM tp), tk AS (SELECT count(DISTINCT id) AS k FROM tr WHERE x IS NOT NULL),
td AS (SELECT t FROM tr, tk WHERE x IS NOT NULL GROUP BY t HAVING count(*) = any_value(k)), d AS (SELECT tr.* FROM tr JOIN td USING (t) WHERE x IS NOT NULL),
o AS (SELECT t, row_number() OVER (ORDER BY t DESC) - 1 AS age, row_number() OVER (ORDER BY t) AS pos FROM td)"""


@query(f"""WITH {TYPES}, w AS (SELECT t, power(0.5, age / 26.0) / (SELECT sum(power(0.5, age / 26.0)) FROM o) AS w FROM o), m AS (SELECT id, sum(w * x) AS m FROM d JOIN w USING (t) GROUP BY id)
SELECT a.id AS i, b.id AS j, round(sum(w * (a.x - ma.m) * (b.x - mb.m)) / (1 - (SELECT sum(w * w) FROM w)) * 252, 6) AS cov
FROM d a JOIN d b ON a.t = b.t AND a.id <= b.id JOIN w ON w.t = a.t JOIN m ma ON ma.id = a.id JOIN m mb ON mb.id = b.id GROUP BY 1, 2""")
def ewma_cov_pairs(spark, sf_dir):
    return cv.ewma(cv.complete(type_returns(spark, sf_dir)), 26.0).select("i", "j", *rnd("cov"))


@query(f"""WITH {TYPES}, m AS (SELECT id, avg(x) AS m FROM d GROUP BY id), c AS (SELECT d.id, pos, x - m AS u FROM d JOIN m ON m.id = d.id JOIN o ON o.t = d.t)
SELECT a.id AS i, b.id AS j, round(avg(a.u * b.u) * 252, 6) AS cov FROM c a JOIN c b ON b.pos = a.pos - 1 GROUP BY 1, 2""")
def lagged_autocov_pairs(spark, sf_dir):
    return cv.lagged(cv.complete(type_returns(spark, sf_dir)), 1).select("i", "j", *rnd("cov"))


@query(f"""WITH {TYPES}, m AS (SELECT id, avg(x) AS m FROM d GROUP BY id), c AS (SELECT d.id, pos, x - m AS u FROM d JOIN m ON m.id = d.id JOIN o ON o.t = d.t), s AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS v FROM d a JOIN d b USING (t) GROUP BY 1, 2),
l AS (SELECT a.id AS i, b.id AS j, a.pos - b.pos AS lag, avg(a.u * b.u) * 252 AS g FROM c a JOIN c b ON a.pos - b.pos BETWEEN 1 AND 2 GROUP BY 1, 2, 3)
SELECT s.i, s.j, round(v + coalesce((SELECT sum((1 - lag / 4.0) * g) FROM l WHERE l.i = s.i AND l.j = s.j), 0) + coalesce((SELECT sum((1 - lag / 4.0) * g) FROM l WHERE l.i = s.j AND l.j = s.i), 0), 6) AS cov FROM s WHERE s.i <= s.j""")
def horizon_cov_pairs(spark, sf_dir):
    return cv.horizon(cv.complete(type_returns(spark, sf_dir)), 2, 4).select("i", "j", *rnd("cov"))


_BETAS = "b AS (SELECT DISTINCT id, 0.2 + length(id) / 20.0 AS beta, left(id, 1) AS block FROM d)"


def _betas(d):
    return d.select("id").distinct().select("id", (F.lit(0.2) + F.length("id") / F.lit(20.0)).cast("double").alias("beta"), F.left("id", F.lit(1)).alias("block"))


@query(f"""WITH {TYPES}, {_BETAS}, s AS (SELECT a.id AS i, c.id AS j, covar_samp(a.x, c.x) * 252 AS v FROM d a JOIN d c USING (t) GROUP BY 1, 2), m AS (SELECT s.i AS id, sum(v * beta) AS sb FROM s JOIN b ON b.id = s.j GROUP BY 1), z AS (SELECT sqrt(sum(beta * sb)) AS sigma FROM b JOIN m USING (id))
SELECT id, round(beta, 6) AS beta, round(sb / sigma, 6) AS mctr, round(beta * sb / sigma, 6) AS ctr FROM b JOIN m USING (id), z""")
def euler_factor(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    return cv.contributions(cv.full(cv.sample(d).select("i", "j", "cov")), _betas(d).drop("block")).select("id", *rnd("beta", "mctr", "ctr"))


@query(f"""WITH {TYPES}, {_BETAS}, s AS (SELECT a.id AS i, c.id AS j, covar_samp(a.x, c.x) * 252 AS v FROM d a JOIN d c USING (t) GROUP BY 1, 2), g AS (SELECT p.block AS block_i, q.block AS block_j, sum(p.beta * v * q.beta) AS variance FROM s JOIN b p ON p.id = s.i JOIN b q ON q.id = s.j GROUP BY 1, 2)
SELECT block_i, block_j, round(variance, 6) AS variance, round(variance / (SELECT sum(variance) FROM g), 6) AS share FROM g""")
def euler_block(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    b = _betas(d)
    return cv.block_variance(cv.full(cv.sample(d).select("i", "j", "cov")), b.drop("block"), b.select("id", "block")).select("block_i", "block_j", *rnd("variance", "share"))


@query(f"""WITH {TYPES}, h AS (SELECT n_name AS p, t.id, (row_number() OVER (PARTITION BY n_name ORDER BY t.id) + n_nationkey)::DOUBLE / 100 AS beta FROM nation CROSS JOIN (SELECT DISTINCT id FROM d) t), s AS (SELECT a.id AS i, c.id AS j, covar_samp(a.x, c.x) * 252 AS v FROM d a JOIN d c USING (t) GROUP BY 1, 2)
SELECT a.p AS portfolio, round(sqrt(sum(a.beta * v * c.beta)), 6) AS vol FROM s JOIN h a ON a.id = s.i JOIN h c ON c.id = s.j AND c.p = a.p GROUP BY 1""")
def portfolio_vol(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("portfolio"), "n_nationkey")
    h = n.crossJoin(F.broadcast(d.select("id").distinct())).select("portfolio", "id", ((F.row_number().over(W.partitionBy("portfolio").orderBy("id")) + F.col("n_nationkey")) / F.lit(100.0)).alias("beta"))
    return cv.quadratic(cv.full(cv.sample(d).select("i", "j", "cov")), h, "portfolio").select("portfolio", F.round(F.sqrt("variance"), 6).alias("vol"))


FORECAST = f"""{MARKET}, k AS (SELECT id, t, ret, mkt, CASE WHEN count(ret) OVER w >= 13 THEN stddev_samp(ret) OVER w * sqrt(252) END AS sig, CASE WHEN count(ret) OVER v >= 26 THEN stddev_samp(ret) OVER v * sqrt(252) END AS slow,
CASE WHEN count(*) OVER f = 4 AND count(ret) OVER f >= 2 THEN stddev_samp(ret) OVER f * sqrt(252) END AS real FROM rm
WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY id ORDER BY t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""


def forecasts(spark, sf_dir):
    """Trailing volatilities that end the row before, and what came after."""
    root = F.sqrt(F.lit(252.0))
    w, v = s.by().rowsBetween(-26, -1), s.by().rowsBetween(-52, -1)
    return with_market(spark, sf_dir).withColumns({"sig": F.when(F.count("ret").over(w) >= 13, F.stddev_samp("ret").over(w) * root), "slow": F.when(F.count("ret").over(v) >= 26, F.stddev_samp("ret").over(v) * root), "real": s.forward_realised("ret", 4) * root})


@query(f"""WITH {FORECAST} SELECT id, count(*) AS n, round(avg(real / sig), 6) AS bias, round(median(real / sig), 6) AS median_bias, round(sqrt(avg(power(ln(real / sig), 2))), 6) AS rmse_log, round(avg(power(real / sig, 2) - ln(power(real / sig, 2)) - 1), 6) AS qlike FROM k WHERE real > 0 AND sig > 0 GROUP BY id""")
def bias_and_qlike(spark, sf_dir):
    return sc.bias(forecasts(spark, sf_dir), "real", "sig").select("id", "n", *rnd("bias", "median_bias", "rmse_log", "qlike"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, ret, sig, ret < -1.6448536 * sig / sqrt(252) AS hit, ret / (sig / sqrt(252)) AS z FROM k WHERE ret IS NOT NULL AND sig IS NOT NULL), g AS (SELECT id, count(*)::DOUBLE AS n, sum(hit::INT)::DOUBLE AS h, stddev_samp(z) AS sd, avg(power(ret, 2) / (sig * sig / 252) + ln(sig * sig / 252)) AS loss FROM x GROUP BY id)
SELECT id, n::BIGINT AS n, h::BIGINT AS hits, round(sd, 6) AS z_std, round(loss, 6) AS loss, CASE WHEN h > 0 AND h < n THEN round(-2 * ((n - h) * ln(0.95) + h * ln(0.05) - (n - h) * ln(1 - h / n) - h * ln(h / n)), 6) END AS lr FROM g""")
def coverage_and_loss(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("ret IS NOT NULL AND sig IS NOT NULL").withColumns({"hit": F.col("ret") < -bd.value_at_risk("sig", 1.6448536), "z": F.col("ret") / (F.col("sig") / F.sqrt(F.lit(252.0))), "l": bd.daily_loss("ret", "sig")})
    g = d.groupBy("id").agg(F.stddev_samp("z").alias("z_std"), F.avg("l").alias("loss"))
    return sc.kupiec(d, "hit", 0.05).join(g, "id").select("id", "n", "hits", *rnd("z_std", "loss", "lr"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, t, (ret < -1.2815516 * sig / sqrt(252))::INT AS h FROM k WHERE ret IS NOT NULL AND sig IS NOT NULL), hp AS (SELECT id, h, lag(h) OVER (PARTITION BY id ORDER BY t) AS b FROM x),
c AS (SELECT id, count(*) FILTER (b = 0 AND h = 0) AS n00, count(*) FILTER (b = 0 AND h = 1) AS n01, count(*) FILTER (b = 1 AND h = 0) AS n10, count(*) FILTER (b = 1 AND h = 1) AS n11 FROM hp GROUP BY id), ok AS (SELECT *, n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 AS complete FROM c)
SELECT id, n00, n01, n10, n11, CASE WHEN complete THEN round(-2 * ((n00 + n10) * ln(1 - (n01 + n11) / (n00 + n01 + n10 + n11)) + (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)) - n00 * ln(n00 / (n00 + n01)) - n01 * ln(n01 / (n00 + n01)) - n10 * ln(n10 / (n10 + n11)) - n11 * ln(n11 / (n10 + n11))), 6) END AS lr_ind FROM ok""")
def christoffersen_counts(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("ret IS NOT NULL AND sig IS NOT NULL").withColumn("hit", F.col("ret") < -bd.value_at_risk("sig", 1.2815516))
    return sc.christoffersen(d, "hit", 0.1).select("id", "n00", "n01", "n10", "n11", *rnd("lr_ind"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, t, (power(ret, 2) / (sig * sig / 252) + ln(sig * sig / 252)) - (power(ret, 2) / (slow * slow / 252) + ln(slow * slow / 252)) AS x FROM k WHERE ret IS NOT NULL AND sig > 0 AND slow > 0),
u AS (SELECT id, x - avg(x) OVER (PARTITION BY id) AS u, avg(x) OVER (PARTITION BY id) AS m, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM x),
g AS (SELECT a.id, a.i - b.i AS l, sum(a.u * b.u) AS g FROM u a JOIN u b ON a.id = b.id AND a.i - b.i BETWEEN 0 AND 4 GROUP BY 1, 2), v AS (SELECT id, sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / 5.0) * g END) AS v FROM g GROUP BY id), s AS (SELECT id, any_value(n) AS n, any_value(m) AS m FROM u GROUP BY id)
SELECT id, n, round(m, 6) AS mean, CASE WHEN n >= 10 THEN round(CASE WHEN v > 0 THEN m / sqrt(v / n / n) ELSE 0 END, 4) END AS t FROM s JOIN v USING (id)""")
def dm_stat(spark, sf_dir):
    d = forecasts(spark, sf_dir).withColumns({"a": bd.daily_loss("ret", "sig"), "b": bd.daily_loss("ret", "slow")})
    return sc.diebold_mariano(d, "a", "b", 4).select("id", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query(f"""WITH {FORECAST}, x AS (SELECT id, real * real AS y, sig * sig AS x, slow * slow AS b FROM k WHERE real IS NOT NULL AND sig IS NOT NULL AND slow IS NOT NULL)
SELECT id, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(1 - sum(power(y - x, 2)) / sum(power(y - b, 2)), 6) AS oos FROM x GROUP BY id""")
def mz_and_oos(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("real IS NOT NULL AND sig IS NOT NULL AND slow IS NOT NULL")
    o = sc.oos_r2(d.select("id", *(F.pow(c, F.lit(2.0)).alias(c) for c in ("real", "sig", "slow"))), "real", "sig", "slow").select("id", F.col("r2").alias("oos"))
    return sc.mincer_zarnowitz(d, "real", "sig").join(o, "id").select("id", "n", *rnd("slope", "intercept", "r2", "oos"))


@query("""WITH s AS (SELECT event_type AS id, count(*) AS n, min(value) AS low, max(value) AS high, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1),
b AS (SELECT *, least(greatest(ceil((high - low) / (2 * iqr / power(n, 1 / 3.0))), 20), 220)::INT AS bins FROM s), w AS (SELECT *, (high - low) / bins AS width FROM b), p AS (SELECT id, n, low, width, unnest(range(bins)) AS bin FROM w),
c AS (SELECT e.event_type AS id, least(floor((value - low) / width), bins - 1)::INT AS bin, count(*) AS c FROM events e JOIN w ON w.id = e.event_type GROUP BY 1, 2)
SELECT p.id, p.bin, round(low + p.bin * width, 6) AS from_x, coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * width), 8) AS density FROM p LEFT JOIN c ON c.id = p.id AND c.bin = p.bin""")
def fd_histogram(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("value").alias("x"))
    return ds.histogram(e).select("id", "bin", F.round("from_x", 6).alias("from_x"), "count", F.round("density", 8).alias("density"))


@query("""WITH e AS (SELECT event_type AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT id, round((i + 0.5) / n, 8) AS p, round(x, 6) AS x FROM e WHERE i % ceil(n / 500.0)::BIGINT = 0""")
def qq_points(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("value").alias("x"))
    return ds.quantile_points(e, 500).select("id", F.round("p", 8).alias("p"), F.round("x", 6).alias("x"))


@query("""WITH s AS (SELECT event_type AS id, count(*) AS n, min(value) AS low, max(value) AS high, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) / power(count(*), 0.2) AS h FROM events GROUP BY 1),
g AS (SELECT id, n, h, k AS point, low + (high - low) * k / 20.0 AS z FROM s CROSS JOIN (SELECT unnest(range(21)) AS k))
SELECT g.id, point, round(any_value(z), 4) AS "at", round(sum(exp(-0.5 * power((z - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM g JOIN events e ON e.event_type = g.id GROUP BY g.id, point""")
def kde_grid(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("value").alias("x"))
    return ds.kde(e, 21).select("id", "point", F.round("at", 4).alias("at"), F.round("density", 4).alias("density"))
