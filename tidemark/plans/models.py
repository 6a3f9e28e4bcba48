"""Kernel queries: models, risk and selection over the driver's tables; those that SQL can express have an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import covariance as cv
from tidemark.operators import kernels as k
from tidemark.operators import longrun as lr
from tidemark.operators import panels as pn
from tidemark.operators import regression as rg
from tidemark.operators import risk as rk
from tidemark.operators import selection as se
from tidemark.operators import series as s
from tidemark.operators import stationarity as st
from tidemark.plans.panel import MARKET, RETURNS, query, returns, rnd, with_market
from tidemark.plans.quant import TYPES, forecasts, read, type_returns


def wide_types(spark, sf_dir):
    """(t, one column for each part type): weekly returns."""
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return type_returns(spark, sf_dir).groupBy("t").pivot("id", names).agg(F.first("ret")), names


def design(spark, sf_dir):
    w, names = wide_types(spark, sf_dir)
    return returns(spark, sf_dir).select("id", "t", F.col("ret").alias("y")).join(w, "t"), names


@query(f"""WITH RECURSIVE {RETURNS}, v AS (SELECT id, t, ret, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM r WHERE ret IS NOT NULL), z AS (SELECT id, avg(ret * ret) AS v FROM v WHERE i <= 20 GROUP BY id),
e AS (SELECT v.id, v.i, v.t, z.v FROM v JOIN z ON z.id = v.id WHERE v.i = 20 UNION ALL SELECT v.id, v.i, v.t, power(0.5, 1 / 10.0) * e.v + (1 - power(0.5, 1 / 10.0)) * v.ret * v.ret FROM e JOIN v ON v.id = e.id AND v.i = e.i + 1)
SELECT r.id, r.t, round(sqrt(e.v * 252), 6) AS sigma FROM r LEFT JOIN e ON e.id = r.id AND e.t = r.t""")
def ewma_recursive(spark, sf_dir):
    return k.ewma_volatility(returns(spark, sf_dir), 10.0, 20).select("id", "t", *rnd("sigma"))


@query(f"""WITH {MARKET}, v AS (SELECT * FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL), l AS (SELECT id, t, ret, mkt, lag(mkt) OVER (PARTITION BY id ORDER BY t) AS m2 FROM v), c AS (SELECT * FROM l WHERE m2 IS NOT NULL),
g AS (SELECT id, count(*) AS n, covar_pop(mkt, mkt) AS a, covar_pop(m2, m2) AS b, covar_pop(mkt, m2) AS c, covar_pop(ret, mkt) AS p, covar_pop(ret, m2) AS q, avg(ret) AS my, avg(mkt) AS m1, avg(m2) AS mm FROM c GROUP BY id),
h AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS b1, (a * q - c * p) / (a * b - c * c) AS b2 FROM g)
SELECT c.id, t, round(ret - my - b1 * (mkt - m1) - b2 * (m2 - mm), 6) AS resid FROM c JOIN h ON h.id = c.id""")
def residualise_two(spark, sf_dir):
    d = with_market(spark, sf_dir).where("ret IS NOT NULL AND mkt IS NOT NULL").withColumn("m2", F.lag("mkt").over(s.by())).where("m2 IS NOT NULL")
    return rg.residuals(d, ["mkt", "m2"], "full", y="ret").select("id", "t", *rnd("resid"))


#: Slopes from rows strictly before each refit, every four rows from the 52nd on, of the last {window} rows; one that can't be fitted keeps the slope before.
REFIT = """WITH {market}, v AS (SELECT id, t, ret, mkt, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS pos FROM rm),
rp AS (SELECT id, pos AS begins FROM v WHERE pos >= 52 AND (pos - 52) % 4 = 0), rf AS (SELECT rp.id, rp.begins, CASE WHEN count(*) FILTER (ret IS NOT NULL AND mkt IS NOT NULL) >= 52 THEN regr_slope(ret, mkt) END AS b FROM rp JOIN v ON v.id = rp.id AND v.pos < rp.begins AND v.pos >= rp.begins - {window} GROUP BY rp.id, rp.begins),
rs AS (SELECT id, begins, last_value(b IGNORE NULLS) OVER (PARTITION BY id ORDER BY begins) AS b FROM rf)
SELECT v.id, v.t, round(ret - mkt * rs.b, 6) AS resid FROM v LEFT JOIN rs ON rs.id = v.id AND rs.begins = 52 + ((v.pos - 52) // 4) * 4 AND v.pos >= 52"""


@query(REFIT.format(market=MARKET, window=104))
def residualise_rolling(spark, sf_dir):
    return rg.residuals(with_market(spark, sf_dir), ["mkt"], "rolling", 104, 52, 4, y="ret").select("id", "t", *rnd("resid"))


@query(REFIT.format(market=MARKET, window=1_000_000))
def residualise_expanding(spark, sf_dir):
    return rg.residuals(with_market(spark, sf_dir), ["mkt"], "expanding", None, 52, 4, y="ret").select("id", "t", *rnd("resid"))


@query(f"""WITH {MARKET}, v AS (SELECT * FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) - 1 AS back, count(*) OVER (PARTITION BY id) AS size FROM v),
w AS (SELECT id, j, regr_slope(ret, mkt) AS beta, regr_r2(ret, mkt) AS r2, count(*) AS n, max(t) AS window_end FROM b, (SELECT unnest(range(0, 40)) AS j) WHERE back BETWEEN j * 13 AND j * 13 + 103 AND size - j * 13 >= 60 GROUP BY id, j)
SELECT id, window_end, n, round(beta, 6) AS beta, round(r2, 6) AS r2 FROM w""")
def rolling_regression_one(spark, sf_dir):
    d = with_market(spark, sf_dir).where("ret IS NOT NULL AND mkt IS NOT NULL")
    g = rg.rolling(d, ["mkt"], rg.Spec(window=104, step=13, least=60), y="ret")
    return g.select("id", "window_end", "n", *rnd("beta", "r2"))


@query(None)
def rolling_regression_hac(spark, sf_dir):
    d, names = design(spark, sf_dir)
    return rg.rolling(d, names, rg.Spec(window=104, step=26, least=60, half_life=52.0, clip=0.01))


@query(None)
def rolling_regression_huber(spark, sf_dir):
    d, names = design(spark, sf_dir)
    return rg.rolling(d, names, rg.Spec(window=156, step=52, least=60, estimator="huber", lags=1))


@query(None)
def rolling_regression_ridge(spark, sf_dir):
    d, names = design(spark, sf_dir)
    return rg.rolling(d, names, rg.Spec(window=156, step=52, least=60, estimator="ridge", ridge=0.1))


@query(None)
def stationarity_battery(spark, sf_dir):
    return st.battery(returns(spark, sf_dir), (0, 104))


@query(f"""WITH {TYPES} SELECT 'types' AS panel, a.id AS i, b.id AS j, round(covar_samp(a.x, b.x) * 252, 6) AS cov FROM d a JOIN d b ON a.t = b.t AND a.id <= b.id GROUP BY a.id, b.id""")
def sample_cov_kernel(spark, sf_dir):
    return cv.sample(cv.complete(type_returns(spark, sf_dir))).select(F.lit("types").alias("panel"), "i", "j", *rnd("cov"))


#: Shrinkage towards constant correlation, from deviations over the dates that all types share.
SHRUNK = f"""{TYPES}, y AS (SELECT id, t, x - avg(x) OVER (PARTITION BY id) AS y FROM d), mo AS (SELECT a.id AS i, b.id AS j, count(*)::DOUBLE AS n, avg(a.y * b.y) AS s, avg(a.y * a.y * b.y * b.y) AS q, avg(a.y * a.y * a.y * b.y) AS c FROM y a JOIN y b USING (t) GROUP BY 1, 2),
dg AS (SELECT i, s, sqrt(s) AS sd FROM mo WHERE i = j), mm AS (SELECT mo.*, p.sd AS si, r.sd AS sj, mo.q - mo.s * mo.s AS spread, mo.c - p.s * mo.s AS third FROM mo JOIN dg p ON p.i = mo.i JOIN dg r ON r.i = mo.j),
rb AS (SELECT avg(s / (si * sj)) AS r FROM mm WHERE i <> j), de AS (SELECT greatest(0, least(1, (sum(spread) - sum(CASE WHEN i = j THEN spread ELSE r * sj / si * third END)) / sum(CASE WHEN i <> j THEN power(r * si * sj - s, 2) ELSE 0 END) / any_value(n))) AS delta FROM mm, rb),
lw AS (SELECT i, j, delta, (delta * CASE WHEN i = j THEN s ELSE r * si * sj END + (1 - delta) * s) * n / (n - 1) * 252 AS cov FROM mm, rb, de)"""


@query(f"""WITH {SHRUNK} SELECT 'types' AS panel, i, j, round(cov, 6) AS cov, round(delta, 6) AS shrinkage FROM lw WHERE i <= j""")
def ledoit_wolf(spark, sf_dir):
    return pn.shrunk(cv.complete(type_returns(spark, sf_dir))).select(F.lit("types").alias("panel"), "i", "j", *rnd("cov", "shrinkage"))


@query(f"""WITH {SHRUNK}, wt AS (SELECT t, power(0.5, age / 26.0) / sum(power(0.5, age / 26.0)) OVER () AS w FROM o), ew AS (SELECT a.id AS i, b.id AS j, (sum(w * a.x * b.x) - sum(w * a.x) * sum(w * b.x)) / (1 - sum(w * w)) * 252 AS cov FROM d a JOIN d b USING (t) JOIN wt USING (t) GROUP BY 1, 2)
SELECT 'types' AS panel, i, j, round(0.6 * ew.cov + 0.4 * lw.cov, 6) AS cov FROM lw JOIN ew USING (i, j) WHERE i <= j""")
def blended_cov(spark, sf_dir):
    return pn.blended(cv.complete(type_returns(spark, sf_dir)), 26.0).select(F.lit("types").alias("panel"), "i", "j", *rnd("cov"))


@query(None)
def factor_pca(spark, sf_dir):
    return pn.components(cv.complete(type_returns(spark, sf_dir)), 3).select(F.lit("types").alias("panel"), "*")


@query(f"""WITH {TYPES}, g AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) GROUP BY 1, 2)
SELECT round(sum(c) FILTER (i = j), 6) AS trace, round(sqrt(sum(c * c)), 6) AS frobenius, count(DISTINCT i) AS series, true AS psd FROM g""")
def cov_diagnostics(spark, sf_dir):
    """Eigenvalue diagnostics of the sample covariance, held against its trace and the root of its squares."""
    g = pn.described(cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", "cov"))
    return g.select(F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x), 6).alias("trace"), F.round(F.sqrt(F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("frobenius"), "series", "psd")


@query(f"""WITH RECURSIVE {RETURNS}, v AS (SELECT id, t, ret, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM r WHERE ret IS NOT NULL),
e AS (SELECT id, i, t, ret, NULL::DOUBLE AS before, ret * ret AS v FROM v WHERE i = 1 UNION ALL SELECT v.id, v.i, v.t, v.ret, e.v, power(0.5, 0.1) * e.v + (1 - power(0.5, 0.1)) * v.ret * v.ret FROM e JOIN v ON v.id = e.id AND v.i = e.i + 1)
SELECT r.id, r.t, round(CASE WHEN e.i > 10 THEN abs(e.ret) / sqrt(e.before) - sqrt(2 / pi()) END, 6) AS value FROM r LEFT JOIN e ON e.id = r.id AND e.t = r.t""")
def return_surprise(spark, sf_dir):
    return k.surprise(returns(spark, sf_dir), 10.0, 10).select("id", "t", *rnd("value"))


@query(None)
def tail_degrees(spark, sf_dir):
    return k.tails(returns(spark, sf_dir).where("ret IS NOT NULL"))


def _loadings(spark, sf_dir):
    d, names = design(spark, sf_dir)
    return rg.rolling(d, names, rg.Spec(window=104, step=26, least=60))


@query(None)
def risk_forecast(spark, sf_dir):
    f = type_returns(spark, sf_dir).select("id", "t", F.col("ret").alias("x")).where("x IS NOT NULL")
    return rk.forecasts(_loadings(spark, sf_dir), returns(spark, sf_dir).select("id", "t", "ret"), f, rk.RiskSpec(window=156, half_life=26.0, specific_half_life=13.0))


@query(None)
def window_reliability(spark, sf_dir):
    return rk.reliability(_loadings(spark, sf_dir))


@query(None)
def model_confidence_set(spark, sf_dir):
    d = forecasts(spark, sf_dir)
    loss = lambda c: F.pow("ret", F.lit(2.0)) / (F.pow(c, F.lit(2.0)) / 252) + F.ln(F.pow(c, F.lit(2.0)) / 252)
    long = d.where("ret IS NOT NULL AND sig > 0 AND slow > 0").select("id", "t", F.explode(F.array(F.struct(F.lit("fast").alias("model"), loss("sig").alias("loss")), F.struct(F.lit("slow").alias("model"), loss("slow").alias("loss")), F.struct(F.lit("double").alias("model"), loss(F.col("sig") * 2).alias("loss")))).alias("x")).select("id", "t", "x.*")
    return k.model_sets(long)


@query(None)
def efficient_frontier(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    c = cv.full(cv.sample(d).select("i", "j", "cov"))
    rows = c.groupBy(F.col("i").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"]).alias("row"))
    m = d.groupBy("id").agg((F.avg("x") * 252).alias("mean"))
    return k.frontier(rows.join(m, "id").select(F.lit("types").alias("universe"), "id", "mean", "row"))


@query(None)
def simulated_band(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.col("n_name").alias("portfolio"), (F.lit(0.03) + F.col("n_nationkey") / F.lit(1000.0)).alias("mean"), (F.lit(0.08) + F.col("n_nationkey") / F.lit(200.0)).alias("vol"))
    return k.simulated(a)


@query("""WITH k AS (SELECT p_brand AS id, p_type AS model, count(*) / 20.0 AS complexity, avg(p_retailprice) AS mean_loss, avg(p_size) > 24 AS kept, count(*) % 3 = 0 AS eligible FROM part GROUP BY 1, 2),
a AS (SELECT *, bool_or(eligible) OVER (PARTITION BY id) AS ok FROM k WHERE kept), b AS (SELECT *, min(complexity) OVER (PARTITION BY id) AS least FROM a WHERE eligible OR NOT ok)
SELECT id, model, round(mean_loss, 6) AS mean_loss FROM b WHERE complexity <= least + 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY mean_loss, model) = 1""")
def parsimony(spark, sf_dir):
    m = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("model")).agg((F.count(F.lit(1)) / F.lit(20.0)).alias("complexity"), F.avg("p_retailprice").alias("mean_loss"), (F.avg("p_size") > 24).alias("kept"), (F.count(F.lit(1)) % 3 == 0).alias("eligible"))
    return se.chosen(m).select("id", "model", *rnd("mean_loss"))


@query("""WITH k AS (SELECT p_brand AS id, count(*) AS n, avg(p_size) AS a, avg(p_retailprice) AS b, min(p_size) AS c FROM part GROUP BY 1), f AS (SELECT *, (NOT a > 24)::INT + (NOT b < 950)::INT + (NOT c = 1)::INT AS fl FROM k)
SELECT id, n, fl AS flags, CASE WHEN n < 70 THEN 'INSUFFICIENT' WHEN NOT c = 1 OR fl > 2 THEN 'FAIL' WHEN fl = 0 THEN 'PASS' ELSE 'CAVEATS' END AS verdict FROM f""")
def gate_verdicts(spark, sf_dir):
    d = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.min("p_size").alias("c"))
    v = se.verdicts(d, {"size": F.col("a") > 24, "price": F.col("b") < 950, "least": F.col("c") == 1}, ["least"], 70)
    return v.select("id", "n", F.size("flags").alias("flags"), "verdict")


@query("""SELECT p_brand AS id, round(power(sum(p_retailprice), 2) / sum(p_retailprice * p_retailprice), 6) AS n_eff, sqrt(2.0 / count(*)) >= abs(avg(p_size) / 25.0 - 1) AS in_band FROM part GROUP BY 1""")
def effective_size(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), "p_retailprice", "p_size")
    b = p.groupBy("id").agg(se.in_band(F.avg("p_size") / F.lit(25.0), F.count(F.lit(1))).alias("in_band"))
    return se.effective(p, "id", "p_retailprice").join(b, "id").select("id", *rnd("n_eff"), "in_band")


@query(f"""WITH {RETURNS}, k AS (SELECT id, t, price * exp(0.0005 * row_number() OVER (PARTITION BY id ORDER BY t)) AS total, price FROM r), y AS (SELECT id, t, (total / lag(total, 52) OVER w) / (price / lag(price, 52) OVER w) - 1 AS y FROM k WINDOW w AS (PARTITION BY id ORDER BY t)),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS b FROM y WHERE y IS NOT NULL), m AS (SELECT id, median(y) AS y FROM l WHERE b <= 104 GROUP BY id), v AS (SELECT id, exp(avg(ln(price))) AS g, median(price) AS md, arg_max(price, t) AS now FROM r GROUP BY id)
SELECT m.id, round(y, 8) AS income, round(g, 4) AS geometric, round(sqrt(g * md), 4) AS target, round(power(sqrt(g * md) / now, 0.1) - 1, 8) AS drift FROM m JOIN v ON v.id = m.id""")
def return_blocks(spark, sf_dir):
    r = returns(spark, sf_dir)
    d = r.withColumn("total", F.col("price") * F.exp(0.0005 * F.row_number().over(s.by()))).withColumn("y", lr.income_yield("total", "price", 52))
    v = lr.valuation_target(r, "price").join(r.groupBy("id").agg(F.max_by("price", "t").alias("now")), "id")
    return lr.smoothed(d, "y", 104).join(v, "id").select("id", F.round("value", 8).alias("income"), F.round("geometric", 4).alias("geometric"), F.round("target", 4).alias("target"), F.round(lr.multiple_drift(F.col("now"), F.col("target"), 10), 8).alias("drift"))


@query("""WITH c AS (SELECT p_brand AS id, p_size::DOUBLE AS tenor, avg(p_retailprice) / 20000 AS y FROM part WHERE p_size % 10 = 0 GROUP BY 1, 2), p AS (SELECT DISTINCT p_brand AS id, p_size::DOUBLE AS tenor FROM part WHERE p_brand IN (SELECT id FROM c)),
a AS (SELECT p.id, p.tenor, max(c.tenor) FILTER (c.tenor <= p.tenor) AS lo, min(c.tenor) FILTER (c.tenor >= p.tenor) AS hi FROM p JOIN c ON c.id = p.id GROUP BY 1, 2)
SELECT a.id, a.tenor, round(CASE WHEN lo IS NULL THEN ch.y WHEN hi IS NULL OR hi = lo THEN cl.y ELSE cl.y + (ch.y - cl.y) * (a.tenor - lo) / (hi - lo) END, 8) AS yield FROM a LEFT JOIN c cl ON cl.id = a.id AND cl.tenor = lo LEFT JOIN c ch ON ch.id = a.id AND ch.tenor = hi""")
def interpolated_curve(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_size").cast("double").alias("tenor"), "p_retailprice")
    c = p.where("tenor % 10 = 0").groupBy("id", "tenor").agg((F.avg("p_retailprice") / 20000).alias("yield"))
    return lr.interpolated(p.select("id", "tenor").distinct(), c).select("id", "tenor", F.round("yield", 8).alias("yield"))


@query(f"""WITH {TYPES}, w AS (SELECT DISTINCT id, 1.0 / (SELECT count(DISTINCT id) FROM d) AS w FROM d), g AS (SELECT a.id, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) GROUP BY 1, 2), i AS (SELECT g.id, 2.5 * sum(c * w) AS implied FROM g JOIN w ON w.id = g.j GROUP BY g.id), h AS (SELECT id, avg(x) * 252 AS m FROM d GROUP BY id)
SELECT i.id, round(implied, 6) AS implied, round((0.7 * implied + 0.3 * m) / 1.0, 6) AS blend FROM i JOIN h ON h.id = i.id""")
def implied_and_blended(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    n = d.agg(F.countDistinct("id").alias("n"))
    w = d.select("id").distinct().crossJoin(F.broadcast(n)).select("id", (1 / F.col("n")).alias("weight"))
    i = lr.implied_returns(cv.full(cv.sample(d).select("i", "j", "cov")), w, 2.5)
    views = i.select("id", F.lit("implied").alias("source"), F.col("implied").alias("value")).unionByName(d.groupBy("id").agg((F.avg("x") * 252).alias("value")).select("id", F.lit("history").alias("source"), "value"))
    b = lr.blended(views, {"implied": 0.7, "history": 0.3})
    return i.join(b, "id").select("id", *rnd("implied"), F.round("value", 6).alias("blend"))


@query("""WITH l AS (SELECT p_brand AS id, p_size AS tenor, l_shipdate::DATE AS t, avg(l_discount) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), x AS (SELECT id, tenor, max(t) AS t, arg_max(value, t) AS value FROM l GROUP BY 1, 2), n AS (SELECT id, max(t) AS newest FROM x GROUP BY id)
SELECT x.id, tenor, t, round(value, 6) AS value FROM x JOIN n ON n.id = x.id WHERE newest - t <= 10""")
def latest_curve(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = d.groupBy(F.col("p_brand").alias("id"), F.col("p_size").alias("tenor"), F.to_date("l_shipdate").alias("t")).agg(F.avg("l_discount").alias("value"))
    return lr.latest_curve(x).select("id", "tenor", "t", *rnd("value"))


@query(f"""WITH {RETURNS}, k AS (SELECT id, t, price, (row_number() OVER (PARTITION BY id ORDER BY t) - 1) AS i FROM r), d AS (SELECT id, i, ln(price / lag(price) OVER (PARTITION BY id ORDER BY i)) / 26 AS g FROM k WHERE i % 26 = 0)
SELECT id, round(avg(g), 8) AS growth, round(stddev_samp(g) / sqrt(count(g)), 8) AS se, count(g) AS decades FROM d WHERE g IS NOT NULL GROUP BY id""")
def block_growth(spark, sf_dir):
    return lr.decade_growth(returns(spark, sf_dir), "price", 26).select("id", F.round("growth", 8).alias("growth"), F.round("se", 8).alias("se"), "decades")


@query(None)
def specification_search(spark, sf_dir):
    """A search over sets of all factors for all brands: each round's candidates are scored in one job by their residual variance."""
    d, names = design(spark, sf_dir)

    def score(todo):
        parts = [rg.rolling(d, list(c.factors), rg.Spec(window=c.window, step=52, least=60, estimator=c.estimator, half_life=c.half_life)).agg(F.lit(c.key()).alias("key"), F.avg("resid_vol").alias("loss")) for c in todo]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # One number a candidate: at most `most` of them.
        return {r["key"]: r["loss"] + 0.001 * next(c.complexity() for c in todo if c.key() == r["key"]) for r in out.collect() if r["loss"] is not None}

    found = se.search([se.Candidate((names[0],), 156)], names, score)
    return spark.createDataFrame([(c.key(), list(c.factors), c.window, c.estimator, float(x)) for c, x in found], "key string, factors array<string>, window int, estimator string, loss double")
