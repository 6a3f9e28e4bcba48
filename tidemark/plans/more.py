"""Further queries of the inventory: loads, coverage, conversions, portfolios and reports, with oracles where SQL says them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import covariance as cv
from tidemark.operators import kernels as k
from tidemark.operators import panels as pn
from tidemark.operators import portfolio as pf
from tidemark.operators import regression as rg
from tidemark.operators import series as s
from tidemark.plans.models import design
from tidemark.plans.panel import MARKET, RETURNS, query, returns, rnd, with_market
from tidemark.plans.quant import TYPES, read, type_returns


@query(f"""WITH {RETURNS} SELECT t, {', '.join(f"round(max(ret) FILTER (id = 'Brand#{i}'), 6) AS b{i}" for i in range(1, 26))} FROM r WHERE id IN (SELECT p_brand FROM part WHERE p_size > 45) GROUP BY t""")
def factor_panel_wide(spark, sf_dir):
    live = read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_brand").alias("id"))
    names = [f"Brand#{i}" for i in range(1, 26)]
    # The names are given, so the pivot needs no pass of its own to find them.
    d = returns(spark, sf_dir).join(live, "id", "left_semi").groupBy("t").pivot("id", names).agg(F.max("ret"))
    return d.select("t", *(F.round(f"`{n}`", 6).alias(f"b{i}") for i, n in enumerate(names, 1)))


@query(f"""WITH {RETURNS}, c AS (SELECT date_trunc('week', o_orderdate)::DATE AS t, avg(o_totalprice) / 50000 AS cash FROM orders GROUP BY 1), j AS (SELECT r.id, r.t, ret, last_value(cash IGNORE NULLS) OVER (PARTITION BY id ORDER BY r.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cash FROM r LEFT JOIN c USING (t))
SELECT id, t, round(ret - cash / 100 / 252, 8) AS excess FROM j""")
def instrument_load(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("t")).agg((F.avg("o_totalprice") / 50000).alias("cash"))
    d = returns(spark, sf_dir).join(c, "t", "left")
    return d.select("id", "t", F.round(F.col("ret") - s.in_force("cash") / 100 / 252, 8).alias("excess"))


@query("""SELECT p_partkey, coalesce(n.n_name, r.r_name, 'missing') AS input, CASE WHEN n.n_name IS NOT NULL THEN 'nation' WHEN r.r_name IS NOT NULL THEN 'region' ELSE 'missing' END AS kind FROM part LEFT JOIN nation n ON n.n_nationkey = p_size LEFT JOIN region r ON r.r_regionkey = p_size - 25""")
def input_resolution(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), "n_name")
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 25).alias("b"), "r_name")
    p = read(spark, sf_dir, "part")
    d = p.join(n, p.p_size == n.a, "left").join(r, p.p_size == r.b, "left")
    return d.select("p_partkey", F.coalesce("n_name", "r_name", F.lit("missing")).alias("input"), F.when(F.col("n_name").isNotNull(), "nation").when(F.col("r_name").isNotNull(), "region").otherwise("missing").alias("kind"))


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS pct, value / 100 AS raw FROM events) SELECT event_id, round(coalesce(pct, raw * 100), 6) AS pct, round(CASE WHEN coalesce(pct, raw * 100) > -100 THEN ln(1 + coalesce(pct, raw * 100) / 100) END, 8) AS log FROM k""")
def unit_conventions(spark, sf_dir):
    k_ = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("pct"), (F.col("value") / 100).alias("raw"))
    pct = F.coalesce("pct", F.col("raw") * 100)
    return k_.select("event_id", F.round(pct, 6).alias("pct"), F.round(F.when(pct > -100, F.log1p(F.when(pct > -100, pct / 100))), 8).alias("log"))


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1""")
def drop_first_row(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn > 1").select("user_id", "event_id", "value")


@query("""WITH b AS (SELECT user_id, event_id, ts, (ts + INTERVAL '5 hours')::DATE AS day, ts <= TIMESTAMP '2024-01-20 20:30:00' AS final FROM events) SELECT user_id, day, max(event_id) AS last, count(*) AS n FROM b WHERE final GROUP BY 1, 2""")
def finished_bars(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-20 20:30:00").cast("timestamp"))
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 5 HOURS"))
    return e.groupBy("user_id", day.alias("day")).agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TYPES}, y AS (SELECT id, id IN ('SMALL', 'MEDIUM', 'LARGE') AS g FROM (SELECT DISTINCT id FROM d)), c AS (SELECT a.id AS i, b.id AS j, corr(a.x, b.x) AS c FROM d a JOIN d b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT p.g = q.g AS within, count(*) AS pairs, round(avg(c), 6) AS mean_corr FROM c JOIN y p ON p.id = c.i JOIN y q ON q.id = c.j GROUP BY 1""")
def residual_structure(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    g = d.select("id").distinct().select("id", F.col("id").isin("SMALL", "MEDIUM", "LARGE").cast("string").alias("group"))
    return pf.residual_structure(d, g).select("within", "pairs", *rnd("mean_corr"))


@query(f"""WITH {TYPES}, k AS (SELECT id, t, x, sum(x) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 13 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 13 FOLLOWING) AS n, avg(x) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) * 13 AS f, avg(x) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) * 13 AS b FROM d),
z AS (SELECT * FROM k WHERE n = 13) SELECT id, count(*) AS n, round(corr(ahead, f), 6) AS corr, round(avg(ahead - f), 6) AS mean_error, round(sqrt(avg(power(ahead - f, 2))), 6) AS rmse, round(1 - sum(power(ahead - f, 2)) / sum(power(ahead - b, 2)), 6) AS oos_r2 FROM z GROUP BY id""")
def track_record(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    w = s.next_rows(13)
    d = d.select("id", F.when(F.count(F.lit(1)).over(w) == 13, F.sum("x").over(w)).alias("ahead"), (F.avg("x").over(s.last_rows(52)) * 13).alias("f"), (F.avg("x").over(s.so_far()) * 13).alias("b"))
    return pf.track_record(d, "ahead", "f", "b").select("id", "n", *rnd("corr", "mean_error", "rmse", "oos_r2"))


@query(f"""WITH {MARKET}, k AS (SELECT id, t, ret, mkt, avg(ret - mkt) OVER w AS drift, count(*) OVER w AS n FROM (SELECT * FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL) WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)) SELECT id, t, round(CASE WHEN n = 52 THEN ret - drift ELSE mkt END, 6) AS value FROM k""")
def spot_return(spark, sf_dir):
    d = with_market(spark, sf_dir).where("ret IS NOT NULL AND mkt IS NOT NULL").select("id", "t", F.col("ret").alias("total"), F.col("mkt").alias("spot"))
    return pf.spot_return(d, 52).select("id", "t", *rnd("value"))


@query(f"""WITH {TYPES}, w AS (SELECT id, t, x, power(0.5, (row_number() OVER (PARTITION BY id ORDER BY t DESC) - 1) / 26.0) AS w FROM d), v AS (SELECT id, sum(w * x * x) / sum(w) * 252 AS v FROM w GROUP BY id) SELECT id, round(greatest(sqrt(0.8 * v + 0.2 * (SELECT avg(v) FROM v)), 0.02), 6) AS specific FROM v""")
def specific_risk(spark, sf_dir):
    return cv.specific(cv.complete(type_returns(spark, sf_dir)), 26.0, shrink=0.2).select("id", *rnd("specific"))


@query(f"""WITH {TYPES}, p AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) GROUP BY 1, 2), v AS (SELECT i, j, c * (0.01 + 0.001 * length(i)) AS v FROM p) SELECT round(greatest(sum(p.c * v.v), 0), 8) AS noise FROM p JOIN v ON p.i = v.i AND p.j = v.j""")
def beta_noise_variance(spark, sf_dir):
    c = cv.full(cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", "cov"))
    v = c.select("i", "j", (F.col("cov") * (F.lit(0.01) + F.lit(0.001) * F.length("i")).cast("double")).alias("v"))
    return c.join(v, ["i", "j"]).agg(F.round(F.greatest(F.sum(F.col("cov") * F.col("v")), F.lit(0.0)), 8).alias("noise"))


@query("""WITH l AS (SELECT l_suppkey AS id, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1), n AS (SELECT max(last) AS newest FROM l) SELECT id, last, newest - last AS behind, newest - last > 4 AS stale FROM l, n""")
def data_age(spark, sf_dir):
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    behind = F.datediff("newest", "last").cast("long")
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("newest")))).select("id", "last", behind.alias("behind"), (behind > 4).alias("stale"))


@query("""WITH b AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice < 5000), u AS (SELECT DISTINCT k FROM b ORDER BY k) SELECT (SELECT count(DISTINCT k) FROM b) AS n, (SELECT string_agg(k::VARCHAR, ', ' ORDER BY k) FROM (SELECT k FROM u LIMIT 12)) || CASE WHEN (SELECT count(*) FROM u) > 12 THEN ' +' || ((SELECT count(*) FROM u) - 12) || ' more' ELSE '' END AS summary""")
def check_summary(spark, sf_dir):
    b = read(spark, sf_dir, "orders").where("o_totalprice < 5000").select(F.col("o_custkey").alias("k")).distinct()
    # The report names twelve at most: a limit that is the feature.
    first = b.orderBy("k").limit(12).agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: x.cast("string")), ", ").alias("named"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(first).select("n", F.concat("named", F.when(F.col("n") > 12, F.concat(F.lit(" +"), F.col("n") - 12, F.lit(" more"))).otherwise("")).alias("summary"))


@query(f"""WITH {MARKET}, b AS (SELECT id, regr_slope(ret, mkt) AS b, regr_intercept(ret, mkt) AS a FROM rm WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY id), x AS (SELECT rm.id, ret, ret - a - b * mkt AS e FROM rm JOIN b ON b.id = rm.id WHERE ret IS NOT NULL AND mkt IS NOT NULL)
SELECT id, round(1 - var_samp(e) / var_samp(ret), 6) AS removed, round(stddev_samp(ret - e) * sqrt(252), 6) AS tracking, round(corr(ret, e), 6) AS corr FROM x GROUP BY id""")
def raw_versus_orthogonal(spark, sf_dir):
    d = with_market(spark, sf_dir).where("ret IS NOT NULL AND mkt IS NOT NULL")
    e = rg.residuals(d, ["mkt"], "full", y="ret")
    x = d.join(e, ["id", "t"]).groupBy("id").agg((1 - F.try_divide(F.var_samp("resid"), F.var_samp("ret"))).alias("removed"), (F.stddev_samp(F.col("ret") - F.col("resid")) * F.sqrt(F.lit(252.0))).alias("tracking"), F.corr("ret", "resid").alias("corr"))
    return x.select("id", *rnd("removed", "tracking", "corr"))


@query(None)
def multi_speed_portfolio(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    f = pf.families(spark, names, {n: "size" if n in ("LARGE", "MEDIUM", "SMALL") else "other" for n in names})
    w = f.withColumn("portfolio", F.concat_ws("/", "family", "portfolio")).select("portfolio", "id", "weight")
    fc = pf.portfolio_forecasts(pf.cov_paths(d, least=30), w)
    r = pf.portfolio_returns(d, w)
    own = k.ewma_volatility(r.select(F.col("portfolio").alias("id"), "t", "ret"), 21.0, 30).select(F.col("id").alias("portfolio"), "t", F.lag("sigma").over(s.by()).alias("benchmark"))
    x = r.join(fc, ["portfolio", "t"]).join(own, ["portfolio", "t"]).withColumn("family", F.split_part("portfolio", F.lit("/"), F.lit(1)))
    return pf.family_summary(pf.score(x))


@query(None)
def stress_days(spark, sf_dir):
    return pn.stress_days(cv.complete(type_returns(spark, sf_dir)), 8).select(F.lit("types").alias("panel"), "*")


@query(None)
def cluster_order(spark, sf_dir):
    c = cv.sample(cv.complete(type_returns(spark, sf_dir))).select("i", "j", F.col("corr").alias("cov"))
    return pf.cluster_order(cv.full(c).select(F.lit("types").alias("panel"), "i", "j", F.col("cov").alias("corr")))


@query(None)
def gram_schmidt(spark, sf_dir):
    d = pn.gram_schmidt(cv.complete(type_returns(spark, sf_dir)), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return d.select(F.lit("types").alias("panel"), "id", "t", *rnd("x"))


@query(None)
def residual_components(spark, sf_dir):
    d, names = design(spark, sf_dir)
    e = rg.residuals(d, names, "full")
    return pn.components(cv.complete(e, "resid"), 2).select(F.lit("brands").alias("panel"), "*")


@query(f"""WITH {MARKET} SELECT id, count(ret) / count(*)::DOUBLE >= 0.9 AS covered, CASE WHEN count(*) >= 252 AND corr(mkt, ret) >= 0.3 THEN 'follows' ELSE 'own' END AS class FROM (SELECT id, ret, lag(mkt) OVER (PARTITION BY id ORDER BY t) AS mkt FROM rm) GROUP BY id""")
def classify_by_lead(spark, sf_dir):
    d = with_market(spark, sf_dir).withColumn("before", F.lag("mkt").over(s.by()))
    g = d.groupBy("id").agg((F.count("ret") / F.count(F.lit(1)) >= 0.9).alias("covered"), F.count(F.lit(1)).alias("n"), F.corr("before", "ret").alias("c"))
    return g.select("id", "covered", F.when((F.col("n") >= 252) & (F.col("c") >= 0.3), "follows").otherwise("own").alias("class"))
