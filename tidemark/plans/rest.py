"""The rest of the inventory: recipes, currencies, hierarchies, regimes, backtests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import covariance as cv
from tidemark.operators import factors as fa
from tidemark.operators import kernels as k
from tidemark.operators import panels as pn
from tidemark.operators import portfolio as pf
from tidemark.plans.panel import RETURNS, query, returns, rnd
from tidemark.plans.quant import FORECAST, forecasts, read, type_returns
from tidemark.sources import tables as tb


@query("""WITH r AS (SELECT p_partkey::VARCHAR AS factor_id, p_brand AS a, p_type AS b, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS c FROM part), u AS (SELECT factor_id, 0 AS i, a AS input FROM r UNION ALL SELECT factor_id, 1, b FROM r UNION ALL SELECT factor_id, 2, c FROM r),
f AS (SELECT factor_id, input, min(i) AS i FROM u GROUP BY 1, 2) SELECT factor_id, row_number() OVER (PARTITION BY factor_id ORDER BY i) - 1 AS place, input FROM f""")
def recipe_identifiers(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    c = F.to_json(F.struct(F.struct(F.array("p_brand", "p_type").alias("long"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("id")).alias("inputs")))
    return tb.recipe_inputs(p.select(F.col("p_partkey").cast("string").alias("factor_id"), c.alias("construction")), ["long", "id"])


@query("""WITH y AS (SELECT s_nationkey AS id, n_regionkey AS block, s_acctbal / 1000 AS beta, abs(s_acctbal) > 3000 AS sig FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT block, round(sum(beta), 6) AS exposure, round(sum(abs(beta)), 6) AS gross, count(*) FILTER (sig) AS significant FROM y GROUP BY 1""")
def exposure_by_block(spark, sf_dir):
    d = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = F.col("s_acctbal") / 1000
    return d.groupBy(F.col("n_regionkey").alias("block")).agg(F.round(F.sum(b), 6).alias("exposure"), F.round(F.sum(F.abs(b)), 6).alias("gross"), F.count_if(F.abs("s_acctbal") > 3000).alias("significant"))


@query("""WITH l AS (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_orderstatus AS verdict, count(*) AS n FROM l GROUP BY 1""")
def verdict_histogram(spark, sf_dir):
    d = tb.latest_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return d.groupBy(F.col("o_orderstatus").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_suppkey AS id, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT max(o_orderdate)::DATE AS newest FROM orders) SELECT id, first, last, n, newest - last AS behind, newest - last <= 10 AS live FROM c, m""")
def coverage_against_other(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"), F.count(F.lit(1)).alias("n"))
    newest = read(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).alias("newest"))
    behind = F.datediff("newest", "last").cast("long")
    return c.crossJoin(F.broadcast(newest)).select("id", "first", "last", "n", behind.alias("behind"), (behind <= 10).alias("live"))


_FX = "('Brand#1', 'USDAAA'), ('Brand#2', 'BBBUSD'), ('Brand#3', 'USDCCC')"


@query(f"""WITH {RETURNS}, x AS (SELECT * FROM (VALUES {_FX}) v(id, pair)) SELECT CASE WHEN pair LIKE 'USD%' THEN right(pair, 3) ELSE left(pair, 3) END AS id, t, round(CASE WHEN pair LIKE 'USD%' THEN 1 / price ELSE price END, 8) AS value FROM r JOIN x ON x.id = r.id WHERE price > 0""")
def spot_levels(spark, sf_dir):
    x = spark.createDataFrame([("Brand#1", "USDAAA"), ("Brand#2", "BBBUSD"), ("Brand#3", "USDCCC")], "id string, pair string")
    d = returns(spark, sf_dir).join(x, "id").select(F.col("pair").alias("id"), "t", F.col("price").alias("value"))
    return fa.spot_levels(d).select("id", "t", F.round("value", 8).alias("value"))


@query(f"""WITH {RETURNS}, s AS (SELECT id, t, ret, row_number() OVER (PARTITION BY id ORDER BY t) AS i FROM r WHERE ret IS NOT NULL), a AS (SELECT id, t, lag(t) OVER (PARTITION BY id ORDER BY t) AS low, ret FROM s WHERE i % 3 = 0 AND id <> 'Brand#1'), f AS (SELECT t, ret FROM s WHERE id = 'Brand#1')
SELECT a.id, a.t, round(a.ret + coalesce((SELECT sum(ret) FROM f WHERE f.t > a.low AND f.t <= a.t), 0), 6) AS ret FROM a WHERE low IS NOT NULL""")
def in_home_currency(spark, sf_dir):
    s = returns(spark, sf_dir).where("ret IS NOT NULL")
    w = W.partitionBy("id").orderBy("t")
    a = s.withColumn("i", F.row_number().over(w)).where("i % 3 = 0 AND id <> 'Brand#1'").select("id", F.lit("one").alias("ccy"), "t", "ret")
    f = s.where("id = 'Brand#1'").select(F.lit("one").alias("ccy"), "t", "ret")
    return fa.in_home_currency(a, f).select("id", "t", *rnd("ret"))


@query(f"""WITH {RETURNS}, l AS (SELECT p_brand AS id, date_trunc('week', l_shipdate)::DATE AS t, avg(l_discount) * 100 AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1, 2), g AS (SELECT id, t, lag(v) OVER (PARTITION BY id ORDER BY t) - 5 AS gap FROM l)
SELECT t, round(avg(sign(gap) * (ret + gap / 100 / 252)), 8) AS value FROM r JOIN g USING (id, t) GROUP BY t""")
def fx_carry(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = d.groupBy(F.col("p_brand").alias("id"), F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.avg("l_discount") * 100).alias("value"))
    return fa.fx_carry(fa.Panels(returns(spark, sf_dir).select("id", "t", "ret"), v), {"legs": ["Brand#1", "Brand#2", "Brand#3"], "home": 5.0}).select("t", F.round("value", 8).alias("value"))


@query(None)
def factor_hierarchy(spark, sf_dir):
    recipes = [fa.Recipe("all", "basket", {"long": [f"Brand#{i}" for i in range(1, 11)]}), fa.Recipe("few", "basket", {"long": ["Brand#1", "Brand#2"]}, 1, ["all"]), fa.Recipe("one", "single", {"id": "Brand#3"}, 2, ["all", "few"])]
    built = fa.build(fa.Panels(returns(spark, sf_dir).select("id", "t", "ret")), recipes)
    return fa.orthogonalised(built, recipes, mode="rolling", window=104, least=52, refit=4)


@query(None)
def regime_covariances(spark, sf_dir):
    """Shrunk covariances of calm and of stressed weeks."""
    p = cv.complete(type_returns(spark, sf_dir))
    days = pn.stress_days(p, 8)
    of = lambda name, rows: pn.shrunk(p.join(days.where(rows).select("t"), "t", "left_semi")).select(F.lit(name).alias("panel"), "i", "j", "cov", "shrinkage")
    return of("stress", F.col("stress")).unionByName(of("calm", ~F.col("stress")))


@query(None)
def tail_path(spark, sf_dir):
    return k.tail_path(type_returns(spark, sf_dir).where("ret IS NOT NULL"), 208, 26)


@query(f"""WITH {FORECAST}, x AS (SELECT id, ret, sig, slow, real FROM k WHERE ret IS NOT NULL AND sig > 0 AND slow > 0), g AS (SELECT id, count(*) AS n, stddev_samp(ret / (sig / sqrt(252))) AS z, avg(power(ret, 2) / (sig * sig / 252) + ln(sig * sig / 252)) AS own, avg(power(ret, 2) / (slow * slow / 252) + ln(slow * slow / 252)) AS other, avg((ret < -1.6448536 * sig / sqrt(252))::INT) AS hits FROM x GROUP BY id)
SELECT id, n, round(z, 6) AS z_std, round(own - other, 6) AS edge, round(hits, 6) AS hits, abs(z - 1) <= sqrt(2.0 / n) AS in_band, CASE WHEN abs(z - 1) <= sqrt(2.0 / n) THEN 'risk is as forecast' WHEN z > 1 THEN 'risk is understated' ELSE 'risk is overstated' END || CASE WHEN own < other THEN ', better than the benchmark' ELSE ', no better than the benchmark' END AS says FROM g""")
def backtest_report(spark, sf_dir):
    d = forecasts(spark, sf_dir).where("ret IS NOT NULL AND sig > 0 AND slow > 0")
    s = pf.score(d.select(F.lit("all").alias("family"), F.col("id").alias("portfolio"), "t", "ret", F.col("sig").alias("sigma"), F.col("slow").alias("benchmark")))
    first = F.when(F.col("in_band"), "risk is as forecast").when(F.col("z_std") > 1, "risk is understated").otherwise("risk is overstated")
    second = F.when(F.col("loss") < F.col("benchmark_loss"), ", better than the benchmark").otherwise(", no better than the benchmark")
    return s.select(F.col("portfolio").alias("id"), "n", F.round("z_std", 6).alias("z_std"), F.round(F.col("loss") - F.col("benchmark_loss"), 6).alias("edge"), F.round("hits", 6).alias("hits"), "in_band", F.concat(first, second).alias("says"))


@query(f"""WITH {RETURNS}, m AS (SELECT id, last_day(t) AS m, arg_max(price, t) AS p FROM r GROUP BY 1, 2), x AS (SELECT id, m, ln(p / lag(p) OVER (PARTITION BY id ORDER BY m)) AS x FROM m)
SELECT a.id AS i, b.id AS j, count(*) AS n, CASE WHEN count(*) >= 36 THEN round(covar_samp(a.x, b.x) * 12, 6) END AS cov FROM x a JOIN x b ON a.m = b.m AND a.id <= b.id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2""")
def strategic_covariance(spark, sf_dir):
    """Pairwise covariances of month-end returns, null under three years."""
    m = returns(spark, sf_dir).groupBy("id", F.last_day("t").alias("t")).agg(F.max_by("price", "t").alias("price"))
    x = m.select("id", "t", F.ln(F.col("price") / F.lag("price").over(W.partitionBy("id").orderBy("t"))).alias("x")).where("x IS NOT NULL")
    a, b = x.select(F.col("id").alias("i"), "t", F.col("x").alias("a")), x.select(F.col("id").alias("j"), "t", F.col("x").alias("b"))
    g = a.join(b, "t").where("i <= j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("c"))
    return g.select("i", "j", "n", F.when(F.col("n") >= 36, F.round(F.col("c") * 12, 6)).alias("cov"))


@query("""WITH c AS (SELECT p_brand AS security, p_type AS spec, avg(p_retailprice) AS loss, max(p_partkey) AS run FROM part GROUP BY 1, 2), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY security ORDER BY loss, spec) = 1) SELECT spec, count(*) AS chosen, max(run) AS last_run FROM l GROUP BY 1""")
def pool_of_choices(spark, sf_dir):
    """How often each specification was a security's best."""
    c = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("security"), F.col("p_type").alias("spec")).agg(F.avg("p_retailprice").alias("loss"), F.max("p_partkey").alias("run"))
    best = tb.latest_per_key(c, ["security"], [F.asc("loss"), F.asc("spec")])
    return best.groupBy("spec").agg(F.count(F.lit(1)).alias("chosen"), F.max("run").alias("last_run"))


@query("""WITH k AS (SELECT o_custkey AS id, o_orderdate::DATE AS d, o_totalprice AS v FROM orders) SELECT id, d, v, o.n FROM k, LATERAL (SELECT count(*) AS n FROM k b WHERE b.id = k.id AND b.d <= k.d) o""")
def running_count(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    w = W.partitionBy("id").orderBy("d").rangeBetween(W.unboundedPreceding, W.currentRow)
    return o.withColumn("n", F.count(F.lit(1)).over(w))
