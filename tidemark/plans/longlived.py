"""Landed files, foreign tables and the record of long-horizon forecasts as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import series as s
from tidemark.operators import trackrecord as tr
from tidemark.plans.forecasts import TAIL, dm_sql
from tidemark.plans.panel import query, rnd
from tidemark.plans.relational import read
from tidemark.sources import landing as ld
from tidemark.sources.stored import shared_folder


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 1 AS writes FROM customer")
def landed_csv(spark, sf_dir):
    """A table landed as CSV under a note and a header, read back by type, and put in place of its source twice: the second time its hash is known."""
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    ld.land_csv(read(spark, sf_dir, "customer"), f"{folder}/csv", ["delivered as it is"])
    rows = ld.read_landed(spark, f"{folder}/csv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", 1)
    sha = ld.content_hash(spark, f"{folder}/csv")
    writes = sum(ld.replace_source(rows, f"{folder}/table", "customer", sha) for _ in range(2))
    return spark.read.parquet(f"{folder}/table").where("source = 'customer'").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.lit(writes).alias("writes"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, 8 AS parts FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def foreign_scan(spark, sf_dir):
    """Orders in another database (the embedded one that Spark brings along), read in eight parts with the filter pushed to it."""
    url = ld.delivered(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "orders")
    d = ld.foreign(spark, url, "orders", '"o_orderkey"', 8, options=ld.DERBY)
    return d.where("o_totalprice > 100000").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("parts", F.lit(d.rdd.getNumPartitions()))


#: Weeks in place of months: smoothed over 26, a horizon of 52, back to the norm over 78.
BUILD = tr.Build(smooth=26, horizon=52, reversion=78, year=52, late=3, least_norm=26, least_growth=52, least_mean=52)
STARTS = ["1993-01-01", "1995-01-01", "1997-01-01"]
RECORD = f"""x0 AS (SELECT p_brand AS id, date_trunc('week', l_shipdate)::DATE AS t, sum(l_extendedprice) / sum(l_quantity) AS price, avg(l_tax) * 10 AS dividend, sum(l_quantity) AS earnings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
x1 AS (SELECT id, t, price, sum(dividend) OVER w + price AS total, lag(earnings, 3) OVER w AS e, lag(dividend, 3) OVER w AS paid, row_number() OVER w - 1 AS pos FROM x0 WINDOW w AS (PARTITION BY id ORDER BY t)),
x2 AS (SELECT *, CASE WHEN count(e) OVER w = 26 THEN avg(e) OVER w END AS smooth FROM x1 WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
x3 AS (SELECT *, ln(price / smooth) AS ratio, ln(smooth) AS log_e FROM x2),
x4 AS (SELECT *, CASE WHEN count(ratio) OVER w >= 26 THEN avg(ratio) OVER w END AS norm, first_value(log_e IGNORE NULLS) OVER w AS first, min(pos) FILTER (log_e IS NOT NULL) OVER w AS begin, first_value(total) OVER w AS start_total, lead(total, 52) OVER (PARTITION BY id ORDER BY t) AS ahead FROM x3 WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fc AS (SELECT id, t, paid / price AS income, CASE WHEN pos - begin >= 52 THEN (log_e - first) / ((pos - begin) / 52.0) END AS growth, (norm - ratio) * (52 / 78.0) AS valuation, ahead / total - 1 AS realised, CASE WHEN pos >= 52 THEN power(total / start_total, 52.0 / pos) - 1 END AS benchmark FROM x4),
fr AS (SELECT *, income + growth + valuation AS forecast FROM fc)"""


def long_panel(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id")), F.col("l_partkey") == F.col("p_partkey"))
    g = d.groupBy("id", F.date_trunc("week", "l_shipdate").cast("date").alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), (F.avg("l_tax") * 10).alias("dividend"), F.sum("l_quantity").alias("earnings"))
    return g.withColumn("total", F.sum("dividend").over(s.so_far()) + F.col("price"))


@query(f"""WITH {RECORD} SELECT id, t, round(income, 6) AS income, round(growth, 6) AS growth, round(valuation, 6) AS valuation, round(forecast, 6) AS forecast, round(realised, 6) AS realised, round(benchmark, 6) AS benchmark FROM fr""")
def forecast_known_then(spark, sf_dir):
    return tr.known_then(long_panel(spark, sf_dir), BUILD).select("id", "t", *rnd("income", "growth", "valuation", "forecast", "realised", "benchmark"))


@query(f"""WITH {RECORD}, sd AS (SELECT id || '/' || s AS id, id AS name, s::DATE AS start, t, forecast, realised, benchmark FROM fr, (SELECT unnest({STARTS!r}) AS s) WHERE t >= s::DATE AND forecast IS NOT NULL AND realised IS NOT NULL AND benchmark IS NOT NULL),
n_of AS (SELECT id, 51 AS lags FROM sd GROUP BY id), {dm_sql("dm", "SELECT id, t, power(forecast - realised, 2) - power(benchmark - realised, 2) AS x FROM sd", "51")},
g AS (SELECT id, name, start, count(*) AS n, corr(forecast, realised) AS corr, avg(forecast - realised) AS mean_error, sqrt(avg(power(forecast - realised, 2))) AS rmse, sqrt(avg(power(benchmark - realised, 2))) AS rmse_benchmark, 1 - sum(power(forecast - realised, 2)) / sum(power(benchmark - realised, 2)) AS oos_r2, min(t) AS first_t, max(t) AS last_t FROM sd GROUP BY 1, 2, 3)
SELECT name AS id, start, g.n, first_t, last_t, round(corr, 5) AS corr, round(mean_error, 5) AS mean_error, round(rmse, 5) AS rmse, round(rmse_benchmark, 5) AS rmse_benchmark, round(oos_r2, 5) AS oos_r2, round(t_stat, 5) AS dm_t, round(CASE WHEN t_stat = 0 THEN 1 ELSE {TAIL.format(x="(t_stat * t_stat)")} END, 5) AS dm_p FROM g LEFT JOIN dm ON dm.id = g.id""")
def forecast_record(spark, sf_dir):
    d = tr.record(tr.known_then(long_panel(spark, sf_dir), BUILD), STARTS, 51)
    return d.select("id", "start", "n", "first_t", "last_t", *rnd("corr", "mean_error", "rmse", "rmse_benchmark", "oos_r2", "dm_t", "dm_p", places=5))
