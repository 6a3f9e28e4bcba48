"""Scans, projections, joins, aggregates and table maintenance over the driver's tables, each with a SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.operators import series as s
from tidemark.plans.panel import PRICES, RETURNS, query, returns, rnd
from tidemark.sources import tables as tb


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH a AS (SELECT 'orders' AS layer, o_custkey AS id, o_orderdate::DATE AS t FROM orders UNION ALL SELECT 'lineitem', l_suppkey, l_shipdate::DATE FROM lineitem
UNION ALL SELECT 'events', user_id, ts::DATE FROM events) SELECT layer, count(*) AS n, min(t) AS first, max(t) AS last, count(DISTINCT id) AS series FROM a GROUP BY layer""")
def freshness_by_layer(spark, sf_dir):
    parts = [("orders", "o_custkey", "o_orderdate"), ("lineitem", "l_suppkey", "l_shipdate"), ("events", "user_id", "ts")]
    # Each layer is reduced before the union, so only its summary moves.
    rows = [read(spark, sf_dir, n).agg(F.lit(n).alias("layer"), F.count(F.lit(1)).alias("n"), F.min(F.to_date(t)).alias("first"), F.max(F.to_date(t)).alias("last"), F.countDistinct(k).alias("series")) for n, k, t in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, bool_or(l_quantity >= 50) AS any_large, round(stddev_samp(l_extendedprice), 4) AS sd, round(avg(l_tax), 8) AS tax
FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY l_returnflag HAVING count(*) > 10""")
def conditional_aggregates(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("date"))
    g = d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.bool_or(F.col("l_quantity") >= 50).alias("any_large"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.round(F.avg("l_tax"), 8).alias("tax"))
    return g.where("n > 10")


@query("""SELECT o_custkey, o_orderkey, o_orderdate::DATE AS t, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, sf_dir):
    d = tb.latest_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return d.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("t"), "o_totalprice")


_BASE = "b AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS st, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v, o_orderstatus AS st FROM orders WHERE o_orderkey % 5 < 2)"


def _base_delta(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.where(k % 3 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("st"), F.lit(1).alias("version"))
    delta = o.where(k % 5 < 2).select(k.alias("k"), F.when(k % 2 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"), F.col("o_orderstatus").alias("st"), F.lit(1).alias("version"))
    return base, delta


@query(f"""WITH {_BASE} SELECT coalesce(b.k, d.k) AS k, CASE WHEN d.k IS NOT NULL THEN d.v ELSE b.v END AS v, coalesce(d.st, b.st) AS st,
CASE WHEN b.k IS NULL THEN 1 WHEN d.k IS NOT NULL AND d.v IS DISTINCT FROM b.v THEN 2 ELSE 1 END AS version FROM b FULL JOIN d ON b.k = d.k""")
def upsert_merge(spark, sf_dir):
    base, delta = _base_delta(spark, sf_dir)
    return tb.upsert(base, delta, ["k"], changed=~F.col("b.v").eqNullSafe(F.col("d.v")), version="version")


@query(f"""WITH {_BASE} SELECT coalesce(b.k, d.k) AS k, CASE WHEN b.k IS NULL OR (d.k IS NOT NULL AND b.st = 'O') THEN d.v ELSE b.v END AS v FROM b FULL JOIN d ON b.k = d.k""")
def upsert_conditional(spark, sf_dir):
    base, delta = _base_delta(spark, sf_dir)
    return tb.upsert(base, delta, ["k"], only_if=F.col("b.st") == "O").select("k", "v")


@query(f"""WITH {_BASE} SELECT k, v FROM b UNION ALL SELECT k, v FROM d WHERE k NOT IN (SELECT k FROM b)""")
def insert_if_absent(spark, sf_dir):
    base, delta = _base_delta(spark, sf_dir)
    return tb.insert_if_absent(base, delta, ["k"]).select("k", "v")


@query(f"""WITH {_BASE} SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM d) UNION ALL SELECT k, v FROM d""")
def delete_then_insert(spark, sf_dir):
    base, delta = _base_delta(spark, sf_dir)
    return tb.replace_keys(base, delta, ["k"]).select("k", "v")


@query("""WITH base AS (SELECT * FROM orders WHERE o_orderdate < DATE '1999-06-01' AND o_custkey % 7 <> 0), m AS (SELECT o_custkey, max(o_orderdate::DATE) AS mark FROM base GROUP BY 1)
SELECT o_orderkey, o_custkey, o_orderdate::DATE AS t FROM orders LEFT JOIN m USING (o_custkey) WHERE mark IS NULL OR o_orderdate::DATE > mark - 10""")
def watermark_resume(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("t"))
    base = o.where((F.col("t") < F.lit("1999-06-01").cast("date")) & (F.col("o_custkey") % 7 != 0))
    return tb.resume(o, base, "o_custkey", "t", overlap_days=10).select("o_orderkey", "o_custkey", "t")


@query(f"""WITH {PRICES}, a AS (SELECT 'Brand#11' AS id, DATE '1997-03-05' AS t, 0.5 AS f UNION ALL SELECT 'Brand#11', DATE '1999-01-04', 0.25 UNION ALL SELECT 'Brand#23', DATE '1998-02-02', 2.0)
SELECT p.id, p.t, round(price * coalesce((SELECT product(f) FROM a WHERE a.id = p.id AND a.t > p.t), 1), 6) AS price FROM p""")
def restatement(spark, sf_dir):
    p = s.weekly_prices(spark, sf_dir).select("id", "t", "price")
    actions = spark.createDataFrame([("Brand#11", "1997-03-05", 0.5), ("Brand#11", "1999-01-04", 0.25), ("Brand#23", "1998-02-02", 2.0)], "id string, d string, factor double").select("id", F.to_date("d").alias("t"), "factor")
    return tb.restated(p, actions, "id", "t", ["price"]).select("id", "t", *rnd("price"))


@query("""WITH v AS (SELECT o_custkey AS id, date_trunc('month', o_orderdate)::DATE AS ref, o_orderdate::DATE AS released, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3),
f AS (SELECT id, ref, arg_min(value, released) AS value, min(released) AS released FROM v GROUP BY 1, 2)
SELECT id, ref, released, value, CASE WHEN released - ref BETWEEN 0 AND 14 THEN released ELSE ref + 20 END AS known FROM f""")
def first_releases(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    v = o.groupBy(F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "month").alias("ref"), F.to_date("o_orderdate").alias("released")).agg(F.max("o_totalprice").alias("value"))
    f = tb.first_releases(v, ["id", "ref"], "value", "released")
    return f.select("id", "ref", "released", "value", F.when(F.datediff("released", "ref").between(0, 14), F.col("released")).otherwise(F.date_add("ref", 20)).alias("known"))


@query("""WITH v AS (SELECT date_trunc('month', o_orderdate)::DATE AS ref, min(o_orderdate::DATE) + (extract(month FROM o_orderdate)::INT % 5) * 6 AS released, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, extract(month FROM o_orderdate)),
k AS (SELECT CASE WHEN released - ref BETWEEN 0 AND 14 THEN released ELSE ref + 20 END AS t, ref, value FROM v) SELECT t, arg_max(value, ref) AS value FROM k GROUP BY t""")
def release_points(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    v = o.groupBy(F.trunc("o_orderdate", "month").alias("ref"), F.month("o_orderdate").alias("m")).agg(F.min(F.to_date("o_orderdate")).alias("d"), F.round(F.avg("o_totalprice"), 4).alias("value"))
    v = v.withColumn("released", F.date_add("d", F.col("m") % 5 * 6))
    return tb.release_points(v, "ref", "released", "value", lag=20)


@query("""WITH k AS (SELECT l_returnflag AS f, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, sum(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT f, name, round(value, 4) AS value FROM k UNPIVOT (value FOR name IN (qty, price, tax)) WHERE isfinite(value)""")
def unpivot_long(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.sum("l_tax").alias("tax"))
    return tb.finite(k.unpivot("f", ["qty", "price", "tax"], "name", "value")).where("value IS NOT NULL").select("f", "name", F.round("value", 4).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN ln((l_quantity - 25) / 25) END AS x FROM lineitem""")
def sink_sanitise(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    # NaN for a negative ratio and minus infinity for zero, as a kernel may hand them over.
    ratio = (F.col("l_quantity") - 25) / 25
    x = F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio))).when(ratio == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return tb.finite(d.select("l_orderkey", "l_linenumber", x.alias("x")))


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS i, l_linestatus AS j FROM lineitem), n AS (SELECT DISTINCT l_returnflag AS i FROM lineitem), m AS (SELECT DISTINCT l_returnflag AS j FROM lineitem)
SELECT n.i, m.j, round((SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = n.i) * (SELECT sum(l_tax) FROM lineitem WHERE l_returnflag = m.j), 2) AS value FROM n CROSS JOIN m""")
def matrix_round_trip(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("x"))
    # Three rows by three: an outer product of flags, through the stored array form and back.
    pairs = a.select(F.lit("k").alias("key"), F.col("l_returnflag").alias("i"), "q").crossJoin(F.broadcast(a.select(F.col("l_returnflag").alias("j"), "x"))).select("key", "i", "j", (F.col("q") * F.col("x")).alias("value"))
    return tb.unflattened(tb.flattened(pairs, ["key"]), ["key"]).select("i", "j", F.round("value", 2).alias("value"))


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT e.user_id, e.event_id, v.value, v.ts AS value_t FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_backward(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return j.asof_backward(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "user_id", "ts", "value").select("user_id", "event_id", "value", "value_t")


@query("""WITH cal AS (SELECT DISTINCT o_orderdate::DATE AS t FROM orders WHERE isodow(o_orderdate) < 6), o AS (SELECT l_suppkey AS k, l_shipdate::DATE AS d, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT k, d, v, (SELECT min(t) FROM cal WHERE t >= d) AS t FROM o) SELECT k, t, arg_max(v, d) AS v FROM x WHERE t IS NOT NULL GROUP BY k, t""")
def roll_forward_calendar(spark, sf_dir):
    cal = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("t")).where(F.weekday("t") < 5)
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("t")).agg(F.round(F.sum("l_quantity"), 4).alias("v"))
    return j.roll_forward(o, cal, "k", "t", "v")


@query("""WITH m AS (SELECT l_suppkey AS k, l_shipdate::DATE AS t, sum(l_discount) AS x FROM lineitem GROUP BY 1, 2),
b AS (SELECT DISTINCT l_suppkey AS k, l_orderkey, l_linenumber, l_shipdate::DATE - 30 AS low, l_shipdate::DATE AS high FROM lineitem)
SELECT b.k, l_orderkey, l_linenumber, round(coalesce(sum(x), 0), 6) AS total FROM b LEFT JOIN m ON m.k = b.k AND m.t > low AND m.t <= high GROUP BY b.k, l_orderkey, l_linenumber, low""")
def interval_sum(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("t"), F.col("l_discount").alias("x"))
    b = li.select("k", "l_orderkey", "l_linenumber", F.date_sub("t", 30).alias("low"), F.col("t").alias("high")).distinct()
    return j.interval_sums(b, li, "k", "low", "high", "t", "x").select("k", "l_orderkey", "l_linenumber", F.round("total", 6).alias("total"))


@query("""WITH c AS (SELECT l_shipdate::DATE AS t, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 1), p AS (SELECT max(n) * 0.30 AS quorum FROM c)
SELECT t, n, n >= greatest(1, floor(quorum)) AS open FROM c, p""")
def calendar_quorum(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("t"), "l_suppkey").where(F.weekday("t") < 5)
    c = li.groupBy("t").agg(F.countDistinct("l_suppkey").alias("n"))
    # The peak is one row.
    return c.crossJoin(F.broadcast(c.agg(F.greatest(F.floor(F.max("n") * F.lit(0.30)), F.lit(1)).alias("quorum")))).select("t", "n", (F.col("n") >= F.col("quorum")).alias("open"))


@query("""WITH s AS (SELECT DISTINCT l_shipdate::DATE AS t FROM lineitem WHERE isodow(l_shipdate) < 6), p AS (SELECT DISTINCT l_suppkey AS k, l_shipdate::DATE AS t FROM lineitem),
x AS (SELECT k, min(t) AS a, max(t) AS b FROM p GROUP BY k) SELECT x.k, s.t FROM x JOIN s ON s.t BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = x.k AND p.t = s.t)""")
def gap_check(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("t"))
    return j.missing_days(li, li.where(F.weekday("t") < 5), "k", "t")


@query("""SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS name FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey + 5 LEFT JOIN nation b ON b.n_nationkey = s_nationkey""")
def disjunctive_join(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return j.either_key(sup, n, [F.col("s_nationkey") + 5, F.col("s_nationkey")], "n_nationkey").select("s_suppkey", F.col("n_name").alias("name"))


@query("""SELECT c_custkey, (SELECT max(o_orderdate)::DATE FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def lateral_latest_anti(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("last_order"))
    bad = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return read(spark, sf_dir, "customer").select("c_custkey").join(bad, "c_custkey", "left_anti").join(last, "c_custkey", "left")


@query(f"""WITH {RETURNS}, sp AS (SELECT c_mktsegment AS seg, date_trunc('week', o_orderdate)::DATE AS t, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sr AS (SELECT seg, t, ln(price / lag(price) OVER (PARTITION BY seg ORDER BY t)) AS x FROM sp)
SELECT id, seg, count(*) AS n, round(corr(ret, x), 6) AS corr FROM r JOIN sr USING (t) WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY id, seg HAVING count(*) >= 250 ORDER BY abs(corr(ret, x)) DESC, id, seg LIMIT 15""")
def reference_corr_topk(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.groupBy(F.col("c_mktsegment").alias("id"), F.date_trunc("week", "o_orderdate").cast("date").alias("t")).agg(F.avg("o_totalprice").alias("price"))
    x = p.select(F.col("id").alias("seg"), "t", s.log_return().alias("x"))
    k = returns(spark, sf_dir).select("id", "t", "ret").join(x, "t").where("ret IS NOT NULL AND x IS NOT NULL").groupBy("id", "seg").agg(F.count(F.lit(1)).alias("n"), F.corr("ret", "x").alias("c"))
    return k.where("n >= 250").orderBy(F.abs("c").desc(), "id", "seg").limit(15).select("id", "seg", "n", F.round("c", 6).alias("corr"))


@query("""WITH bad AS (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07), n AS (SELECT count(*) AS checked FROM lineitem) SELECT checked, l_orderkey FROM n LEFT JOIN bad ON true""")
def violations_with_count(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("checked")).join(li.where("l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07").select("l_orderkey"), F.lit(True), "left")


@query("""WITH m AS (SELECT max(o_orderdate::DATE) AS newest FROM orders) SELECT o_custkey, count(*) AS n, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last,
CASE WHEN max(o_orderdate::DATE) >= any_value(newest) - 10 THEN 'live' WHEN max(o_orderdate::DATE) >= any_value(newest) - 200 THEN 'not_refreshed' ELSE 'discontinued' END AS status FROM orders, m GROUP BY o_custkey""")
def coverage_status(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("t"))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    newest = o.agg(F.max("t").alias("newest"))
    live = F.when(F.col("last") >= F.date_sub("newest", 10), "live").when(F.col("last") >= F.date_sub("newest", 200), "not_refreshed").otherwise("discontinued")
    return g.crossJoin(F.broadcast(newest)).select("o_custkey", "n", "first", "last", live.alias("status"))


@query("""SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT) AS k, count(*) FILTER (json_extract_string(props, '$.k')::BIGINT > 50) AS large FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def json_path_agg(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").where(k.isNotNull()).groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k > 50).alias("large"))


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN lower(p_name) LIKE 'red%' THEN 1 ELSE 2 END AS r FROM part WHERE lower(p_name) LIKE '%r%' ORDER BY r, p_retailprice DESC NULLS LAST, p_partkey LIMIT 20""")
def ranked_search(spark, sf_dir):
    n = F.lower("p_name")
    r = F.when(n == "red ring", 0).when(n.startswith("red"), 1).otherwise(2)
    return read(spark, sf_dir, "part").where(n.contains("r")).select("p_partkey", "p_name", r.alias("r"), "p_retailprice").orderBy("r", F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).drop("p_retailprice")


@query(r"""SELECT p_partkey, regexp_replace(p_brand || ' (ex-' || p_type || ')', '\s*\((?:ex|Ex)-[^)]*\)', '', 'g') AS name, split_part(p_brand, '#', 1) AS provider, split_part(p_brand, '#', 2) AS code,
CASE WHEN p_type LIKE 'E%' THEN 'economy' WHEN p_type LIKE '%O' THEN 'ends_o' WHEN p_type LIKE 'S%' THEN 'standard' ELSE 'other' END AS class, regexp_matches(p_name || ' of ' || p_type, '\bof\b') AS mentions FROM part""")
def text_rules(spark, sf_dir):
    t = F.col("p_type")
    kind = F.when(t.like("E%"), "economy").when(t.like("%O"), "ends_o").when(t.like("S%"), "standard").otherwise("other")
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.concat("p_brand", F.lit(" (ex-"), t, F.lit(")")), r"\s*\((?:ex|Ex)-[^)]*\)", "").alias("name"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("provider"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("code"), kind.alias("class"), F.concat("p_name", F.lit(" of "), t).rlike(r"\bof\b").alias("mentions"))


@query("""WITH d AS (SELECT DISTINCT l_shipdate::DATE AS t FROM lineitem), n AS (SELECT count(*) AS n FROM d), c AS (SELECT p_brand AS id, count(DISTINCT l_shipdate::DATE) AS k, min(l_shipdate::DATE) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT id, first, round(k / n::DOUBLE, 6) AS coverage, k / n::DOUBLE >= 0.6 AS kept FROM c, n""")
def coverage_filter(spark, sf_dir):
    p = s.weekly_prices(spark, sf_dir, unit="day")
    days = p.agg(F.countDistinct("t").alias("n"))
    c = p.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("first"))
    share = F.col("k") / F.col("n")
    return c.crossJoin(F.broadcast(days)).select("id", "first", F.round(share, 6).alias("coverage"), (share >= 0.6).alias("kept"))


@query("""WITH n AS (SELECT count(DISTINCT p_brand) AS k FROM part) SELECT l_shipdate::DATE AS t FROM lineitem JOIN part ON l_partkey = p_partkey, n GROUP BY 1 HAVING count(DISTINCT p_brand) >= any_value(k) * 0.8""")
def complete_case_days(spark, sf_dir):
    p = s.weekly_prices(spark, sf_dir, unit="day").groupBy("t").agg(F.countDistinct("id").alias("c"))
    k = read(spark, sf_dir, "part").agg(F.countDistinct("p_brand").alias("k"))
    return p.crossJoin(F.broadcast(k)).where(F.col("c") >= F.col("k") * 0.8).select("t")


@query("""SELECT p_type, p_brand, list_sort(list_distinct(list(p_size))) AS sizes, median(p_retailprice) AS med, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1, 2""")
def quantiles_by_group(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"), F.median("p_retailprice").alias("med"), F.round(F.percentile("p_retailprice", 0.95), 6).alias("p95"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("""WITH y AS (SELECT o_custkey AS id, (extract(year FROM o_orderdate) // 2)::BIGINT AS era, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2)
SELECT id, count(*) AS eras, round(avg(m), 4) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM y GROUP BY id HAVING count(*) >= 3""")
def two_level_t_stat(spark, sf_dir):
    y = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.floor(F.year("o_orderdate") / 2).alias("era")).agg(F.avg("o_totalprice").alias("m"))
    g = y.groupBy("id").agg(F.count(F.lit(1)).alias("eras"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).where("eras >= 3")
    return g.select("id", "eras", F.round("mean", 4).alias("mean"), F.round(F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("eras")), 4).alias("t"))


@query(f"""WITH {PRICES} SELECT id, round(power(arg_max(price, t) / arg_min(price, t), 365.25 / (max(t) - min(t))) - 1, 6) AS cagr FROM p GROUP BY id""")
def naive_history(spark, sf_dir):
    p = s.weekly_prices(spark, sf_dir).groupBy("id").agg(F.max_by("price", "t").alias("b"), F.min_by("price", "t").alias("a"), F.datediff(F.max("t"), F.min("t")).alias("d"))
    return p.select("id", F.round(F.pow(F.col("b") / F.col("a"), F.lit(365.25) / F.col("d")) - 1, 6).alias("cagr"))


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH k AS (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1, 2""")
def sliding_events(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS stop, count(*) AS n FROM b GROUP BY user_id, sid""")
def session_events(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("""WITH t AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part), k AS (SELECT p_brand, (p_size > 10)::INT + (p_size < 40)::INT + (p_retailprice > 1000)::INT + (p_retailprice < 1900)::INT + (p_partkey % 2 = 0)::INT AS score FROM t)
SELECT score, count(*) AS n, count(DISTINCT p_brand) AS brands FROM k GROUP BY score""")
def quality_score(spark, sf_dir):
    tests = [F.col("p_size") > 10, F.col("p_size") < 40, F.col("p_retailprice") > 1000, F.col("p_retailprice") < 1900, F.col("p_partkey") % 2 == 0]
    score = sum((c.cast("int") for c in tests), F.lit(0))
    return read(spark, sf_dir, "part").groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"))


@query("""SELECT p_brand AS id, list_sort(list(DISTINCT l_suppkey)) AS used_by FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def inverted_index(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("used_by"))


@query("""WITH a AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT p_type, list(DISTINCT p_brand) AS brands FROM part WHERE p_retailprice > 930 GROUP BY 1)
SELECT a.p_type, len(list_intersect(a.brands, b.brands)) AS both, len(list_filter(a.brands, lambda x: NOT list_contains(b.brands, x))) AS only_a FROM a JOIN b USING (p_type)""")
def set_operations(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a = p.where("p_size < 10").groupBy("p_type").agg(F.collect_set("p_brand").alias("a"))
    b = p.where("p_retailprice > 930").groupBy("p_type").agg(F.collect_set("p_brand").alias("b"))
    return a.join(b, "p_type").select("p_type", F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"))


@query("""SELECT sha256(p_brand || '|' || p_type) AS spec_id, count(*) AS n FROM part GROUP BY 1""")
def spec_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("spec_id")).agg(F.count(F.lit(1)).alias("n"))
