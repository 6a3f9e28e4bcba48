"""Candidate evaluation, long-only weights and block structure, on universes small enough for a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import covariance as cv
from tidemark.operators import evaluation as ev
from tidemark.operators import grids as gr
from tidemark.operators import panels as pn
from tidemark.operators import series as s
from tidemark.operators import unitroots as ur
from tidemark.operators import weights as wt
from tidemark.operators.selection import Candidate
from tidemark.plans.forecasts import TAIL
from tidemark.plans.panel import MARKET, query, returns, rnd, with_market
from tidemark.plans.panel import PRICES as PRICES_SQL
from tidemark.plans.quant import TYPES, type_returns

CANDIDATES = {"market_52": Candidate(("mkt",), 52), "market_104": Candidate(("mkt",), 104), "late_104": Candidate(("m2",), 104)}
#: Windows of each candidate at each grid row, in one scan of the rows before it.
FIT = "SELECT g.id, g.part, g.t AS window_end, '{name}' AS candidate, '{x}' AS factor, regr_slope(v.y, v.{x}) AS beta, regr_r2(v.y, v.{x}) AS r2, count(*) AS n, var_samp(v.{x}) AS vx, (var_pop(v.y) - power(covar_pop(v.y, v.{x}), 2) / var_pop(v.{x})) * count(*) / (count(*) - 2) AS e2 FROM g JOIN v ON v.id = g.id AND v.pos <= g.pos AND v.pos > g.pos - {w} WHERE g.part <> 'embargo' AND v.y IS NOT NULL AND v.{x} IS NOT NULL GROUP BY ALL HAVING count(*) >= 40"


@query(f"""WITH {MARKET}, v AS (SELECT id, t, ret AS y, mkt, lag(mkt) OVER w AS m2, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY id) AS size FROM rm WINDOW w AS (PARTITION BY id ORDER BY t)),
g0 AS (SELECT *, count(*) OVER (PARTITION BY id) AS k, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS back FROM v WHERE size - 5 - pos >= 0 AND (size - 5 - pos) % 5 = 0 AND pos >= 104),
g1 AS (SELECT *, min(pos) FILTER (back <= least(36, greatest(12, round(k * 0.30)::INT))) OVER (PARTITION BY id) AS first_test FROM g0 WHERE k >= 24),
g AS (SELECT id, t, pos, CASE WHEN pos >= first_test THEN 'test' WHEN pos + 4 < first_test THEN 'validation' ELSE 'embargo' END AS part FROM g1),
f AS ({" UNION ALL ".join(FIT.format(name=k, x=c.factors[0], w=c.window) for k, c in CANDIDATES.items())}),
sp AS (SELECT id, part, min(t) AS low, max(t) AS last, min(min(t)) FILTER (part = 'test') OVER (PARTITION BY id) AS cut FROM g WHERE part <> 'embargo' GROUP BY id, part),
dy AS (SELECT v.id, sp.part, v.t, v.y, v.mkt, v.m2, (SELECT max(t) FROM g WHERE g.id = v.id AND g.part = sp.part AND g.t < v.t) AS window_end FROM v JOIN sp ON sp.id = v.id WHERE v.t > low AND v.t <= last + 6 AND (sp.part = 'test' OR v.t < cut)),
x AS (SELECT f.id, f.candidate, f.part, y, CASE factor WHEN 'mkt' THEN mkt ELSE m2 END * beta AS fit, beta * beta * vx + e2 AS s2 FROM dy JOIN f ON f.id = dy.id AND f.part = dy.part AND f.window_end = dy.window_end),
a AS (SELECT id, candidate, part, count(*) AS n_days, CASE WHEN count(*) >= 50 THEN 1 - sum(power(y - fit, 2)) / (var_pop(y) * count(*)) END AS oos_r2, avg(y * y / s2 + ln(s2)) AS loss FROM x WHERE y IS NOT NULL AND fit IS NOT NULL GROUP BY ALL),
b AS (SELECT id, candidate, part, count(*) AS n_windows, avg(r2) AS r2 FROM f GROUP BY ALL)
SELECT b.id, b.candidate, b.part, n_windows, n_days, round(oos_r2, 6) AS oos_r2, round(loss, 6) AS loss, round(r2, 6) AS r2 FROM b LEFT JOIN a ON a.id = b.id AND a.candidate = b.candidate AND a.part = b.part""")
def candidate_evaluation(spark, sf_dir):
    d = with_market(spark, sf_dir).withColumn("m2", F.lag("mkt").over(s.by())).select("id", "t", F.col("ret").alias("y"), "mkt", "m2")
    out = ev.evaluated(d, list(CANDIDATES.values()), 4, 5, 104, least=40, least_test=12)
    name = F.coalesce(*(F.when(F.col("candidate") == c.key(), F.lit(k)) for k, c in CANDIDATES.items()))
    return out.select("id", name.alias("candidate"), "part", "n_windows", "n_days", *rnd("oos_r2", "loss", "r2"))


def pair_universes(spark, sf_dir):
    """Every two part types as a universe: their covariances, means, and products with the mean of all types."""
    d = cv.complete(type_returns(spark, sf_dir))
    half = cv.sample(d).select("i", "j", "cov")
    target = d.groupBy("t").agg(F.avg("x").alias("y"))
    cross = d.join(target, "t").groupBy("id").agg((F.avg("x") * 252).alias("mean"), (F.covar_samp("x", "y") * 252).alias("cross"))
    pairs = half.where("i < j").select(F.concat_ws("+", "i", "j").alias("universe"), F.array("i", "j").alias("ids"), F.col("cov").alias("c"))
    own = half.where("i = j").select(F.col("i").alias("id"), F.col("cov").alias("v"))
    u = pairs.select("universe", "c", F.posexplode("ids").alias("k", "id")).join(own, "id").join(cross, "id")
    return u.select("universe", "id", "mean", F.when(F.col("k") == 0, F.array("v", "c")).otherwise(F.array("c", "v")).alias("row"), "cross")


#: The first weight of two: held between zero and one where variance is least, the tangency (or the one with a positive mean and the higher ratio), the nearest mix.
@query(f"""WITH {TYPES}, tg AS (SELECT t, avg(x) AS y FROM d GROUP BY t), mo AS (SELECT id, avg(x) * 252 AS m, var_samp(x) * 252 AS v, covar_samp(x, y) * 252 AS q FROM d JOIN tg USING (t) GROUP BY id),
pr AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) WHERE a.id < b.id GROUP BY 1, 2),
u AS (SELECT i, j, c, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2, a.q AS q1, b.q AS q2, b.v * a.m - c * b.m AS y1, a.v * b.m - c * a.m AS y2 FROM pr JOIN mo a ON a.id = i JOIN mo b ON b.id = j),
w AS (SELECT *, least(1, greatest(0, (v2 - c) / (v1 + v2 - 2 * c))) AS w_min, least(1, greatest(0, (q1 - q2 + v2 - c) / (v1 + v2 - 2 * c))) AS w_style FROM u),
z AS (SELECT *, CASE WHEN m1 <= 0 AND m2 <= 0 THEN w_min WHEN y1 > 0 AND y2 > 0 THEN y1 / (y1 + y2) WHEN m1 / sqrt(v1) >= m2 / sqrt(v2) THEN 1 ELSE 0 END AS w_max FROM w),
l AS (SELECT i || '+' || j AS universe, i, j, unnest([{{'p': 'min_variance', 'w': w_min}}, {{'p': 'max_sharpe', 'w': w_max}}, {{'p': 'style', 'w': w_style}}], recursive := true), m1, m2, v1, v2, c FROM z)
SELECT universe, p AS portfolio, round(w * m1 + (1 - w) * m2, 6) AS mean, round(sqrt(w * w * v1 + (1 - w) * (1 - w) * v2 + 2 * w * (1 - w) * c), 6) AS vol, round(w, 6) AS first_weight, true AS optimal FROM l""")
def long_only_weights(spark, sf_dir):
    d = wt.of_universes(pair_universes(spark, sf_dir))
    g = d.groupBy("universe", "portfolio").agg(F.first("mean").alias("mean"), F.first("vol").alias("vol"), F.min_by("weight", "id").alias("first_weight"), (F.max("kkt") < 1e-8).alias("optimal"))
    return g.select("universe", "portfolio", *rnd("mean", "vol", "first_weight"), "optimal")


@query(None)
def exact_frontier(spark, sf_dir):
    """The frontier of all part types; every point with its kkt."""
    d = cv.complete(type_returns(spark, sf_dir))
    c = cv.full(cv.sample(d).select("i", "j", "cov"))
    rows = c.groupBy(F.col("i").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"]).alias("row"))
    m = d.groupBy("id").agg((F.avg("x") * 252).alias("mean"))
    return wt.of_universes(rows.join(m, "id").select(F.lit("types").alias("universe"), "id", "mean", "row", F.lit(None).cast("double").alias("cross")), 15)


#: Of two members with correlation r: the share (1 + |r|) / 2, loadings of equal size, the second with r's sign.
@query(f"""WITH {TYPES}, bk AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= 2 THEN 'a' WHEN row_number() OVER (ORDER BY id) <= 4 THEN 'b' WHEN row_number() OVER (ORDER BY id) = 5 THEN 'c' ELSE 'd' END AS block FROM (SELECT DISTINCT id FROM d)),
x AS (SELECT d.id, t, x, block FROM d JOIN bk ON bk.id = d.id), rb AS (SELECT a.block, corr(a.x, b.x) AS r FROM x a JOIN x b ON a.block = b.block AND a.t = b.t AND a.id < b.id GROUP BY a.block),
ob AS (SELECT block, id, sqrt(var_samp(x) * 252) AS vol, count(*) OVER (PARTITION BY block) AS size, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM x GROUP BY block, id)
SELECT ob.block, size, id, round(vol, 6) AS vol, round(coalesce((1 + abs(r)) / 2, 1), 6) AS pc1_share, round(CASE WHEN size = 1 THEN 1 WHEN k = 1 THEN sqrt(0.5) ELSE sign(r) * sqrt(0.5) END, 6) AS loading, round(coalesce(r, 0), 6) AS centrality FROM ob LEFT JOIN rb r ON r.block = ob.block""")
def block_components(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    at = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("id"))
    blocks = d.select("id").distinct().withColumn("block", F.when(at <= 2, "a").when(at <= 4, "b").when(at == 5, "c").otherwise("d"))
    return pn.block_structure(cv.sample(d).select("i", "j", "cov"), blocks).select("block", "size", "id", *rnd("vol", "pc1_share", "loading", "centrality"))


GRID = [gr.Configuration(n, m) for n, m in (("slow", ((1.0, 52.0),)), ("middle", ((1.0, 26.0),)), ("fast", ((1.0, 8.0),)), ("two", ((0.5, 8.0), (0.5, 52.0))), ("three", ((0.25, 8.0), (0.25, 26.0), (0.5, 52.0))), ("mostly_fast", ((0.8, 8.0), (0.2, 26.0))))]


def holdings(d):
    """Two portfolios: all ids at equal weights, and the first two by name, one long and half as much short."""
    ids = d.select("id").distinct()
    rank = F.row_number().over(W.orderBy("id"))
    size = ids.agg(F.count(F.lit(1)).alias("k"))
    # Ids of a universe are a short list.
    every = ids.crossJoin(F.broadcast(size)).select(F.lit("all").alias("portfolio"), "id", (1.0 / F.col("k")).alias("weight"))
    two = ids.withColumn("r", rank).where("r <= 2").select(F.lit("two").alias("portfolio"), "id", F.when(F.col("r") == 1, 1.0).otherwise(-0.5).alias("weight"))
    return every.unionByName(two)


@query(f"""WITH {TYPES}, pp AS (SELECT a.id AS i, b.id AS j, a.t, a.x * b.x AS ab, row_number() OVER (PARTITION BY a.id, b.id ORDER BY a.t) AS k FROM d a JOIN d b ON a.t = b.t AND a.id <= b.id),
hl AS (SELECT unnest([8.0, 26.0, 52.0]) AS h), em AS (SELECT p.i, p.j, p.t, h, sum(power(0.5, (p.k - q.k) / h) * q.ab) / sum(power(0.5, (p.k - q.k) / h)) AS m FROM pp p JOIN pp q ON q.i = p.i AND q.j = p.j AND q.k <= p.k CROSS JOIN hl WHERE p.k >= 40 GROUP BY ALL),
ho AS (SELECT 'all' AS portfolio, id, 1.0::DOUBLE / count(*) OVER () AS w FROM (SELECT DISTINCT id FROM d) UNION ALL SELECT 'two', id, CASE r WHEN 1 THEN 1.0 ELSE -0.5 END FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT DISTINCT id FROM d)) WHERE r <= 2),
vv AS (SELECT a.portfolio, t, h, sum(a.w * b.w * m * CASE WHEN i = j THEN 1 ELSE 2 END) AS v FROM em JOIN ho a ON a.id = i JOIN ho b ON b.id = j AND b.portfolio = a.portfolio GROUP BY ALL),
cf AS (SELECT * FROM (VALUES {", ".join(f"('{c.name}', {w}, {h})" for c in GRID for w, h in c.mix)}) z(configuration, share, h))
SELECT portfolio, configuration, t, round(sqrt(sum(share * v) * 252), 6) AS sigma FROM vv JOIN cf ON cf.h = vv.h GROUP BY ALL""")
def configuration_grid(spark, sf_dir):
    d = cv.complete(type_returns(spark, sf_dir))
    return gr.grid(d, holdings(d), GRID, 40).select("portfolio", "configuration", "t", F.round("sigma", 6).alias("sigma"))


NORMAL = "CASE WHEN {z} < 0 THEN {t} / 2 ELSE 1 - {t} / 2 END"


@query(f"""WITH {PRICES_SQL}, x0 AS (SELECT id, t, ln(price) AS x FROM p WHERE price > 0), x1 AS (SELECT *, lag(x) OVER w AS b4, x - lag(x) OVER w AS d FROM x0 WINDOW w AS (PARTITION BY id ORDER BY t)), x2 AS (SELECT *, lag(d) OVER (PARTITION BY id ORDER BY t) AS d1 FROM x1),
g AS (SELECT id, count(*) AS n, covar_pop(b4, b4) AS a, covar_pop(d1, d1) AS b, covar_pop(b4, d1) AS c, covar_pop(d, b4) AS p, covar_pop(d, d1) AS q, covar_pop(d, d) AS v FROM x2 WHERE d1 IS NOT NULL GROUP BY id),
h AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS b1, (a * q - c * p) / (a * b - c * c) AS b2 FROM g), s AS (SELECT id, n, b1 / sqrt((v - b1 * p - b2 * q) / (n - 3) * b / (a * b - c * c)) AS tt FROM h),
z AS (SELECT *, CASE WHEN tt <= -1.61 THEN 2.1659 + 1.4412 * tt + 0.038269 * tt * tt ELSE 1.7339 + 0.93202 * tt - 0.12745 * tt * tt - 0.010368 * tt * tt * tt END AS z FROM s)
SELECT id, n, round(tt, 6) AS t_stat, round(CASE WHEN tt < -18.83 THEN 0 WHEN tt > 2.74 THEN 1 ELSE {NORMAL.format(z="z", t=TAIL.format(x="(z * z)"))} END, 6) AS p_value FROM z""")
def unit_root_one_lag(spark, sf_dir):
    """Log prices of each brand: levels, which may have a unit root."""
    d = returns(spark, sf_dir).where("price > 0").select("id", "t", F.ln("price").alias("x"))
    return ur.one_lag(d).select("id", "n", *rnd("t_stat", "p_value"))


@query(f"""WITH {TYPES}, mo AS (SELECT id, avg(x) * 252 AS m FROM d GROUP BY id), ve AS (SELECT 'history' AS vector, id, m FROM mo UNION ALL SELECT 'even', id, 0.05 FROM mo UNION ALL SELECT 'reverse', id, -m FROM mo),
pc AS (SELECT a.id AS i, b.id AS j, covar_samp(a.x, b.x) * 252 AS c FROM d a JOIN d b USING (t) GROUP BY 1, 2),
ho AS (SELECT 'all' AS portfolio, id, 1.0::DOUBLE / count(*) OVER () AS w FROM mo UNION ALL SELECT 'two', id, CASE r WHEN 1 THEN 1.0 ELSE -0.5 END FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM mo) WHERE r <= 2),
rk AS (SELECT a.portfolio, sqrt(sum(a.w * b.w * c)) AS risk FROM ho a JOIN ho b ON b.portfolio = a.portfolio JOIN pc ON i = a.id AND j = b.id GROUP BY 1), ex AS (SELECT portfolio, vector, sum(w * m) AS excess FROM ho JOIN ve ON ve.id = ho.id GROUP BY 1, 2)
SELECT ex.portfolio, vector, round(excess, 6) AS excess, round(risk, 6) AS risk, round(excess / risk, 6) AS sharpe, CASE WHEN ex.portfolio = 'all' THEN true END AS below FROM ex JOIN rk ON rk.portfolio = ex.portfolio""")
def perspectives(spark, sf_dir):
    """Two portfolios under three views; none without short positions lies above a view's own frontier."""
    d = cv.complete(type_returns(spark, sf_dir))
    m = d.groupBy("id").agg((F.avg("x") * 252).alias("m"))
    views = F.explode(F.array(*(F.struct(F.lit(n).alias("vector"), v.alias("excess")) for n, v in (("history", F.col("m")), ("even", F.lit(0.05)), ("reverse", -F.col("m")))))).alias("v")
    out = wt.perspectives(holdings(d), m.select("id", views).select("v.vector", "id", "v.excess"), cv.full(cv.sample(d).select("i", "j", "cov")))
    return out.select("portfolio", "vector", *rnd("excess", "risk", "sharpe"), F.when(F.col("portfolio") == "all", F.col("gap") > -1e-6).alias("below"))
