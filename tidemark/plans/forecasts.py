"""Rolling regressions with lags, forecasts that use them, and their scores, with one factor so that SQL has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regression as rg
from tidemark.operators import risk as rk
from tidemark.operators import series as s
from tidemark.plans.panel import MARKET, query, returns, rnd, with_market
from tidemark.sources.stored import materialised

#: Windows of 104 rows each 26 rows, 60 at least; forecasts of 4 rows.
SPEC = rg.Spec(window=104, step=26, least=60, lags=1)
RISK = rk.RiskSpec(window=156, half_life=26.0, share=0.6, specific_half_life=13.0, horizon=4, lags=2, revert_half_life=20.0)

#: Slopes on the market and on the market of the row before, inside each window: the normal equations of two regressors.
DIMSON = f"""{MARKET}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) - 1 AS back, count(*) OVER (PARTITION BY id) AS size FROM rm),
wr AS (SELECT id, j, t, ret, mkt, lag(mkt) OVER (PARTITION BY id, j ORDER BY t) AS m2, max(t) OVER (PARTITION BY id, j) AS window_end FROM b, (SELECT unnest(range(0, 40)) AS j) WHERE back BETWEEN j * 26 AND j * 26 + 103 AND size - j * 26 >= 60),
wc AS (SELECT * FROM wr WHERE ret IS NOT NULL AND mkt IS NOT NULL AND m2 IS NOT NULL),
wg AS (SELECT id, window_end, count(*) AS n, covar_pop(mkt, mkt) AS a, covar_pop(m2, m2) AS b, covar_pop(mkt, m2) AS c, covar_pop(ret, mkt) AS p, covar_pop(ret, m2) AS q, covar_pop(ret, ret) AS v, avg(ret) AS my, avg(mkt) AS m1, avg(m2) AS mm FROM wc GROUP BY id, window_end),
wb AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS b1, (a * q - c * p) / (a * b - c * c) AS b2 FROM wg WHERE n >= 4),
wl AS (SELECT *, b1 + b2 AS beta, v - b1 * p - b2 * q AS left_over, sqrt(greatest(v - b1 * p - b2 * q, 0) * n / (n - 3) * 252) AS resid_vol FROM wb)"""


def loadings(spark, sf_dir):
    return materialised(rg.rolling(with_market(spark, sf_dir), ["mkt"], SPEC, "ret", detail=True))


@query(f"""WITH {DIMSON} SELECT id, window_end, n, round(beta, 6) AS beta, round(b1, 6) AS same_day, round(b2, 6) AS day_before, round(1 - left_over / v, 6) AS r2, round(resid_vol, 6) AS resid_vol FROM wl""")
def dimson_regression(spark, sf_dir):
    d = loadings(spark, sf_dir)
    return d.select("id", "window_end", F.col("n").cast("long").alias("n"), F.round("beta", 6).alias("beta"), F.round(F.get("lag_betas", 0), 6).alias("same_day"), F.round(F.get("lag_betas", 1), 6).alias("day_before"), *rnd("r2", "resid_vol"))


#: The market's variance of each window end with weights, long run, lagged products, and what follows for the horizon; then residuals and their mean.
RISK_SQL = f"""{DIMSON},
fx AS (SELECT t, mkt AS x, lag(mkt) OVER (ORDER BY t) AS x1, row_number() OVER (ORDER BY t) AS pos FROM m WHERE mkt IS NOT NULL),
en AS (SELECT window_end, (SELECT max(pos) FROM fx WHERE t <= window_end) AS last FROM (SELECT DISTINCT window_end FROM wl)),
fr AS (SELECT window_end, pos, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, power(0.5, (last - pos) / 26.0) AS w FROM en JOIN fx ON pos <= last AND pos > last - 156 WINDOW w AS (PARTITION BY window_end ORDER BY pos)),
mu AS (SELECT window_end, count(*) AS n, sum(w * x) / sum(w) AS me, avg(x) AS m, sum(w) AS sw, sum(w * w) / (sum(w) * sum(w)) AS w2, var_samp(x) * 252 AS far FROM fr GROUP BY window_end HAVING count(*) >= 60),
vc AS (SELECT fr.window_end, any_value(far) AS far, 0.6 * sum(w * power(x - me, 2)) / any_value(sw) / (1 - any_value(w2)) * 252 + 0.4 * any_value(far) AS c,
  (0.6 * sum(w * (x - me) * (l1 - me)) / sum(w) FILTER (l1 IS NOT NULL) + 0.4 * avg((x - m) * (l1 - m))) * 252 AS g1,
  (0.6 * sum(w * (x - me) * (l2 - me)) / sum(w) FILTER (l2 IS NOT NULL) + 0.4 * avg((x - m) * (l2 - m))) * 252 AS g2 FROM fr JOIN mu ON mu.window_end = fr.window_end GROUP BY fr.window_end),
gw AS (SELECT (1 - power(0.5, 4 / 20.0)) / (4 * (1 - power(0.5, 1 / 20.0))) AS g),
hc AS (SELECT window_end, c, greatest(far + g * (c - far) + 2 * (0.75 * g1 + 0.5 * g2), 0) AS ch FROM vc, gw),
dy AS (SELECT r.id, r.t, r.ret, (SELECT max(window_end) FROM wl WHERE wl.id = r.id AND wl.window_end < r.t) AS window_end FROM r),
e AS (SELECT dy.id, dy.t, dy.window_end, power(dy.ret - b1 * fx.x - b2 * fx.x1, 2) AS e2, row_number() OVER (PARTITION BY dy.id ORDER BY dy.t) AS k FROM dy JOIN wl ON wl.id = dy.id AND wl.window_end = dy.window_end LEFT JOIN fx ON fx.t = dy.t),
rc AS (SELECT id, k, t, e2, window_end, NULL::DOUBLE AS before, e2 AS v FROM e WHERE k = 1
  UNION ALL SELECT e.id, e.k, e.t, e.e2, e.window_end, rc.v, CASE WHEN e.e2 IS NULL THEN rc.v WHEN rc.v IS NULL THEN e.e2 ELSE power(0.5, 1 / 13.0) * rc.v + (1 - power(0.5, 1 / 13.0)) * e.e2 END FROM rc JOIN e ON e.id = rc.id AND e.k = rc.k + 1),
fo AS (SELECT rc.id, rc.t, rc.window_end, beta * beta * hc.c AS fv, (b1 * b1 + b2 * b2) * hc.c AS dv, beta * beta * ch AS hv, greatest(coalesce(before * 252, 0.0004), 0.0004) AS s, greatest(power(resid_vol, 2), 0.0004) AS far FROM rc JOIN wl ON wl.id = rc.id AND wl.window_end = rc.window_end JOIN hc ON hc.window_end = rc.window_end)"""


def forecast_rows(spark, sf_dir):
    market = s.market_returns(spark, sf_dir).select(F.lit("mkt").alias("id"), "t", F.col("mkt").alias("x")).where("x IS NOT NULL")
    return rk.forecasts(loadings(spark, sf_dir), returns(spark, sf_dir).select("id", "t", "ret"), market, RISK)


@query(f"""WITH RECURSIVE {RISK_SQL} SELECT id, t, window_end, round(sqrt(fv), 6) AS sigma_factor, round(sqrt(s), 6) AS sigma_specific, round(sqrt(fv + s), 6) AS sigma, round(sqrt(dv + s), 6) AS sigma_dimson,
round(sqrt(hv + greatest(far + g * (s - far), 0.0004)), 6) AS sigma_horizon FROM fo, gw""")
def risk_forecast_horizon(spark, sf_dir):
    """One factor with a lag: all columns have a closed form."""
    return forecast_rows(spark, sf_dir).select("id", "t", "window_end", *rnd("sigma_factor", "sigma_specific", "sigma", "sigma_dimson", "sigma_horizon"))


#: Trailing volatilities of 26, 52 and 13 rows that end with the row; each fourth row is on the grid; a forecast is reliable unless the row's volume ends in seven.
SCORED = f"""{MARKET}, v AS (SELECT r.id, r.t, r.ret, r.volume, m.mkt FROM r JOIN m ON m.t = r.t),
k AS (SELECT id, t, ret, CASE WHEN count(ret) OVER a >= 13 THEN stddev_samp(ret) OVER a * sqrt(252) END AS sigma, CASE WHEN count(ret) OVER b >= 26 THEN stddev_samp(ret) OVER b * sqrt(252) END AS own, CASE WHEN count(ret) OVER c >= 6 THEN stddev_samp(ret) OVER c * sqrt(252) END AS capm,
  row_number() OVER w AS pos, row_number() OVER w % 4 = 0 AS on_grid, volume::BIGINT % 10 <> 7 AS is_reliable,
  CASE WHEN count(*) OVER f = 4 AND count(ret) OVER f >= 2 THEN stddev_samp(ret) OVER f * sqrt(252) END AS real, CASE WHEN count(*) OVER f = 4 THEN sum(coalesce(ret, 0)) OVER f END AS r_h FROM v
  WINDOW w AS (PARTITION BY id ORDER BY t), a AS (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW), b AS (w ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), c AS (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), f AS (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""
#: P(|normal| > sqrt(x)) by the rational approximation of its tail, and Student's two-sided tail with a whole number of degrees, as a finite sum.
TAIL = "((0.254829592 + (-0.284496736 + (1.421413741 + (-1.453152027 + 1.061405429 / (1 + 0.3275911 * sqrt({x} / 2))) / (1 + 0.3275911 * sqrt({x} / 2))) / (1 + 0.3275911 * sqrt({x} / 2))) / (1 + 0.3275911 * sqrt({x} / 2))) / (1 + 0.3275911 * sqrt({x} / 2)) * exp(-{x} / 2))"
STUDENT = """(1 - CASE WHEN {n} % 2 = 0 THEN sin(atan({t} / sqrt({n}))) * list_sum(list_transform(range(0, {n} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * power(cos(atan({t} / sqrt({n}))), 2 * k)))
ELSE 2 / pi() * (atan({t} / sqrt({n})) + sin(atan({t} / sqrt({n}))) * cos(atan({t} / sqrt({n}))) * list_sum(list_transform(range(0, ({n} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * power(cos(atan({t} / sqrt({n}))), 2 * k)))) END)"""


def scored_inputs(spark, sf_dir):
    root = F.sqrt(F.lit(252.0))
    vol = lambda n, least: F.when(F.count("ret").over(s.last_rows(n)) >= least, F.stddev_samp("ret").over(s.last_rows(n)) * root)
    v = returns(spark, sf_dir).join(s.market_returns(spark, sf_dir).select("t"), "t")
    d = v.withColumns({"sigma": vol(26, 13), "own": vol(52, 26), "capm": vol(13, 6), "on_grid": F.row_number().over(s.by()) % 4 == 0, "is_reliable": F.col("volume").cast("long") % 10 != 7})
    return materialised(d.select("id", "t", "ret", "sigma", F.lit(None).cast("double").alias("sigma_horizon"), "own", "capm", "on_grid", "is_reliable"))


def dm_sql(name: str, rows: str, lags: str) -> str:
    """CTEs <name>_d and <name>: the test of equal losses of rows (id, t, x) with `lags` lags, an expression of n."""
    return f"""{name}_c AS (SELECT *, x - avg(x) OVER (PARTITION BY id) AS u, row_number() OVER (PARTITION BY id ORDER BY t) AS k, count(*) OVER (PARTITION BY id) AS n FROM ({rows}) WHERE x IS NOT NULL),
{name}_p AS (SELECT a.id, sum(greatest(1 - (a.k - b.k) / ({lags} + 1.0), 0) * (CASE WHEN a.k = b.k THEN 1 ELSE 2 END) * a.u * b.u) AS v FROM {name}_c a LEFT JOIN n_of o ON o.id = a.id JOIN {name}_c b ON a.id = b.id AND b.k <= a.k AND a.k - b.k <= {lags} GROUP BY a.id),
{name} AS (SELECT c.id, count(*) AS n, CASE WHEN count(*) >= 10 THEN CASE WHEN any_value(p.v) > 0 THEN avg(x) / sqrt(any_value(p.v) / count(*) / count(*)) ELSE 0 END END AS t_stat FROM {name}_c c JOIN {name}_p p ON p.id = c.id GROUP BY c.id)"""


NW = "floor(4 * power({n} / 100.0, 2.0 / 9))::INT"
QL = "(power(real / {s}, 2) - ln(power(real / {s}, 2)) - 1)"
DL = "({r} * {r} / ({s} * {s} / 252) + ln({s} * {s} / 252))"
#: Likelihood ratios of the hits' rate and of their order, with the exact tail where no or every row is a hit.
COVER = """{n}_h AS (SELECT id, t, ret < -{q} * force / sqrt(252) AS hit, lag(ret < -{q} * force / sqrt(252)) OVER (PARTITION BY id ORDER BY t) AS before FROM {rows}),
{n}_g AS (SELECT id, count(*)::DOUBLE AS n, sum(hit::INT)::DOUBLE AS x, count(*) FILTER (NOT before AND NOT hit)::DOUBLE AS n00, count(*) FILTER (NOT before AND hit)::DOUBLE AS n01, count(*) FILTER (before AND NOT hit)::DOUBLE AS n10, count(*) FILTER (before AND hit)::DOUBLE AS n11 FROM {n}_h GROUP BY id HAVING count(*) >= 10),
{n}_l AS (SELECT *, CASE WHEN x > 0 AND x < n THEN -2 * ((n - x) * ln(1 - {p}) + x * ln({p}) - (n - x) * ln(1 - x / n) - x * ln(x / n)) END AS lr,
  CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN -2 * ((n00 + n10) * ln(1 - (n01 + n11) / (n00 + n01 + n10 + n11)) + (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)) - n00 * ln(n00 / (n00 + n01)) - n01 * ln(n01 / (n00 + n01)) - n10 * ln(n10 / (n10 + n11)) - n11 * ln(n11 / (n10 + n11))) END AS ind FROM {n}_g),
{n} AS (SELECT id, x::BIGINT AS exceptions, n * {p} AS expected, lr, CASE WHEN lr IS NOT NULL THEN """ + TAIL.format(x="greatest(lr, 0)") + """ ELSE least(1, 2 * CASE WHEN x = 0 THEN power(1 - {p}, n) ELSE power({p}, n) END) END AS p, lr + ind AS cc, ind FROM {n}_l)"""


def cover_sql(name: str, rows: str, q: str, p: str) -> str:
    return COVER.replace("{n}", name).replace("{q}", q).replace("{p}", p).replace("{rows}", rows)


BACKTEST = f"""WITH {SCORED},
sp AS (SELECT *, sigma IS NOT NULL AS span FROM k),
b0 AS (SELECT *, span AND is_reliable AS usable, lag(own) OVER w AS own_before, min(t) FILTER (span) OVER (PARTITION BY id) AS first_t, max(t) FILTER (span) OVER (PARTITION BY id) AS last_t, max(pos) FILTER (span) OVER (PARTITION BY id) AS last_pos,
  last_value(CASE WHEN span AND is_reliable THEN sigma END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS force FROM sp WINDOW w AS (PARTITION BY id ORDER BY t)),
b AS (SELECT *, usable AND on_grid AND real IS NOT NULL AS scored, t > first_t AND t <= last_t + 6 AND ret IS NOT NULL AND force IS NOT NULL AS covered, t > first_t AND pos <= last_pos + 4 AS paired FROM b0 WHERE first_t IS NOT NULL),
st AS (SELECT id, pos - lag(pos) OVER (PARTITION BY id ORDER BY t) AS step FROM b WHERE scored),
n_of AS (SELECT id, count(*) AS n_forecasts, greatest({NW.format(n="count(*)")}, ceil(4.0 / greatest(floor(coalesce(median(step), 1)), 1))::INT - 1) AS lags FROM st GROUP BY id),
x1 AS (SELECT *, CASE WHEN scored AND real > 0 AND sigma > 0 THEN {QL.format(s="sigma")} END AS q, CASE WHEN scored AND real > 0 AND own > 0 THEN {QL.format(s="own")} END AS q_own, CASE WHEN scored AND real > 0 AND capm > 0 THEN {QL.format(s="capm")} END AS q_capm,
  CASE WHEN paired AND force > 0 THEN {DL.format(r="ret", s="force")} END AS l, CASE WHEN paired AND own_before > 0 THEN {DL.format(r="ret", s="own_before")} END AS l_own,
  CASE WHEN scored AND sigma > 0 THEN {DL.format(r="r_h", s="(sigma * 2)")} END AS h, CASE WHEN scored AND own > 0 THEN {DL.format(r="r_h", s="(own * 2)")} END AS h_own, CASE WHEN scored AND sigma > 0 THEN r_h / (sigma * sqrt(4 / 252.0)) END AS zb, CASE WHEN covered THEN ret / (force / sqrt(252)) END AS z FROM b),
{dm_sql("d_own", "SELECT id, t, q - q_own AS x FROM x1", "o.lags")}, {dm_sql("d_capm", "SELECT id, t, q - q_capm AS x FROM x1", "o.lags")}, {dm_sql("d_day", "SELECT id, t, l - l_own AS x FROM x1", NW.format(n="a.n"))}, {dm_sql("d_hor", "SELECT id, t, h - h_own AS x FROM x1", "o.lags")},
cv AS (SELECT * FROM b WHERE covered), {cover_sql("c95", "cv", "1.6448536269514715", "0.05")}, {cover_sql("c99", "cv", "2.3263478740408408", "0.01")},
mx AS (SELECT id, t, real * real AS y, sigma * sigma AS x FROM b WHERE scored AND sigma IS NOT NULL), mf AS (SELECT id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM mx GROUP BY id HAVING count(*) >= 10),
me AS (SELECT mx.id, x, y - a - b * x AS g, row_number() OVER (PARTITION BY mx.id ORDER BY t) AS k FROM mx JOIN mf ON mf.id = mx.id),
mm AS (SELECT p.id, sum(w * p.g * q.g) AS gg, sum(w * p.x * p.g * q.x * q.g) AS hh, sum(w * (p.g * q.x * q.g + p.x * p.g * q.g) / 2) AS gh FROM (SELECT p.id, p.k AS pk, q.k AS qk, greatest(1 - (p.k - q.k) / (o.lags + 1.0), 0) * (CASE WHEN p.k = q.k THEN 1 ELSE 2 END) AS w FROM me p JOIN n_of o ON o.id = p.id JOIN me q ON q.id = p.id AND q.k <= p.k AND p.k - q.k <= o.lags) z JOIN me p ON p.id = z.id AND p.k = pk JOIN me q ON q.id = z.id AND q.k = qk GROUP BY p.id),
mi AS (SELECT mf.*, gg, gh, hh, sxx / (n * sxx - sx * sx) AS p, -sx / (n * sxx - sx * sx) AS q, n / (n * sxx - sx * sx) AS r FROM mf JOIN mm ON mm.id = mf.id),
mv AS (SELECT *, p * p * gg + 2 * p * q * gh + q * q * hh AS v00, p * q * gg + (p * r + q * q) * gh + q * r * hh AS v01, q * q * gg + 2 * q * r * gh + r * r * hh AS v11 FROM mi),
mz AS (SELECT *, abs(a) / sqrt(v00) AS ta, abs(b - 1) / sqrt(v11) AS tb, (v11 * a * a - 2 * v01 * a * (b - 1) + v00 * (b - 1) * (b - 1)) / (v00 * v11 - v01 * v01) AS wald FROM mv),
ag AS (SELECT id, count(*) FILTER (span AND NOT usable) AS n_excluded, 1.0::DOUBLE AS finite_share, count(*) FILTER (span AND NOT is_reliable) / count(*) FILTER (span) AS unreliable_share, count(*) FILTER (span AND on_grid) AS n_grid,
  avg(real / sigma) FILTER (scored) AS mean_bias, median(real / sigma) FILTER (scored) AS median_bias, stddev_samp(zb) AS bias_stat, stddev_samp(z) AS z_std, avg(q) AS qlike, avg(q_own) FILTER (q IS NOT NULL) AS qlike_own_ewma, avg(q_capm) FILTER (q IS NOT NULL) AS qlike_capm,
  avg(l) FILTER (l_own IS NOT NULL) AS daily_loss, avg(l_own) FILTER (l IS NOT NULL) AS daily_loss_own_ewma, count(*) FILTER (l IS NOT NULL AND l_own IS NOT NULL) AS n_days, avg(h) FILTER (h_own IS NOT NULL) AS horizon_loss, avg(h_own) FILTER (h IS NOT NULL) AS horizon_loss_own_ewma,
  min(t) FILTER (covered) AS sample_start, max(t) FILTER (covered) AS sample_end FROM x1 GROUP BY id),
zk AS (SELECT id, avg(power(z - m, 4)) / power(avg(power(z - m, 2)), 2) - 3 AS z_kurtosis FROM (SELECT id, z, avg(z) OVER (PARTITION BY id) AS m FROM x1 WHERE z IS NOT NULL) GROUP BY id)"""
ROUNDED = ["finite_share", "unreliable_share", "mean_bias", "median_bias", "bias_stat", "z_std", "z_kurtosis", "qlike", "qlike_own_ewma", "qlike_capm", "daily_loss", "daily_loss_own_ewma", "horizon_loss", "horizon_loss_own_ewma", "mz_alpha", "mz_beta", "mz_alpha_p", "mz_beta_p", "mz_joint_p", "mz_r2", "dm_t_own_ewma", "dm_p_own_ewma", "dm_t_capm", "dm_p_capm", "dm_t_daily_own_ewma", "dm_p_daily_own_ewma", "dm_t_horizon_own_ewma", "dm_p_horizon_own_ewma", *(f"{c}_{n}" for n in ("95", "99") for c in ("expected", "kupiec_stat", "kupiec_p", "christoffersen_stat", "christoffersen_p"))]
WHOLE = ["n_forecasts", "n_excluded", "n_grid", "n_days", "mz_hac_lags", "exceptions_95", "exceptions_99"]
dm_columns = lambda a, name: f"{a}.t_stat AS dm_t_{name}, CASE WHEN {a}.t_stat = 0 THEN 1 ELSE {TAIL.format(x=f'({a}.t_stat * {a}.t_stat)')} END AS dm_p_{name}"
cover_columns = lambda a, n: f"{a}.exceptions AS exceptions_{n}, {a}.expected AS expected_{n}, {a}.lr AS kupiec_stat_{n}, {a}.p AS kupiec_p_{n}, {a}.cc AS christoffersen_stat_{n}, coalesce(exp(-{a}.cc / 2), {a}.p) AS christoffersen_p_{n}"


@query(f"""{BACKTEST}, al AS (SELECT ag.*, z_kurtosis, coalesce(n_forecasts, 0) AS n_forecasts, n_of.lags AS mz_hac_lags, mz.a AS mz_alpha, mz.b AS mz_beta, mz.r2 AS mz_r2, exp(-wald / 2) AS mz_joint_p, {STUDENT.format(t="ta", n="(mz.n - 2)")} AS mz_alpha_p, {STUDENT.format(t="tb", n="(mz.n - 2)")} AS mz_beta_p,
{dm_columns("d_own", "own_ewma")}, {dm_columns("d_capm", "capm")}, {dm_columns("d_day", "daily_own_ewma")}, {dm_columns("d_hor", "horizon_own_ewma")}, {cover_columns("c95", "95")}, {cover_columns("c99", "99")}
FROM ag LEFT JOIN zk ON zk.id = ag.id LEFT JOIN n_of ON n_of.id = ag.id LEFT JOIN mz ON mz.id = ag.id LEFT JOIN d_own ON d_own.id = ag.id LEFT JOIN d_capm ON d_capm.id = ag.id LEFT JOIN d_day ON d_day.id = ag.id LEFT JOIN d_hor ON d_hor.id = ag.id LEFT JOIN c95 ON c95.id = ag.id LEFT JOIN c99 ON c99.id = ag.id)
SELECT id, sample_start, sample_end, {", ".join(WHOLE)}, {", ".join(f"round({c}, 5) AS {c}" for c in ROUNDED)} FROM al""")
def backtest_scores(spark, sf_dir):
    from tidemark.operators import backtests as bt

    d = scored_inputs(spark, sf_dir)
    out = bt.backtest(d.where("sigma IS NOT NULL").select("id", "t", "sigma", "sigma_horizon", "on_grid", "is_reliable"), d.select("id", "t", "ret", "own", "capm"), 4)
    return out.select("id", "sample_start", "sample_end", *(F.col(c).cast("long").alias(c) for c in WHOLE), *rnd(*ROUNDED, places=5))


SCORE = ["z_std", "loss", "loss_own_ewma", "dm_t_own_ewma", "dm_p_own_ewma", "expected_95", "kupiec_p_95", "christoffersen_p_95", "expected_99", "kupiec_p_99", "bias_stat", "bias_band", "bias_worst_z", "bias_stat_ex_worst", "mean_sigma_ann", "realized_vol_ann"]


@query(f"""WITH {SCORED}, p0 AS (SELECT id, t, ret, lag(sigma) OVER w AS force, lag(own) OVER w AS o FROM k WINDOW w AS (PARTITION BY id ORDER BY t)), po AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS k FROM p0 WHERE ret IS NOT NULL AND force > 0 AND o IS NOT NULL),
l AS (SELECT *, {DL.format(r="ret", s="force")} AS loss, {DL.format(r="ret", s="o")} AS loss_own, ret / (force / sqrt(252)) AS z FROM po), n_of AS (SELECT id, count(*) AS lags FROM po GROUP BY id),
{dm_sql("d_own", "SELECT id, t, loss - loss_own AS x FROM l", NW.format(n="a.n"))}, {cover_sql("c95", "po", "1.6448536269514715", "0.05")}, {cover_sql("c99", "po", "2.3263478740408408", "0.01")},
bl AS (SELECT id, k // 4 AS block, sum(ret) / (arg_min(force, t) * sqrt(4 / 252.0)) AS zb, min(t) AS begin FROM po GROUP BY 1, 2 HAVING count(*) = 4),
wo AS (SELECT id, begin, zb FROM bl QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(zb) DESC, begin) = 1),
bs AS (SELECT bl.id, count(*) AS n_blocks, CASE WHEN count(*) > 2 THEN stddev_samp(bl.zb) END AS bias_stat, CASE WHEN count(*) > 2 THEN sqrt(2.0 / count(*)) END AS bias_band, CASE WHEN count(*) > 3 THEN any_value(wo.zb) END AS bias_worst_z, CASE WHEN count(*) > 3 THEN any_value(wo.begin) END AS bias_worst_date,
  CASE WHEN count(*) > 3 THEN stddev_samp(bl.zb) FILTER (bl.begin <> wo.begin) END AS bias_stat_ex_worst FROM bl JOIN wo ON wo.id = bl.id GROUP BY bl.id),
g AS (SELECT id, count(*) AS n_days, stddev_samp(z) AS z_std, avg(loss) AS loss, avg(loss_own) AS loss_own_ewma, avg(force) AS mean_sigma_ann, stddev_samp(ret) * sqrt(252) AS realized_vol_ann FROM l GROUP BY id),
al AS (SELECT g.*, {dm_columns("d_own", "own_ewma")}, {cover_columns("c95", "95")}, {cover_columns("c99", "99")}, bs.* EXCLUDE (id), abs(bias_stat - 1) <= bias_band AS bias_in_band FROM g LEFT JOIN d_own ON d_own.id = g.id LEFT JOIN c95 ON c95.id = g.id LEFT JOIN c99 ON c99.id = g.id LEFT JOIN bs ON bs.id = g.id)
SELECT id, n_days, exceptions_95, exceptions_99, n_blocks, bias_worst_date, bias_in_band, {", ".join(f"round({c}, 5) AS {c}" for c in SCORE)} FROM al""")
def portfolio_scores(spark, sf_dir):
    from tidemark.operators import backtests as bt

    out = bt.portfolio_score(scored_inputs(spark, sf_dir).select("id", "t", "ret", "sigma", "sigma_horizon", "own"), 4)
    return out.select("id", *(F.col(c).cast("long").alias(c) for c in ("n_days", "exceptions_95", "exceptions_99", "n_blocks")), "bias_worst_date", "bias_in_band", *rnd(*SCORE, places=5))


#: Windows of one regressor: sums, residuals, and the Bartlett-weighted sandwich about the inverse of X'X.
ONE = f"""{MARKET}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) - 1 AS back, count(*) OVER (PARTITION BY id) AS size FROM rm),
wc AS (SELECT id, j, t, ret AS y, mkt AS x, max(t) OVER (PARTITION BY id, j) AS window_end FROM b, (SELECT unnest(range(0, 40)) AS j) WHERE back BETWEEN j * 26 AND j * 26 + 103 AND size - j * 26 >= 60),
wo AS (SELECT * FROM wc WHERE y IS NOT NULL AND x IS NOT NULL),
wf AS (SELECT id, window_end, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, covar_pop(y, x) AS cxy, var_pop(x) AS vp, var_samp(x) AS vs, avg(x) AS mx, avg(y) AS my FROM wo GROUP BY id, window_end HAVING count(*) >= 3)"""


@query(f"""WITH {ONE}, fb AS (SELECT *, cxy / vp AS beta, my - cxy / vp * mx AS alpha, floor(4 * power(n / 100.0, 2.0 / 9))::INT AS lags FROM wf),
er AS (SELECT wo.id, wo.window_end, wo.x, wo.y - alpha - beta * wo.x AS e, lags, row_number() OVER (PARTITION BY wo.id, wo.window_end ORDER BY t) AS k FROM wo JOIN fb ON fb.id = wo.id AND fb.window_end = wo.window_end),
mt AS (SELECT p.id, p.window_end, sum(w * p.e * q.e) AS gg, sum(w * p.e * q.e * p.x * q.x) AS hh, sum(w * p.e * q.e * (p.x + q.x) / 2) AS gh FROM (SELECT a.id, a.window_end, a.k AS pk, b.k AS qk, (1 - (a.k - b.k) / (a.lags + 1.0)) * CASE WHEN a.k = b.k THEN 1 ELSE 2 END AS w FROM er a JOIN er b ON b.id = a.id AND b.window_end = a.window_end AND b.k <= a.k AND a.k - b.k <= a.lags) z JOIN er p ON p.id = z.id AND p.window_end = z.window_end AND p.k = pk JOIN er q ON q.id = z.id AND q.window_end = z.window_end AND q.k = qk GROUP BY ALL),
vr AS (SELECT fb.*, -sx / (n * sxx - sx * sx) AS q, n / (n * sxx - sx * sx) AS r, gg, gh, hh FROM fb JOIN mt ON mt.id = fb.id AND mt.window_end = fb.window_end)
SELECT id, window_end, n, round(beta, 6) AS beta, round(sqrt(q * q * gg + 2 * q * r * gh + r * r * hh), 6) AS se, round(beta / sqrt(q * q * gg + 2 * q * r * gh + r * r * hh), 4) AS t_stat FROM vr""")
def rolling_hac_one(spark, sf_dir):
    d = rg.rolling(with_market(spark, sf_dir), ["mkt"], rg.Spec(window=104, step=26, least=60), "ret")
    return d.select("id", "window_end", F.col("n").cast("long").alias("n"), *rnd("beta", "se"), F.round("t_stat", 4).alias("t_stat"))


@query(f"""WITH {ONE} SELECT id, window_end, n, round(cxy / (vp + 0.1 * vs), 6) AS beta FROM wf""")
def rolling_ridge_one(spark, sf_dir):
    """The slope drawn towards zero by a tenth of the regressor's variance a row; the intercept is free."""
    d = rg.rolling(with_market(spark, sf_dir), ["mkt"], rg.Spec(window=104, step=26, least=60, estimator="ridge", ridge=0.1), "ret")
    return d.select("id", "window_end", F.col("n").cast("long").alias("n"), *rnd("beta"))
