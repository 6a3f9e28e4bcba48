"""Forecasts, scores, candidates, weights, grids, landing and upserts on data whose answer is known."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import specfun as sf
from tidemark.operators import kernels as k
from tidemark.operators import regression as rg
from tidemark.operators import risk as rk
from tidemark.operators import unitroots as ur
from tidemark.operators import weights as wt

RNG = np.random.default_rng(20)
DAY0 = date(2021, 1, 1)


def days(n):
    return [DAY0 + timedelta(i) for i in range(n)]


def test_constants_of_the_sql():
    """Each quantile in the SQL of a plan, from its distribution."""
    from tidemark.plans.panel import ORACLES

    assert sf.t_quantile(0.95, 5) == pytest.approx(2.0150483733330233, abs=1e-12) and sf.t_quantile(0.99, 5) == pytest.approx(3.3649299989072185, abs=1e-12)
    assert sf.normal_quantile(0.95) == pytest.approx(1.6448536269514722, abs=1e-12) and sf.normal_quantile(0.99) == pytest.approx(2.3263478740408408, abs=1e-12)
    assert rk.shortfall_factor(0.975) == pytest.approx(2.3378027922014113, abs=1e-12)
    assert abs(sf.normal_quantile(0.95) - 1.6448536) < 1e-7 and abs(sf.normal_quantile(0.9) - 1.2815516) < 1e-7
    import tidemark.plans.catalog  # noqa: F401

    assert all(x in ORACLES["tail_losses"] for x in ("2.0150483733330233", "3.3649299989072185", "1.6448536269514722", "2.3263478740408408", "2.3378027922014113"))


def test_lag_moments_keep_gaps():
    x = RNG.normal(size=(40, 2))
    x[10, 1] = np.nan
    y = x - x[np.isfinite(x).all(axis=1)].mean(axis=0)
    rows = [i for i in range(2, 40) if 10 not in (i, i - 2)]
    assert np.allclose(rk.lag_moment(x, 2), sum(np.outer(y[i], y[i - 2]) for i in rows) / len(rows))
    assert not rk.lag_moment(x, 40).any()


def test_forecast_with_lags_horizon_and_errors(spark):
    n, d, names = 260, days(260), ["u", "w"]
    f, e = RNG.normal(size=(n, 2)), RNG.normal(size=n)
    r = np.zeros(n)
    r[1:] = f[1:] @ [0.5, -1.0] + f[:-1] @ [0.3, 0.2] + e[1:]
    rows = spark.createDataFrame([("s", d[i], float(r[i]), float(f[i, 0]), float(f[i, 1])) for i in range(n)], "id string, t date, ret double, u double, w double")
    spec = rg.Spec(window=150, step=1000, least=60, lags=1)
    cut = rows.where(F.col("t") <= F.lit(d[199]))
    loadings = rg.rolling(cut, ["w", "u"], spec, "ret", detail=True).cache()
    factors = spark.createDataFrame([(c, d[i], float(f[i, j])) for i in range(n) for j, c in enumerate(names)], "id string, t date, x double")
    risk = rk.RiskSpec(window=120, half_life=30.0, specific_half_life=10.0, horizon=5, lags=2, revert_half_life=15.0, debias=True)
    got = {x.t: x for x in rk.forecasts(loadings, rows.select("id", "t", "ret"), factors, risk).collect()}
    assert min(got) == d[200] and len(got) == 60
    # The same by hand: slopes by lag, in the order of the names.
    x = np.column_stack([np.ones(149), f[51:200], f[50:199]])
    fit = rg.fit(r[51:200], x[:, 1:])
    b = [fit["beta"][1:3], fit["beta"][3:5]]
    v = [fit["cov"][1:3, 1:3], fit["cov"][3:5, 3:5]]
    held = f[80:200]
    far = k.ledoit_wolf(held)[0] * 252
    c = k.repaired(0.6 * k.ewma_matrix(held, 30.0) * 252 + 0.4 * far)
    daily = sum(float(p @ c @ p) - float(np.trace(c @ q)) for p, q in zip(b, v, strict=True))
    total = b[0] + b[1]
    a = np.tile(np.eye(2), 2)
    spread = a @ fit["cov"][1:, 1:] @ a.T
    g = (1 - 0.5 ** (5 / 15)) / (5 * (1 - 0.5 ** (1 / 15)))
    h = far + g * (c - far)
    for lag in (1, 2):
        m = (0.6 * rk.lag_moment(held, lag, 30.0) + 0.4 * rk.lag_moment(held, lag)) * 252
        h = h + (1 - lag / 5) * (m + m.T)
    h = k.repaired(h)
    row = got[d[230]]
    assert row.sigma_factor == pytest.approx(math.sqrt(max(float(total @ c @ total) - float(np.trace(c @ spread)), 0)), rel=1e-6)
    e2, mean = [], None
    for i in range(200, 230):
        err = r[i] - f[i] @ b[0] - f[i - 1] @ b[1]
        e2 = err * err - float(f[i] @ v[0] @ f[i]) - float(f[i - 1] @ v[1] @ f[i - 1])
        mean = e2 if mean is None else 0.5 ** (1 / 10) * mean + (1 - 0.5 ** (1 / 10)) * e2
    s = max(mean * 252, rk.LEAST_SPECIFIC**2)
    assert row.sigma_specific == pytest.approx(math.sqrt(s), rel=1e-6) and row.sigma_dimson == pytest.approx(math.sqrt(max(daily, 0) + s), rel=1e-6)
    ahead = fit["resid_vol"] ** 2 + g * (s - fit["resid_vol"] ** 2)
    assert row.sigma_horizon == pytest.approx(math.sqrt(max(float(total @ h @ total) - float(np.trace(h @ spread)), 0) + ahead), rel=1e-6)
    plan = rk.forecasts(loadings, rows.select("id", "t", "ret"), factors, risk)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_backtest_of_a_right_and_a_wrong_forecast(spark):
    from tidemark.operators import backtests as bt

    n, d = 700, days(700)
    sd = 0.01 * np.exp(np.sin(np.arange(n) / 60))
    r = RNG.normal(size=n) * sd
    root = math.sqrt(252)
    rows = [(i, d[t], float(r[t]), float(sd[min(t + 1, n - 1)] * root) * (1 if i == "right" else 0.5), 0.01 * root, None if t % 50 == 0 else 0.012 * root) for i in ("right", "wrong") for t in range(n)]
    s = spark.createDataFrame(rows, "id string, t date, ret double, sigma double, own double, capm double")
    f = s.select("id", "t", "sigma", F.lit(None).cast("double").alias("sigma_horizon"), (F.dayofyear("t") % 5 == 0).alias("on_grid"), (F.dayofyear("t") != 100).alias("is_reliable"))
    got = {x.id: x for x in bt.backtest(f, s.select("id", "t", "ret", "own", "capm"), 5).collect()}
    a, b = got["right"], got["wrong"]
    assert 0.9 < a.z_std < 1.1 and 1.8 < b.z_std < 2.2 and a.kupiec_p_95 > 0.01 > b.kupiec_p_95 and a.qlike < b.qlike and a.daily_loss < b.daily_loss
    assert a.n_excluded == 2 and a.finite_share == 1 and a.dm_t_daily_own_ewma < -2 and a.exceptions_95 < b.exceptions_95 and len(a) == 48
    empty = bt.backtest(f.limit(0), s.select("id", "t", "ret", "own", "capm"), 5)
    assert empty.count() == 0
    p = {x.id: x for x in bt.portfolio_score(s.withColumn("sigma_horizon", F.lit(None).cast("double")), 5).collect()}
    assert p["right"].bias_in_band and not p["wrong"].bias_in_band and p["right"].n_blocks == 139 and p["right"].bias_stat_ex_worst < p["right"].bias_stat
    early = bt.backtest(f, s.select("id", "t", "ret", "own", "capm"), 5, end=d[99]).where("id = 'right'").first()
    assert early.n_forecasts < a.n_forecasts and early.sample_end <= d[99] + timedelta(7)


def test_long_only_weights_are_optimal():
    for size in (1, 2, 5, 12, 30):
        for _ in range(15):
            x = RNG.normal(size=(size + 5, size)) * RNG.uniform(0.5, 2, size)
            s, mean = np.cov(x, rowvar=False).reshape(size, size), RNG.normal(size=size)
            low, kkt = wt.least_variance(s)
            assert kkt < 1e-8 and low.min() >= 0 and low.sum() == pytest.approx(1)
            w, kkt = wt.best_sharpe(mean, s)
            assert kkt < 1e-8 and w.sum() == pytest.approx(1)
            if (mean > 0).any():
                best = max(RNG.dirichlet(np.ones(size) * 0.5, 200), key=lambda v: v @ mean / math.sqrt(v @ s @ v))
                assert w @ mean / math.sqrt(w @ s @ w) >= best @ mean / math.sqrt(best @ s @ best) - 1e-9
            target = float(low @ mean) + 0.6 * float(mean.max() - low @ mean)
            w, kkt = wt.at_mean(mean, s, target, low)
            assert kkt < 1e-7 and w @ mean == pytest.approx(target) and w @ s @ w >= low @ s @ low - 1e-12
            mix = RNG.dirichlet(np.ones(size))
            w, kkt = wt.style(s @ mix, s)
            assert kkt < 1e-8 and np.allclose(w, mix, atol=1e-6)


def test_candidates_see_nothing_of_the_test(spark):
    from tidemark.operators import evaluation as ev
    from tidemark.operators.selection import Candidate

    n, d = 400, days(400)
    f = RNG.normal(size=(n, 2))
    y = f @ [1.0, 0.0] + 0.5 * RNG.normal(size=n)
    rows = [("s", d[i], float(y[i]), float(f[i, 0]), float(f[i, 1])) for i in range(n)] + [("short", d[i], 0.0, 0.0, 0.0) for i in range(50)]
    r = spark.createDataFrame(rows, "id string, t date, y double, a double, b double")
    good, bad = Candidate(("a",), 100), Candidate(("b",), 60)
    got = {(x.candidate, x.part): x for x in ev.evaluated(r, [good, bad], 5, 5, 100, least_test=12).collect()}
    assert len(got) == 4 and got[good.key(), "test"].oos_r2 > 0.7 > 0.1 > got[bad.key(), "test"].oos_r2
    parts = ev.grid(r, 5, 5, 100, least_test=12).orderBy("t").collect()
    first = min(p.t for p in parts if p.part == "test")
    assert {p.part for p in parts} == {"validation", "embargo", "test"} and all((first - p.t).days > 5 for p in parts if p.part == "validation")
    # Another future changes no validation figure.
    other = r.withColumn("y", F.when(F.col("t") >= F.lit(first), 9.0).otherwise(F.col("y")))
    again = {(x.candidate, x.part): x for x in ev.evaluated(other, [good, bad], 5, 5, 100, least_test=12).collect()}
    for c in (good, bad):
        x, z = got[c.key(), "validation"], again[c.key(), "validation"]
        assert (x.n_windows, x.n_days, x.oos_r2, x.loss) == (z.n_windows, z.n_days, z.oos_r2, z.loss)


def test_fits_are_stored_once(spark, tmp_path):
    from tidemark.operators import grids as gr

    asked = spark.sparkContext.accumulator(0)

    def fit(rows):
        def one(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        return rows.where("id <> 'none'").select("id", F.length("id").alias("size")).mapInArrow(one, "id string, size int")

    store, spec = str(tmp_path / "fits"), rk.RiskSpec()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(map(tuple, gr.fit_once(ids("a", "bb", "none"), spec, store, fit).collect())) == [("a", 1), ("bb", 2)] and asked.value == 2
    assert sorted(map(tuple, gr.fit_once(ids("bb", "ccc", "none"), spec, store, fit).collect())) == [("bb", 2), ("ccc", 3)] and asked.value == 3
    gr.fit_once(ids("a", "bb", "ccc", "none"), spec, store, fit).collect()
    assert asked.value == 3 and gr.spec_key(spec) != gr.spec_key(rk.RiskSpec(window=5))
    gr.fit_once(ids("a"), rk.RiskSpec(window=5), store, fit).collect()
    assert asked.value == 4
    a, b = gr.Configuration("x", ((0.5, 8.0), (0.5, 52.0))), gr.Configuration("y", ((0.5, 52.0), (0.5, 8.0)))
    assert a.key() == b.key()
    c = gr.normalised("n", [(2.0, 52.0), (1.0, 8.0), (1.0, 8.0)])
    assert c.mix == ((0.5, 8.0), (0.5, 52.0)) and gr.label(c) == "8:50+52:50"
    for bad in (lambda: gr.Configuration("z", ((0.5, 8.0),)), lambda: gr.normalised("z", [(0.0, 8.0)])):
        with pytest.raises(ValueError):
            bad()


def test_unit_root_p_values(spark):
    """The published critical values have the p-values that they are published for."""
    t = [-3.43, -2.86, -2.57, -1.57, -0.44, -20.0, 3.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in t], "t double").select("t", ur.unit_root_p(F.col("t")).alias("p")).collect()]
    assert np.allclose(got[:5], [0.01, 0.05, 0.10, 0.50, 0.90], atol=[1e-3, 1e-3, 1e-3, 2e-2, 1e-2]) and got[5:] == [0.0, 1.0]
    assert np.allclose(got, [ur.unit_root_p_of(x) for x in t], atol=2e-7)


def test_hot_keys_against_one_window(spark):
    from tidemark.operators import joins as j

    rows = [("a" if i % 3 else None, DAY0 + timedelta(int(RNG.integers(0, 900))), None if RNG.random() < 0.6 else float(i)) for i in range(600)]
    d = spark.createDataFrame(list({(r[0], r[1]): r for r in rows}.values()), "k string, t date, x double")
    got = j.forward_filled(j.forward_filled(d, "k", "t", "x", "f", bucket="month"), "k", "t", "x", "f2", 2, bucket="month").orderBy("k", "t").collect()
    held = {}
    for r in got:
        past = held.setdefault(r.k, [])
        past.append(r.x)
        assert r.f == next((v for v in reversed(past) if v is not None), None)
        assert r.f2 == next((v for v in reversed(past[-3:]) if v is not None), None)
    m = j.with_running(d.withColumn("x", F.coalesce("x", F.lit(1.0))), "k", "t", "x", "run").where("k = 'a'").orderBy("t").collect()
    assert np.allclose([r.run for r in m], np.cumsum([r.x for r in m]))


def test_exponential_means_in_buckets(spark):
    from tidemark.operators import recursions as rc

    rows = [(i, DAY0 + timedelta(int(n)), None if RNG.random() < 0.3 else float(RNG.normal())) for i in ("a", None) for n in np.sort(RNG.choice(1500, 200, replace=False))]
    rows = [(i, t, None if t < DAY0 + timedelta(200) and i == "a" else x) for i, t, x in rows]
    got = {(r.id, r.t): r for r in rc.exponential_means(spark.createDataFrame(rows, "id string, t date, x double"), "id", "t", "x", 7.0, "month").collect()}
    lam, v = 0.5 ** (1 / 7), {}
    for i, t, x in rows:
        before = v.get(i)
        if x is not None:
            v[i] = x if before is None else lam * before + (1 - lam) * x
        for want, have in ((v.get(i), got[i, t].value), (before, got[i, t].before)):
            assert (want is None and have is None) or have == pytest.approx(want)


def test_upserts_write_what_they_touch(spark, tmp_path):
    from tidemark.streaming import events as ev

    path = str(tmp_path / "u")
    u = ev.Upserts(path, ["k"], "v", buckets=16)
    base = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    u.put(base, 0)
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / "u" / f"v={n}").rglob("*.parquet"))
    first = size(0)
    for n in (1, 1, 2, 3):
        u.put(spark.createDataFrame([(5, n), (5, n - 1), (5000 + n, n)], "k long, v int"), n)
    assert size(3) < first / 4 and u.read(spark).count() == 2003
    assert {r.k: r.v for r in u.read(spark).where("k = 5 OR k > 4000").collect()} == {5: 3, 5001: 1, 5002: 2, 5003: 3}
    assert not list((tmp_path / "u").glob("_current/n=0")) and len(u.current(spark)) == 16
    kept = {(r["bucket"], r["version"]) for n in (2, 3) for r in spark.read.parquet(f"{path}/_current/n={n}").collect()}
    there = {(int(p.name.removeprefix("bucket=")), int(p.parent.name.removeprefix("v="))) for p in (tmp_path / "u").glob("v=*/bucket=*")}
    assert there == kept


def test_landed_files(spark, tmp_path):
    from tidemark.sources import landing as ld

    d = spark.createDataFrame([(1, 'a "quoted", cell', 1.5), (2, None, None), (3, "", 2.0)], "k long, s string, x double").repartition(2)
    ld.land_csv(d, str(tmp_path / "c"), ["a note, with a comma"])
    got = sorted(map(tuple, ld.read_landed(spark, str(tmp_path / "c"), "k long, s string, x double").collect()))
    assert got == [(1, 'a "quoted", cell', 1.5), (2, None, None), (3, None, 2.0)]
    sha = ld.content_hash(spark, str(tmp_path / "c"))
    assert sha == ld.content_hash(spark, str(tmp_path / "c")) and len(sha) == 64
    t = str(tmp_path / "t")
    assert ld.replace_source(d, t, "one", sha) and ld.replace_source(d.limit(1), t, "two", sha) and not ld.replace_source(d.limit(1), t, "one", sha)
    assert ld.replace_source(d.limit(2), t, "one", "other") and sorted((r.source, r["count"]) for r in spark.read.parquet(t).groupBy("source").count().collect()) == [("one", 2), ("two", 1)]


def test_forecasts_known_then_look_nowhere_ahead(spark):
    from tidemark.operators import trackrecord as tr

    n, d = 200, days(200)
    p = np.exp(np.cumsum(RNG.normal(size=n) * 0.02)) * 10
    rows = [("s", d[i], float(p[i]), 0.1, float(5 + i / 50), float(p[i] * 1.01**i)) for i in range(n)]
    b = tr.Build(smooth=10, horizon=20, reversion=30, year=10, late=2, least_norm=15, least_growth=20, least_mean=20)
    schema = "id string, t date, price double, dividend double, earnings double, total double"
    got = tr.known_then(spark.createDataFrame(rows, schema), b).orderBy("t").collect()
    other = [(*r[:2], *(r[2:] if i < 120 else (1.0, 9.0, 9.0, 1.0))) for i, r in enumerate(rows)]
    again = tr.known_then(spark.createDataFrame(other, schema), b).orderBy("t").collect()
    assert [r.forecast for r in got[:120]] == [r.forecast for r in again[:120]] and [r.benchmark for r in got[:120]] == [r.benchmark for r in again[:120]]
    assert got[50].forecast is not None and got[50].realised == pytest.approx(math.sqrt(rows[70][5] / rows[50][5]) - 1)
    score = tr.record(spark.createDataFrame(got), ["2021-01-01", "2021-06-20"], 19).orderBy("start").collect()
    assert score[0].n > 100 and score[0].oos_r2 is not None and len(score) == 2 and tr.pooled(spark.createDataFrame(got)).first().n == 1
