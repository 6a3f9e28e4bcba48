"""Kernels on simulated data whose answer is known, identities, and no look-ahead."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.functions import specfun as sf
from tidemark.operators import kernels as k
from tidemark.operators import regression as rg
from tidemark.operators import selection as se
from tidemark.operators import stationarity as st
from tidemark.sources import calendars as cal

RNG = np.random.default_rng(7)


def test_tails_against_table_values():
    assert sf.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert sf.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert sf.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert sf.f_tail(3.3258345304130112, 5, 10) == pytest.approx(0.05, abs=1e-8)
    assert sf.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert sf.t_quantile(0.05, 5) == pytest.approx(-2.015048372669157, abs=1e-8)
    assert sf.chi2_tail(2.0, 1) == pytest.approx(math.erfc(1.0), abs=1e-12)


def test_regression_finds_slopes_and_errors_cover():
    x = RNG.normal(size=(4000, 3))
    y = x @ [1.2, -0.4, 0.8] + RNG.normal(scale=0.5, size=4000)
    got = rg.fit(y, x)
    assert np.allclose(got["beta"][1:], [1.2, -0.4, 0.8], atol=0.03)
    assert np.allclose(got["se"][1:], 0.5 / math.sqrt(4000), rtol=0.15)
    assert got["vif"] == pytest.approx([1, 1, 1], abs=0.02) and 1.9 < got["dw"] < 2.1


def test_huber_resists_outliers_and_ridge_shrinks():
    x = RNG.normal(size=(500, 1))
    y = 2 * x[:, 0] + RNG.normal(scale=0.1, size=500)
    y[:25] += 50
    assert abs(rg.fit(y, x, rg.Spec(estimator="huber"))["beta"][1] - 2) < abs(rg.fit(y, x)["beta"][1] - 2) + 1e-9
    assert rg.fit(y, x, rg.Spec(estimator="ridge", ridge=1.0))["beta"][1] < rg.fit(y, x)["beta"][1]
    assert rg.fit(y, x, rg.Spec(estimator="ridge", ridge=0.0))["beta"] == pytest.approx(rg.fit(y, x)["beta"])
    with pytest.raises(ValueError):
        rg.Spec(estimator="elasticnet")


def test_lagged_slopes_are_summed():
    f = RNG.normal(size=(3000, 1))
    y = 0.6 * f[:, 0] + np.concatenate([[0], 0.4 * f[:-1, 0]]) + RNG.normal(scale=0.1, size=3000)
    got = rg.fit(y, rg.with_lags(f, 1))
    b, v = rg.collapsed(got["beta"], got["cov"], 1, 1)
    assert b[0] == pytest.approx(1.0, abs=0.02) and v[0, 0] > 0


def test_rolling_residual_does_not_look_ahead():
    x = RNG.normal(size=(400, 1))
    y = x[:, 0] + RNG.normal(size=400)
    a = rg.residual_path(y, x, 100, 60, 20)
    y2 = y.copy()
    y2[300:] += 100
    assert np.allclose(a[60:300], rg.residual_path(y2, x, 100, 60, 20)[60:300]) and np.isnan(a[:60]).all()


def test_verdicts_on_known_processes():
    noise = RNG.normal(size=1500)
    assert st.analyse(noise * 0.01)["state"] == "stationary"
    assert st.analyse(np.cumsum(noise))["state"] == "unit_root"
    e, v, out = RNG.normal(size=1500), 1.0, []
    for z in e:
        v = 0.05 + 0.25 * (out[-1] ** 2 if out else 1) + 0.7 * v
        out.append(z * math.sqrt(v))
    assert "arch_effects" in st.analyse(np.array(out) * 0.01)["flags"]
    spike = noise * 0.01
    spike[700], spike[701] = 0.4, -0.4
    assert "price_spike" in st.analyse(spike)["flags"]
    assert st.analyse(np.zeros(200))["verdict"] == "insufficient"


def test_every_break_is_tried():
    for seed, n, at in ((1, 150, 61), (2, 731, 333), (3, 1100, 517)):
        x = np.random.default_rng(seed).normal(size=n) + 8.0 * (np.arange(n) >= at)
        lags = min(int(12 * (n / 100) ** 0.25) // 2, n // 10)
        y, z = st._design(x, lags, lags)
        i = np.arange(len(y), dtype=float)
        each = [(st._t_of(y, np.column_stack([z, i, i >= b]), 1)[0], b + lags + 1) for b in range(int(0.15 * len(y)), int(0.85 * len(y)))]
        t, row = st.zivot_andrews(x)
        assert abs(t - min(each)[0]) < 1e-6 * abs(t) and row == min(each)[1] and abs(row - at) <= 1


def test_unit_root_size_is_near_its_level():
    hits = sum(st.df_level(st.adf(np.cumsum(np.random.default_rng(i).normal(size=300)))[0], 300) <= 0.05 for i in range(200))
    assert 1 <= hits <= 24


def test_shrinkage_and_repair():
    x = RNG.normal(size=(60, 8)) @ np.diag(np.linspace(0.5, 2, 8))
    c, d = k.ledoit_wolf(x)
    assert 0 <= d <= 1 and np.allclose(c, c.T)
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    good = k.repaired(bad)
    assert np.linalg.eigvalsh(good)[0] > -1e-10 and np.allclose(np.diag(good), 1)
    assert k.repaired(np.eye(3)) is not None and np.array_equal(k.repaired(np.eye(3)), np.eye(3))


def test_recursion_equals_weighted_sum():
    r = RNG.normal(size=50)
    lam = 0.5 ** (1 / 5)
    v = float((r[:10] ** 2).mean())
    want = lam**40 * v + sum((1 - lam) * lam ** (49 - i) * r[i] ** 2 for i in range(10, 50))
    assert k.ewma_path(r, 5, 10)[-1] == pytest.approx(math.sqrt(want * 252))
    r[20] = math.nan
    assert k.ewma_path(r, 5, 10)[20] == k.ewma_path(r, 5, 10)[19]


def test_t_degrees():
    assert k.t_degrees(RNG.standard_t(4, size=20000)) == pytest.approx(4, abs=0.5)
    assert k.t_degrees(RNG.normal(size=20000)) > 25 and k.t_degrees(np.zeros(10)) is None


def test_frontier_weights():
    cov = np.diag([0.01, 0.04])
    assert k.best_weights(cov, np.zeros(2), 1.0) == pytest.approx([0.8, 0.2], abs=1e-4)
    assert k.best_weights(cov, np.array([0.0, 1.0]), 0.01) == pytest.approx([0, 1], abs=1e-6)
    assert k.onto_simplex(np.array([5.0, 0, 0])) == pytest.approx([1, 0, 0])


def test_confidence_set_keeps_best_and_drops_worse():
    base = RNG.normal(size=400)
    p = k.confidence_set(np.stack([base, base + RNG.normal(scale=0.2, size=400), base + 1.0 + RNG.normal(scale=0.2, size=400)], axis=1))
    assert p[0] >= 0.1 and p[2] < 0.1 and p.max() == 1
    same = k.confidence_set(np.stack([base, base], axis=1))
    assert (same >= 0.1).all()


def test_split_keeps_the_test_apart():
    train, test = se.split(3000, 21)
    assert 24 <= len(test) <= 36 and max(train) + 21 < min(test) and min(train) >= 756


def test_candidate_keys_ignore_defaults():
    assert se.Candidate(("a",)).key() == se.Candidate(("a",), 252, "ols", None).key() != se.Candidate(("a",), 126).key()
    found = se.search([se.Candidate(("a",))], ["a", "b"], lambda cs: {c.key(): abs(len(c.factors) - 2) for c in cs})
    assert found[0][0].factors == ("a", "b")


def test_calendars(spark):
    from pyspark.sql import functions as F

    years = [(2024, date(2024, 3, 31)), (2025, date(2025, 4, 20)), (1981, date(1981, 4, 19)), (2049, date(2049, 4, 18)), (2000, date(2000, 4, 23)), (2011, date(2011, 4, 24))]
    got = spark.createDataFrame([(y,) for y, _ in years], "y int").select("y", cal.easter(F.col("y")).alias("t")).collect()
    assert {r.y: r.t for r in got} == dict(years)
    shut = {}
    for r in cal.holidays(spark, 1990, 2026).collect():
        shut.setdefault(r.calendar, set()).add(r.t)
    assert shut["us"] >= {date(2023, 1, 2), date(2023, 6, 19), date(2023, 11, 23), date(2021, 7, 5), date(2020, 7, 3), date(2012, 10, 29), date(2001, 9, 11)}
    assert not shut["us"] & {date(2021, 12, 31), date(2010, 12, 31), date(1997, 1, 20), date(2021, 6, 18)}
    assert shut["uk"] >= {date(2021, 12, 27), date(2021, 12, 28), date(2022, 12, 26), date(2022, 12, 27), date(2020, 12, 25), date(2020, 12, 28), date(2002, 6, 4), date(2022, 6, 2), date(2020, 5, 8)}
    assert not shut["uk"] & {date(2020, 5, 4), date(2022, 5, 30), date(2012, 5, 28)}
    assert {t for t in shut["fx"] if t.year == 2023} == {date(2023, 12, 25)} and all(t.weekday() < 5 for c in shut.values() for t in c)


def test_panel_algebra_from_pair_sums(spark):
    from tidemark.operators import panels as pn

    n, names = 300, ["a", "b", "c", "d"]
    x = RNG.normal(size=(n, 4)) @ RNG.normal(size=(4, 4)) + RNG.normal(size=4)
    x[:, 3] *= 5
    days = [date(2020, 1, 1) + timedelta(i) for i in range(n)]
    d = spark.createDataFrame([(names[j], days[i], float(x[i, j])) for i in range(n) for j in range(4)], "id string, t date, x double")
    full = lambda df, c="cov": (lambda m: np.array([[m[min(a, b), max(a, b)] for b in names] for a in names]))({(r.i, r.j): r[c] for r in df.collect()})
    want, delta = k.ledoit_wolf(x)
    got = pn.shrunk(d, 1)
    assert np.allclose(full(got), want) and got.first().shrinkage == pytest.approx(delta)
    assert np.allclose(full(pn.blended(d, 30.0, 0.6, 1)), 0.6 * k.ewma_matrix(x, 30.0) + 0.4 * want)
    v, q = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    parts = pn.components(d, 2)
    first = {r.id: r.loading for r in parts.where("component = 1").collect()}
    assert np.allclose(np.abs([first[a] for a in names]), np.abs(q[:, -1])) and parts.where("component = 1").first().share == pytest.approx(v[-1] / 4)
    z = (x - x.mean(axis=0)) / x.std(axis=0) @ np.array([first[a] for a in names])
    s = {r.t: r.pc1_vol for r in pn.stress_days(d, 10).collect()}
    assert s[days[100]] == pytest.approx(z[91:101].std(ddof=1)) and s[days[8]] is None
    assert pn.stress_days(d, 10).where("stress").count() == pytest.approx(0.2 * (n - 9), abs=2)
    g = {(r.id, r.t): r.x for r in pn.gram_schmidt(d, ["c", "a", "d"]).collect()}
    a = np.column_stack([np.ones(n), x[:, 2], x[:, 0]])
    resid = x[:, 3] - a @ np.linalg.lstsq(a, x[:, 3], rcond=None)[0]
    assert np.allclose([g["d", t] for t in days], resid) and np.allclose([g["c", t] for t in days], x[:, 2])
    e = pn.described(pn.shrunk(d, 1)).first()
    assert np.allclose(e.eigenvalues, np.linalg.eigvalsh(want)[::-1]) and e.psd and e.series == 4
    bad = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0), ("b", "b", 1.0)], "i string, j string, cov double")
    fixed = {(r.i, r.j): r.cov for r in pn.positive(bad).collect()}
    assert fixed["a", "a"] == pytest.approx(1) and abs(fixed["a", "b"]) <= 1 + 1e-6
    near = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0)], "i string, j string, cov double")
    far = spark.createDataFrame([("a", "a", 3.0), ("a", "b", 0.0)], "i string, j string, cov double")
    assert {(r.i, r.j): r.cov for r in pn.reverted(near, far, 0.25).collect()} == {("a", "a"): 2.5, ("a", "b"): 0.5}


def test_forecasts_by_windows(spark):
    """Factor and specific variance at one day from the definitions, on one window of loadings."""
    from tidemark.operators import risk as rk

    n, days = 200, [date(2021, 1, 1) + timedelta(i) for i in range(200)]
    f, e = RNG.normal(size=(n, 2)), RNG.normal(size=n)
    beta = np.array([0.5, -1.0])
    r = f @ beta + e
    factors = spark.createDataFrame([(c, days[i], float(f[i, j])) for i in range(n) for j, c in enumerate(("x", "y"))], "id string, t date, x double")
    series = spark.createDataFrame([("s", days[i], float(r[i])) for i in range(n)], "id string, t date, ret double")
    loadings = spark.createDataFrame([("s", days[149], "x", 0.5), ("s", days[149], "y", -1.0)], "id string, window_end date, factor string, beta double")
    spec = rk.RiskSpec(window=100, half_life=30.0, specific_half_life=10.0)
    got = {x.t: x for x in rk.forecasts(loadings, series, factors, spec).collect()}
    assert min(got) == days[150] and len(got) == 50
    held = f[50:150]
    c = k.repaired(0.6 * k.ewma_matrix(held, 30.0) + 0.4 * k.ledoit_wolf(held)[0]) * 252
    lam, v = 0.5 ** (1 / 10), None
    for i in range(150, 160):
        v = e[i] ** 2 if v is None else lam * v + (1 - lam) * e[i] ** 2
    assert got[days[160]].sigma_factor == pytest.approx(math.sqrt(beta @ c @ beta)) and got[days[160]].sigma_specific == pytest.approx(math.sqrt(v * 252))
    assert got[days[150]].sigma_specific == rk.LEAST_SPECIFIC
    assert rk.shortfall_factor(0.975) == pytest.approx(2.3378027922, abs=1e-9) and rk.shortfall_factor(0.975, 1e6) == pytest.approx(2.3378, abs=1e-3)
    assert rk.quantile_factor(0.99, 5.0) == pytest.approx(3.3649299989 / math.sqrt(5 / 3), abs=1e-6)


def test_first_of_several_keys(spark):
    from tidemark.operators.joins import either_key

    left = spark.createDataFrame([("r1", "a", "a.T"), ("r2", "b", "b.T"), ("r3", "c", None), ("r1", "a", "a.T")], "row string, k string, alt string")
    right = spark.createDataFrame([("a", 1), ("a.T", 2), ("b.T", 3)], "key string, v int")
    assert sorted((r.row, r.v) for r in either_key(left, right, ["alt", "k"], "key").collect()) == [("r1", 2), ("r1", 2), ("r2", 3), ("r3", None)]
    assert sorted((r.row, r.v) for r in either_key(left, right, ["k", "alt"], "key", "inner").collect()) == [("r1", 1), ("r1", 1), ("r2", 3)]


def test_sessions(spark):
    got = {r["t"] for r in cal.sessions(spark, "us", date(2024, 1, 1), date(2024, 1, 31)).collect()}
    assert date(2024, 1, 1) not in got and date(2024, 1, 15) not in got and date(2024, 1, 2) in got and len(got) == 21


def test_streams_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming import events as ev

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    stream = ev.stream_of(spark, folder, e.schema, files=10)
    q = ev.tumbling(stream, "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = ev.tumbling(e, "1 day").orderBy("start", "event_type").collect()
    assert [(r.start, r.event_type, r.n) for r in spark.table("days").orderBy("start", "event_type").collect()] == [(r.start, r.event_type, r.n) for r in want]
    q = ev.ewma_by_user(ev.stream_of(spark, folder, e.schema, files=10).select("user_id", "event_id", "ts", "value"), 5.0).writeStream.outputMode("append").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == e.count()
    put = ev.upsert_sink(str(tmp_path / "v"), ["user_id"], "ts")
    put(e.where("event_id % 2 = 0"), 0)
    put(e.where("event_id % 2 = 1"), 1)
    newest = ev.Upserts(str(tmp_path / "v"), ["user_id"], "ts").read(spark)
    assert newest.count() == e.select("user_id").distinct().count()
    assert newest.agg(F.max("ts")).first() == e.agg(F.max("ts")).first()


def test_file_sources(spark, tmp_path):
    from tidemark.sources import tables as tb

    (tmp_path / "v.csv").write_text("﻿Date,Aland,Borduria\n31/01/2020,10.5,0\n29/02/2020,#VALUE!,12\n", encoding="utf-8")
    got = sorted(map(tuple, tb.read_valuation_csv(spark, str(tmp_path / "v.csv")).collect()))
    assert got == [("Aland", date(2020, 1, 31), 10.5), ("Borduria", date(2020, 2, 29), 12.0)]
    m = spark.createDataFrame([(1871.01,), (1871.1,), (1999.12,)], "x double").select(tb.decimal_month(__import__("pyspark").sql.functions.col("x")).alias("m")).collect()
    assert [r.m for r in m] == [date(1871, 1, 31), date(1871, 10, 31), date(1999, 12, 31)]
    d = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int")
    path = str(tmp_path / "t")
    d.write.partitionBy("source").parquet(path)
    tb.replace_partitions(spark.read.parquet(path).where("source = 'a'").selectExpr("v + 10 AS v", "source"), path, "source")
    assert sorted((r.source, r.v) for r in spark.read.parquet(path).collect()) == [("a", 11), ("b", 2)]


def test_factor_order_is_checked():
    from tidemark.operators.factors import Recipe, in_order

    ok = in_order([Recipe("b", "single", {}, 1, ["a"]), Recipe("a", "single")])
    assert [r.factor_id for r in ok] == ["a", "b"]
    for bad in ([Recipe("a", "single", residual_on=["b"]), Recipe("b", "single")], [Recipe("a", "nothing")], [Recipe("a", "single"), Recipe("a", "single")]):
        with pytest.raises(ValueError):
            in_order(bad)


def test_no_lookahead_in_windows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import series as s

    rows = [("a", date(2024, 1, 1) + timedelta(i), float(RNG.normal())) for i in range(60)]
    d = spark.createDataFrame(rows, "id string, t date, ret double")
    changed = d.withColumn("ret", F.when(F.col("t") > date(2024, 2, 1), F.col("ret") + 9).otherwise(F.col("ret")))
    cols = [s.rolling_vol("ret", 10).alias("v"), s.in_force("ret").alias("f"), F.avg("ret").over(s.so_far()).alias("m")]
    cut = F.col("t") <= date(2024, 2, 1)
    assert d.select("t", *cols).where(cut).orderBy("t").collect() == changed.select("t", *cols).where(cut).orderBy("t").collect()


def test_ledger_chain_and_fetching(spark, tmp_path):
    from tidemark.sources import jobs

    path = str(tmp_path / "ledger")
    with jobs.ledger(spark, path, "fetch") as run:
        run.item("a", "done", 5)
        run.item("b", "failed", 0, "no answer")
    with pytest.raises(RuntimeError), jobs.ledger(spark, path, "fit"):
        raise RuntimeError("broken")
    entries = spark.read.parquet(path)
    assert {(r.job, r.status) for r in jobs.latest_runs(entries).collect()} == {("fetch", "partial"), ("fit", "failed")}
    today = entries.selectExpr("max(to_date(finished)) AS d").first().d
    assert [r.item for r in jobs.settled_today(entries, "fetch", today).collect()] == ["a"]
    done = []
    assert jobs.chain([("one", lambda: done.append(1), True), ("two", lambda: 1 / 0, False), ("three", lambda: 1 / 0, True), ("four", lambda: done.append(4), False)])[3][1] == "skipped" and done == [1]
    now, slept = [0.0], []
    lim = jobs.Limiter(2.0, clock=lambda: now[0], sleep=slept.append)
    lim.wait(), lim.wait(), lim.wait()
    assert slept == [0.5, 1.0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return "ok"

    assert jobs.with_backoff(flaky, sleep=slept.append) == "ok" and len(tries) == 3
    with pytest.raises(KeyError):
        jobs.with_backoff(lambda: {}["x"], give_up=(KeyError,), sleep=slept.append)


def test_portfolio_identities(spark):
    import pandas as pd

    from tidemark.operators import covariance as cv
    from tidemark.operators import portfolio as pf

    t0 = date(2020, 1, 1)
    x = RNG.normal(size=(300, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1]]) * 0.01
    rows = spark.createDataFrame(pd.DataFrame([(n, t0 + timedelta(i), float(x[i, k])) for i in range(300) for k, n in enumerate("abc")], columns=["id", "t", "x"]))
    c = cv.full(cv.sample(cv.complete(rows, "x")).select("i", "j", "cov")).cache()
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", -0.2)], "id string, beta double")
    sigma = math.sqrt(cv.quadratic(c, w.selectExpr("'p' AS p", "id", "beta"), "p").first().variance)
    parts = cv.contributions(c, w).collect()
    assert sum(r.ctr for r in parts) == pytest.approx(sigma) and all(r.ctr == pytest.approx(r.beta * r.mctr) for r in parts)
    b = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, block string")
    assert sum(r.variance for r in cv.block_variance(c, w, b).collect()) == pytest.approx(sigma**2)
    want = np.array([0.5, 0.3, -0.2]) @ np.cov(x, rowvar=False) @ np.array([0.5, 0.3, -0.2]) * 252
    assert sigma**2 == pytest.approx(want)
    path = pf.cov_paths(rows, ((20.0, 1.0),), 30).where("i = 'a' AND j = 'b'").orderBy("t").collect()
    lam, p = 0.5 ** (1 / 20), x[:299, 0] * x[:299, 1]
    wts = lam ** np.arange(299)[::-1]
    assert path[-1].cov == pytest.approx(float(wts @ p / wts.sum()) * 252) and len(path) == 270


def test_landed_sources(spark, tmp_path):
    from tidemark.sources import tables as tb

    (tmp_path / "o.json").write_text('{"series_id": "X", "observations": [{"date": "2024-01-02", "value": "1.5"}, {"date": "2024-01-03", "value": "."}]}\n')
    assert sorted((str(r.date), r.value) for r in tb.read_observations(spark, str(tmp_path / "o.json")).collect()) == [("2024-01-02", 1.5), ("2024-01-03", None)]
    sheet = spark.createDataFrame([(0, "Date", "Real"), (1, None, "Price"), (2, "1871.01", "4.4")], "line int, c0 string, c1 string")
    assert [tuple(r) for r in tb.stacked_header(sheet, 2, {"Date": "month", "Real Price": "price"}).collect()] == [("1871.01", "4.4")]
    with pytest.raises(ValueError):
        tb.stacked_header(sheet, 2, {"Yield": "y"})
    d = spark.createDataFrame([("a", "2024-01-01", 1.0)], "ccy string, date string, usd_per_unit double")
    assert tb.validated(d, "input_fx").schema["date"].dataType.simpleString() == "date"
    with pytest.raises(ValueError):
        tb.validated(d.drop("ccy"), "input_fx")
    d.write.parquet(str(tmp_path / "panelR12"))
    tb.register(spark, "/root/testdata/sf0.001", ["region"])
    assert spark.sql("SELECT count(*) AS n FROM region").first().n == 5


def test_formula_names_what_is_built():
    from tidemark.operators.factors import BUILDERS, Recipe, formula

    inputs = {"id": "A", "long": ["A", "B"], "short": ["C"], "tenors": ["2", "5", "10"], "shape": "slope", "transform": "diff", "implied": "V", "skip": 22, "span": 231, "vol": 63, "legs": ["A"], "home": 1.0, "a": "A", "b": "B", "tenor": 10}
    for m in BUILDERS:
        own = inputs | ({"long": "A", "short": "B"} if m == "spread" else {})
        assert formula(Recipe("f", m, own, 0, ["g"])).endswith("less its fit on g")
    assert formula(Recipe("f", "spread", {"long": "A", "short": "B"})) == "f = r(A) - r(B)"


def test_missing_days_by_months(spark):
    from tidemark.operators.joins import missing_days

    days = [date(2023, 11, 28) + timedelta(i) for i in range(140)]
    open_days = [t for t in days if t.weekday() < 5]
    rows = [(k, t) for k, step in ((1, 3), (2, 50), (3, 1), (4, 200), (None, 10)) for t in days[::step] for _ in range(2)] + [(1, None), (5, None)]
    d = spark.createDataFrame(rows, "k int, t date")
    out = missing_days(d, spark.createDataFrame([(t,) for t in open_days + open_days[:5]], "t date"), "k", "t")
    want = []
    for k in {r[0] for r in rows}:
        had = [t for q, t in rows if q == k and t]
        # A null key equals none, so its own days are missing too.
        want += [(k, t) for t in open_days if had and min(had) <= t <= max(had) and (k is None or t not in had)]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key) and len(want) > 200
    # The expected days of a full series are never dealt out: what is joined is a calendar of months.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "SortMergeJoin" not in plan
