import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import bootstrap, checks, moments, portfolio, regression, returns, risk, runs
from driftpanel.plans import report
from driftpanel.sources import cache, prices

#: A small panel of three assets and two factors.
A = np.array([[0.010, 0.005, -0.002], [0.011, 0.004, -0.001], [0.009, 0.006, 0.000], [0.008, 0.003, 0.001], [0.012, 0.002, -0.003], [0.007, 0.005, 0.002]])
FACTORS = np.array([[0.010, 0.004], [0.011, 0.003], [0.009, 0.005], [0.008, 0.002], [0.012, 0.001], [0.007, 0.004]])


def long(spark, values, names, label):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(values))]
    rows = [(days[i], i, n, float(values[i, j])) for i in range(len(values)) for j, n in enumerate(names)]
    return spark.createDataFrame(rows, f"time date, time_idx int, {label} string, ret double")


@pytest.fixture(scope="module")
def small(spark):
    return long(spark, A, "ABC", "asset").cache(), long(spark, FACTORS, ["MKT", "SEC"], "factor").cache()


def test_sample_model_and_risk(small):
    a, f = small
    coefficients, fits = regression.sample_ols(a, returns.wide_factors(f, ["MKT", "SEC"]), 2)
    got = {r.asset: r for r in coefficients.collect()}
    assert np.allclose([got["C"].b1, got["C"].b2], [-0.97058824, -0.07466063], atol=1e-7)
    assert np.allclose([got[k].alpha for k in "ABC"], [0, 0.001, 0.00895701357], atol=1e-9)
    betas, sigma = risk.long_betas(coefficients, ["MKT", "SEC"]), risk.factor_covariance(f)
    rows = {r.asset: r for r in risk.sample_risk(fits, betas, sigma).collect()}
    assert np.allclose([rows[k].sys_var * 1e6 for k in "ABC"], [3.5, 2.1666667, 3.12081448], atol=1e-6)
    assert abs(rows["C"].idio_var - 3.79185520e-7) < 1e-14 and abs(rows["C"].sys_share - 0.89166128) < 1e-7
    parts = {(r.asset, r.factor): r.contribution for r in risk.factor_contributions(betas, sigma).collect()}
    assert abs(parts["C", "MKT"] - 3.20294118e-6) < 1e-13 and abs(sum(v for (x, _), v in parts.items() if x == "C") - rows["C"].sys_var) < 1e-15
    mu = {r.asset: r.mu for r in moments.shrink_mean(moments.mean_factor_model(betas, f, fits, coefficients), 0.1).collect()}
    assert np.allclose([mu[k] for k in "ABC"], [0.00898888889, 0.00418888889, -0.0000111111], atol=1e-9)
    one = moments.stabilized(moments.shrink_cov(moments.cov_factor_model(betas, sigma, fits), 0.1)).toPandas().pivot(index="asset_i", columns="asset_j", values="cov").to_numpy()
    assert np.allclose(one * 1e6, [[3.51, -1.17, -2.97], [-1.17, 2.1766667, 0.99], [-2.97, 0.99, 3.51]], atol=1e-6)
    assert all(r.ok for r in checks.variance_identity(fits).collect())


def test_ewma_is_the_pandas_recursion(small):
    a, _ = small
    df = pd.DataFrame(A, columns=list("ABC"))
    mean = df.ewm(halflife=2, adjust=False).mean().iloc[-1]
    assert np.allclose([r.mu for r in moments.mean_ewma(a, 2).orderBy("asset").collect()], mean, atol=1e-15)
    cov = df.ewm(halflife=2, adjust=False).cov().loc[5].to_numpy()
    got = moments.cov_ewma(a, 2).toPandas().pivot(index="asset_i", columns="asset_j", values="cov").to_numpy()
    assert np.allclose(got, cov, atol=1e-15)


def test_any_number_of_factors_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    f, r = rng.normal(size=(40, 3)), rng.normal(size=(40, 2))
    a = long(spark, r, "AB", "asset").withColumn("path", F.lit(0))
    g = long(spark, f, "XYZ", "factor").withColumn("path", F.lit(0))
    rows = regression.rolling_ols_any(a, g, 12, chunk=7).toPandas().sort_values(["time_idx", "asset"])
    assert len(rows) == (40 - 11) * 2 and not rows.duplicated(["time_idx", "asset"]).any()
    for row in rows.itertuples():
        w = slice(row.time_idx - 11, row.time_idx + 1)
        x = np.column_stack([np.ones(12), f[w]])
        b = np.linalg.lstsq(x, r[w][:, "AB".index(row.asset)], rcond=None)[0]
        assert np.allclose([row.alpha, *row.betas], b, atol=1e-9)
        assert abs(row.fitted + row.residual - r[row.time_idx, "AB".index(row.asset)]) < 1e-12
    whole = regression.sample_ols_any(a, g)[0].filter("asset = 'A'").first()
    assert np.allclose([whole.alpha, *whole.betas], np.linalg.lstsq(np.column_stack([np.ones(40), f]), r[:, 0], rcond=None)[0])


def test_rolling_warm_up_and_window_longer_than_history(small):
    a, f = small
    model = regression.rolling_ols(a, returns.wide_factors(f, ["MKT"]), 3)
    rows = {(r.asset, r.time_idx): r for r in risk.rolling_risk(model, 3).collect()}
    assert rows["A", 1].sys_var is None and rows["A", 2].sys_var is not None
    assert rows["A", 3].idio_var is None and rows["A", 4].idio_var is not None
    assert regression.rolling_ols(a, returns.wide_factors(f, ["MKT"]), 9).filter("b1 is not null").count() == 0


def test_bootstrap_keeps_blocks_and_calendar(small, spark):
    a, f = small
    draws = bootstrap.hashed_draws(a, 2, 4, 7)
    pa, pf = bootstrap.resample(a, draws, 2), bootstrap.resample(f, draws, 2)
    x = {(r.path, r.time_idx, r.source_idx) for r in pa.collect()}
    assert x == {(r.path, r.time_idx, r.source_idx) for r in pf.collect()} and len(x) == 24
    history = {(r.time_idx, r.asset): r.ret for r in a.collect()}
    assert all(history[r.source_idx, r.asset] == r.ret for r in pa.collect())
    whole = bootstrap.resample(a, bootstrap.hashed_draws(a, 6, 1, 7), 6)
    assert {(r.time_idx, r.asset, r.ret) for r in whole.collect()} == {(i, n, v) for (i, n), v in history.items()}
    rng = np.random.default_rng(5)
    starts = [r.start for r in bootstrap.sequential_draws(spark, 6, 2, 2, 5).orderBy("path", "block").collect()]
    assert starts == [int(v) for _ in range(2) for v in rng.integers(0, 5, size=3)]
    with pytest.raises(ValueError):
        bootstrap.sequential_draws(spark, 6, 7, 1, 0)


def test_missing_price_drops_its_date_and_the_next(spark):
    day = lambda i: dt.date(2024, 1, i)
    rows = [(day(i), s, 1.0 + i + (s == "B")) for i in range(1, 6) for s in "AB" if (i, s) != (3, "B")]
    got = returns.complete_dates(returns.log_returns(spark.createDataFrame(rows, "time date, series string, price double")))
    assert sorted({r.time for r in got.collect()}) == [day(2), day(5)]


def test_business_days(spark):
    days = [dt.date(2024, 2, 20) + dt.timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 5, 251):
        got = {r.d: r.s for r in df.select("d", returns.business_day_before(F.col("d"), n).alias("s")).collect()}
        assert all(got[d] == (pd.Timestamp(d) - pd.offsets.BDay(n)).date() for d in days)


def test_cumulative_portfolio_drifts_from_the_next_row(spark):
    a = long(spark, A, "ABC", "asset").withColumn("path", F.lit(0))
    w = spark.createDataFrame([(0, dt.date(2024, 1, 2), n, 1 / 3) for n in "ABC"], "path int, time date, asset string, weight double")
    rows = report.portfolio_cumulative(w, a).orderBy("time_idx").collect()
    expected = (np.cumprod(1 + np.expm1(A[2:]).mean(axis=1)) - 1) * 100
    assert [r.time_idx for r in rows] == [2, 3, 4, 5] and np.allclose([r.cumulative for r in rows], expected)


def test_estimators_and_groups(small):
    fitted = portfolio.PortfolioOptimizer(covariance=portfolio.CovarianceEstimator(shrinkage=0.1)).fit(small[0])
    w = {r.asset: r.weight for r in fitted.get_weights().collect()}
    assert abs(sum(w.values()) - 1) < 1e-8 and abs(w["A"] - 0.44705882) < 1e-6
    with pytest.raises(ValueError):
        moments.shrink_mean(moments.mean_hist(small[0]), 1.5)
    with pytest.raises(ValueError):
        checks.check_panel(small[0].drop("ret"), "asset")
    assert checks.missing_labels(small[0], "asset", ["A", "Z"]) == ["Z"]


def test_store_names_and_wide_frames(spark, tmp_path):
    name = cache.Store.name
    assert name("x", {"a": 1}, {"l": ["B", "A"]}) == name("x", {"a": 1}, {"l": ["A", "B"]}) != name("x", {"a": 2}, {"l": ["A", "B"]})
    assert name("x", {"a": ["B", "A"]}) != name("x", {"a": ["A", "B"]}) and name("x", {"a": 1, "b": 2}) == name("x", {"b": 2, "a": 1})
    store, made = cache.Store(spark, str(tmp_path)), []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert store.fetch("k", make).count() == 3
    assert made == [1] and store.holds("k") and not store.holds("other")
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, float("nan"))], "time date, A double, B double")
    assert {(r.series, r.price) for r in prices.from_wide(wide).collect()} == {("A", 1.0), ("B", None)}
    with pytest.raises(ValueError):
        prices.mock_returns(spark, "2024-01-01", "2024-01-10", [])


def test_event_stream_gives_the_batch_means(spark, tmp_path):
    from driftpanel.streaming import events

    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, i % 24), 1, "click", float(i), "") for i in range(12)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_prices(events.read_events(spark, str(tmp_path / "in")))
    job = stream.writeStream.outputMode("complete").format("memory").queryName("means").start()
    try:
        job.processAllAvailable()
        assert sorted(r.price for r in spark.table("means").collect()) == [1.5, 5.5, 9.5]
    finally:
        job.stop()


def numpy_risk(r, f, window):
    """(time_idx, asset) -> contributions and own variance, by the definitions."""
    beta, resid, out = {}, np.full(r.shape, np.nan), {}
    for t in range(window - 1, len(f)):
        w = slice(t - window + 1, t + 1)
        b = np.linalg.lstsq(np.column_stack([np.ones(window), f[w]]), r[w], rcond=None)[0]
        beta[t], resid[t] = b[1:], r[t] - b[0] - f[t] @ b[1:]
        sigma = np.cov(f[w], rowvar=False)
        for j in range(r.shape[1]):
            own = resid[w, j]
            out[t, j] = b[1:, j] * (sigma @ b[1:, j]), None if np.isnan(own).any() else own.var(ddof=1)
    return out


def test_rolling_risk_of_three_factors(spark):
    rng = np.random.default_rng(8)
    r, f, window = rng.normal(0, 0.01, (30, 2)), rng.normal(0, 0.01, (30, 3)), 6
    a = long(spark, r, "AB", "asset").withColumn("path", F.lit(0))
    g = long(spark, f, "XYZ", "factor").withColumn("path", F.lit(0))
    want = numpy_risk(r, f, window)
    rows = risk.rolling_risk_any(regression.rolling_ols_any(a, g, window), g, window).collect()
    assert len(rows) == len(want)
    for row in rows:
        parts, own = want[row.time_idx, "AB".index(row.asset)]
        assert np.allclose(row.contributions, parts, atol=1e-12) and abs(row.sys_var - parts.sum()) < 1e-12
        assert row.idio_var is None if own is None else abs(row.idio_var - own) < 1e-12
        assert row.sys_share is None if own is None else abs(row.sys_share - parts.sum() / (parts.sum() + own)) < 1e-9
    long_rows = risk.contribution_rows(risk.rolling_risk_any(regression.rolling_ols_any(a, g, window), g, window))
    assert long_rows.count() == 3 * len(want) and set(long_rows.columns) == {"path", "time", "asset", "factor", "contribution"}


def test_windows_do_not_depend_on_runs(spark):
    rng = np.random.default_rng(4)
    a, f = long(spark, rng.normal(0, 1, (25, 2)), "AB", "asset"), long(spark, rng.normal(0, 1, (25, 1)), "X", "factor")
    rows = regression.joined(a, returns.wide_factors(f, ["X"]))
    for chunk in (3, 7, 100):
        cut = runs.own_rows(runs.in_runs(rows, 4, chunk), chunk)
        assert cut.count() == rows.count() and cut.exceptAll(rows.select(cut.columns)).count() == 0


def test_compute_mu_and_cov_of_a_model(small):
    a, f = (x.withColumn("path", F.lit(0)) for x in small)
    model = portfolio.factor_model(*regression.sample_ols_any(a, f), f)
    mu = {r.asset: r.mu for r in portfolio.compute_mu(model=model, method="factor_model", shrinkage=0.1).collect()}
    assert np.allclose([mu[k] for k in "ABC"], [0.00898888889, 0.00418888889, -0.0000111111], atol=1e-10)
    cov = {(r.asset_i, r.asset_j): r.cov for r in portfolio.compute_cov(model=model, method="factor_model", shrinkage=0.1).collect()}
    want = 0.9 * np.cov(A, rowvar=False) + 0.1 * np.diag(np.diag(np.cov(A, rowvar=False))) + 1e-8 * np.eye(3)
    assert np.allclose([[cov[i, j] for j in "ABC"] for i in "ABC"], want, atol=1e-14)
    rolling = portfolio.factor_model(regression.rolling_ols_any(a, f, 4), small[0].limit(0).withColumn("residual", F.lit(0.0)), f)
    assert rolling["betas"].count() == 6
    w = {r.asset: r.weight for r in portfolio.sample_weights(a, f, portfolio.Problem()).collect()}
    assert abs(w["A"] - 0.44705882) < 1e-6 and abs(sum(w.values()) - 1) < 1e-8


def test_a_value_that_is_not_finite_fails(spark):
    cov = spark.createDataFrame([("A", "A", 1.0), ("A", "B", float("nan"))], "asset_i string, asset_j string, cov double")
    with pytest.raises(Exception, match="not finite"):
        checks.finite(cov).collect()
    assert checks.finite(cov.limit(1)).count() == 1


def test_ewma_moments_are_those_of_pandas(small):
    h = 2.0
    wide = pd.DataFrame(FACTORS, columns=["MKT", "SEC"])
    mean = {r.factor: r.m for r in moments.mean_of(small[1], "factor", halflife=h).collect()}
    assert np.allclose([mean[k] for k in wide], wide.ewm(halflife=h, adjust=False).mean().iloc[-1], atol=1e-15)
    cov = {(r.factor, r.factor_p): r.cov for r in moments.factor_cov(small[1], h).collect()}
    want = wide.ewm(halflife=h, adjust=False).cov().loc[5]
    assert np.allclose([[cov[i, j] for j in wide] for i in wide], want, atol=1e-18)
    var = {r.factor: r.v for r in moments.variance_of(small[1], "factor", halflife=h).collect()}
    assert np.allclose([var[k] for k in wide], np.diag(want), atol=1e-18)


def test_weights_for_figures(spark):
    day = dt.date(2024, 1, 1)
    w = spark.createDataFrame([(p, day, n, x) for p in (-1, 0, 1, 2) for n, x in (("A", 0.1 * (p + 2)), ("B", 1 - 0.1 * (p + 2)))], "path int, time date, asset string, weight double")
    boxes = {r.asset: r for r in report.weight_boxes(w).collect()}
    assert np.allclose([boxes["A"].least, boxes["A"].q1, boxes["A"].median, boxes["A"].most, boxes["A"].realized], [0.2, 0.25, 0.3, 0.4, 0.1])
    assert report.weights_through_time(w, ["A"], "area").count() == 4
    with pytest.raises(ValueError):
        report.weights_through_time(w, ["A", "Z"])
    with pytest.raises(Exception, match="at least 0"):
        report.weights_through_time(w.withColumn("weight", -F.col("weight")), kind="area").collect()
    assert report.weights_through_time(w.withColumn("weight", -F.col("weight"))).count() == 8


def test_closed_form_by_path(spark):
    covs = {p: np.cov(np.random.default_rng(p).normal(size=(30, 3)), rowvar=False) for p in (0, 1)}
    rows = [(p, i, j, float(c["ABC".index(i), "ABC".index(j)])) for p, c in covs.items() for i in "ABC" for j in "ABC"]
    got = {(r.path, r.asset): r.weight for r in portfolio.closed_form(spark.createDataFrame(rows, "path int, asset_i string, asset_j string, cov double")).collect()}
    for p, c in covs.items():
        x = np.linalg.solve(c, np.ones(3))
        assert np.allclose([got[p, n] for n in "ABC"], x / x.sum())


def test_stored_paths_are_drawn_once(small, spark, tmp_path):
    a, f = small
    store = cache.Store(spark, str(tmp_path))
    one, two = (bootstrap.paths(a, f, 2, 3, 7, store, "small")[0] for _ in range(2))
    assert one.exceptAll(two).count() == 0 and len(list(tmp_path.iterdir())) == 2
    assert bootstrap.paths(a, f, 2, 3, 8, store, "small")[0].count() == 54 and len(list(tmp_path.iterdir())) == 4
    bootstrap.paths(a, f, 2, 3, None, store, "small")
    assert len(list(tmp_path.iterdir())) == 4


def test_residual_paths_without_residuals_are_the_model(small):
    """Degenerate residuals: every path is alpha + beta f of the drawn dates."""
    a, f = small
    fits = a.select("time", "time_idx", "asset", F.lit(0.0).alias("residual"))
    betas = a.sparkSession.createDataFrame([("A", 0.1, 1.0), ("B", 0.0, 2.0), ("C", 0.2, 0.0)], "asset string, alpha double, beta double")
    market = f.filter("factor = 'MKT'")
    rows = bootstrap.residual_paths(fits, market, betas, bootstrap.hashed_draws(a, 2, 5, 1), 2).collect()
    by = {}
    for r in rows:
        by.setdefault((r.path, r.time_idx), {})[r.asset] = r.ret
    values = set(np.round(FACTORS[:, 0], 12))
    assert all(abs(v["C"] - 0.2) < 1e-15 and round(v["A"] - 0.1, 12) in values and abs(v["B"] - 2 * (v["A"] - 0.1)) < 1e-12 for v in by.values())


def test_symmetric_assets_get_equal_weights():
    rng = np.random.default_rng(9)
    for rho in (0.0, 0.3, 0.8):
        cov = 0.04 * (rho + (1 - rho) * np.eye(5))
        w, record = portfolio.optimize(cov, None, portfolio.Problem(), int(rng.integers(100)))
        assert np.allclose(w, 0.2, atol=1e-7) and record["weight_diff_init"] < 1e-5


def test_loaded_prices_carry_their_origin(spark, tmp_path):
    items = spark.createDataFrame([(dt.date(2024, 1, d), s, 10.0 * d, 2.0) for d in (1, 2, 9) for s in "AN"], "l_shipdate date, l_returnflag string, l_extendedprice double, l_quantity double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    store = cache.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        got = prices.load_prices(spark, str(tmp_path), "flag", kind="factor", frequency="day", series=["A"], end="2024-01-02", store=store)
    assert [(r.time, r.series, r.kind, r.price) for r in got.orderBy("time").collect()] == [(dt.date(2024, 1, 1), "A", "factor", 5.0), (dt.date(2024, 1, 2), "A", "factor", 10.0)]
    assert got.schema["price"].metadata["frequency"] == "daily"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" not in plan and "PushedFilters" in plan and "LessThanOrEqual(time" in plan and "EqualTo(series,A)" in plan
    assert prices.load_prices(spark, str(tmp_path), "flag", kind="factor", frequency="day", store=store).count() == 6
    assert len(list((tmp_path / "store").iterdir())) == 1  # one stored panel serves all spans
    with pytest.raises(ValueError):
        prices.load_prices(spark, str(tmp_path), "flag", kind="other")
    with pytest.raises(ValueError):
        prices.to_long(got.limit(0), "price")
    assert prices.to_long(got, "price").columns == ["time", "series", "price"]
