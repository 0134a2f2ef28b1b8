"""Panels in one pass, merging moments by path and with gaps, rolling fits by updating, the store's commits."""

import datetime as dt
import json
import os
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import crossproducts, moments, portfolio, regression, returns
from driftpanel.sources import cache, prices

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


# Panels


def price_frame(seed, n_days=60, names="ABC", factors="XY", missing=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for by, series in (("asset", names), ("factor", factors)):
        for i in range(n_days):
            for s in series:
                if rng.random() > missing and not (by == "factor" and i in (7, 8)):
                    price = rng.choice([float(rng.uniform(1, 2)), float(rng.uniform(1, 2)), None, 0.0], p=[0.5, 0.48, 0.01, 0.01])
                    rows.append((by, day(i), s, price))
    return rows


def panel_by_pandas(rows):
    """Complete dates of both kinds by the definitions: union grid, previous row, any gap drops a date."""
    out, common = {}, None
    for by in ("asset", "factor"):
        wide = pd.DataFrame([r[1:] for r in rows if r[0] == by], columns=["time", "series", "price"]).pivot(index="time", columns="series", values="price").astype(float).sort_index()
        ok = (wide > 0) & (wide.shift() > 0)
        ret = np.log(wide.where(wide > 0) / wide.shift().where(wide.shift() > 0)).where(ok)
        out[by] = ret.dropna(how="any")
        common = out[by].index if common is None else common.intersection(out[by].index)
    return {by: x.loc[common] for by, x in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_panel_is_that_of_the_definitions(spark, seed):
    rows = price_frame(seed)
    df = spark.createDataFrame(rows, "by string, time date, series string, price double")
    a, f = returns.panel(*(df.filter(F.col("by") == k).select("time", "series", "price") for k in ("asset", "factor")))
    want = panel_by_pandas(rows)
    for got, by, label in ((a, "asset", "asset"), (f, "factor", "factor")):
        found = {(r.time, r[label]): (r.ret, r.time_idx) for r in got.collect()}
        times = list(want[by].index)
        assert len(times) > 10
        assert found.keys() == {(t, s) for t in times for s in want[by].columns}
        assert all(abs(v - want[by].loc[t, s]) < 1e-14 and i == times.index(t) for (t, s), (v, i) in found.items())
    whole = returns.complete_dates(returns.log_returns(df.filter("by = 'asset'").select("time", "series", "price")))
    assert {r.time for r in whole.collect()} >= set(want["asset"].index)


def test_no_panel_without_a_common_date(spark):
    df = spark.createDataFrame([(day(i), s, 1.0 + i) for i in range(3) for s in "AB"], "time date, series string, price double")
    later = df.select(F.date_add("time", 100).alias("time"), "series", "price")
    assert [x.count() for x in returns.panel(df, later)] == [0, 0]
    assert [x.count() for x in returns.panel(df, df.limit(0))] == [0, 0]
    one = df.filter((F.col("series") != "B") | (F.col("time") == F.lit(day(0))))  # B stops after the first date
    assert returns.panel(one, df)[0].count() == 0


def test_prices_of_several_keys_come_from_one_scan(spark, tmp_path):
    items = [(dt.datetime(2024, 1, 1 + i % 20), k % 3, f, s, 10.0 * (i + k), 1.0 + k) for i in range(40) for k, (f, s) in enumerate((("A", "O"), ("N", "F"), ("R", None)))]
    items += [(None, 1, "A", "O", 5.0, 1.0), (dt.datetime(2024, 1, 2), 99, "A", "O", 5.0, 1.0), (dt.datetime(2024, 2, 2), 1, "A", "O", 5.0, 0.0)]
    spark.createDataFrame(items, "l_shipdate timestamp_ntz, l_partkey long, l_returnflag string, l_linestatus string, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"T{k}", f"B{k}") for k in range(3)], "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    both = prices.item_prices(spark, str(tmp_path), ["type", "flag", "status", "type"], "day")
    assert both._jdf.queryExecution().executedPlan().toString().count("l_shipdate:timestamp") == 1  # in the schema that a scan reads
    got = {}
    for r in both.collect():
        got.setdefault(r.by, set()).add((r.time, r.series, r.price))
    assert set(got) == {"type", "flag", "status"}
    for by in got:
        assert got[by] == {tuple(r) for r in prices.derived_prices(spark, str(tmp_path), by, "day").collect()}
    assert (day(32), "A", None) in got["flag"] and {s for _, s, _ in got["status"]} == {"O", "F"}
    with pytest.raises(ValueError):
        prices.item_prices(spark, str(tmp_path), ["type", "other"])


# Moments that merge


def two_paths(seed=5, n=70, names="ABCD", gaps=True):
    """Two paths with leading and inner gaps, as frames by path, and as rows."""
    rng, frames, rows = np.random.default_rng(seed), {}, []
    for path in (0, 1):
        wide = pd.DataFrame(rng.normal(0.01 * path, 0.01 * (1 + path), (n, len(names))), columns=list(names))
        if gaps:
            wide.iloc[: 5 + path, 1] = np.nan
            wide.iloc[20 + path : 31, 2] = np.nan
            wide = wide.mask(rng.random(wide.shape) < 0.08)
            wide["D"] = wide["D"].where(np.arange(n) == 3)
        frames[path] = wide
        rows += [(path, day(i), i, s, None if np.isnan(v) else float(v)) for i, row in wide.iterrows() for s, v in row.items()]
    return frames, rows


@pytest.fixture(scope="module")
def paths(spark):
    frames, rows = two_paths()
    return frames, spark.createDataFrame(rows, "path int, time date, time_idx int, asset string, ret double").cache()


def square(df, *on):
    return {tuple(r[c] for c in on): r.cov for r in df.collect()}


@pytest.mark.parametrize("width", [256, 2, 1])
@pytest.mark.parametrize("run", [2048, 16, 5])
def test_covariances_by_path_with_gaps(paths, run, width):
    frames, df = paths
    got = {(r.path, r.i, r.j): r for r in crossproducts.covariances(df, "asset", ["path"], run, width).collect()}
    weighted = {(r.path, r.i, r.j): r.cov for r in crossproducts.ew_covariances(df, "asset", 6.0, ["path"], run, width).collect()}
    seen = 0
    for path, wide in frames.items():
        cov, ew = wide.cov(), wide.ewm(halflife=6.0, adjust=False).cov().loc[wide.index[-1]]
        for i in wide:
            for j in wide:
                n = int((wide[i].notna() & wide[j].notna()).sum())
                if i > j or not n:
                    assert (path, i, j) not in got
                    continue
                assert got[path, i, j].n == n
                for found, want in ((got[path, i, j].cov, cov.loc[i, j]), (weighted[path, i, j], ew.loc[i, j])):
                    assert found is None if n == 1 else abs(found - want) < 1e-15
                seen += 1
    assert seen > 12


@pytest.mark.parametrize("run", [2048, 7])
def test_means_and_variances_by_path_with_gaps(paths, run):
    frames, df = paths
    x = F.col("ret")
    got = {(r.path, r.asset): r for r in crossproducts.ew_moments(df, ["path", "asset"], {"m": x, "xx": x * x}, 6.0, run).collect()}
    mean, var = ({(r.path, r.asset): r[c] for r in d.collect()} for d, c in ((moments.mean_ewma(df, 6.0), "mu"), (moments.variance_of(df, "asset", halflife=6.0), "v")))
    hist = {(r.path, r.asset): r.mu for r in moments.mean_hist(df).collect()}
    for path, wide in frames.items():
        ewm = wide.ewm(halflife=6.0, adjust=False)
        for s in wide:
            assert abs(got[path, s].m - ewm.mean().iloc[-1][s]) < 1e-15 and abs(mean[path, s] - ewm.mean().iloc[-1][s]) < 1e-15
            want = ewm.var().iloc[-1][s]
            assert var[path, s] is None if wide[s].count() == 1 else abs(var[path, s] - want) < 1e-15
            assert abs(hist[path, s] - wide[s].mean()) < 1e-15


@pytest.mark.parametrize("method", ["hist", "ewma"])
def test_estimators_keep_paths_apart(spark, method):
    frames, rows = two_paths(gaps=False)
    df = spark.createDataFrame(rows, "path int, time date, time_idx int, asset string, ret double")
    settings = {"method": method, "halflife": 9.0, "shrinkage": 0.2}
    mu = {(r.path, r.asset): r.mu for r in portfolio.compute_mu(df, **settings).collect()}
    cov = square(portfolio.compute_cov(df, **settings), "path", "asset_i", "asset_j")
    for path, wide in frames.items():
        ewm = wide.ewm(halflife=9.0, adjust=False)
        m = wide.mean() if method == "hist" else ewm.mean().iloc[-1]
        c = wide.cov() if method == "hist" else ewm.cov().loc[wide.index[-1]]
        assert np.allclose([mu[path, s] for s in wide], 0.8 * m + 0.2 * m.mean(), atol=1e-15)
        c = 0.8 * c + 0.2 * np.diag(np.diag(c)) + 1e-8 * np.eye(len(c))
        assert np.allclose([[cov[path, i, j] for j in wide] for i in wide], c, atol=1e-15)
    alone = portfolio.compute_mu(df.filter("path = 1").drop("path"), **settings)
    assert {r.asset: round(r.mu, 15) for r in alone.collect()} == {s: round(mu[1, s], 15) for s in "ABCD"}


def test_many_series_are_not_joined_with_themselves(spark):
    """300 series of 40 dates in blocks: as many rows as pairs leave the runs."""
    x = np.random.default_rng(2).normal(size=(40, 300))
    rows = spark.createDataFrame(pd.DataFrame({"time_idx": np.repeat(np.arange(40), 300), "asset": [f"s{k:03}" for k in range(300)] * 40, "ret": x.ravel()}))
    half = crossproducts.covariances(rows, "asset")
    assert half._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    got, want = half.collect(), np.cov(x, rowvar=False)
    assert len(got) == 300 * 301 // 2
    assert all(abs(r.cov - want[int(r.i[1:]), int(r.j[1:])]) < 1e-12 for r in got)


def test_estimators_check_what_they_are_given(spark, paths):
    df = paths[1]
    for bad in (df.limit(0), df.drop("ret"), df.drop("time_idx")):
        with pytest.raises(ValueError):
            portfolio.compute_mu(bad)
        with pytest.raises(ValueError):
            portfolio.compute_cov(bad)
    fits = df.withColumn("residual", F.col("ret"))
    factors = df.withColumnRenamed("asset", "factor")
    model = {"coefficients": df, "betas": df, "fits": fits, "factors": factors.withColumn("time_idx", F.col("time_idx") + 1000)}
    for wrong in (None, {}, model, model | {"factors": factors.drop("ret")}):
        with pytest.raises(ValueError):
            portfolio.compute_cov(model=wrong, method="factor_model")


def test_mock_returns_do_not_depend_on_partitions(spark):
    one = prices.mock_returns(spark, "2024-01-01", "2024-03-29", ["a", "b"], 0.01, 7)
    names = spark.createDataFrame([("b",), ("a",)], "series string").repartition(5)
    two = prices.drawn_returns(prices.business_days(spark, "2024-01-01", "2024-03-29").repartition(7), names, 0.01, 7)
    assert one.count() == 65 * 2 and one.exceptAll(two).count() == 0
    x = np.array([r.ret for r in prices.mock_returns(spark, "2000-01-03", "2020-01-01", ["a", "b"], 1.0, 3).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x**4).mean() - 3) < 0.3
    assert prices.mock_returns(spark, "2024-01-01", "2024-01-05", ["a"], 0.01, 8).exceptAll(one).count() == 5


def test_a_halflife_is_needed(paths):
    for h in (None, 0, -1.0):
        with pytest.raises(ValueError):
            crossproducts.ew_covariances(paths[1], "asset", h)


# Rolling fits


def long_rows(spark, x, names, label, skip=()):
    rows = [(0, day(i), i, n, float(x[i, j])) for i in range(len(x)) for j, n in enumerate(names) if (i, n) not in skip and not np.isnan(x[i, j])]
    return spark.createDataFrame(rows, f"path int, time date, time_idx int, {label} string, ret double")


def test_updated_fits_are_the_minimum_norm_solution_where_rank_drops():
    rng = np.random.default_rng(0)
    f, r = rng.normal(size=(160, 3)), rng.normal(size=(160, 2))
    f[50:90, 2] = 2 * f[50:90, 1]
    f[110:140, 0] = 0.5
    for intercept in (True, False):
        x = np.column_stack([np.ones(160), f]) if intercept else f
        got = regression.rolling_least_squares(f, r, 12, intercept)
        for t in range(11, 160):
            w = slice(t - 11, t + 1)
            assert np.allclose(got[t - 11], np.linalg.lstsq(x[w], r[w], rcond=None)[0], atol=1e-8)


@pytest.mark.parametrize("blocks", [1, 3])
def test_rolling_fits_are_keyed_by_asset(spark, blocks):
    """Missing rows, an asset that ends where another begins, a date without factors."""
    rng = np.random.default_rng(1)
    f, r = rng.normal(size=(60, 2)), rng.normal(size=(60, 4))
    names = ["a", "aa", "b", "c"]
    skip = {(20, "a")} | {(i, "b") for i in range(30, 60)} | {(i, "aa") for i in range(30)}
    a, g = long_rows(spark, r, names, "asset", skip), long_rows(spark, f, "XY", "factor", {(45, "X"), (45, "Y")})
    got = {(r_.time_idx, r_.asset): r_ for r_ in regression.rolling_ols_any(a, g, 8, chunk=10, blocks=blocks).collect()}
    want = {}
    for j, n in enumerate(names):
        for t in range(7, 60):
            w = range(t - 7, t + 1)
            if not any((i, n) in skip or i == 45 for i in w):
                want[t, n] = np.linalg.lstsq(np.column_stack([np.ones(8), f[list(w)]]), r[list(w), j], rcond=None)[0]
    assert got.keys() == want.keys()
    for (t, n), b in want.items():
        row = got[t, n]
        assert np.allclose([row.alpha, *row.betas], b, atol=1e-10) and row.time == day(t) and row.factors == ["X", "Y"]
        assert abs(row.fitted + row.residual - r[t, names.index(n)]) < 1e-12


def test_a_date_that_lacks_one_factor_fails(spark):
    rng = np.random.default_rng(1)
    a, g = long_rows(spark, rng.normal(size=(20, 1)), "a", "asset"), long_rows(spark, rng.normal(size=(20, 2)), "XY", "factor", {(9, "X")})
    with pytest.raises(Exception, match="lacks a factor"):
        regression.rolling_ols_any(a, g, 5).collect()


def test_windows_with_a_missing_date_are_null(spark):
    rng = np.random.default_rng(3)
    r, f = rng.normal(size=(20, 1)), rng.normal(size=(20, 1))
    a, g = long_rows(spark, r, "a", "asset", {(9, "a")}).drop("path"), long_rows(spark, f, "X", "factor").drop("path")
    rows = {x.time_idx: x.b1 for x in regression.rolling_ols(a, returns.wide_factors(g, ["X"]), 5).collect()}
    assert {t for t, b in rows.items() if b is not None} == {*range(4, 9), *range(14, 20)}


# The store


@pytest.fixture
def store(spark, tmp_path):
    return cache.Store(spark, str(tmp_path / "store"))


def test_a_killed_write_leaves_the_old_result(spark, store):
    store.put("x", spark.range(3), {"seed": 7})
    boom = F.udf(lambda i: 1 // 0 if i > 5 else i, "int")
    with pytest.raises(Exception):
        store.put("x", spark.range(10).select(boom("id").alias("id")))
    store.staged("x", spark.range(9))  # a writer that died before its rename
    assert store.get("x").count() == 3 and store.generations("x") == [1]
    assert store.manifest("x")["origin"] == {"seed": "7"} and store.manifest("x")["schema"]["fields"][0]["name"] == "id"
    assert store.sweep("x") >= 1 and store.get("x").count() == 3
    os.remove(f"{store.path('x')}/g-000001/{cache.MANIFEST}")  # not whole: as if it were not there
    assert not store.holds("x")
    with pytest.raises(FileNotFoundError):
        store.get("x")


def test_readers_keep_their_generation(spark, store):
    store.put("x", spark.range(3))
    reader = store.get("x")
    store.put("x", spark.range(5))
    assert reader.count() == 3 and store.get("x").count() == 5 and store.generations("x") == [1, 2]
    store.put("x", spark.range(6))
    assert store.generations("x") == [2, 3] and store.get("x").count() == 6


def test_two_writers_at_once(spark, store):
    staged = [store.staged("x", spark.range(n)) for n in (3, 4, 5, 6)]
    numbers = []
    threads = [threading.Thread(target=lambda s=s: numbers.append(store.publish("x", s))) for s in staged]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == store.generations("x") == [1, 2, 3, 4]
    assert sorted(spark.read.parquet(f"{store.path('x')}/{cache.GENERATION.format(n)}").count() for n in numbers) == [3, 4, 5, 6]
    late = store.staged("x", spark.range(50))
    assert store.publish("x", late, replace=False) == 4 and not os.path.exists(late)


def test_a_session_keeps_what_it_computed(spark):
    made = []
    held = cache.session_store(spark)
    assert held is cache.session_store(spark)
    for _ in range(2):
        assert held.fetch("kept", lambda: made.append(1) or spark.range(4)).count() == 4
    assert made == [1] and json.loads(json.dumps(held.manifest("kept")))["origin"] == {}
