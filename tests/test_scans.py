"""Scans in two phases and quantiles by selection, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpanel.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    wide = pd.DataFrame({"key": np.repeat(["a", "b", "c"], 50), "time_idx": np.tile(np.arange(50), 3), "x": rng.normal(size=150)})
    wide.loc[rng.random(150) < 0.3, "x"] = np.nan
    wide.loc[wide["key"] == "c", "x"] = np.nan
    wide.loc[(wide["key"] == "b") & (wide["time_idx"] < 21), "x"] = np.nan
    wide = wide[(wide["time_idx"] % 7 != 3) | (wide["key"] != "a")]  # positions that a series lacks
    df = spark.createDataFrame([(k, int(t), None if np.isnan(x) else float(x)) for k, t, x in wide.itertuples(index=False)], "key string, time_idx int, x double")
    return wide.sort_values(["key", "time_idx"]), df.repartition(3).cache()


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("run", [1, 4, 10, 1024])
def test_prefix_is_that_of_one_pass(rows, run, before):
    wide, df = rows
    got = {(r.key, r.time_idx): (r.total, r.held) for r in scans.prefix(df, ["key"], sums={"total": F.col("x")}, lasts={"held": F.col("x")}, before=before, run=run).collect()}
    assert len(got) == len(wide)
    for key, own in wide.groupby("key"):
        x = own["x"]
        total = x.fillna(0).cumsum().where(x.notna().cummax())
        held = x.ffill()
        if before:
            total, held = total.shift(), held.shift()
        for t, a, b in zip(own["time_idx"], total, held):
            one, two = got[key, t]
            assert one is None if np.isnan(a) else abs(one - a) < 1e-12
            assert two is None if np.isnan(b) else two == b


@pytest.mark.parametrize("few,bins", [(3, 16), (4096, 1024)])
def test_quantiles_are_exact(spark, few, bins):
    rng = np.random.default_rng(1)
    groups = {"many": rng.normal(size=500), "equal": np.full(40, 2.5), "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 60), [0.0]]), "ties": rng.integers(0, 3, 90).astype(float), "one": np.array([7.0]), "none": np.array([])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(3).cache()
    cuts = {"least": 0.0, "p10": 0.1, "q": 0.37, "median": 0.5, "p90": 0.9, "most": 1.0}
    got = {r.key: r for r in scans.quantiles(df, ["key"], "x", cuts, few, bins).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        for n, p in cuts.items():
            want = np.quantile(xs, p) if len(xs) else None
            assert got[k][n] is None if want is None else np.isclose(got[k][n], want, rtol=1e-12, atol=0)
    whole = scans.quantiles(df, [], "x", {"median": 0.5}, few, bins).first()
    assert np.isclose(whole.median, np.median(np.concatenate(list(groups.values()))), rtol=1e-12)
