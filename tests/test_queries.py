import os

import pytest

import __spark_entry__ as entry
from tests.compare import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
NAMES = ["panel_vwap", "log_returns", "aligned_returns", "business_windows", "sample_ols_k2", "rolling_risk_k1", "cov_ewma", "cov_factor_model", "bootstrap_paths", "minvar_two_asset", "cumulative_bands", "sample_ols_multi", "rolling_risk_multi", "pair_rolling_weights"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert rows_of(entry.queries()[name](spark, FOLDER)) == rows_of_sql(entry.oracle_sql()[name], FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_rolling_weights_are_portfolios(spark):
    rows = entry.queries()["rolling_weights"](spark, FOLDER).collect()
    total = {}
    for r in rows:
        total[r.path, r.time] = total.get((r.path, r.time), 0) + r.weight
        assert -1e-6 <= r.weight <= 1 + 1e-6
    assert total and all(abs(v - 1) < 4e-6 for v in total.values())  # weights have six digits
    assert {p for p, _ in total} == set(range(-1, 10))
