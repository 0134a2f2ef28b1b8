"""The registered queries over panels derived from the given tables.

Assets are part types by week; factors are return flags (A, N, R) or supplier regions by week.
Doubles are rounded to ten decimals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bootstrap, checks, moments, perturb, portfolio, regression, returns, risk, scans
from ..sources.cache import Store, session_store
from ..sources.prices import derived_prices, drawn_returns, from_wide, item_prices, load_prices, to_wide
from . import report

WINDOW, EVERY, BLOCK, PATHS, SEED, HALFLIFE, SHRINKAGE = 52, 4, 4, 10, 42, 26, 0.1
ONE, TWO = ["R"], ["R", "A"]
REGIONS = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 10) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several queries read, kept as files for the session."""
    return session_store(spark).fetch(Store.name(name, {"from": sf_dir}), make, {"from": sf_dir})


def price_rows(spark: SparkSession, sf_dir: str, *by: str, frequency: str = "week") -> DataFrame:
    """The prices of some kinds of series with those before them: from one scan of the line items."""
    kinds = sorted({*by})
    return stored(spark, sf_dir, f"prices-{'-'.join(kinds)}-{frequency}", lambda: returns.with_previous(item_prices(spark, sf_dir, kinds, frequency)))


def prices_of(spark: SparkSession, sf_dir: str, by: str, frequency: str = "week") -> DataFrame:
    return price_rows(spark, sf_dir, by, frequency=frequency).select("time", "series", "price")


def panel_rows(spark: SparkSession, sf_dir: str, factor: str = "flag", by: str = "type") -> DataFrame:
    return returns.panel_rows(price_rows(spark, sf_dir, by, factor), by, factor)


def panels(spark: SparkSession, sf_dir: str, factor: str = "flag", by: str = "type") -> tuple[DataFrame, DataFrame]:
    return returns.sides(panel_rows(spark, sf_dir, factor, by), by, factor)


def one_factor(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, None]:
    return returns.with_factors(panel_rows(spark, sf_dir), "type", "flag", ONE), None


def two_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, None]:
    return returns.with_factors(panel_rows(spark, sf_dir), "type", "flag", TWO), panels(spark, sf_dir)[1].filter(F.col("factor").isin(TWO)), None


def drawn_side(spark: SparkSession, sf_dir: str, side: str, block: int = BLOCK, history: bool = True, by: str = "type") -> DataFrame:
    """Assets (or the flags, with ``side`` "factor") along the bootstrap paths, and the history as path -1."""
    kind = by if side == "asset" else "flag"

    def make() -> DataFrame:
        rows = stored(spark, sf_dir, f"panel-{by}", lambda: panel_rows(spark, sf_dir, by=by))
        panel = rows.filter(F.col("by") == kind).select("time", "time_idx", F.col("series").alias(side), "ret")
        found = bootstrap.resample(panel, bootstrap.hashed_draws(rows, block, PATHS, SEED), block)
        return bootstrap.with_history(found, panel) if history else found

    return stored(spark, sf_dir, f"paths-{by}-{block}-{history}-{side}", make)


def drawn(spark: SparkSession, sf_dir: str, by: str = "type") -> tuple[DataFrame, DataFrame]:
    return tuple(drawn_side(spark, sf_dir, side, by=by) for side in ("asset", "factor"))


# Panels


@query
def panel_vwap(spark, sf_dir):
    return derived_prices(spark, sf_dir, "type")


@query
def panel_brand_month(spark, sf_dir):
    return derived_prices(spark, sf_dir, "brand", "month")


@query
def panel_region_day(spark, sf_dir):
    return derived_prices(spark, sf_dir, "region", "day")


@query
def log_returns(spark, sf_dir):
    return returns.log_returns(prices_of(spark, sf_dir, "type", "day")).select("time", "series", "ret")


@query
def complete_dates(spark, sf_dir):
    return returns.complete_dates(returns.log_returns(prices_of(spark, sf_dir, "brand", "week")))


@query
def aligned_returns(spark, sf_dir):
    a, f = panels(spark, sf_dir, "region")
    return a.withColumnRenamed("asset", "series").unionByName(f.withColumnRenamed("factor", "series"))


@query
def simple_returns(spark, sf_dir):
    a, _ = panels(spark, sf_dir)
    return a.select("time", "asset", F.expm1("ret").alias("simple"))


@query
def time_slice(spark, sf_dir):
    a, _ = panels(spark, sf_dir)
    return a.filter((F.col("time") >= F.lit("1996-01-01").cast("date")) & (F.col("time") <= F.lit("1996-12-31").cast("date"))).select("time", "asset", "ret")


@query
def wide_long_round_trip(spark, sf_dir):
    prices = derived_prices(spark, sf_dir, "flag")
    return from_wide(to_wide(prices, ["A", "N", "R"])).filter("price is not null")


@query
def stored_prices(spark, sf_dir):
    """Factor prices through a store: made and kept by the first call, read by the second."""
    store = Store(spark, f"{session_store(spark).folder}/stored-{uuid.uuid4().hex}")
    for _ in range(2):
        out = load_prices(spark, sf_dir, "flag", kind="factor", store=store)
    return out


@query
def loaded_slice(spark, sf_dir):
    """A span of time, read from the stored panel by pushed filters."""
    return load_prices(spark, sf_dir, "type", frequency="day", start="1995-01-01", end="1996-12-31", store=session_store(spark))


def _mock(spark, sf_dir, scale, seed, frequency):
    """Drawn returns of the part types on the days (or weeks) of the line items."""
    days = prices_of(spark, sf_dir, "type", frequency).select("time").distinct().filter("weekday(time) < 5")
    return drawn_returns(days, spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("series")).distinct(), scale, seed)


@query
def mock_asset_returns(spark, sf_dir):
    return _mock(spark, sf_dir, 0.01, 1, "day")


@query
def mock_factor_returns(spark, sf_dir):
    return _mock(spark, sf_dir, 0.008, 2, "week")


@query
def selected_series(spark, sf_dir):
    """Some named series; a missing name would fail."""
    return returns.select_series(panels(spark, sf_dir)[1], "factor", ["A", "R"]).select("time", "factor", "ret")


@query
def missing_series(spark, sf_dir):
    """Series of the parts that the weekly brand panel has no complete date for: a left anti join."""
    labels = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("series")).distinct()
    return labels.join(prices_of(spark, sf_dir, "brand").filter("time < date'1992-01-08'").select("series").distinct(), "series", "left_anti")


@query
def panel_checks(spark, sf_dir):
    return checks.panel_counts(panels(spark, sf_dir)[0], "asset")


@query
def business_windows(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("time")).distinct()
    return days.select("time", returns.business_day_before(F.col("time"), 251).alias("window_start"))


# Regression and risk


@query
def sample_ols_k1(spark, sf_dir):
    return regression.sample_ols(*one_factor(spark, sf_dir))[0]


@query
def sample_ols_fit(spark, sf_dir):
    return regression.sample_ols(*one_factor(spark, sf_dir))[1].select("time", "asset", "fitted", "residual")


@query
def sample_ols_k2(spark, sf_dir):
    a, _, wide = two_factors(spark, sf_dir)
    return regression.sample_ols(a, wide, 2)[0]


@query
def sample_ols_noint(spark, sf_dir):
    return regression.sample_ols(*one_factor(spark, sf_dir), intercept=False)[0]


@query
def rolling_ols_k1(spark, sf_dir):
    return regression.rolling_ols(*one_factor(spark, sf_dir), WINDOW).select("time", "asset", "alpha", "b1", "fitted", "residual")


@query
def rolling_ols_k2(spark, sf_dir):
    a, _, wide = two_factors(spark, sf_dir)
    return regression.rolling_ols(a, wide, WINDOW, 2).select("time", "asset", "alpha", "b1", "b2", "fitted", "residual")


@query
def rolling_ols_noint(spark, sf_dir):
    return regression.rolling_ols(*one_factor(spark, sf_dir), WINDOW, intercept=False).select("time", "asset", "b1", "fitted", "residual")


@query
def rolling_risk_k1(spark, sf_dir):
    model = regression.rolling_ols(*one_factor(spark, sf_dir), WINDOW)
    return risk.rolling_risk(model, WINDOW).select("time", "asset", "sys_var", "idio_var", "total_var", "sys_share")


def flagship(spark: SparkSession, sf_dir: str, window: int = 26) -> DataFrame:
    model = regression.rolling_ols(*one_factor(spark, sf_dir), window)
    return rounded(risk.rolling_risk(model, window).select("time", "asset", "sys_var", "idio_var", "total_var", "sys_share"))


@query
def rolling_share(spark, sf_dir):
    model = regression.rolling_ols(*one_factor(spark, sf_dir), WINDOW)
    shares = risk.rolling_risk(model, WINDOW).filter("sys_share is not null")
    return shares.groupBy("asset").agg(F.avg("sys_share").alias("mean_share"), F.min("sys_share").alias("least"), F.max("sys_share").alias("most"))


@query
def factor_cov(spark, sf_dir):
    return risk.factor_covariance(panels(spark, sf_dir)[1])


def _two_factor_model(spark, sf_dir):
    a, f, wide = two_factors(spark, sf_dir)
    coefficients, fits = regression.sample_ols(a, wide, 2)
    return {"coefficients": coefficients, "fits": fits, "betas": risk.long_betas(coefficients, TWO), "factors": f}


@query
def factor_contrib(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return risk.factor_contributions(m["betas"], risk.factor_covariance(m["factors"]))


@query
def sample_risk(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return risk.sample_risk(m["fits"], m["betas"], risk.factor_covariance(m["factors"]))


@query
def risk_stack(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return report.risk_stack(risk.sample_risk(m["fits"], m["betas"], risk.factor_covariance(m["factors"])), normalize=True)


@query
def variance_identity(spark, sf_dir):
    return checks.variance_identity(regression.sample_ols(*one_factor(spark, sf_dir))[1])


@query
def decomposition_identity(spark, sf_dir):
    return checks.decomposition_identity(regression.sample_ols(*one_factor(spark, sf_dir))[1])


def _any_factors(spark, sf_dir):
    both = (x.withColumn("path", F.lit(-1)) for x in panels(spark, sf_dir, "region"))
    return tuple(stored(spark, sf_dir, f"regions-{k}", lambda x=x: x) for k, x in enumerate(both))


def each_beta() -> list:
    return [F.round(F.col("betas")[k], 6).alias(f"b{k + 1}") for k in range(REGIONS)]


@query
def rolling_ols_multi(spark, sf_dir):
    """Five region factors, in the order of their names."""
    model = regression.rolling_ols_any(*_any_factors(spark, sf_dir), WINDOW)
    return model.select("time", "asset", F.round("alpha", 8).alias("alpha"), *each_beta(), F.round("fitted", 8).alias("fitted"), F.round("residual", 8).alias("residual"))


@query
def sample_ols_multi(spark, sf_dir):
    return regression.sample_ols_any(*_any_factors(spark, sf_dir))[0].select("asset", F.round("alpha", 8).alias("alpha"), *each_beta())


@query
def sample_ols_multi_fit(spark, sf_dir):
    fits = regression.sample_ols_any(*_any_factors(spark, sf_dir))[1]
    return fits.select("time", "asset", F.round("fitted", 8).alias("fitted"), F.round("residual", 8).alias("residual"))


def _risk_multi(spark, sf_dir):
    a, f = _any_factors(spark, sf_dir)
    return risk.rolling_risk_any(regression.rolling_ols_any(a, f, WINDOW), f, WINDOW)


def _rounded_risk(df, *keys):
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in ("sys_var", "idio_var", "total_var")], F.round("sys_share", 6).alias("sys_share"))


@query
def rolling_risk_multi(spark, sf_dir):
    return _rounded_risk(_risk_multi(spark, sf_dir), "time", "asset")


@query
def rolling_contributions_multi(spark, sf_dir):
    """The heat map of any number of factors."""
    return risk.contribution_rows(_risk_multi(spark, sf_dir)).select("time", "asset", "factor", F.round("contribution", 9).alias("contribution"))


def _sample_model(spark, sf_dir):
    a, f = _any_factors(spark, sf_dir)
    coefficients, fits = regression.sample_ols_any(a, f)
    return portfolio.factor_model(stored(spark, sf_dir, "five-coefficients", lambda: coefficients), stored(spark, sf_dir, "five-fits", lambda: fits), f)


@query
def sample_risk_multi(spark, sf_dir):
    m = _sample_model(spark, sf_dir)
    return _rounded_risk(risk.sample_risk(m["fits"], m["betas"], risk.factor_covariance(m["factors"])), "asset")


@query
def compute_mu_multi(spark, sf_dir):
    """Shrunk means of the five-factor model."""
    mu = portfolio.compute_mu(model=_sample_model(spark, sf_dir), method="factor_model", shrinkage=SHRINKAGE)
    return mu.select("asset", F.round("mu", 8).alias("mu"))


@query
def compute_cov_multi(spark, sf_dir):
    """Shrunk, stable covariances of the five-factor model."""
    cov = portfolio.compute_cov(model=_sample_model(spark, sf_dir), method="factor_model", shrinkage=SHRINKAGE)
    return cov.select("asset_i", "asset_j", F.round("cov", 9).alias("cov"))


@query
def rolling_ols_multi_k1(spark, sf_dir):
    """The general path on one factor, which SQL can check."""
    a, f = panels(spark, sf_dir)
    a, f = a.withColumn("path", F.lit(-1)), f.filter("factor = 'R'").withColumn("path", F.lit(-1))
    return regression.rolling_ols_any(a, f, WINDOW).select("time", "asset", "alpha", F.col("betas")[0].alias("b1"), "fitted", "residual")


# Moments


@query
def mean_hist(spark, sf_dir):
    return moments.mean_hist(panels(spark, sf_dir)[0])


@query
def mean_ewma(spark, sf_dir):
    return moments.mean_ewma(panels(spark, sf_dir)[0], HALFLIFE)


@query
def mean_shrink_grand(spark, sf_dir):
    return moments.shrink_mean(moments.mean_hist(panels(spark, sf_dir)[0]), SHRINKAGE)


@query
def mean_shrink_zero(spark, sf_dir):
    return moments.shrink_mean(moments.mean_hist(panels(spark, sf_dir)[0]), SHRINKAGE, "zero")


@query
def cov_hist(spark, sf_dir):
    return moments.cov_hist(panels(spark, sf_dir)[0])


@query
def cov_ewma(spark, sf_dir):
    return moments.cov_ewma(panels(spark, sf_dir)[0], HALFLIFE)


@query
def cov_shrink_diag(spark, sf_dir):
    return moments.shrink_cov(moments.cov_hist(panels(spark, sf_dir)[0]), SHRINKAGE)


@query
def cov_shrink_identity(spark, sf_dir):
    return moments.shrink_cov(moments.cov_hist(panels(spark, sf_dir)[0]), SHRINKAGE, "identity")


@query
def cov_stabilized(spark, sf_dir):
    return moments.stabilized(moments.shrink_cov(moments.cov_hist(panels(spark, sf_dir)[0]), SHRINKAGE))


@query
def mean_factor_model(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return moments.mean_factor_model(m["betas"], m["factors"], m["fits"], m["coefficients"])


@query
def cov_factor_model(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return moments.cov_factor_model(m["betas"], risk.factor_covariance(m["factors"]), m["fits"])


@query
def mean_factor_model_ewma(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return moments.mean_factor_model(m["betas"], m["factors"], m["fits"], m["coefficients"], HALFLIFE)


@query
def cov_factor_model_ewma(spark, sf_dir):
    m = _two_factor_model(spark, sf_dir)
    return moments.cov_factor_model(m["betas"], moments.factor_cov(m["factors"], HALFLIFE), m["fits"], HALFLIFE)


def _by_path(spark, sf_dir):
    return drawn_side(spark, sf_dir, "asset").drop("source_idx")


@query
def bootstrap_mean_ewma(spark, sf_dir):
    """Shrunk means of each path."""
    return portfolio.compute_mu(_by_path(spark, sf_dir), method="ewma", halflife=HALFLIFE, shrinkage=SHRINKAGE)


@query
def bootstrap_cov(spark, sf_dir):
    """Shrunk, stable covariances of each path."""
    return portfolio.compute_cov(_by_path(spark, sf_dir), method="hist", shrinkage=SHRINKAGE)


@query
def bootstrap_cov_ewma(spark, sf_dir):
    return moments.cov_ewma(_by_path(spark, sf_dir), HALFLIFE)


def _gappy(spark, sf_dir):
    """Daily brand returns with the days that a brand misses: each brand's own rows, positions by day."""
    rows = price_rows(spark, sf_dir, "brand", frequency="day")
    days = returns.calendar(rows)
    return rows.withColumn("ret", returns.log_return(F.col("price"), F.col("prev_price"))).join(days, "time").select("time_idx", F.col("series").alias("asset"), "ret")


@query
def gappy_mean_ewma(spark, sf_dir):
    """The recursion over series that miss days: what came before fades by the length of the gap."""
    return moments.mean_ewma(_gappy(spark, sf_dir), HALFLIFE)


@query
def gappy_cov_hist(spark, sf_dir):
    """Covariances of the days that both brands have."""
    return moments.cov_hist(_gappy(spark, sf_dir))


@query
def variance_ewma(spark, sf_dir):
    return moments.variance_of(panels(spark, sf_dir)[0], "asset", halflife=HALFLIFE).withColumnRenamed("v", "variance")


# Bootstrap


@query
def bootstrap_draws(spark, sf_dir):
    return bootstrap.hashed_draws(panels(spark, sf_dir)[0], BLOCK, PATHS, SEED)


@query
def bootstrap_paths(spark, sf_dir):
    return drawn_side(spark, sf_dir, "asset", history=False).select("path", "time", "asset", "ret", "source_idx")


@query
def bootstrap_factor_paths(spark, sf_dir):
    return drawn_side(spark, sf_dir, "factor", history=False).select("path", "time", "factor", "ret", "source_idx")


@query
def bootstrap_cumulative(spark, sf_dir):
    return report.cumulative_returns(drawn_side(spark, sf_dir, "asset")).select("path", "time", "asset", "cumulative")


@query
def bootstrap_moments(spark, sf_dir):
    return drawn_side(spark, sf_dir, "asset").groupBy("path", "asset").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))


@query
def path_counts(spark, sf_dir):
    return checks.path_counts(drawn_side(spark, sf_dir, "asset"), "asset")


@query
def path_lines(spark, sf_dir):
    return report.path_lines(drawn_side(spark, sf_dir, "factor"), "R", 5).select("path", "time", "factor", "cumulative")


@query
def bootstrap_rolling_ols(spark, sf_dir):
    a, f = drawn(spark, sf_dir)
    rows = regression.rolling_ols(a.drop("source_idx"), returns.wide_factors(f, ONE), WINDOW)
    return rows.select("path", "time", "asset", "alpha", "b1", "residual")


@query
def residual_bootstrap(spark, sf_dir):
    a, f = panels(spark, sf_dir)
    coefficients, fits = regression.sample_ols(a, returns.wide_factors(f, ONE))
    draws = bootstrap.hashed_draws(a, BLOCK, PATHS, SEED)
    betas = coefficients.select("asset", "alpha", F.col("b1").alias("beta"))
    return bootstrap.residual_paths(fits, f.filter("factor = 'R'"), betas, draws, BLOCK).select("path", "time", "asset", "ret")


# Portfolios


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Weights, or the columns ``names``, to six digits: the solver and SQL are both exact beyond that."""
    return _rounded_to(df, 6, *(names or ("weight",)))


def _stable(spark, sf_dir, by="type"):
    a = panels(spark, sf_dir, by=by)[0]
    return a, moments.stabilized(moments.shrink_cov(moments.cov_hist(a), SHRINKAGE))


def _pair(spark, sf_dir, problem, with_mu=True):
    """Weights of the two line statuses, whose problem SQL can solve."""
    a, cov = _stable(spark, sf_dir, "status")
    return portfolio.optimize_groups(cov, moments.mean_hist(a) if with_mu else None, problem).select("asset", F.round("weight", 4).alias("weight"))


@query
def minvar_two_asset(spark, sf_dir):
    return _pair(spark, sf_dir, portfolio.Problem(), with_mu=False)


@query
def mean_variance_two_asset(spark, sf_dir):
    return _pair(spark, sf_dir, portfolio.Problem("mean_variance", risk_aversion=2.0))


@query
def max_sharpe_two_asset(spark, sf_dir):
    return _pair(spark, sf_dir, portfolio.Problem("max_sharpe"))


@query
def long_short_two_asset(spark, sf_dir):
    return _pair(spark, sf_dir, portfolio.Problem("mean_variance", long_only=False, gross_budget=1.4, short_budget=0.2, min_weight=-0.2, max_weight=0.9))


@query
def optimizer_fit_two_asset(spark, sf_dir):
    optimizer = portfolio.PortfolioOptimizer(portfolio.MeanEstimator("ewma", HALFLIFE), portfolio.CovarianceEstimator("ewma", HALFLIFE, SHRINKAGE))
    return optimizer.fit(panels(spark, sf_dir, by="status")[0]).get_weights().select("asset", F.round("weight", 4).alias("weight"))


@query
def minvar_closed_form_3(spark, sf_dir):
    """Of the three return flags."""
    return portfolio.closed_form(_stable(spark, sf_dir, "flag")[1]).select("asset", F.round("weight", 8).alias("weight"))


@query
def minvar_closed_form(spark, sf_dir):
    """Of all part types."""
    return portfolio.closed_form(_stable(spark, sf_dir)[1]).select("asset", F.round("weight", 8).alias("weight"))


@query
def minvar_weights(spark, sf_dir):
    return _six(portfolio.optimize_groups(_stable(spark, sf_dir)[1], None, portfolio.Problem(), []).select("asset", "weight"))


@query
def mean_variance_weights(spark, sf_dir):
    a, cov = _stable(spark, sf_dir)
    return _six(portfolio.optimize_groups(cov, moments.mean_hist(a), portfolio.Problem("mean_variance", risk_aversion=2.0), []).select("asset", "weight"))


@query
def max_sharpe_weights(spark, sf_dir):
    a, cov = _stable(spark, sf_dir)
    return portfolio.optimize_groups(cov, moments.mean_hist(a), portfolio.Problem("max_sharpe", l2_reg=0.01), []).select("asset", "weight")


@query
def long_short_weights(spark, sf_dir):
    a, cov = _stable(spark, sf_dir)
    problem = portfolio.Problem("mean_variance", long_only=False, gross_budget=1.4, short_budget=0.2, min_weight=-0.2, max_weight=0.9)
    return portfolio.optimize_groups(cov, moments.mean_hist(a), problem, []).select("asset", "weight")


@query
def opt_diagnostics(spark, sf_dir):
    solved = portfolio.optimize_groups(_stable(spark, sf_dir)[1], None, portfolio.Problem(), [])
    return portfolio.diagnostics(solved, [])


@query
def optimizer_fit(spark, sf_dir):
    optimizer = portfolio.PortfolioOptimizer(portfolio.MeanEstimator("ewma", HALFLIFE), portfolio.CovarianceEstimator("ewma", HALFLIFE, SHRINKAGE))
    return _six(optimizer.fit(panels(spark, sf_dir)[0]).get_weights())


@query
def rebalance_dates(spark, sf_dir):
    times = panels(spark, sf_dir)[0].select("time", "time_idx").distinct()
    return returns.rebalance_dates(times, WINDOW, EVERY)


def _rebalances(times: DataFrame) -> DataFrame:
    at = returns.rebalance_dates(times, WINDOW, EVERY)
    return at.withColumn("window_start", F.date_sub("time", 7 * (WINDOW - 1)))


@query
def rebalance_slices(spark, sf_dir):
    a = panels(spark, sf_dir)[0]
    times = a.select("time", "time_idx").distinct()
    at = portfolio.slices(_rebalances(times))
    rows = a.join(at, "time")
    return rows.groupBy("at", "asset").agg(F.count("*").alias("n_rows"), F.avg("ret").alias("mean"), F.var_samp("ret").alias("var"))


def rolling(spark: SparkSession, sf_dir: str, by: str = "type", names: list[str] | None = None) -> DataFrame:
    """Weights and records at each rebalance of all paths and the history."""

    def make() -> DataFrame:
        a, f = drawn(spark, sf_dir, by=by)
        a, f = a.drop("source_idx"), f.drop("source_idx")
        f = f if names is None else f.filter(F.col("factor").isin(names))
        model = regression.rolling_ols_any(a, f, WINDOW)
        times = a.select("path", "time", "time_idx").distinct()
        return portfolio.rolling_weights(model, f, _rebalances(times), portfolio.Problem(), SHRINKAGE)

    return stored(spark, sf_dir, f"rolling-{by}-{'-'.join(names or ['all'])}", make)


@query
def rolling_weights(spark, sf_dir):
    return _six(rolling(spark, sf_dir).select("path", "time", "asset", "weight"))


def _improvement(records: DataFrame, *keys: str) -> DataFrame:
    """Of records, what the exact weights determine: the objective, and what it gains on equal weights."""
    return _six(records.select(*keys, "success", "constraint_violation", "obj_value", "obj_improvement"), "obj_value", "obj_improvement")


@query
def minvar_improvement(spark, sf_dir):
    solved = portfolio.optimize_groups(_stable(spark, sf_dir)[1], None, portfolio.Problem(), [])
    return _improvement(portfolio.diagnostics(solved, []))


@query
def rolling_improvement(spark, sf_dir):
    return _improvement(portfolio.diagnostics(rolling(spark, sf_dir), ["path", "time"]), "path", "time")


@query
def diagnostic_summary(spark, sf_dir):
    records = portfolio.diagnostics(rolling(spark, sf_dir), ["path", "time"])
    return report.diagnostic_summary(records)


@query
def weight_bands(spark, sf_dir):
    return _six(report.bands(rolling(spark, sf_dir), "weight", ["time", "asset"]), "p10", "median", "p90", "realized")


@query
def weight_std(spark, sf_dir):
    return _six(report.spread(rolling(spark, sf_dir), "weight", ["time", "asset"]), "std")


@query
def top6_assets(spark, sf_dir):
    return _six(report.top_assets(rolling(spark, sf_dir)), "mean_weight")


@query
def cumulative_portfolio(spark, sf_dir):
    a = drawn_side(spark, sf_dir, "asset")
    return _six(report.portfolio_cumulative(rolling(spark, sf_dir), a.drop("source_idx")), "cumulative")


def _rolling_pair(spark, sf_dir):
    """The same of the two line statuses and one factor, whose problems SQL can solve."""
    return rolling(spark, sf_dir, "status", ONE)


def _rounded_to(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def pair_rolling_weights(spark, sf_dir):
    return _rounded_to(_rolling_pair(spark, sf_dir).select("path", "time", "asset", "weight"), 4, "weight")


@query
def pair_diagnostic_summary(spark, sf_dir):
    summary = report.diagnostic_summary(portfolio.diagnostics(_rolling_pair(spark, sf_dir), ["path", "time"]))
    return _rounded_to(summary, 4, "median_cond_number", "max_cond_number", "median_obj_improvement", "max_multi_init_obj_diff")


@query
def pair_weight_bands(spark, sf_dir):
    return _rounded_to(report.bands(_rolling_pair(spark, sf_dir), "weight", ["time", "asset"]), 4, "p10", "median", "p90", "realized")


@query
def pair_weight_std(spark, sf_dir):
    return _rounded_to(report.spread(_rolling_pair(spark, sf_dir), "weight", ["time", "asset"]), 4, "std")


@query
def pair_top_assets(spark, sf_dir):
    return _rounded_to(report.top_assets(_rolling_pair(spark, sf_dir)), 4, "mean_weight")


@query
def pair_cumulative(spark, sf_dir):
    a = drawn_side(spark, sf_dir, "asset", by="status")
    out = report.portfolio_cumulative(_rolling_pair(spark, sf_dir), a.drop("source_idx")).select("path", "time", "cumulative")
    return _rounded_to(out, 2, "cumulative")


@query
def pair_weights_through_time(spark, sf_dir):
    """What an area chart of the history's weights shows."""
    history = _rolling_pair(spark, sf_dir).filter("path = -1").drop("path")
    return _rounded_to(report.weights_through_time(history.withColumn("weight", F.greatest("weight", F.lit(0.0))), kind="area"), 4, "weight")


def _sample_pair(spark, sf_dir):
    a, f = drawn(spark, sf_dir, by="status")
    return portfolio.sample_weights(a.drop("source_idx"), f.drop("source_idx").filter(F.col("factor").isin(ONE)), portfolio.Problem(), SHRINKAGE)


@query
def pair_sample_weights(spark, sf_dir):
    """One problem for each path, on its whole sample."""
    return _rounded_to(_sample_pair(spark, sf_dir).select("path", "asset", "weight"), 4, "weight")


@query
def pair_weight_boxes(spark, sf_dir):
    return _rounded_to(report.weight_boxes(_sample_pair(spark, sf_dir)), 4, "least", "q1", "median", "q3", "most", "realized")


@query
def sample_weights(spark, sf_dir):
    a, f = drawn(spark, sf_dir)
    return _six(portfolio.sample_weights(a.drop("source_idx"), f.drop("source_idx"), portfolio.Problem(), SHRINKAGE).select("path", "asset", "weight"))


def _equal(spark, sf_dir):
    a = drawn_side(spark, sf_dir, "asset")
    a = a.drop("source_idx")
    times = panels(spark, sf_dir)[0].select("time", "time_idx").distinct()
    return report.portfolio_cumulative(report.equal_weights(a, returns.rebalance_dates(times, WINDOW, EVERY)), a)


@query
def equal_weight_cumulative(spark, sf_dir):
    return _equal(spark, sf_dir).select("path", "time", "cumulative")


@query
def cumulative_bands(spark, sf_dir):
    return report.bands(_equal(spark, sf_dir), "cumulative", ["time"])


@query
def return_quantiles(spark, sf_dir):
    """Exact quantiles of each asset's returns along all paths, by selection."""
    cuts = {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "most": 1.0}
    return scans.quantiles(drawn_side(spark, sf_dir, "asset", history=False), ["asset"], "ret", cuts, few=256, bins=64)


@query
def many_path_bands(spark, sf_dir):
    """``cumulative_bands`` by selection."""
    paths = stored(spark, sf_dir, "equal-paths", lambda: _equal(spark, sf_dir))
    return report.many_path_bands(paths, "cumulative", ["time"])


@query
def terminal_stats(spark, sf_dir):
    return report.terminal_stats(_equal(spark, sf_dir))


@query
def sharpe_table(spark, sf_dir):
    return report.sharpe(drawn_side(spark, sf_dir, "asset"))


@query
def factor_heatmap(spark, sf_dir):
    """Factor contributions by week of the rolling two-factor model: beta_k (Sigma beta)_k."""
    a, _, wide = two_factors(spark, sf_dir)
    over = W.partitionBy("asset").orderBy("time_idx").rowsBetween(-(WINDOW - 1), 0)
    full = F.count("f1").over(over) == WINDOW
    rows = regression.rolling_ols(a, wide, WINDOW, 2).withColumns({"v1": F.when(full, F.var_samp("f1").over(over)), "v2": F.when(full, F.var_samp("f2").over(over)), "c": F.when(full, F.covar_samp("f1", "f2").over(over))})
    return rows.filter("b1 is not null").select("time", "asset", (F.col("b1") * (F.col("v1") * F.col("b1") + F.col("c") * F.col("b2"))).alias("c_R"), (F.col("b2") * (F.col("c") * F.col("b1") + F.col("v2") * F.col("b2"))).alias("c_A"))


@query
def event_daily_mean(spark, sf_dir):
    """What the streaming job of ``streaming.events`` gives once all events are in."""
    return derived_prices(spark, sf_dir, "event", "day")


@query
def risk_lines(spark, sf_dir):
    """Shares of systematic and own variance of one asset by week."""
    model = regression.rolling_ols(*one_factor(spark, sf_dir), WINDOW)
    one = model.join(model.agg(F.min("asset").alias("asset")), "asset")
    whole = F.col("sys_var") + F.col("idio_var")
    return risk.rolling_risk(one, WINDOW).select("time", "asset", F.try_divide("sys_var", whole).alias("sys"), F.try_divide("idio_var", whole).alias("idio"))


@query
def noisy_returns(spark, sf_dir):
    return perturb.noisy(panels(spark, sf_dir)[0], 0.001, SEED).select("time", "asset", "ret")


@query
def volatility_regime(spark, sf_dir):
    return perturb.volatility_regime(panels(spark, sf_dir)[0], 2.0, "1995-01-01", "1995-12-31").select("time", "asset", "ret")


@query
def reindexed_means(spark, sf_dir):
    """Mean returns for every brand that the parts have, 0 where the panel lacks it."""
    means = returns.complete_dates(returns.log_returns(prices_of(spark, sf_dir, "brand", "month"))).groupBy("series").agg(F.avg("ret").alias("mean"))
    labels = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("series"))
    return returns.reindex(means, labels, "series", 0.0)
