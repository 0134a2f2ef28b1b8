"""Variance decomposition into factors and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .crossproducts import both_orders, covariances
from .runs import chunk_of, in_runs, own_rows


def _shares(df: DataFrame) -> DataFrame:
    total = F.col("sys_var") + F.col("idio_var")
    return df.withColumn("total_var", total).withColumn("sys_share", F.when(F.col("total_var") > 0, F.col("sys_var") / F.col("total_var")))


def rolling_risk(model: DataFrame, window: int) -> DataFrame:
    """Of a one-factor rolling model: sys_var from the first full window, idio_var (and what builds
    on it) once a window holds only full residuals."""
    keys, chunk = [c for c in ("path", "asset") if c in model.columns], chunk_of(window)
    over = W.partitionBy(*keys, "run").orderBy("time_idx").rangeBetween(-(window - 1), 0)
    sys = F.when(F.count("f1").over(over) == window, F.col("b1") * F.col("b1") * F.var_samp("f1").over(over))
    idio = F.when(F.count("residual").over(over) == window, F.var_samp("residual").over(over))
    return _shares(own_rows(in_runs(model, window, chunk).withColumns({"sys_var": sys, "idio_var": idio}), chunk))


def rolling_covariance(factors: DataFrame, window: int) -> DataFrame:
    """path, time_idx, sigma: the covariances of all factor pairs in the trailing window, as an array
    in the order of (factor, factor_p); from the first full window on."""
    chunk = chunk_of(window)
    x = factors.select("path", "time_idx", "factor", F.col("ret").alias("x"))
    y = factors.select("path", "time_idx", F.col("factor").alias("factor_p"), F.col("ret").alias("y"))
    over = W.partitionBy("path", "run", "factor", "factor_p").orderBy("time_idx").rangeBetween(-(window - 1), 0)
    pairs = in_runs(x.join(y, ["path", "time_idx"]), window, chunk).withColumns({"n": F.count("x").over(over), "cov": F.covar_samp("x", "y").over(over)})
    full = own_rows(pairs, chunk).filter(F.col("n") == window)
    return full.groupBy("path", "time_idx").agg(F.sort_array(F.collect_list(F.struct("factor", "factor_p", "cov"))).alias("s")).select("path", "time_idx", F.col("s.cov").alias("sigma"))


def _contributions(betas: str = "betas", sigma: str = "sigma"):
    """beta_k (Sigma beta)_k of arrays; sigma is square, row after row."""
    k = F.size(betas)
    row = lambda i: F.aggregate(F.zip_with(F.slice(sigma, i * k + 1, k), betas, lambda c, b: c * b), F.lit(0.0), lambda a, x: a + x)
    return F.transform(betas, lambda b, i: b * row(i))


def _total(values) -> object:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rolling_risk_any(model: DataFrame, factors: DataFrame, window: int) -> DataFrame:
    """The same of a model of ``rolling_ols_any`` with any number of factors: path, time, time_idx,
    asset, factors, contributions (array), sys_var, idio_var, total_var, sys_share."""
    chunk = chunk_of(window)
    over = W.partitionBy("path", "asset", "run").orderBy("time_idx").rangeBetween(-(window - 1), 0)
    idio = F.when(F.count("residual").over(over) == window, F.var_samp("residual").over(over))
    rows = own_rows(in_runs(model, window, chunk).withColumn("idio_var", idio), chunk)
    rows = rows.join(rolling_covariance(factors, window), ["path", "time_idx"]).withColumn("contributions", _contributions())
    return _shares(rows.withColumn("sys_var", _total("contributions"))).select("path", "time", "time_idx", "asset", "factors", "contributions", "sys_var", "idio_var", "total_var", "sys_share")


def contribution_rows(risk: DataFrame) -> DataFrame:
    """One row for each factor of ``rolling_risk_any``: what a heat map of them shows."""
    return risk.select("path", "time", "asset", F.explode(F.arrays_zip(F.col("factors").alias("factor"), F.col("contributions").alias("contribution"))).alias("c")).select("path", "time", "asset", "c.factor", "c.contribution")


def factor_covariance(factors: DataFrame) -> DataFrame:
    """factor, factor_p, cov over all rows (and by path if there is one)."""
    keys = [c for c in ("path",) if c in factors.columns]
    return both_orders(covariances(factors, "factor", keys), keys, "factor", "factor_p")


def long_betas(coefficients: DataFrame, names: list[str]) -> DataFrame:
    """asset, factor, beta of coefficients b1, b2, ..."""
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"b{k}").alias("beta")) for k, n in enumerate(names, 1)])
    keys = [c for c in ("path", "asset") if c in coefficients.columns]
    return coefficients.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.factor", "p.beta")


def array_betas(coefficients: DataFrame) -> DataFrame:
    """The same of coefficients with arrays ``factors`` and ``betas``."""
    keys = [c for c in ("path", "asset") if c in coefficients.columns]
    return coefficients.select(*keys, F.explode(F.arrays_zip(F.col("factors").alias("factor"), F.col("betas").alias("beta"))).alias("p")).select(*keys, "p.factor", "p.beta")


def factor_contributions(betas: DataFrame, covariance: DataFrame) -> DataFrame:
    """(path,) asset, factor, contribution: beta_k (Sigma beta)_k; they add up to the systematic
    variance."""
    keys = [c for c in ("path",) if c in betas.columns]
    other = betas.select(*keys, "asset", F.col("factor").alias("factor_p"), F.col("beta").alias("beta_p"))
    cross = covariance.join(other, [*keys, "factor_p"]).groupBy(*keys, "asset", "factor").agg(F.sum(F.col("cov") * F.col("beta_p")).alias("sb"))
    return betas.join(cross, [*keys, "asset", "factor"]).select(*keys, "asset", "factor", (F.col("beta") * F.col("sb")).alias("contribution"))


def sample_risk(fits: DataFrame, betas: DataFrame, covariance: DataFrame) -> DataFrame:
    """(path,) asset, sys_var, idio_var, total_var, sys_share over the whole sample; a missing beta
    fails."""
    keys = [c for c in ("path", "asset") if c in betas.columns]
    known = betas.withColumn("beta", F.when(F.col("beta").isNotNull(), F.col("beta")).otherwise(F.raise_error(F.lit("a beta is missing")).cast("double")))
    sys = factor_contributions(known, covariance).groupBy(*keys).agg(F.sum("contribution").alias("sys_var"))
    idio = fits.groupBy(*keys).agg(F.var_samp("residual").alias("idio_var"))
    return _shares(sys.join(idio, keys))
