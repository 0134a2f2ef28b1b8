"""Means and covariances of returns (time_idx, asset, ret), and what is done to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crossproducts import both_orders, covariances, ew_covariances, ew_moments


def _keys(df: DataFrame, *names: str) -> list[str]:
    return [c for c in ("path", *names) if c in df.columns]


def mean_of(rows: DataFrame, label: str, value: str = "ret", halflife: float | None = None) -> DataFrame:
    """(path,) ``label``, m: the mean, exponentially weighted if ``halflife`` is given."""
    keys = _keys(rows, label)
    if halflife is None:
        return rows.groupBy(*keys).agg(F.avg(value).alias("m"))
    return ew_moments(rows, keys, {"m": F.col(value)}, halflife).drop("w2")


def variance_of(rows: DataFrame, label: str, value: str = "ret", halflife: float | None = None) -> DataFrame:
    """(path,) ``label``, v: the variance, exponentially weighted if ``halflife`` is given."""
    keys, x = _keys(rows, label), F.col(value)
    if halflife is None:
        return rows.groupBy(*keys).agg(F.var_samp(value).alias("v"))
    found = ew_moments(rows, keys, {"m": x, "xx": x * x}, halflife)
    return found.select(*keys, F.when(F.col("w2") < 1 - 1e-12, (F.col("xx") - F.col("m") * F.col("m")) / (1 - F.col("w2"))).alias("v"))


def factor_cov(factors: DataFrame, halflife: float | None = None) -> DataFrame:
    """(path,) factor, factor_p, cov, exponentially weighted if ``halflife`` is given."""
    keys = _keys(factors)
    half = covariances(factors, "factor", keys) if halflife is None else ew_covariances(factors, "factor", halflife, keys)
    return both_orders(half, keys, "factor", "factor_p")


def mean_hist(returns: DataFrame) -> DataFrame:
    """(path,) asset, mu: the mean of what is there."""
    return mean_of(returns, "asset").withColumnRenamed("m", "mu")


def mean_ewma(returns: DataFrame, halflife: float) -> DataFrame:
    """(path,) asset, mu: the last value of the recursion that starts at the first value of each series; a gap
    lets what came before fade by its length."""
    return mean_of(returns, "asset", halflife=halflife).withColumnRenamed("m", "mu")


def cov_hist(returns: DataFrame) -> DataFrame:
    """(path,) asset_i, asset_j, cov (n - 1), of the dates that both have."""
    keys = _keys(returns)
    return both_orders(covariances(returns, "asset", keys), keys, "asset_i", "asset_j")


def cov_ewma(returns: DataFrame, halflife: float) -> DataFrame:
    """(path,) asset_i, asset_j, cov of the recursion over the dates that both have, unbiased."""
    keys = _keys(returns)
    return both_orders(ew_covariances(returns, "asset", halflife, keys), keys, "asset_i", "asset_j")


def _checked(shrinkage: float, target: str, targets: tuple[str, ...]) -> None:
    if not 0 <= shrinkage <= 1:
        raise ValueError("shrinkage must lie in [0, 1]")
    if target not in targets:
        raise ValueError(f"target must be one of {targets}")


def shrink_mean(mu: DataFrame, shrinkage: float, target: str = "grand_mean") -> DataFrame:
    _checked(shrinkage, target, ("zero", "grand_mean"))
    keys = _keys(mu)
    if target == "zero":
        return mu.select(*keys, "asset", ((1 - shrinkage) * F.col("mu")).alias("mu"))
    mean = mu.groupBy(*keys).agg(F.avg("mu").alias("_mean"))
    both = mu.join(mean, keys) if keys else mu.crossJoin(mean)  # one row
    return both.select(*keys, "asset", ((1 - shrinkage) * F.col("mu") + shrinkage * F.col("_mean")).alias("mu"))


def shrink_cov(cov: DataFrame, shrinkage: float, target: str = "diagonal") -> DataFrame:
    _checked(shrinkage, target, ("diagonal", "identity"))
    own, keys = F.col("asset_i") == F.col("asset_j"), _keys(cov)
    if target == "diagonal":
        to = F.when(own, F.col("cov")).otherwise(0.0)
    else:
        mean = cov.filter(own).groupBy(*keys).agg(F.avg("cov").alias("_mean"))
        cov = cov.join(mean, keys) if keys else cov.crossJoin(mean)  # one row
        to = F.when(own, F.col("_mean")).otherwise(0.0)
    return cov.select(*keys, "asset_i", "asset_j", ((1 - shrinkage) * F.col("cov") + shrinkage * to).alias("cov"))


def stabilized(cov: DataFrame, ridge: float = 1e-8) -> DataFrame:
    """Symmetric, with the ridge on the diagonal; pairs that stand in one order only are left out."""
    keys, half = _keys(cov), F.col("cov") * 0.5
    sides = F.array(*[F.struct(F.col(i).alias("asset_i"), F.col(j).alias("asset_j"), half.alias("half")) for i, j in (("asset_i", "asset_j"), ("asset_j", "asset_i"))])
    each = cov.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    both = each.groupBy(*keys, "asset_i", "asset_j").agg(F.sum("half").alias("cov"), F.count("*").alias("n")).filter("n = 2")
    return both.select(*keys, "asset_i", "asset_j", (F.col("cov") + F.when(F.col("asset_i") == F.col("asset_j"), ridge).otherwise(0.0)).alias("cov"))


def mean_factor_model(betas: DataFrame, factors: DataFrame, fits: DataFrame, coefficients: DataFrame, halflife: float | None = None) -> DataFrame:
    """B mean(f) + mean(residual) + alpha, by path if there is one; missing residual means and alphas
    are 0. ``betas`` is long (``risk.long_betas``, ``risk.array_betas``)."""
    keys = _keys(betas)
    f = mean_of(factors, "factor", halflife=halflife)
    systematic = betas.join(f, [*keys, "factor"]).groupBy(*keys, "asset").agg(F.sum(F.col("beta") * F.col("m")).alias("s"))
    rest = mean_of(fits, "asset", "residual", halflife).withColumnRenamed("m", "e")
    on = [*keys, "asset"]
    rows = systematic.join(rest, on, "left").join(coefficients.select(*on, "alpha"), on, "left")
    return rows.select(*on, (F.col("s") + F.coalesce("e", F.lit(0.0)) + F.coalesce("alpha", F.lit(0.0))).alias("mu"))


def cov_factor_model(betas: DataFrame, covariance: DataFrame, fits: DataFrame, halflife: float | None = None) -> DataFrame:
    """B Sigma B' + diag(var(residual)), by path if there is one; a missing residual variance is 0."""
    keys = _keys(betas)
    i = betas.select(*keys, F.col("asset").alias("asset_i"), "factor", F.col("beta").alias("bi"))
    j = betas.select(*keys, F.col("asset").alias("asset_j"), F.col("factor").alias("factor_p"), F.col("beta").alias("bj"))
    half = i.join(covariance, [*keys, "factor"]).groupBy(*keys, "asset_i", "factor_p").agg(F.sum(F.col("bi") * F.col("cov")).alias("bs"))
    systematic = half.join(j, [*keys, "factor_p"]).groupBy(*keys, "asset_i", "asset_j").agg(F.sum(F.col("bs") * F.col("bj")).alias("s"))
    own = variance_of(fits, "asset", "residual", halflife).select(*keys, F.col("asset").alias("asset_i"), F.col("asset").alias("asset_j"), F.col("v").alias("d"))
    rows = systematic.join(own, [*keys, "asset_i", "asset_j"], "left")
    return rows.select(*keys, "asset_i", "asset_j", (F.col("s") + F.coalesce("d", F.lit(0.0))).alias("cov"))
