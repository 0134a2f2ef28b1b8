"""Checks of panels and models; failures raise ValueError."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_panel(df: DataFrame, label: str) -> None:
    """time, ``label`` and ret must be there, with at least one row."""
    check_columns(df, label, "time")
    if df.limit(1).count() == 0:
        raise ValueError("the panel is empty")


def check_columns(df: DataFrame, label: str, *more: str) -> None:
    if missing := {label, "ret", *more} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")


def check_rows(df: DataFrame, label: str) -> None:
    """What an estimator needs of returns: ``label``, ret and time_idx, with at least one row."""
    check_columns(df, label, "time_idx")
    if df.isEmpty():
        raise ValueError("there are no returns")


def check_model(model: dict[str, DataFrame] | None) -> None:
    """What an estimator needs of a factor model: its four frames, and dates that fits and factors share."""
    if missing := {"coefficients", "betas", "fits", "factors"} - set(model or {}):
        raise ValueError(f"the model lacks {sorted(missing)}")
    check_columns(model["factors"], "factor", "time_idx")
    on = [c for c in ("path", "time_idx") if c in model["fits"].columns and c in model["factors"].columns]
    if not on or model["fits"].join(model["factors"], on, "left_semi").isEmpty():
        raise ValueError("the model's fits and factors share no date")


def panel_counts(df: DataFrame, label: str) -> DataFrame:
    """By label: rows, distinct times, and steps back in time by time_idx (0 in a sound panel)."""
    back = F.lag("time").over(W.partitionBy(label).orderBy("time_idx")) > F.col("time")
    return df.withColumn("back", back.cast("int")).groupBy(label).agg(F.count("*").alias("n_rows"), F.countDistinct("time").alias("n_times"), F.coalesce(F.sum("back"), F.lit(0)).alias("n_back"))


def path_counts(paths: DataFrame, label: str) -> DataFrame:
    return paths.groupBy("path").agg(F.count("*").alias("n_rows"), F.countDistinct("time_idx").alias("n_times"), F.countDistinct(label).alias("n_series"))


def variance_identity(fits: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """By asset: |var(ret) - var(fitted) - var(residual)| / var(ret), and whether it is below."""
    v = fits.groupBy("asset").agg(F.var_samp("ret").alias("r"), F.var_samp("fitted").alias("f"), F.var_samp("residual").alias("e"))
    error = F.try_divide(F.abs(F.col("r") - (F.col("f") + F.col("e"))), F.col("r"))
    return v.select("asset", error.alias("error"), (error < tolerance).alias("ok"))


def decomposition_identity(fits: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Largest |ret - fitted - residual| and |fitted - (alpha + sum of beta_k f_k)| by asset, of as
    many columns b1, f1, ... as there are; 0 if none."""
    k = sum(c.startswith("b") and c[1:].isdigit() for c in fits.columns)
    model = sum((F.col(f"b{i}") * F.col(f"f{i}") for i in range(1, k + 1)), F.col("alpha"))
    one = F.coalesce(F.max(F.abs(F.col("ret") - F.col("fitted") - F.col("residual"))), F.lit(0.0))
    two = F.coalesce(F.max(F.abs(F.col("fitted") - model)), F.lit(0.0))
    return fits.groupBy("asset").agg(one.alias("reconstruction"), two.alias("fit")).select("asset", (F.col("reconstruction") < tolerance).alias("reconstruction_ok"), (F.col("fit") < tolerance).alias("fit_ok"))


def finite(cov: DataFrame, value: str = "cov") -> DataFrame:
    """``cov``, checked: a missing or infinite value fails when it is met."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return cov.withColumn(value, F.when(~bad, x).otherwise(F.raise_error(F.lit(f"{value} is not finite")).cast("double")))


def missing_labels(df: DataFrame, label: str, names: list[str]) -> list[str]:
    """Those of ``names`` (a short list of the caller's) that the panel lacks."""
    found = {r[0] for r in df.filter(F.col(label).isin(names)).select(label).distinct().collect()}
    return [n for n in names if n not in found]
