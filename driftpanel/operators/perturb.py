"""Other ways to disturb a history: noise, and a period of other volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def noisy(returns: DataFrame, scale: float, seed: int, label: str = "asset") -> DataFrame:
    """Each return with uniform noise in [-scale, scale), from an MD5 of its place and the seed, so
    that any engine and any partition adds the same."""
    text = F.concat(F.col(label), F.lit("-"), F.col("time_idx").cast("string"), F.lit(f"-{seed}"))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return returns.withColumn("ret", F.col("ret") + (share * 2 - 1) * scale)


def volatility_regime(returns: DataFrame, factor: float, start: str, end: str, label: str = "asset") -> DataFrame:
    """Returns from ``start`` to ``end`` spread about each series' mean by ``factor``."""
    mean = returns.groupBy(label).agg(F.avg("ret").alias("_mean"))
    inside = (F.col("time") >= F.lit(start).cast("date")) & (F.col("time") <= F.lit(end).cast("date"))
    spread = F.col("_mean") + factor * (F.col("ret") - F.col("_mean"))
    return returns.join(mean, label).withColumn("ret", F.when(inside, spread).otherwise(F.col("ret"))).drop("_mean")
