"""From prices to aligned panels of log returns. Missing is NULL throughout, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar(times: DataFrame) -> DataFrame:
    """The distinct times, with time_idx from 0: only they pass through one window."""
    return times.select("time").distinct().select("time", (F.row_number().over(W.orderBy("time")) - 1).alias("time_idx"))


def dense(prices: DataFrame) -> DataFrame:
    """Every series at every time that any series has; absent prices are NULL. Each series counts
    through the calendar, which is joined by position. Reads ``prices`` three times: give it stored."""
    times = calendar(prices.filter("time is not null"))
    last = times.agg(F.max("time_idx").alias("_last"))  # one row
    names = prices.filter("series is not null").select("series").distinct()
    grid = names.crossJoin(last).select("series", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("time_idx")).join(times, "time_idx")
    return grid.select("time", "series").join(prices, ["time", "series"], "left")


def log_return(price: Column, before: Column) -> Column:
    """ln(price / price before); NULL unless both are positive."""
    return F.ln(F.when((price > 0) & (before > 0), price / before))


def log_returns(prices: DataFrame) -> DataFrame:
    """The return over the row before at every time of the panel, by series (see ``dense``)."""
    before = F.lag("price").over(W.partitionBy("series").orderBy("time"))
    return dense(prices).select("time", "series", "price", log_return(F.col("price"), before).alias("ret"))


def complete_dates(returns: DataFrame) -> DataFrame:
    """Times at which every series has a return."""
    n = returns.select(F.countDistinct("series").alias("_n"))  # one row
    counted = returns.withColumn("_c", F.count("ret").over(W.partitionBy("time"))).crossJoin(n)
    return counted.filter(F.col("_c") == F.col("_n")).select("time", "series", "ret")


def with_previous(prices: DataFrame) -> DataFrame:
    """``prices`` (by, time, series, price) with each row's previous time and price of its series,
    rows of a series together and in order of time. What panels are built from, small beside its source."""
    own = W.partitionBy("by", "series").orderBy("time")
    return prices.select("by", "time", "series", "price", F.lag("time").over(own).alias("prev_time"), F.lag("price").over(own).alias("prev_price"))


def panel_rows(rows: DataFrame, assets: str, factors: str) -> DataFrame:
    """by, time, time_idx, series, ret of the times at which every series of both kinds has a return.

    ``rows`` is that of ``with_previous``, stored (it is read three times, its source not at all); ``assets`` and
    ``factors`` name its kinds. No grid is made: a time at which all N series of a kind have a row, and
    all the same time before it, has no gap in any of them. A series' first row has no time before,
    so those rows count the series. Both kinds of a time meet in one window, which aligns them.
    """
    kinds = sorted({assets, factors})
    rows = rows.filter(F.col("by").isin(kinds))
    sizes = rows.filter("prev_time is null").groupBy("by").agg(F.count("*").alias("_n"))  # a row for each kind
    over, whole = W.partitionBy("time"), F.lit(True)
    for k in kinds:
        own = lambda c: F.when(F.col("by") == k, c)  # noqa: B023, E731
        n = F.max(own(F.col("_n"))).over(over)
        whole &= (F.count(own(F.col("ret"))).over(over) == n) & (F.min(own(F.col("prev_time"))).over(over) == F.max(own(F.col("prev_time"))).over(over))
    each = rows.withColumn("ret", log_return(F.col("price"), F.col("prev_price"))).join(F.broadcast(sizes), "by")
    full = each.withColumn("_whole", whole).filter("_whole").select("by", "time", "series", "ret")
    return full.join(calendar(full), "time").select("by", "time", "time_idx", "series", "ret")


def sides(rows: DataFrame, assets: str, factors: str) -> tuple[DataFrame, DataFrame]:
    """The assets' and the factors' rows of ``panel_rows``, their series called asset and factor."""
    return tuple(rows.filter(F.col("by") == k).select("time", "time_idx", F.col("series").alias(name), "ret") for k, name in ((assets, "asset"), (factors, "factor")))


def with_factors(rows: DataFrame, assets: str, factors: str, names: Sequence[str]) -> DataFrame:
    """The assets' rows of ``panel_rows`` with the named factors of their time as f1, f2, ...; no join."""
    over = W.partitionBy("time")
    wide = {f"f{i}": F.max(F.when((F.col("by") == factors) & (F.col("series") == n), F.col("ret"))).over(over) for i, n in enumerate(names, 1)}
    return rows.withColumns(wide).filter(F.col("by") == assets).select("time", "time_idx", F.col("series").alias("asset"), "ret", *wide)


def panel(asset_prices: DataFrame, factor_prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and factors of any two price panels (time, series, price) on their common complete times."""
    both = [p.select(F.lit(k).alias("by"), "time", "series", "price") for p, k in ((asset_prices, "asset"), (factor_prices, "factor"))]
    rows = with_previous(both[0].unionByName(both[1]).filter("time is not null and series is not null"))
    return sides(panel_rows(rows, "asset", "factor"), "asset", "factor")


def business_day_before(day: Column, n: int) -> Column:
    """The n-th Monday-to-Friday day strictly before ``day``, holidays not minded; the day itself
    for n = 0."""
    if n == 0:
        return day
    monday = F.lit("1970-01-05").cast("date")
    since = F.datediff(day, monday)
    week = F.floor(since / 7)
    index = week * 5 + F.least(since - week * 7, F.lit(5)) - n
    return F.date_add(monday, (F.floor(index / 5) * 7 + F.pmod(index, F.lit(5))).cast("int"))


def rebalance_dates(times: DataFrame, window: int, every: int) -> DataFrame:
    """``times`` (time, time_idx) from the first full window on, each ``every`` rows."""
    return times.filter((F.col("time_idx") >= window - 1) & ((F.col("time_idx") - (window - 1)) % every == 0))


def wide_factors(factors: DataFrame, names: list[str]) -> DataFrame:
    """One column f1, f2, ... for each named factor, by path (if any) and time."""
    keys = [c for c in ("path", "time", "time_idx") if c in factors.columns]
    return factors.groupBy(*keys).agg(*[F.max(F.when(F.col("factor") == n, F.col("ret"))).alias(f"f{k}") for k, n in enumerate(names, 1)])


def select_series(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """The named series; ValueError if one is missing."""
    found = {r[0] for r in df.filter(F.col(label).isin(names)).select(label).distinct().collect()}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"missing: {missing}")
    return df.filter(F.col(label).isin(names))


def reindex(df: DataFrame, labels: DataFrame, label: str, fill: float | None = None) -> DataFrame:
    """One row for each of ``labels``; what ``df`` lacks is NULL, or ``fill`` in numbers."""
    out = labels.select(label).distinct().join(df, label, "left")
    return out if fill is None else out.fillna(fill)
