"""What is read off the paths: dispersion, cumulative returns, and the data behind each figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.returns import select_series
from ..operators.scans import prefix, quantiles
from ..sources.cache import kept


def bands(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Exact p10, median and p90 across paths (history, path -1, apart), and the history's value."""
    drawn = F.when(F.col("path") >= 0, F.col(value))
    return df.groupBy(*keys).agg(F.percentile(drawn, 0.1).alias("p10"), F.percentile(drawn, 0.5).alias("median"), F.percentile(drawn, 0.9).alias("p90"), F.max(F.when(F.col("path") < 0, F.col(value))).alias("realized"))


def many_path_bands(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The same by selection, for so many paths that no task should hold a group's values: ``df`` stored."""
    drawn = F.when(F.col("path") >= 0, F.col(value))
    found = quantiles(df.select(*keys, drawn.alias("_v")), keys, "_v", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    realized = df.groupBy(*keys).agg(F.max(F.when(F.col("path") < 0, F.col(value))).alias("realized"))
    return found.join(realized, keys)


def spread(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Standard deviation across paths."""
    return df.filter("path >= 0").groupBy(*keys).agg(F.stddev_samp(value).alias("std"))


def weights_through_time(weights: DataFrame, assets: list[str] | None = None, kind: str = "line") -> DataFrame:
    """time, asset, weight (by path if there is one) of the named assets; all of them must be there.
    An area cannot show negative weights: with one below -1e-12 it fails when it is met."""
    if kind not in ("line", "area"):
        raise ValueError("kind must be 'line' or 'area'")
    rows = weights if assets is None else select_series(weights, "asset", assets)
    shown = F.when(F.col("weight").isNull() | (F.col("weight") >= -1e-12), F.col("weight")).otherwise(F.raise_error(F.lit("an area needs weights of at least 0")).cast("double"))
    return rows.select(*[c for c in ("path",) if c in rows.columns], "time", "asset", (shown if kind == "area" else F.col("weight")).alias("weight"))


def weight_boxes(weights: DataFrame) -> DataFrame:
    """By asset the least, quartiles and largest of the paths' weights, and the history's."""
    drawn = F.when(F.col("path") >= 0, F.col("weight"))
    cuts = [F.percentile(drawn, p).alias(name) for p, name in ((0.0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "most"))]
    return weights.groupBy("asset").agg(*cuts, F.max(F.when(F.col("path") < 0, F.col("weight"))).alias("realized"))


def top_assets(weights: DataFrame, n: int = 6) -> DataFrame:
    """The assets of the largest mean weight; ties by name."""
    mean = weights.filter("path >= 0").groupBy("asset").agg(F.avg("weight").alias("mean_weight"))
    return mean.orderBy(F.desc("mean_weight"), "asset").limit(n)


def cumulative_returns(returns: DataFrame) -> DataFrame:
    """Percent growth of each series along its path."""
    label = next(c for c in ("asset", "factor") if c in returns.columns)
    keys = [c for c in ("path",) if c in returns.columns]
    total = prefix(returns.select(*keys, "time", "time_idx", label, "ret"), [*keys, label], sums={"total": F.col("ret")})
    return total.select(*keys, "time", "time_idx", label, ((F.exp("total") - 1) * 100).alias("cumulative"))


def portfolio_cumulative(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Percent growth of drifting weights: a weight holds from the row after its date on, until the
    next; rows before every asset has one are left out."""
    keys = ["path", "asset"]
    rows = returns.join(weights.select("path", "time", "asset", "weight"), ["path", "time", "asset"], "left")
    rows = prefix(rows, keys, lasts={"held": F.col("weight")}, before=True)
    daily = rows.groupBy("path", "time", "time_idx").agg(F.sum(F.col("held") * F.expm1("ret")).alias("r"), (F.count("held") == F.count("*")).alias("full")).filter("full")
    total = prefix(kept(daily), ["path"], sums={"total": F.log1p("r")})
    return total.select("path", "time", "time_idx", ((F.exp("total") - 1) * 100).alias("cumulative"))


def equal_weights(returns: DataFrame, rebalances: DataFrame) -> DataFrame:
    """path, time, asset, weight = 1 / assets at each rebalance (time_idx)."""
    n = F.count("*").over(W.partitionBy("path", "time"))
    return returns.join(rebalances.select("time_idx"), "time_idx", "left_semi").select("path", "time", "asset", (F.lit(1.0) / n).alias("weight"))


def diagnostic_summary(records: DataFrame) -> DataFrame:
    """Over bootstrap paths and over the history. The names of the columns are fixed values of the interface."""
    kind = F.when(F.col("path") >= 0, "bootstrap_paths").otherwise("realized_path")
    return records.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_records"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.sum("constraint_violation").alias("constraint_violations"), F.median("cond_number").alias("median_cond_number"),
        F.max("cond_number").alias("max_cond_number"), F.median("obj_improvement").alias("median_obj_improvement"), F.max("obj_diff_init").alias("max_multi_init_obj_diff"),
    )


def terminal_stats(cumulative: DataFrame) -> DataFrame:
    """Of the last value of each path: mean, quartile range and worst decile."""
    last = cumulative.groupBy("path").agg(F.max_by("cumulative", "time_idx").alias("x")).filter("path >= 0")
    return last.agg(F.count("*").alias("n_paths"), F.avg("x").alias("mean"), (F.percentile("x", 0.75) - F.percentile("x", 0.25)).alias("iqr"), F.percentile("x", 0.1).alias("worst_decile"))


def sharpe(returns: DataFrame) -> DataFrame:
    """Mean over deviation of each path's series, a row at a time."""
    return returns.groupBy("path", "asset").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"))


def risk_stack(risk: DataFrame, normalize: bool = False) -> DataFrame:
    whole = F.col("sys_var") + F.col("idio_var")
    if not normalize:
        return risk.select("asset", "sys_var", "idio_var")
    return risk.select("asset", F.try_divide("sys_var", whole).alias("sys_var"), F.try_divide("idio_var", whole).alias("idio_var"))


def path_lines(paths: DataFrame, series: str, n_paths: int | None = None) -> DataFrame:
    """The lines of one series: the first ``n_paths`` paths and the history."""
    if n_paths is not None and n_paths <= 0:
        raise ValueError("n_paths must be positive")
    label = next(c for c in ("asset", "factor") if c in paths.columns)
    rows = paths.filter(F.col(label) == series)
    return cumulative_returns(rows if n_paths is None else rows.filter(F.col("path") < n_paths))
