"""Moving-block bootstrap: alternative orders of the same history."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cache import Store


def checked(block_size: int, n_paths: int, n_times: int | None = None, align: str = "inner", method: str = "block") -> None:
    if method != "block" or align != "inner":
        raise ValueError("only method='block' and align='inner' are supported")
    if block_size <= 0 or n_paths <= 0:
        raise ValueError("block_size and n_paths must be positive")
    if n_times is not None and block_size > n_times:
        raise ValueError("block_size is longer than the history")


def hashed_draws(times: DataFrame, block_size: int, n_paths: int, seed: int) -> DataFrame:
    """path, block, start: starts from an MD5 of path, block and seed, so that any engine and any
    partition draws the same."""
    checked(block_size, n_paths)
    n = times.agg((F.max("time_idx") + 1).alias("n"))
    rows = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("path"))
    rows = rows.select("n", "path", F.explode(F.expr(f"sequence(0, cast(ceil(n / {block_size}) as int) - 1)")).alias("block"))
    text = F.concat(F.col("path").cast("string"), F.lit("-"), F.col("block").cast("string"), F.lit(f"-{seed}"))
    start = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % (F.col("n") - block_size + 1)
    return rows.select("path", "block", start.alias("start"))


def sequential_draws(spark: SparkSession, n_times: int, block_size: int, n_paths: int, seed: int | None) -> DataFrame:
    """The same from one NumPy generator, path after path: a few numbers, drawn on the driver."""
    checked(block_size, n_paths, n_times)
    rng, blocks = np.random.default_rng(seed), -(-n_times // block_size)
    rows = [(p, b, int(s)) for p in range(n_paths) for b, s in enumerate(rng.integers(0, n_times - block_size + 1, size=blocks))]
    return spark.createDataFrame(rows, "path int, block int, start bigint")


def resample(panel: DataFrame, draws: DataFrame, block_size: int) -> DataFrame:
    """``panel`` (time, time_idx, label, ret) along each path. Rows keep the calendar: the block's
    values stand at the next times of the history. Pass the same draws for assets and factors."""
    times = panel.select("time", "time_idx").distinct()
    each = draws.select("path", "block", "start", F.explode(F.sequence(F.lit(0), F.lit(block_size - 1))).alias("o"))
    moves = each.select("path", (F.col("block") * block_size + F.col("o")).alias("time_idx"), (F.col("start") + F.col("o")).alias("source_idx"))
    moves = moves.join(times, "time_idx")
    values = panel.drop("time").withColumnRenamed("time_idx", "source_idx")
    label = next(c for c in ("asset", "factor") if c in panel.columns)
    return moves.join(values, "source_idx").select("path", "time", "time_idx", label, "ret", "source_idx")


def with_history(paths: DataFrame, panel: DataFrame) -> DataFrame:
    """The paths and the history itself, as path -1."""
    return paths.unionByName(panel.withColumns({"path": F.lit(-1), "source_idx": F.col("time_idx").cast("bigint")}))


def residual_paths(fits: DataFrame, factors: DataFrame, betas: DataFrame, draws: DataFrame, block_size: int) -> DataFrame:
    """Returns rebuilt with fixed betas from factors and residuals drawn together: ``fits`` has
    time_idx, asset, residual; ``betas`` asset, alpha, beta of one factor (time_idx, ret)."""
    drawn_e = resample(fits.select("time", "time_idx", "asset", F.col("residual").alias("ret")), draws, block_size)
    drawn_f = resample(factors, draws, block_size).select("path", "time_idx", F.col("ret").alias("f"))
    rows = drawn_e.join(drawn_f, ["path", "time_idx"]).join(betas, "asset")
    return rows.select("path", "time", "time_idx", "asset", (F.col("alpha") + F.col("beta") * F.col("f") + F.col("ret")).alias("ret"))


def paths(assets: DataFrame, factors: DataFrame, block_size: int, n_paths: int, seed: int | None, store: Store | None = None, source: str = "") -> tuple[DataFrame, DataFrame]:
    """Assets and factors along paths of common draws. With a ``store`` and a seed the draws' rows are
    kept and read again; ``source`` names the panels that they come from. Without a seed each call
    draws anew."""
    if seed is None:
        seed = int(np.random.default_rng().integers(1 << 31))
        store = None
    draws = hashed_draws(assets, block_size, n_paths, seed)
    out = []
    for panel, label in ((assets, "asset"), (factors, "factor")):
        make = lambda panel=panel: resample(panel, draws, block_size)
        if store is None:
            out.append(make())
            continue
        name = Store.name(f"{label}-paths", {"source": source, "block": block_size, "paths": n_paths, "seed": seed})
        kept = store.fetch(name, make)
        if not {"path", "time", "time_idx", label, "ret"} <= set(kept.columns):
            raise ValueError(f"{store.path(name)} holds no {label} paths")
        out.append(kept)
    return out[0], out[1]
