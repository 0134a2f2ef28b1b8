"""Linear factor models, rolling and over the whole sample.

One or two factors are plain window aggregates. Any number goes through ``applyInPandas``: windows are
solved along a run of dates by updating, and by the minimum-norm solution where rank drops, keyed by
asset and split by path and run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import chunk_of, in_runs, own_rows


def joined(assets: DataFrame, wide: DataFrame | None) -> DataFrame:
    """Assets with the factors of their time; without ``wide`` they have them already."""
    if wide is None:
        return assets
    keys = [c for c in ("path", "time", "time_idx") if c in assets.columns and c in wide.columns]
    return assets.join(wide, keys)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("path", "asset") if c in df.columns]


def _fit(rows: DataFrame, k: int, intercept: bool, over) -> dict[str, Column]:
    def agg(c):
        return c.over(over) if over is not None else c

    if not intercept:
        if k != 1:
            raise ValueError("without intercept in closed form: one factor")
        return {"b1": F.try_divide(agg(F.sum(F.col("ret") * F.col("f1"))), agg(F.sum(F.col("f1") * F.col("f1"))))}
    if k == 1:
        b1 = F.try_divide(agg(F.covar_samp("ret", "f1")), agg(F.var_samp("f1")))
        return {"b1": b1, "alpha": agg(F.avg("ret")) - b1 * agg(F.avg("f1"))}
    v1, v2, c12 = agg(F.var_samp("f1")), agg(F.var_samp("f2")), agg(F.covar_samp("f1", "f2"))
    c1, c2 = agg(F.covar_samp("ret", "f1")), agg(F.covar_samp("ret", "f2"))
    det = v1 * v2 - c12 * c12
    b1, b2 = F.try_divide(c1 * v2 - c2 * c12, det), F.try_divide(c2 * v1 - c1 * c12, det)
    return {"b1": b1, "b2": b2, "alpha": agg(F.avg("ret")) - b1 * agg(F.avg("f1")) - b2 * agg(F.avg("f2"))}


def _project(rows: DataFrame, k: int, intercept: bool) -> DataFrame:
    fitted = sum((F.col(f"b{i}") * F.col(f"f{i}") for i in range(1, k + 1)), F.col("alpha") if intercept else F.lit(0.0))
    return rows.withColumn("fitted", fitted).withColumn("residual", F.col("ret") - F.col("fitted"))


def rolling_ols(assets: DataFrame, wide: DataFrame | None, window: int, k: int = 1, intercept: bool = True) -> DataFrame:
    """Rows of ``assets`` with f1.., b1.., alpha, fitted and residual of the trailing ``window`` dates
    (time_idx); NULL where the series lacks one of them."""
    rows, chunk = joined(assets, wide), chunk_of(window)
    over = W.partitionBy(*_keys(rows), "run").orderBy("time_idx").rangeBetween(-(window - 1), 0)
    full = F.count("ret").over(over) == window
    fit = {n: F.when(full, c) for n, c in _fit(rows, k, intercept, over).items()}
    return _project(own_rows(in_runs(rows, window, chunk).withColumns(fit), chunk), k, intercept)


def sample_ols(assets: DataFrame, wide: DataFrame | None, k: int = 1, intercept: bool = True) -> tuple[DataFrame, DataFrame]:
    """(coefficients by asset, rows with fitted and residual) over all rows."""
    rows = joined(assets, wide)
    keys = _keys(rows)
    coefficients = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in _fit(rows, k, intercept, None).items()])
    return coefficients, _project(rows.join(coefficients, keys), k, intercept)


def arrays(df: DataFrame, label: str, out: str) -> DataFrame:
    """One row for each path and time: the returns as an array in the order of their labels."""
    each = df.groupBy("path", "time", "time_idx").agg(F.sort_array(F.collect_list(F.struct(label, "ret"))).alias("_a"))
    return each.select("path", "time", "time_idx", F.col(f"_a.{label}").alias(f"{out}_names"), F.col("_a.ret").alias(out))


#: A window's Gram matrix is solved as it is if the least pivot of its Cholesky factor, of columns scaled to
#: length one, is above this; below, columns are as good as dependent and the minimum-norm solution is taken.
PIVOT = 1e-2


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minimum-norm coefficients of many windows: x (n, w, k), y (n, w, m) give (n, k, m)."""
    return np.linalg.pinv(x) @ y


def _windows(a: np.ndarray, w: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, w, axis=0).swapaxes(1, 2)


def _moving(a: np.ndarray, w: int) -> np.ndarray:
    """Sums of ``a`` over each window of ``w`` rows: what enters is added, what leaves is taken away."""
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
    return total[w:] - total[:-w]


def rolling_least_squares(f: np.ndarray, r: np.ndarray, window: int, intercept: bool = True) -> np.ndarray:
    """Coefficients (T - window + 1, k, N) of each trailing window of T rows: factors ``f`` (T, k) without
    gaps on returns ``r`` (T, N) with NaN where a series has none; NaN where its window has such.

    The Gram matrix and the products with the returns are kept up to date along the run, row in, row
    out, around the run's means. Each is factored (Cholesky, columns scaled to length one); where a
    pivot shows that rank drops, that window alone is solved by singular values.
    """
    if intercept:
        f = np.column_stack([np.ones(len(f)), f])
    k, known = f.shape[1], ~np.isnan(r)
    shift = np.where(np.arange(k) >= int(intercept), f.mean(axis=0), 0.0) if intercept else np.zeros(k)
    x, y = f - shift, np.where(known, r, 0.0)
    gram = _moving(x[:, :, None] * x[:, None, :], window)
    both = _moving(x[:, :, None] * y[:, None, :], window)
    full = _moving(known.astype(float), window) > window - 0.5
    size = np.sqrt(np.maximum(np.einsum("nii->ni", gram), 0))
    safe = np.where(size > 0, size, 1)
    scaled = gram / (safe[:, :, None] * safe[:, None, :])
    pivots, good = _pivots(scaled)
    good &= (size > 0).all(axis=1) & (pivots > PIVOT)
    out = np.full((len(gram), k, r.shape[1]), np.nan)
    if good.any():
        out[good] = np.linalg.solve(scaled[good], both[good] / safe[good][:, :, None]) / safe[good][:, :, None]
    if intercept:  # back from the shifted factors
        out[:, 0] -= np.einsum("k,nkm->nm", shift[1:], out[:, 1:])
    if not good.all():
        bad = np.flatnonzero(~good)
        out[bad] = least_squares(_windows(f, window)[bad], _windows(np.where(known, r, 0.0), window)[bad])
    return np.where(full[:, None, :], out, np.nan)


def _pivots(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least diagonal of each matrix's Cholesky factor, and whether there is one."""
    n, k = gram.shape[:2]
    low, least, good = np.zeros_like(gram), np.full(n, np.inf), np.ones(n, bool)
    for j in range(k):
        d = gram[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
        good &= d > 0
        root = np.sqrt(np.where(d > 0, d, 1))
        least = np.minimum(least, np.where(d > 0, root, 0))
        low[:, j, j] = root
        for i in range(j + 1, k):
            low[:, i, j] = (gram[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(axis=1)) / root
    return least, good


def rolling_ols_any(assets: DataFrame, factors: DataFrame, window: int, intercept: bool = True, chunk: int | None = None, blocks: int = 1) -> DataFrame:
    """path, time, time_idx, asset, alpha, factors, betas, fitted, residual for any number of factors
    (in the order of their names), at the dates of a series whose ``window`` dates it has in full.

    Dates are split into runs that overlap by a window, assets by hash into ``blocks`` (for very many); the
    factors of a run go to each of its blocks once. All factors must be there at each date that has one.
    """
    size = chunk_of(window) if chunk is None else chunk
    label = T.StructType.fromDDL("path int, run int, block int, time date, time_idx int, asset string, ret double")
    block = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    left = in_runs(assets.select("path", "time", "time_idx", "asset", "ret").withColumn("block", block), window, size).select(*[F.col(f.name).cast(f.dataType) for f in label])
    right = in_runs(arrays(factors, "factor", "f"), window, size).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(key, rows: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({c: pd.Series([], dtype=object) for c in MODEL})
        if rows.empty or f.empty:
            return nothing
        f = f.sort_values("time_idx", ignore_index=True)
        at, names = f["time_idx"].to_numpy(np.int64), list(f["f_names"].iloc[0])
        if any(list(n) != names for n in f["f_names"]):
            raise ValueError("a date lacks a factor that another has")
        series, column = np.unique(rows["asset"].to_numpy(str).astype(object), return_inverse=True)
        x, out = np.stack(f["f"].to_list()).astype(float), []
        for first, last in _stretches(at):  # a date without factors breaks the windows that would hold it
            if last - first < window:
                continue
            own = np.flatnonzero((rows["time_idx"] >= at[first]) & (rows["time_idx"] <= at[last - 1]))
            r = np.full((last - first, len(series)), np.nan)
            r[rows["time_idx"].to_numpy(np.int64)[own] - at[first], column[own]] = rows["ret"].to_numpy(float)[own]
            b = rolling_least_squares(x[first:last], r, window, intercept)
            i, j = np.nonzero(~np.isnan(b[:, 0, :]) & (at[first + window - 1 : last] // size == key[1])[:, None])
            if not len(i):
                continue
            end, beta = i + window - 1, b[i, int(intercept) :, j]
            alpha = b[i, 0, j] if intercept else np.full(len(i), np.nan)
            fitted = np.einsum("nk,nk->n", x[first:last][end], beta) + (alpha if intercept else 0)
            out.append(pd.DataFrame({
                "path": key[0], "time": f["time"].to_numpy()[first + end], "time_idx": at[first + end], "asset": series[j], "alpha": pd.Series(alpha).astype(object).where(~np.isnan(alpha), None),
                "factors": [names] * len(i), "betas": list(beta), "fitted": fitted, "residual": r[end, j] - fitted,
            }))
        return pd.concat(out, ignore_index=True) if out else nothing

    keys = ["path", "run", "block"]
    schema = "path int, time date, time_idx int, asset string, alpha double, factors array<string>, betas array<double>, fitted double, residual double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, schema)


MODEL = ["path", "time", "time_idx", "asset", "alpha", "factors", "betas", "fitted", "residual"]


def _stretches(at: np.ndarray) -> list[tuple[int, int]]:
    """First and end of the stretches of consecutive numbers."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(at)]))


def sample_ols_any(assets: DataFrame, factors: DataFrame, intercept: bool = True) -> tuple[DataFrame, DataFrame]:
    """(coefficients: path, asset, alpha, factors, betas; rows with fitted and residual) over all rows
    of each series, for any number of factors: each series is a minimum-norm problem of its own."""
    rows = assets.join(arrays(factors, "factor", "f"), ["path", "time", "time_idx"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.stack(pdf["f"].to_list())
        x = np.column_stack([np.ones(len(f)), f]) if intercept else f
        b = np.linalg.lstsq(x, pdf["ret"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "asset": pdf["asset"].iloc[0], "alpha": b[0] if intercept else None, "factors": [list(pdf["f_names"].iloc[0])], "betas": [b[int(intercept) :]]})

    coefficients = rows.groupBy("path", "asset").applyInPandas(solve, "path int, asset string, alpha double, factors array<string>, betas array<double>")
    dot = F.aggregate(F.zip_with("betas", "f", lambda b, f: b * f), F.coalesce("alpha", F.lit(0.0)), lambda a, x: a + x)
    fits = rows.join(coefficients.drop("factors"), ["path", "asset"]).withColumn("fitted", dot)
    return coefficients, fits.select("path", "time", "time_idx", "asset", "ret", "fitted", (F.col("ret") - F.col("fitted")).alias("residual"))


def latest_model(model: DataFrame) -> DataFrame:
    """path, asset and the last alpha, factors, betas that a rolling model has."""
    known = model.filter("betas is not null")
    last = known.groupBy("path", "asset").agg(F.max_by(F.struct("alpha", "factors", "betas"), "time_idx").alias("m"))
    return last.select("path", "asset", "m.*")
