"""Covariances and exponentially weighted moments from tables that merge.

Rows are cut into runs of dates. A run of two blocks of series is a dense matrix, whose products
NumPy forms in a task; what leaves the task is one row for each pair of series, and those rows are
merged by Spark. No series is joined with another by time: for N series and T dates there are
N * N / 2 * T / RUN rows, and each value is sent once for each block of series, most often once.

Plain moments of a pair are (n, mean, mean, co-moment) of the dates that both have. Exponentially
weighted ones are elements of a monoid. The recursion y = (d y + a x) / (d + a) with d = (1 - a) ** gap
is, between two values of a series, y -> p y + q x with p + q = 1, so that a run of values is one
affine map, (P, S) with y -> P y + S, and maps compose. An element keeps its first value apart, as
the gap before it is known only when it meets its left neighbour. A gap is counted in positions
(time_idx) of the panel, those that the series misses included; what comes before its first value
does not count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dates of a run, and series of a block.
RUN, WIDTH = 2048, 256


def rate(halflife: float | None) -> float:
    """The weight of a new value."""
    if halflife is None or not halflife > 0:
        raise ValueError("halflife must be positive")
    return 1 - math.exp(-math.log(2) / halflife)


def _run(size: int) -> Column:
    return F.floor(F.col("time_idx") / size).cast("bigint")


# Exponentially weighted moments of single series


def ew_moments(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], halflife: float, run: int = RUN) -> DataFrame:
    """``keys``, the weighted mean of each of ``values`` and ``w2``, the sum of squared weights, of the dates
    (time_idx) at which none of them is null. Folded in runs, then over the runs of a series."""
    a, names = rate(halflife), list(values)
    known = rows.select(*keys, "time_idx", *[c.alias(n) for n, c in values.items()]).dropna(subset=names)
    lists = known.groupBy(*keys, _run(run).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("time_idx", *names))).alias("_v"))

    def start(v: Column) -> Column:
        own = [v[n].alias(f"f_{n}") for n in names] + [F.lit(0.0).alias(f"s_{n}") for n in names]
        return F.struct(v["time_idx"].alias("first"), v["time_idx"].alias("last"), F.lit(1.0).alias("p"), F.lit(0.0).alias("w2"), *own)

    def joined(x: Column, y: Column) -> Column:
        """The element of two neighbours."""
        d = F.pow(F.lit(1 - a), (y["first"] - x["last"]).cast("double"))
        p, q = d / (d + a), F.lit(a) / (d + a)
        sums = [(y["p"] * (p * x[f"s_{n}"] + q * y[f"f_{n}"]) + y[f"s_{n}"]).alias(f"s_{n}") for n in names]
        w2 = y["p"] * y["p"] * (p * p * x["w2"] + q * q) + y["w2"]
        return F.struct(x["first"].alias("first"), y["last"].alias("last"), (y["p"] * p * x["p"]).alias("p"), w2.alias("w2"), *[x[f"f_{n}"].alias(f"f_{n}") for n in names], *sums)

    def folded(elements: Column) -> Column:
        return F.aggregate(F.slice(elements, F.lit(2), F.size(elements)), F.element_at(elements, 1), joined)

    runs = lists.select(*keys, "_run", folded(F.transform("_v", start)).alias("_e"))
    whole = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_run", "_e"))).alias("_r"))
    e = whole.select(*keys, folded(F.col("_r._e")).alias("_e"))
    weight = F.col("_e.p")
    return e.select(*keys, *[(weight * F.col(f"_e.f_{n}") + F.col(f"_e.s_{n}")).alias(n) for n in names], (weight * weight + F.col("_e.w2")).alias("w2"))


# Pairs


def _matrix(pdf: pd.DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, labels and values (positions by labels, NaN where there is none) of one run."""
    at, row = np.unique(pdf["time_idx"].to_numpy(), return_inverse=True)
    names, column = np.unique(pdf[label].to_numpy(str).astype(object), return_inverse=True)
    x = np.full((len(at), len(names)), np.nan)
    x[row, column] = pdf["ret"].to_numpy(float)
    return at, names, x


def _pairs(rows: DataFrame, label: str, keys: Sequence[str], products: Callable, schema: str, run: int, width: int) -> DataFrame:
    """``products(at, x, y)`` of each run and pair of blocks: a dict of arrays (series of x by series of y),
    as one row for each pair i <= j of labels, in columns i, j and those of ``schema``."""
    n = rows.select(F.countDistinct(label).alias("_n"))  # one row
    known = rows.filter(F.col("ret").isNotNull() & ~F.isnan("ret")).select(*keys, "time_idx", label, "ret").crossJoin(n)
    blocks = F.greatest(F.ceil(F.col("_n") / width), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(label), F.col("_blocks")).cast("int")
    dealt = known.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*keys, "time_idx", label, "ret", "_own", _run(run).alias("_run"), F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))
    names = [c.split()[0] for c in schema.split(", ")]

    def form(pdf: pd.DataFrame) -> pd.DataFrame:
        at, labels, x = _matrix(pdf, label)
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        block = pdf.groupby(label)["_own"].first().reindex(labels).to_numpy()
        one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = products(at, x[:, one], x[:, two])
        i, j = (g.ravel() for g in np.meshgrid(one, two, indexing="ij"))
        keep = found.pop("seen").ravel() & ((i <= j) if lo == hi else True)
        swap = labels[i] > labels[j]  # blocks are by hash, pairs by label
        out = {k: [pdf[k].iloc[0]] * int(keep.sum()) for k in keys} | {"_run": pdf["_run"].iloc[0], "i": np.where(swap, labels[j], labels[i])[keep], "j": np.where(swap, labels[i], labels[j])[keep]}
        for c in names:
            v = found[c].ravel()
            if c[-1] in "xy" and (other := {"x": "y", "y": "x"}[c[-1]]) and f"{c[:-1]}{other}" in found:
                v = np.where(swap, found[f"{c[:-1]}{other}"].ravel(), v)
            out[c] = v[keep]
        return pd.DataFrame(out)

    types = dict(rows.dtypes)
    full = ", ".join([*(f"{k} {types[k]}" for k in keys), f"_run bigint, i string, j string, {schema}"])
    return dealt.groupBy(*keys, "_run", "_lo", "_hi").applyInPandas(form, full)


def _plain(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, means and co-moments of the dates that both have."""
    mx, my = (~np.isnan(v) for v in (x, y))
    cx, cy = (np.where(m.any(axis=0), np.where(m, v, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1), 0) for m, v in ((mx, x), (my, y)))
    x0, y0 = np.where(mx, x - cx, 0), np.where(my, y - cy, 0)
    fx, fy = mx.astype(float), my.astype(float)
    n = fx.T @ fy
    some = np.maximum(n, 1)
    sx, sy = x0.T @ fy, fx.T @ y0
    return {"seen": n > 0, "n": n, "mx": cx[:, None] + sx / some, "my": cy[None, :] + sy / some, "c": x0.T @ y0 - sx * sy / some}


def covariances(rows: DataFrame, label: str, keys: Sequence[str] = (), run: int = RUN, width: int = WIDTH) -> DataFrame:
    """``keys``, i, j (i <= j), n and cov (n - 1) of the series ``label`` of ``rows`` (time_idx, ``label``, ret) over
    the dates that both of a pair have; NULL for one date, no row for none."""
    parts = _pairs(rows, label, keys, _plain, "n double, mx double, my double, c double", run, width)
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    total = parts.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum(n * mx).alias("x"), F.sum(n * my).alias("y"), F.sum(F.col("c") + n * mx * my).alias("xy"))
    return total.select(*keys, "i", "j", F.col("n").cast("bigint").alias("n"), F.when(n > 1, (F.col("xy") - F.col("x") * F.col("y") / n) / (n - 1)).alias("cov"))


def _weighted(a: float) -> Callable:
    def products(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        shape = (x.shape[1], y.shape[1])
        if not (np.isnan(x).any() or np.isnan(y).any()):
            d = (1 - a) ** np.diff(at).astype(float)
            p, q = d / (d + a), a / (d + a)
            after = np.append(np.cumprod(p[::-1])[::-1][1:], 1.0) if len(p) else np.zeros(0)
            u = q * after
            full = lambda v: np.broadcast_to(v, shape)
            return {
                "seen": full(True), "first": full(at[0]), "last": full(at[-1]), "p": full(np.prod(p)), "w2": full((u * u).sum()), "fx": full(x[0][:, None]), "fy": full(y[0][None, :]),
                "sx": full((u @ x[1:])[:, None]), "sy": full((u @ y[1:])[None, :]), "sxy": (x[1:] * u[:, None]).T @ y[1:],
            }
        seen, p = np.zeros(shape, bool), np.ones(shape)
        first, last = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        fx, fy, sx, sy, sxy, w2 = (np.zeros(shape) for _ in range(6))
        for t, xs, ys in zip(at.tolist(), x, y):
            now = ~np.isnan(xs)[:, None] & ~np.isnan(ys)[None, :]
            vx, vy = np.broadcast_to(xs[:, None], shape), np.broadcast_to(ys[None, :], shape)
            new, go = now & ~seen, now & seen
            first[new], fx[new], fy[new] = t, vx[new], vy[new]
            d = (1 - a) ** (t - last[go]).astype(float)
            pk, qk = d / (d + a), a / (d + a)
            p[go] *= pk
            sx[go], sy[go] = pk * sx[go] + qk * vx[go], pk * sy[go] + qk * vy[go]
            sxy[go], w2[go] = pk * sxy[go] + qk * vx[go] * vy[go], pk * pk * w2[go] + qk * qk
            last[now], seen = t, seen | now
        return {"seen": seen, "first": first, "last": last, "p": p, "w2": w2, "fx": fx, "fy": fy, "sx": sx, "sy": sy, "sxy": sxy}

    return products


def ew_covariances(rows: DataFrame, label: str, halflife: float, keys: Sequence[str] = (), run: int = RUN, width: int = WIDTH) -> DataFrame:
    """``keys``, i, j (i <= j) and cov, exponentially weighted and unbiased, of the dates that both of a pair
    have; NULL for one date."""
    a = rate(halflife)
    schema = "first bigint, last bigint, p double, w2 double, fx double, fy double, sx double, sy double, sxy double"
    parts = _pairs(rows, label, keys, _weighted(a), schema, run, width)
    element = F.struct("_run", *[c.split()[0] for c in schema.split(", ")])
    lists = parts.groupBy(*keys, "i", "j").agg(F.sort_array(F.collect_list(element)).alias("_r"))
    names = {"x": lambda e: e["fx"], "y": lambda e: e["fy"], "xy": lambda e: e["fx"] * e["fy"]}

    def start(e: Column) -> Column:
        return F.struct(e["last"].alias("last"), (e["p"] * e["p"] + e["w2"]).alias("w2"), *[(e["p"] * f(e) + e[f"s{n}"]).alias(n) for n, f in names.items()])

    def step(m: Column, e: Column) -> Column:
        d = F.pow(F.lit(1 - a), (e["first"] - m["last"]).cast("double"))
        p, q = d / (d + a), F.lit(a) / (d + a)
        w2 = e["p"] * e["p"] * (p * p * m["w2"] + q * q) + e["w2"]
        return F.struct(e["last"].alias("last"), w2.alias("w2"), *[(e["p"] * (p * m[n] + q * f(e)) + e[f"s{n}"]).alias(n) for n, f in names.items()])

    r = F.col("_r")
    m = lists.select(*keys, "i", "j", F.aggregate(F.slice(r, F.lit(2), F.size(r)), start(F.element_at(r, 1)), step).alias("m"))
    return m.select(*keys, "i", "j", F.when(F.col("m.w2") < 1 - 1e-12, (F.col("m.xy") - F.col("m.x") * F.col("m.y")) / (1 - F.col("m.w2"))).alias("cov"))


def both_orders(half: DataFrame, keys: Sequence[str], one: str, two: str) -> DataFrame:
    """``keys``, ``one``, ``two``, cov: each pair i < j in both orders, from one read of ``half``."""
    pair = F.array(F.struct(F.col("i").alias("l"), F.col("j").alias("r")), F.struct(F.col("j").alias("l"), F.col("i").alias("r")))
    each = half.select(*keys, "cov", F.explode(F.when(F.col("i") == F.col("j"), F.slice(pair, 1, 1)).otherwise(pair)).alias("p"))
    return each.select(*keys, F.col("p.l").alias(one), F.col("p.r").alias(two), "cov")
