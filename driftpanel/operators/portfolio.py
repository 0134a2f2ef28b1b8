"""Constrained portfolios: one small dense problem for each group of a grouped DataFrame."""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solver import solve
from . import checks, moments
from .regression import latest_model
from .risk import array_betas

CHECK = 1e-6
ILL_CONDITIONED = 1e8
#: Days of the rebalances that one task solves in a row.
RUN_DAYS = 731
#: What another start or a worse end may differ by before a warning.
DIFFERENT = 1e-3
DIAGNOSTICS = (
    "success boolean, status int, message string, cond_number double, constraint_violation int, obj_value double, obj_improvement double, "
    "local_perturbation_obj_diff double, weight_diff_init double, obj_diff_init double, n_iter int"
)
NAMES = [x.split()[0] for x in DIAGNOSTICS.split(", ")]


@dataclass(frozen=True)
class Problem:
    objective: str = "min_variance"
    long_only: bool = True
    budget: float = 1.0
    gross_budget: float | None = None
    long_budget: float | None = None
    short_budget: float | None = None
    risk_free_rate: float = 0.0
    risk_aversion: float = 1.0
    l2_reg: float = 0.0
    bounds: tuple[tuple[float | None, float | None], ...] | None = None
    min_weight: float | None = None
    max_weight: float | None = None
    raise_on_failure: bool = True

    def limits(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.long_only and self.short_budget:
            raise ValueError("a short budget contradicts long_only")
        low, high = (np.zeros(n), np.ones(n)) if self.long_only else (np.full(n, -np.inf), np.full(n, np.inf))
        if self.bounds is not None:
            low = np.array([-np.inf if a is None else a for a, _ in self.bounds])
            high = np.array([np.inf if b is None else b for _, b in self.bounds])
        if self.min_weight is not None:
            low = np.full(n, float(self.min_weight))
        if self.max_weight is not None:
            high = np.full(n, float(self.max_weight))
        return low, high


@dataclass
class Warm:
    """Where the last problem of a row of like ones ended: the next starts there."""

    names: list[str] | None = None
    weights: np.ndarray | None = None
    held: tuple[int, ...] = ()


def optimize(cov: np.ndarray, mu: np.ndarray | None, problem: Problem, seed: int = 0, warm: Warm | None = None, names: list[str] | None = None) -> tuple[np.ndarray, dict[str, Any]]:
    """Weights and a diagnostic record. Covariance and means are divided by the mean variance
    first; l2_reg and risk_free_rate are not. A condition number above ILL_CONDITIONED warns.

    ``warm`` starts the search at the weights of another problem of the same ``names`` and keeps this one's
    answer for the next.
    """
    n = len(cov)
    if cov.shape != (n, n) or not n or not np.allclose(cov, cov.T, atol=1e-8):
        raise ValueError("the covariance must be square and symmetric")
    scale = np.trace(cov) / n
    if not scale > 0:
        raise ValueError("the mean variance must be positive")
    s, m = cov / scale, (np.zeros(n) if mu is None else np.asarray(mu, float)) / scale
    if np.linalg.eigvalsh(s)[0] < -1e-8:
        raise ValueError("the covariance is not positive semidefinite")
    low, high = problem.limits(n)
    start = np.full(n, problem.budget / n)

    cond = float(np.linalg.cond(s))
    if cond > ILL_CONDITIONED:
        warnings.warn(f"the covariance is ill-conditioned: {cond:.3g}", stacklevel=2)

    def run(w0: np.ndarray, held: tuple[int, ...] = ()) -> tuple[np.ndarray, bool, int, tuple[int, ...]]:
        return solve(s, m, problem.objective, low, high, problem.budget, problem.gross_budget, problem.long_budget, problem.short_budget, problem.risk_aversion, problem.risk_free_rate, problem.l2_reg, w0, held)

    def value(w: np.ndarray) -> float:
        risk, l2 = w @ s @ w, problem.l2_reg * w @ w
        if problem.objective == "min_variance":
            return float(risk + l2)
        if problem.objective == "mean_variance":
            return float(problem.risk_aversion * risk - m @ w + l2)
        return float(-(m @ w - problem.risk_free_rate) / np.sqrt(max(risk, 1e-16)) + l2)

    same = warm is not None and warm.weights is not None and warm.names == names and len(warm.weights) == n
    w, ok, steps, held = run(warm.weights, warm.held) if same else run(start)
    if warm is not None:
        warm.names, warm.weights, warm.held = (names, w, held) if ok else (None, None, ())
    record: dict[str, Any] = dict.fromkeys(NAMES) | {"success": bool(ok), "status": 0 if ok else 1, "message": "converged" if ok else "not converged", "cond_number": cond, "constraint_violation": 0, "n_iter": int(steps)}
    if not ok:
        if problem.raise_on_failure:
            raise RuntimeError("the solver did not converge")
        return np.full(n, np.nan), record
    broken = violations(w, problem, low, high)
    if broken and problem.raise_on_failure:
        raise RuntimeError(f"constraints are violated: {', '.join(broken)}")
    rng = np.random.default_rng(seed)
    end, first = value(w), value(start)
    record |= {"constraint_violation": len(broken), "obj_value": end, "obj_improvement": (end - first) / (abs(first) + 1e-12)}
    if record["obj_improvement"] > CHECK and not violations(start, problem, low, high):
        warnings.warn("the objective is worse than that of equal weights", stacklevel=2)
    if problem.long_only and problem.bounds is None and problem.min_weight is None and problem.max_weight is None and problem.gross_budget is None:
        near = np.clip(w + rng.uniform(-1e-6, 1e-6, n), 0, 1)
        record["local_perturbation_obj_diff"] = value(near / near.sum() * problem.budget) - end
    again, ok, *_ = run(rng.dirichlet(np.ones(n)))
    if ok:
        record |= {"weight_diff_init": float(np.linalg.norm(again - w)), "obj_diff_init": abs(value(again) - end)}
        if record["weight_diff_init"] > DIFFERENT and record["obj_diff_init"] > CHECK:
            warnings.warn("another start ends elsewhere", stacklevel=2)
    return w, record


def violations(w: np.ndarray, problem: Problem, low: np.ndarray, high: np.ndarray) -> list[str]:
    checks = {
        "budget": abs(w.sum() - problem.budget) > CHECK,
        "long_only": problem.long_only and (w < -CHECK).any(),
        "gross": problem.gross_budget is not None and np.abs(w).sum() > problem.gross_budget + CHECK,
        "long": problem.long_budget is not None and np.maximum(w, 0).sum() > problem.long_budget + CHECK,
        "short": problem.short_budget is not None and np.maximum(-w, 0).sum() > problem.short_budget + CHECK,
        "lower": (w < low - CHECK).any(),
        "upper": (w > high + CHECK).any(),
    }
    return [k for k, bad in checks.items() if bad]


def _square_rows(cov: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group and asset, with its row of the covariance as an array of structs."""
    return cov.groupBy(*keys, F.col("asset_i").alias("asset")).agg(F.sort_array(F.collect_list(F.struct("asset_j", "cov"))).alias("row"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    names = list(pdf["asset"])
    return np.array([[dict((x["asset_j"], x["cov"]) for x in row)[n] for n in names] for row in pdf["row"]], float)


def optimize_groups(cov: DataFrame, mu: DataFrame | None, problem: Problem, keys: list[str] | None = None) -> DataFrame:
    """``cov`` (keys, asset_i, asset_j, cov) and ``mu`` (keys, asset, mu): for each group the keys,
    asset, weight and the diagnostic record (the same for all assets of a group). A group is as large
    as its assets squared. Without keys each path, if there is one, is a group. The random starts of
    the checks are seeded by the keys."""
    keys = [c for c in ("path",) if c in cov.columns] if keys is None else keys
    cells = _square_rows(cov, keys)
    cells = cells.join(mu, [*keys, "asset"], "left") if mu is not None else cells.withColumn("mu", F.lit(None).cast("double"))

    no_mu = mu is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset", ignore_index=True)
        seed = zlib.crc32(repr([str(pdf[k].iloc[0]) for k in keys]).encode())
        w, record = optimize(_matrix(pdf), None if no_mu else pdf["mu"].to_numpy(float), problem, seed)
        out = pdf[[*keys, "asset"]].copy()
        out["weight"] = [None if np.isnan(x) else float(x) for x in w]
        for k, v in record.items():
            out[k] = v
        return out

    types = dict(cov.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "asset string, weight double", DIAGNOSTICS])
    return cells.groupBy(*(keys or [F.lit(0).alias("_")])).applyInPandas(run, schema)


def closed_form(cov: DataFrame) -> DataFrame:
    """(path,) asset, weight of least variance without bounds: inverse(cov) 1, scaled to sum to 1."""
    keys = [c for c in ("path",) if c in cov.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset", ignore_index=True)
        x = np.linalg.solve(_matrix(pdf), np.ones(len(pdf)))
        return pdf[[*keys, "asset"]].assign(weight=x / x.sum())

    schema = ", ".join([*(f"{k} int" for k in keys), "asset string, weight double"])
    return _square_rows(cov, keys).groupBy(*(keys or [F.lit(0).alias("_")])).applyInPandas(run, schema)


def diagnostics(solved: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each group."""
    return solved.select(*keys, *NAMES).distinct()


def factor_model(coefficients: DataFrame, fits: DataFrame, factors: DataFrame) -> dict[str, DataFrame]:
    """What the estimators' factor_model method takes, from a model with arrays: of the whole sample,
    or the last coefficients of a rolling one."""
    last = latest_model(coefficients) if "time_idx" in coefficients.columns else coefficients
    return {"coefficients": last, "betas": array_betas(last), "fits": fits, "factors": factors}


@dataclass
class MeanEstimator:
    """Means of returns (time_idx, asset, ret), or of a factor model passed to ``fit``; by path if
    they have one. With a halflife, a factor model's means are weighted too."""

    method: str = "hist"
    halflife: float | None = None
    shrinkage: float = 0.0
    target: str = "grand_mean"
    mean_: DataFrame | None = field(default=None, init=False)

    def fit(self, returns: DataFrame | None = None, model: dict[str, DataFrame] | None = None) -> MeanEstimator:
        if self.method == "factor_model":
            checks.check_model(model)
            mu = moments.mean_factor_model(model["betas"], model["factors"], model["fits"], model["coefficients"], self.halflife)
        elif self.method in ("hist", "ewma"):
            checks.check_rows(returns, "asset")
            mu = moments.mean_hist(returns) if self.method == "hist" else moments.mean_ewma(returns, self.halflife)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        self.mean_ = moments.shrink_mean(mu, self.shrinkage, self.target)
        return self


@dataclass
class CovarianceEstimator:
    method: str = "hist"
    halflife: float | None = None
    shrinkage: float = 0.0
    target: str = "diagonal"
    ridge: float = 1e-8
    covariance_: DataFrame | None = field(default=None, init=False)

    def fit(self, returns: DataFrame | None = None, model: dict[str, DataFrame] | None = None) -> CovarianceEstimator:
        if self.method == "factor_model":
            checks.check_model(model)
            cov = moments.cov_factor_model(model["betas"], moments.factor_cov(model["factors"], self.halflife), model["fits"], self.halflife)
        elif self.method in ("hist", "ewma"):
            checks.check_rows(returns, "asset")
            cov = moments.cov_hist(returns) if self.method == "hist" else moments.cov_ewma(returns, self.halflife)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        self.covariance_ = moments.stabilized(moments.shrink_cov(cov, self.shrinkage, self.target), self.ridge)
        return self


def compute_mu(returns: DataFrame | None = None, model: dict[str, DataFrame] | None = None, **settings: Any) -> DataFrame:
    """asset, mu of a ``MeanEstimator`` with ``settings``."""
    return MeanEstimator(**settings).fit(returns, model).mean_


def compute_cov(returns: DataFrame | None = None, model: dict[str, DataFrame] | None = None, **settings: Any) -> DataFrame:
    """asset_i, asset_j, cov of a ``CovarianceEstimator`` with ``settings``; a value that is missing
    or not finite fails."""
    return checks.finite(CovarianceEstimator(**settings).fit(returns, model).covariance_)


@dataclass
class PortfolioOptimizer:
    """Means, covariance, weights, in one object: ``fit(...).get_weights()``."""

    mean: MeanEstimator = field(default_factory=MeanEstimator)
    covariance: CovarianceEstimator = field(default_factory=CovarianceEstimator)
    problem: Problem = field(default_factory=Problem)
    solved_: DataFrame | None = field(default=None, init=False)

    def fit(self, returns: DataFrame | None = None, model: dict[str, DataFrame] | None = None) -> PortfolioOptimizer:
        self.mean.fit(returns, model)
        self.covariance.fit(returns, model)
        self.solved_ = optimize_groups(self.covariance.covariance_, self.mean.mean_, self.problem)
        return self

    def get_weights(self) -> DataFrame:
        return self.solved_.select(*[c for c in ("path",) if c in self.solved_.columns], "asset", "weight")


#: Older option -> where it goes now; those in LEGACY depend on others.
CLASSIC = {
    "ewma_mu_halflife": "mean.halflife", "mu_shrinkage": "mean.shrinkage", "ewma_cov_halflife": "covariance.halflife", "cov_shrinkage": "covariance.shrinkage",
    "obj": "problem.objective", "rf": "problem.risk_free_rate", "l": "problem.risk_aversion", "budget": "problem.budget", "gross_budget": "problem.gross_budget", "upperlng": "problem.max_weight",
}
LEGACY = ("method_mu", "method_cov", "sht", "budgetsht", "uppersht")


def classic_optimizer(**options: Any) -> PortfolioOptimizer:
    """A ``PortfolioOptimizer`` from the older option names; others raise ValueError. ``sht`` allows
    short positions: without it the long side has the whole budget, with it ``budgetsht`` bounds the
    short side and ``uppersht`` each short weight."""
    if unknown := sorted(set(options) - set(CLASSIC) - set(LEGACY)):
        raise ValueError(f"unknown options: {unknown}")
    given: dict[str, dict[str, Any]] = {"mean": {}, "covariance": {}, "problem": {}}
    for option, to in CLASSIC.items():
        if option in options:
            part, _, name = to.partition(".")
            given[part][name] = options[option]
    for option, part in (("method_mu", "mean"), ("method_cov", "covariance")):
        method = options.get(option, "hist")
        given[part]["method"] = "ewma" if method.startswith("ewma") else method
    short, floor = bool(options.get("sht")), options.get("uppersht")
    sides = {"short_budget": options.get("budgetsht"), "min_weight": None if floor is None else -floor} if short else {"long_budget": options.get("budget", 1.0)}
    return PortfolioOptimizer(MeanEstimator(**given["mean"]), CovarianceEstimator(**given["covariance"]), Problem(long_only=not short, **sides, **given["problem"]))


def sample_weights(assets: DataFrame, factors: DataFrame, problem: Problem, shrinkage: float = 0.1, ridge: float = 1e-8) -> DataFrame:
    """path, asset, weight and record of each path (path, time, time_idx, label, ret) from the
    covariance of a factor model over its whole sample, for any number of factors."""
    from .regression import sample_ols_any

    coefficients, fits = (x.persist() for x in sample_ols_any(assets, factors))  # each is read several times
    cov = compute_cov(model=factor_model(coefficients, fits, factors), method="factor_model", shrinkage=shrinkage, ridge=ridge)
    return optimize_groups(cov, None, problem)


def slices(rebalances: DataFrame) -> DataFrame:
    """``rebalances`` ((path,) time, window_start) as one row for each of its days: at, time. Rows of a
    panel meet only the rebalances that hold them, by an equality on (path and) time."""
    keys = [c for c in ("path",) if c in rebalances.columns]
    return rebalances.select(*keys, F.col("time").alias("at"), F.explode(F.sequence("window_start", "time")).alias("time"))


def rolling_weights(model: DataFrame, factors: DataFrame, rebalances: DataFrame, problem: Problem, shrinkage: float = 0.1, ridge: float = 1e-8) -> DataFrame:
    """Weights at each rebalance of each path from a factor-model covariance.

    ``model`` is that of ``rolling_ols_any``; ``rebalances`` has path, time, window_start. Each row
    goes only to the rebalances whose slice holds its date (``slices``). Betas are the last that the
    slice has. Residuals of a first slice may be a single one: their variance is then 0. Problems of one
    path and run of dates are solved in order of time, each warm-started from the one before.
    """
    days = slices(rebalances)
    inside = lambda df: df.join(days, ["path", "time"])
    f = factors.select("path", "time", "factor", "ret")
    held = inside(f)
    pairs = held.withColumnRenamed("ret", "x").join(held.select("path", "at", "time", F.col("factor").alias("factor_p"), F.col("ret").alias("y")), ["path", "at", "time"])
    sigma = pairs.groupBy("path", "at", "factor", "factor_p").agg(F.covar_samp("x", "y").alias("cov"))
    # the last betas of the slice, and the residuals' variance
    own = inside(model.select("path", "time", "asset", "residual", "betas")).groupBy("path", "at", "asset").agg(
        F.coalesce(F.var_samp("residual"), F.lit(0.0)).alias("d"), F.max_by("betas", F.when(F.col("betas").isNotNull(), F.col("time"))).alias("betas")
    )
    square = F.sort_array(F.collect_list(F.struct("factor", "factor_p", "cov")))
    sigma = sigma.groupBy("path", "at").agg(square.alias("sigma"))
    starts = rebalances.select("path", F.col("time").alias("at"), "window_start")
    rows = own.filter("betas is not null").join(sigma, ["path", "at"]).join(starts, ["path", "at"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        warm, out = Warm(), []
        for _, one in pdf.groupby("at", sort=True):
            out.append(solved(one.sort_values("asset", ignore_index=True), warm))
        return pd.concat(out, ignore_index=True)

    def solved(pdf: pd.DataFrame, warm: Warm) -> pd.DataFrame:
        b, k = np.stack(pdf["betas"].to_list()), len(pdf["betas"].iloc[0])
        s = np.array([x["cov"] for x in pdf["sigma"].iloc[0]], float).reshape(k, k)
        c = b @ s @ b.T + np.diag(pdf["d"].to_numpy(float))
        c = (1 - shrinkage) * c + shrinkage * np.diag(np.diag(c))
        c = 0.5 * (c + c.T) + ridge * np.eye(len(c))
        seed = zlib.crc32(f"{pdf['path'].iloc[0]}|{pdf['at'].iloc[0]}".encode())
        w, record = optimize(c, None, replace(problem, raise_on_failure=False), seed, warm, list(pdf["asset"]))
        out = pdf[["path", "at", "window_start", "asset"]].copy()
        out["weight"] = [None if np.isnan(x) else float(x) for x in w]
        for key, v in record.items():
            out[key] = v
        return out

    # rebalances of a run of dates follow one another in a task, each from where the last one ended
    dated = rows.withColumn("_run", F.floor(F.datediff("at", F.lit("1970-01-01").cast("date")) / RUN_DAYS))
    return dated.groupBy("path", "_run").applyInPandas(run, f"path int, at date, window_start date, asset string, weight double, {DIAGNOSTICS}").withColumnRenamed("at", "time")


__all__ = [
    "CovarianceEstimator", "MeanEstimator", "PortfolioOptimizer", "Problem", "classic_optimizer", "closed_form", "compute_cov", "compute_mu", "diagnostics", "factor_model",
    "optimize", "optimize_groups", "rolling_weights", "sample_weights", "slices",
]
