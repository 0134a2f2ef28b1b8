import itertools

import numpy as np
import pytest

from driftpanel.functions import solver
from driftpanel.operators.portfolio import Problem, Warm, classic_optimizer, optimize

#: A small panel of three assets.
A = np.array([[0.010, 0.005, -0.002], [0.011, 0.004, -0.001], [0.009, 0.006, 0.000], [0.008, 0.003, 0.001], [0.012, 0.002, -0.003], [0.007, 0.005, 0.002]])
COV = np.cov(A, rowvar=False)
SHRUNK = 0.9 * COV + 0.1 * np.diag(np.diag(COV)) + 1e-8 * np.eye(3)


def test_min_variance_of_the_small_panel():
    w, record = optimize(SHRUNK, None, Problem())
    assert np.allclose(w, [0.44705882, 0.15882353, 0.39411765], atol=1e-6)
    assert abs(record["obj_value"] - 0.06942413) < 1e-7 and abs(record["cond_number"] - 13.2175) < 1e-3
    assert record["success"] and record["constraint_violation"] == 0 and record["obj_improvement"] < 0


def test_long_short_constraints():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.05, 0.02], [0.0, 0.02, 0.06]])
    w, _ = optimize(cov, np.array([0.08, 0.05, 0.03]), Problem("mean_variance", long_only=False, gross_budget=1.4, short_budget=0.2, min_weight=-0.2, max_weight=0.9))
    assert abs(w.sum() - 1) < 1e-6 and np.abs(w).sum() <= 1.4 + 1e-6 and -np.minimum(w, 0).sum() <= 0.2 + 1e-6


@pytest.mark.parametrize("objective", ["min_variance", "mean_variance", "max_sharpe"])
def test_no_feasible_neighbour_is_better(objective):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    cov, mu = np.cov(x, rowvar=False), rng.normal(0.1, 0.1, 6)
    w, record = optimize(cov, mu, Problem(objective))
    s, m = cov / (np.trace(cov) / 6), mu / (np.trace(cov) / 6)
    value = {"min_variance": lambda w: w @ s @ w, "mean_variance": lambda w: w @ s @ w - m @ w, "max_sharpe": lambda w: -(m @ w) / np.sqrt(w @ s @ w)}[objective]
    for _ in range(300):
        other = rng.dirichlet(np.ones(6))
        near = w + 0.01 * (other - w)
        assert value(near) >= value(w) - 1e-8
    assert abs(record["obj_value"] - value(w)) < 1e-9


def test_errors():
    with pytest.raises(ValueError):
        optimize(np.array([[1.0, 0.5], [0.1, 1.0]]), None, Problem())
    with pytest.raises(ValueError):
        optimize(-np.eye(2), None, Problem())
    with pytest.raises(ValueError):
        optimize(np.eye(2), None, Problem(short_budget=0.1))
    with pytest.raises(ValueError):
        optimize(np.eye(2), None, Problem("other"))
    with pytest.raises(ValueError):
        classic_optimizer(colour="red")


def test_infeasible_is_reported():
    w, record = optimize(np.eye(3), None, Problem(max_weight=0.1, raise_on_failure=False))
    assert np.isnan(w).all() and not record["success"]


def test_starts_end_at_the_same_weights():
    rng = np.random.default_rng(12)
    for k in range(40):
        n = int(rng.integers(2, 25))
        x = rng.normal(size=(n + 5, n)) * rng.uniform(0.2, 3, n)
        w, record = optimize(np.cov(x, rowvar=False) + 1e-8 * np.eye(n), rng.normal(0, 0.1, n), Problem(("min_variance", "mean_variance")[k % 2]), k)
        assert record["success"] and record["obj_diff_init"] < 1e-6 and record["weight_diff_init"] < 1e-2


def by_sets(cov, mu, risk_aversion):
    """Long-only weights by trying each set of assets."""
    best = None
    for k in range(1, len(cov) + 1):
        for held in map(list, itertools.combinations(range(len(cov)), k)):
            x, y = np.linalg.solve(cov[np.ix_(held, held)], np.column_stack([np.ones(k), mu[held]])).T
            w = np.zeros(len(cov))
            w[held] = (y + (2 * risk_aversion - y.sum()) / x.sum() * x) / (2 * risk_aversion)
            value = risk_aversion * w @ cov @ w - mu @ w
            if (w >= -1e-12).all() and (best is None or value < best[0]):
                best = value, w
    return best[1]


def market(rng, n, rows=60):
    x = rng.normal(size=(rows, 1)) * 0.02 + rng.normal(size=(rows, n)) * rng.uniform(0.005, 0.03, n)
    return np.cov(x, rowvar=False) + 1e-8 * np.eye(n)


def test_active_set_is_exact():
    rng = np.random.default_rng(0)
    for k in range(120):
        n = int(rng.integers(1, 8))
        cov, mu = np.atleast_2d(market(rng, n)) if n > 1 else np.eye(1), rng.normal(0, 0.002, n) * (k % 2)
        w, record = optimize(cov, mu, Problem("mean_variance", risk_aversion=2.0))
        assert record["success"] and np.abs(w - by_sets(cov, mu, 2.0)).max() < 1e-9


def test_warm_starts_end_at_the_same_weights_in_fewer_steps():
    rng, warm, steps = np.random.default_rng(2), Warm(), []
    x = rng.normal(size=(400, 1)) * 0.02 + rng.normal(size=(400, 8)) * rng.uniform(0.005, 0.03, 8)
    for i in range(0, 300, 4):
        cov = np.cov(x[i : i + 52], rowvar=False) + 1e-8 * np.eye(8)
        w, one = optimize(cov, None, Problem(max_weight=0.4), i, warm, list("abcdefgh"))
        cold, two = optimize(cov, None, Problem(max_weight=0.4), i)
        assert np.abs(w - cold).max() < 1e-10
        steps.append((one["n_iter"], two["n_iter"]))
    assert np.mean([a for a, _ in steps]) < 0.8 * np.mean([b for _, b in steps])
    other, _ = optimize(np.eye(2), None, Problem(), 0, warm, ["x", "y"])  # other assets: a cold start
    assert np.allclose(other, 0.5) and warm.names == ["x", "y"]
    optimize(np.eye(2), None, Problem(max_weight=0.1, raise_on_failure=False), 0, warm, ["x", "y"])
    assert warm.weights is None


def test_degenerate_faces_end():
    rng = np.random.default_rng(6)
    for n in (3, 6, 12):
        same = np.full((n, n), 0.04) + 1e-8 * np.eye(n)  # all assets alike
        w, record = optimize(same, None, Problem(max_weight=1.0 / n))  # one point is feasible
        assert record["success"] and np.allclose(w, 1 / n)
        cov = market(rng, n)
        g, h = np.vstack([-np.eye(n), -np.eye(n), np.eye(n)]), np.r_[np.zeros(2 * n), np.ones(n)]  # each bound twice
        start = np.eye(n)[0]
        x, ok, _, _ = solver.active_set(2 * cov, np.zeros(n), np.ones((1, n)), np.ones(1), g, h, start, tuple(range(3 * n)))
        assert ok and np.abs(x - by_sets(cov, np.zeros(n), 1.0)).max() < 1e-9


def test_certificate_tells_a_wrong_answer():
    p, q, a, b, g, h = np.eye(2), np.zeros(2), np.ones((1, 2)), np.ones(1), -np.eye(2), np.zeros(2)
    assert solver.certificate(p, q, a, b, g, h, np.array([0.5, 0.5]), np.array([-0.5]), np.zeros(2)) < 1e-15
    for x, y, z in (([0.6, 0.4], -0.5, [0, 0]), ([0.5, 0.6], -0.5, [0, 0]), ([0.5, 0.5], -0.5, [-1, 0]), ([0.5, 0.5], -0.5, [1, 0])):
        assert solver.certificate(p, q, a, b, g, h, np.array(x), np.array([y]), np.array(z, float)) > 0.05


def test_budgets_of_sides_are_solved_exactly():
    rng = np.random.default_rng(8)
    problem = Problem("mean_variance", long_only=False, gross_budget=1.4, short_budget=0.2, min_weight=-0.2, max_weight=0.9)
    for k in range(20):
        cov, mu = np.cov(rng.normal(size=(60, 6)), rowvar=False), rng.normal(0, 0.5, 6)
        w, record = optimize(cov, mu, problem, k)
        assert record["success"] and not record["constraint_violation"] and record["obj_diff_init"] < 1e-7


def test_an_ill_conditioned_covariance_warns():
    with pytest.warns(UserWarning, match="ill-conditioned"):
        optimize(np.diag([1.0, 1e-9]), None, Problem())


def test_older_options_map_to_the_new_ones():
    long = classic_optimizer(method_mu="ewma1", ewma_mu_halflife=5.0, mu_shrinkage=0.1, method_cov="ewma", ewma_cov_halflife=7.0, cov_shrinkage=0.2, obj="mean_variance", l=3.0, rf=0.01, budget=0.9, upperlng=0.5, uppersht=0.3, budgetsht=0.1)
    assert (long.mean.method, long.mean.halflife, long.mean.shrinkage) == ("ewma", 5.0, 0.1)
    assert (long.covariance.method, long.covariance.halflife, long.covariance.shrinkage) == ("ewma", 7.0, 0.2)
    assert long.problem == Problem("mean_variance", long_only=True, budget=0.9, long_budget=0.9, risk_free_rate=0.01, risk_aversion=3.0, max_weight=0.5)
    short = classic_optimizer(sht=True, budgetsht=0.3, uppersht=0.2, gross_budget=1.6)
    assert short.problem == Problem(long_only=False, gross_budget=1.6, short_budget=0.3, min_weight=-0.2)
    assert (short.mean.method, short.covariance.method) == ("hist", "hist") and classic_optimizer().problem.long_budget == 1.0
