"""DuckDB SQL for the queries of ``queries.py``, from shared table expressions."""

from __future__ import annotations

from .queries import BLOCK, EVERY, HALFLIFE, PATHS, REGIONS, SEED, SHRINKAGE, WINDOW

ITEMS = {
    "type": ("lineitem join part on l_partkey = p_partkey", "p_type"),
    "brand": ("lineitem join part on l_partkey = p_partkey", "p_brand"),
    "flag": ("lineitem", "l_returnflag"),
    "status": ("lineitem", "l_linestatus"),
    "region": ("lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey", "r_name"),
}


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 10) + 0 as {name or x}"


def prices(by: str, frequency: str = "week") -> str:
    source, series = ITEMS[by]
    return f"select date_trunc('{frequency}', l_shipdate::date)::date as time, {series} as series, sum(l_extendedprice) / sum(l_quantity) as price from {source} group by all"


def log_returns(p: str, px: str) -> str:
    """Tables {p}_l (all rows) and {p}_r (complete dates)."""
    return f"""{p}_p as ({px}),
{p}_d as (select time, series, price from (select distinct time from {p}_p) cross join (select distinct series from {p}_p) left join {p}_p using (time, series)),
{p}_l as (select time, series, case when price > 0 and lag(price) over w > 0 then ln(price / lag(price) over w) end as ret from {p}_d window w as (partition by series order by time)),
{p}_r as (select time, series, ret from (select *, count(ret) over (partition by time) as c from {p}_l) where c = (select count(distinct series) from {p}_d))"""


def panels(factor: str = "flag", by: str = "type") -> str:
    """Tables a (time, time_idx, asset, ret) and f (time, time_idx, factor, ret)."""
    return f"""with {log_returns("pa", prices(by))}, {log_returns("pf", prices(factor))},
ti as (select time, row_number() over (order by time) - 1 as time_idx from (select time from pa_r intersect select time from pf_r)),
a as (select time, time_idx, series as asset, ret from pa_r join ti using (time)),
f as (select time, time_idx, series as factor, ret from pf_r join ti using (time))"""


WIDE = """wide as (select time, time_idx, max(case when factor = 'R' then ret end) as f1, max(case when factor = 'A' then ret end) as f2 from f group by all),
x as (select a.*, f1, f2 from a join wide using (time, time_idx))"""
BASE = f"{panels()},\n{WIDE}"
OLS1 = "covar_samp(ret, f1) / var_samp(f1)"
SAMPLE1 = f"k1 as (select asset, {OLS1} as b1, avg(ret) - {OLS1} * avg(f1) as alpha from x group by asset),\ns1 as (select x.*, b1, alpha, alpha + b1 * f1 as fitted, ret - (alpha + b1 * f1) as residual from x join k1 using (asset))"
TWO = "(covar_samp(ret, f1) * var_samp(f2) - covar_samp(ret, f2) * covar_samp(f1, f2)) / (var_samp(f1) * var_samp(f2) - covar_samp(f1, f2) ** 2)"
OTHER = "(covar_samp(ret, f2) * var_samp(f1) - covar_samp(ret, f1) * covar_samp(f1, f2)) / (var_samp(f1) * var_samp(f2) - covar_samp(f1, f2) ** 2)"
SAMPLE2 = f"""k2 as (select asset, b1, b2, m - b1 * m1 - b2 * m2 as alpha from (select asset, {TWO} as b1, {OTHER} as b2, avg(ret) as m, avg(f1) as m1, avg(f2) as m2 from x group by asset)),
s2 as (select x.*, alpha + b1 * f1 + b2 * f2 as fitted, ret - (alpha + b1 * f1 + b2 * f2) as residual, alpha from x join k2 using (asset)),
f2 as (select * from f where factor in ('R', 'A')),
sg as (select l.factor, q.factor as factor_p, covar_samp(l.ret, q.ret) as cov from f2 l join f2 q using (time_idx) group by all),
bt as (select asset, 'R' as factor, b1 as beta from k2 union all select asset, 'A', b2 from k2),
ct as (select b.asset, b.factor, b.beta * sum(cov * o.beta) as contribution from bt b join sg using (factor) join bt o on o.asset = b.asset and o.factor = factor_p group by b.asset, b.factor, b.beta),
rk as (select asset, sys_var, idio_var, sys_var + idio_var as total_var, case when sys_var + idio_var > 0 then sys_var / (sys_var + idio_var) end as sys_share
  from (select asset, sum(contribution) as sys_var from ct group by asset) join (select asset, var_samp(residual) as idio_var from s2 group by asset) using (asset))"""
OVER = f"over (partition by {{key}}asset order by time_idx rows {WINDOW - 1} preceding)"


def over(expr: str, key: str = "") -> str:
    """Every aggregate of ``expr`` over the trailing window."""
    import re

    return re.sub(r"\b((?:covar_samp|var_samp|avg|sum|count)\([^()]*\))", lambda m: f"{m[1]} {OVER.format(key=key)}", expr)


def rolling(expr: str, key: str = "") -> str:
    return f"case when {over('count(ret)', key)} = {WINDOW} then {over(expr, key)} end"


def rolling1(table: str = "x", key: str = "") -> str:
    return f"""q1 as (select *, {rolling(OLS1, key)} as b1, {rolling("avg(ret)", key)} as m, {rolling("avg(f1)", key)} as m1 from {table}),
r1 as (select *, m - b1 * m1 as alpha, (m - b1 * m1) + b1 * f1 as fitted, ret - ((m - b1 * m1) + b1 * f1) as residual from q1)"""


RISK1 = f"""v1 as (select time, asset, case when {over("count(f1)")} = {WINDOW} then b1 * b1 * {over("var_samp(f1)")} end as sys_var,
  case when {over("count(residual)")} = {WINDOW} then {over("var_samp(residual)")} end as idio_var from r1),
risk1 as (select *, sys_var + idio_var as total_var, case when sys_var + idio_var > 0 then sys_var / (sys_var + idio_var) end as sys_share from v1)"""
DRAWS = f"""n as (select max(time_idx) + 1 as n from a),
draws as (select path, block, cast('0x' || substr(md5(path::varchar || '-' || block::varchar || '-{SEED}'), 1, 8) as bigint) % (n - {BLOCK} + 1) as start
  from n, range({PATHS}) p(path), lateral (select unnest(range(cast(ceil(n / {BLOCK}) as bigint))) as block)),
moves as (select path, block * {BLOCK} + o as time_idx, start + o as source_idx from draws, range({BLOCK}) q(o)),
ba as (select path, ti.time, moves.time_idx, asset, ret, source_idx from moves join ti using (time_idx) join a on a.time_idx = source_idx),
bf as (select path, ti.time, moves.time_idx, factor, ret, source_idx from moves join ti using (time_idx) join f on f.time_idx = source_idx),
ha as (select * from ba union all select -1, time, time_idx, asset, ret, time_idx from a),
hf as (select * from bf union all select -1, time, time_idx, factor, ret, time_idx from f)"""
BOOT = f"{panels()},\n{DRAWS}"
EQUAL = f"""w as (select path, time, asset, 1.0 / count(*) over (partition by path, time) as weight from ha where time_idx >= {WINDOW - 1} and (time_idx - {WINDOW - 1}) % {EVERY} = 0),
h0 as (select ha.*, last_value(weight ignore nulls) over (partition by path, asset order by time_idx rows unbounded preceding) as held from ha left join w using (path, time, asset)),
h1 as (select *, lag(held) over (partition by path, asset order by time_idx) as held1 from h0),
dy as (select path, time, time_idx, sum(held1 * (exp(ret) - 1)) as r from h1 group by all having count(held1) = count(*)),
cum as (select path, time, time_idx, (exp(sum(ln(1 + r)) over (partition by path order by time_idx rows unbounded preceding)) - 1) * 100 as cumulative from dy)"""
ALPHA = f"(1 - exp(-ln(2) / {HALFLIFE}))"
EW = f"""ew as (select *, case when time_idx = 0 then pow(1 - {ALPHA}, n - 1) else {ALPHA} * pow(1 - {ALPHA}, n - 1 - time_idx) end as w from a, (select max(time_idx) + 1 as n from a))"""
COV = "cv as (select p.asset as asset_i, q.asset as asset_j, covar_samp(p.ret, q.ret) as cov from a p join a q using (time_idx) group by all)"
SHRUNK = f"{COV},\nsh as (select asset_i, asset_j, (1 - {SHRINKAGE}) * cov + {SHRINKAGE} * case when asset_i = asset_j then cov else 0 end as cov from cv)"
STABLE = f"{SHRUNK},\nst as (select s.asset_i, s.asset_j, 0.5 * (s.cov + t.cov) + case when s.asset_i = s.asset_j then 1e-8 else 0 end as cov from sh s join sh t on s.asset_i = t.asset_j and s.asset_j = t.asset_i)"
MONDAY = "date '1970-01-05'"


def business_day_before(day: str, n: int) -> str:
    since = f"({day} - {MONDAY})"
    index = f"((({since}) // 7) * 5 + least(({since}) % 7, 5) - {n})"
    return f"({MONDAY} + cast((({index}) // 5) * 7 + ({index}) % 5 as integer))"


def orthogonal(rolling: bool, base: str | None = None, count: int = REGIONS, key: str = "", assets: str = "a", factors: str = "f") -> str:
    """Tables for any number of factors, here the regions, one set for each end t of a window (one
    for the whole sample, t = -1): o, factors made orthogonal one after the other (q), and their
    projections r on those before; np, sums of q; cf, coefficients alpha, b1, ... by t and asset; and
    fit, the rows of the last date (all, for the sample) with fitted and residual. ``key`` ("path, ")
    keeps the paths of ``assets`` and ``factors`` apart."""
    k = range(1, count + 1)
    same = " and ".join(f"e.{x} = w0.{x}" for x in key.replace(",", "").split()) or "true"
    wide = ", ".join(f"max(case when i = {j} then ret end) as f{j}" for j in k)
    out = [f"fn as (select factor, row_number() over (order by factor) as i from (select distinct factor from {factors}))", f"w0 as (select {key}time_idx, {wide} from {factors} join fn using (factor) group by {key}time_idx)"]
    if rolling:
        out.append(f"o0 as (select e.time_idx as t, w0.* from w0 join (select {key}time_idx from w0 where time_idx >= {WINDOW - 1}) e on {same} and w0.time_idx between e.time_idx - {WINDOW - 1} and e.time_idx)")
    else:
        out.append("o0 as (select -1 as t, * from w0)")
    for j in k:
        rs = "".join(f", sum(f{j} * q{m}) over d / sum(q{m} * q{m}) over d as r{j}_{m}" for m in range(1, j))
        minus = "".join(f" - r{j}_{m} * q{m}" for m in range(1, j))
        out.append(f"p{j} as (select *, avg(f{j}) over d as a{j}{rs} from o{j - 1} window d as (partition by {key}t)), o{j} as (select *, f{j} - a{j}{minus} as q{j} from p{j})")
    rs = [f"r{j}_{m}" for j in k for m in range(1, j)]
    keep = ", ".join(f"max({c}) as {c}" for c in [*rs, *(f"a{j}" for j in k)])
    out.append(f"np as (select {key}t, count(*) as rows_, {keep}, {', '.join(f'sum(q{j} * q{j}) as s{j}' for j in k)} from o{count} group by {key}t)")
    out.append(f"cs as (select {key}t, asset, avg(ret) as m, {', '.join(f'sum(ret * q{j}) / sum(q{j} * q{j}) as c{j}' for j in k)} from o{count} join {assets} using ({key}time_idx) group by {key}t, asset)")
    last, steps = f"cs join np using ({key}t)", []
    for j in reversed(k):  # back substitution
        steps.append(f"b{j}_ as (select *, c{j}{''.join(f' - r{m}_{j} * b{m}' for m in range(j + 1, count + 1))} as b{j} from {last})")
        last = f"b{j}_"
    out += steps
    model = " + ".join(f"b{j} * f{j}" for j in k)
    out.append(f"cf as (select *, m{''.join(f' - b{j} * a{j}' for j in k)} as alpha from {last})")
    paths = "".join(f" and cf.{x} = w0.{x}" for x in key.replace(",", "").split())
    same = "".join(f" and x.{v} = cf.{v}" for v in key.replace(",", "").split())
    at = "cf.t = w0.time_idx" if rolling else "true"
    out.append(f"fit as (select cf.*, x.time, x.time_idx, ret, alpha + {model} as fitted, ret - (alpha + {model}) as residual from cf join w0 on {at}{paths} join {assets} x on x.time_idx = w0.time_idx and x.asset = cf.asset{same})")
    # cov(f_j, fitted) from the orthogonal parts
    cov = {j: " + ".join([f"c{j} * s{j}", *(f"c{m} * r{j}_{m} * s{m}" for m in range(1, j))]) for j in k}
    contributions = ", ".join(f"b{j} * ({cov[j]}) / (rows_ - 1) as k{j}" for j in k)
    out.append(f"ko as (select *, {contributions} from cf)")
    return f"{base or panels('region')},\n" + ",\n".join(out)


def long_only(keys: str, cov: str, mu: str | None = None, risk_aversion: float = 1.0) -> str:
    """Table sw (keys, asset, weight): the weights of at least 0 that sum to 1 and minimise risk_aversion w'Cw - mu'w,
    exactly. ``cov`` names a table (keys, asset_i, asset_j, cov), ``mu`` one of (keys, asset, mu).

    For each set of assets that may hold a weight (bits of s) the others' rows become those of the
    identity, Gauss-Jordan steps solve C x = 1 and C y = mu, and of the sets whose weights are not
    negative the one of the least objective holds the answer."""
    both = f"{keys}, " if keys else ""
    on = f"using ({both}asset)"
    means = mu or f"(select distinct {both}asset_i as asset, 0.0::double as mu from {cov})"
    by = f"group by {keys}" if keys else ""
    two = 2 * risk_aversion
    inside = "(s >> (i - 1)) & 1 = 1"
    return f"""gr as (select {both}asset_i as asset, list(cov order by asset_j) as row from {cov} group by {both}asset_i),
gm as (select {both}list(asset order by asset) as names, list(row order by asset) as c, list(mu order by asset) as mu, count(*)::int as n from gr join {means} m {on} {by}),
gs as (select *, [[case when {inside} and (s >> (j - 1)) & 1 = 1 then c[i][j] when i = j and not ({inside}) then 1.0 else 0.0 end for j in range(1, n + 1)]
    || [case when {inside} then 1.0 else 0.0 end, case when {inside} then mu[i] else 0.0 end] for i in range(1, n + 1)] as e
  from (select *, unnest(range(1, 1::bigint << n)) as s from gm)),
gj as (select {both}s, n, names, mu, 1 as k, e from gs
  union all select {both}s, n, names, mu, k + 1, [[case when i = k then e[k][j] / e[k][k] else e[i][j] - e[i][k] * e[k][j] / e[k][k] end for j in range(1, n + 3)] for i in range(1, n + 1)] from gj where k <= n),
gx as (select {both}n, names, mu, x, y, ({two} - list_sum(y)) / list_sum(x) as lam from (select {both}n, names, mu, [v[n + 1] for v in e] as x, [v[n + 2] for v in e] as y from gj where k = n + 1)),
gw as (select {both}n, names, mu, lam, [(y[i] + lam * x[i]) / {two} for i in range(1, n + 1)] as w from gx),
gb as (select {both}arg_min(names, lam - list_dot_product(mu, w)) as names, arg_min(w, lam - list_dot_product(mu, w)) as w from gw where list_min(w) >= -1e-12 {by}),
sw as (select {both}unnest(names) as asset, greatest(unnest(w), 0.0) as weight from gb)"""


BETAS = ", ".join(f"round(b{j}, 6) + 0 as b{j}" for j in range(1, REGIONS + 1))
SYS = " + ".join(f"k{j}" for j in range(1, REGIONS + 1))


def rounded(digits: int, x: str, name: str) -> str:
    return f"round({x}, {digits}) + 0 as {name}"


RISK_COLUMNS = ", ".join([rounded(9, "sys_var", "sys_var"), rounded(9, "idio_var", "idio_var"), rounded(9, "sys_var + idio_var", "total_var"), rounded(6, "case when sys_var + idio_var > 0 then sys_var / (sys_var + idio_var) end", "sys_share")])
ROLLING_RISK = f"""rr as (select fit.time, fit.asset, {SYS} as sys_var, case when count(residual) over w = {WINDOW} then var_samp(residual) over w end as idio_var
  from fit join (select t, asset, {", ".join(f"k{j}" for j in range(1, REGIONS + 1))} from ko) q using (t, asset) window w as (partition by fit.asset order by fit.time_idx rows {WINDOW - 1} preceding))"""
#: The five-factor model's covariance: B Sigma B' from the orthogonal parts.
PARTS = {j: f"(b{j} + {' + '.join(f'r{m}_{j} * b{m}' for m in range(j + 1, REGIONS + 1))})" if j < REGIONS else f"b{j}" for j in range(1, REGIONS + 1)}
MODEL_COV = f"""ov as (select asset, rows_, {", ".join(f"{PARTS[j]} as g{j}, s{j}" for j in PARTS)} from cf),
rv as (select asset, var_samp(residual) as d, avg(residual) as e from fit group by asset),
mc as (select x.asset as asset_i, y.asset as asset_j, ({" + ".join(f"x.g{j} * y.g{j} * x.s{j}" for j in PARTS)}) / (x.rows_ - 1) + case when x.asset = y.asset then d else 0 end as cov from ov x cross join ov y join rv on rv.asset = x.asset)"""

PAIR_COV = """k as (select min(asset_i) as one, max(asset_i) as two from st), v as (select one, two, (select cov from st where asset_i = one and asset_j = one) as v1, (select cov from st where asset_i = two and asset_j = two) as v2,
  (select cov from st where asset_i = one and asset_j = two) as c, (select avg(ret) from a where asset = one) as m1, (select avg(ret) from a where asset = two) as m2 from k)"""
PAIR = f"{panels(by='status')},\n{STABLE},\n{PAIR_COV}"


def pair(w: str, base: str = PAIR) -> str:
    """Both weights, given that of the first asset."""
    return f"{base}, w as (select one, two, {w} as w from v) select one as asset, round(w, 4) + 0 as weight from w union all select two, round(1 - w, 4) + 0 from w"


SHARPE = """(select w from (select unnest([0.0, 1.0, case when (m1 * v2 - m2 * c) + (m2 * v1 - m1 * c) <> 0 then greatest(0.0, least(1.0, (m1 * v2 - m2 * c) / ((m1 * v2 - m2 * c) + (m2 * v1 - m1 * c)))) end]) as w)
  where w is not null order by (m1 * w + m2 * (1 - w)) / sqrt(v1 * w * w + v2 * (1 - w) * (1 - w) + 2 * c * w * (1 - w)) desc limit 1)"""
EW_STABLE = f"""{EW}, cv as (select p.asset as asset_i, q.asset as asset_j, (sum(p.w * p.ret * q.ret) - sum(p.w * p.ret) * sum(p.w * q.ret)) / (1 - sum(p.w * p.w)) as cov from ew p join ew q using (time_idx) group by all),
sh as (select asset_i, asset_j, (1 - {SHRINKAGE}) * cov + {SHRINKAGE} * case when asset_i = asset_j then cov else 0 end as cov from cv),
st as (select asset_i, asset_j, cov + case when asset_i = asset_j then 1e-8 else 0 end as cov from sh)"""
PAIR_BOOT = f"{panels(by='status')},\n{DRAWS}, x as (select ha.*, hf.ret as f1 from ha join hf using (path, time_idx) where factor = 'R')"


def solved_pair(keys: str, source: str) -> str:
    """pw (keys, asset, weight) and pc (keys, cond, better) from ``source`` (keys, asset, b, s, d)."""
    both = ", ".join(f"l.{x}" for x in keys.split(", "))
    on = " and ".join(f"l.{x} = q.{x}" for x in keys.split(", "))
    return f"""pm as (select {both}, l.asset as one, q.asset as two, l.b * l.b * l.s + l.d + 1e-8 as v1, q.b * q.b * q.s + q.d + 1e-8 as v2, (1 - {SHRINKAGE}) * l.b * q.b * l.s as c
  from {source} l join {source} q on {on} and l.asset < q.asset),
pe as (select *, greatest(0, least(1, (v2 - c) / (v1 + v2 - 2 * c))) as w, sqrt((v1 - v2) * (v1 - v2) + 4 * c * c) as gap from pm),
pc as (select {keys}, (v1 + v2 + gap) / (v1 + v2 - gap) as cond, (v1 * w * w + v2 * (1 - w) * (1 - w) + 2 * c * w * (1 - w)) / ((v1 + v2 + 2 * c) / 4) - 1 as better from pe),
pw as (select {keys}, one as asset, w as weight from pe union all select {keys}, two, 1 - w from pe)"""


ROLLING_PAIR = f"""{PAIR_BOOT},
{rolling1(key="path, ")},
rb as (select path, time as at_, time - {7 * (WINDOW - 1)} as ws from (select distinct path, time, time_idx from ha) where time_idx >= {WINDOW - 1} and (time_idx - {WINDOW - 1}) % {EVERY} = 0),
sl as (select rb.path, at_ as time, asset, coalesce(var_samp(residual), 0) as d, var_samp(f1) as s, arg_max(b1, r1.time) filter (where b1 is not null) as b from rb join r1 on r1.path = rb.path and r1.time between ws and at_ group by all),
{solved_pair("path, time", "sl")}"""
SAMPLE_PAIR = f"""{PAIR_BOOT},
kp as (select path, asset, {OLS1} as b, avg(ret) - {OLS1} * avg(f1) as alpha, var_samp(f1) as s from x group by path, asset),
sl as (select path, asset, b, s, var_samp(ret - (alpha + b * f1)) as d from x join kp using (path, asset) group by all),
{solved_pair("path", "sl")}"""
HELD_PAIR = """h0 as (select ha.*, last_value(weight ignore nulls) over (partition by path, asset order by time_idx rows unbounded preceding) as held from ha left join pw using (path, time, asset)),
h1 as (select *, lag(held) over (partition by path, asset order by time_idx) as held1 from h0),
dy as (select path, time, time_idx, sum(held1 * (exp(ret) - 1)) as r from h1 group by all having count(held1) = count(*)),
cum as (select path, time, (exp(sum(ln(1 + r)) over (partition by path order by time_idx rows unbounded preceding)) - 1) * 100 as cumulative from dy)"""


def bands(value: str, digits: int) -> str:
    return ", ".join([*(rounded(digits, f"quantile_cont({value}, {p}) filter (path >= 0)", n) for p, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))), rounded(digits, f"max({value}) filter (path < 0)", "realized")])


#: The covariance of each rebalance of each path, from the three flags' rolling model.
ROLLING_ALL = f"""{orthogonal(True, f"{BOOT}", 3, "path, ", "ha", "hf")},
rb as (select path, time as at_, time_idx as at_idx, time - {7 * (WINDOW - 1)} as ws from (select distinct path, time, time_idx from ha) where time_idx >= {WINDOW - 1} and (time_idx - {WINDOW - 1}) % {EVERY} = 0),
sd as (select rb.path, at_, fit.asset, coalesce(var_samp(residual), 0) as d from rb join fit on fit.path = rb.path and fit.time between ws and at_ group by all),
wd as (select path, time, w0.* exclude (path) from w0 join (select distinct path, time, time_idx from ha) using (path, time_idx)),
sf as (select rb.path, at_, {", ".join(f"covar_samp(f{i}, f{j}) as s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))} from rb join wd on wd.path = rb.path and wd.time between ws and at_ group by all),
sb as (select rb.path, at_, asset, b1, b2, b3 from rb join cf on cf.path = rb.path and cf.t = at_idx),
rc as (select x.path, x.at_ as time, x.asset as asset_i, y.asset as asset_j, {" + ".join(f"x.b{i} * s{i}{j} * y.b{j}" for i in (1, 2, 3) for j in (1, 2, 3))} as c, d from sb x join sb y using (path, at_) join sf using (path, at_) join sd on sd.path = x.path and sd.at_ = x.at_ and sd.asset = x.asset),
rv_ as (select path, time, asset_i, asset_j, case when asset_i = asset_j then c + d + 1e-8 else (1 - {SHRINKAGE}) * c end as cov from rc),
{long_only("path, time", "rv_")}""".replace("with ", "with recursive ", 1)
SAMPLE_ALL = f"""{orthogonal(False, f"{BOOT}", 3, "path, ", "ha", "hf")},
sd as (select path, asset, var_samp(residual) as d from fit group by all),
sf as (select path, {", ".join(f"covar_samp(f{i}, f{j}) as s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))} from w0 group by path),
rc as (select x.path, x.asset as asset_i, y.asset as asset_j, {" + ".join(f"x.b{i} * s{i}{j} * y.b{j}" for i in (1, 2, 3) for j in (1, 2, 3))} as c, d from cf x join cf y using (path) join sf using (path) join sd on sd.path = x.path and sd.asset = x.asset),
rv_ as (select path, asset_i, asset_j, case when asset_i = asset_j then c + d + 1e-8 else (1 - {SHRINKAGE}) * c end as cov from rc),
{long_only("path", "rv_")}""".replace("with ", "with recursive ", 1)
STABLE_ALL = f"{panels()},\n{STABLE}".replace("with ", "with recursive ", 1)
EW_ALL = f"{panels()},\n{EW_STABLE}".replace("with ", "with recursive ", 1)
MU_ALL = "(select asset, avg(ret) as mu from a group by asset)"
SQL: dict[str, str] = {
    "minvar_closed_form": f"{STABLE_ALL}, {long_only('', 'st')}, gf as (select names, x from gj, lateral (select [v[n + 1] for v in e] as x) where k = n + 1 and s = (1::bigint << n) - 1) select unnest(names) as asset, round(unnest([v / list_sum(x) for v in x]), 8) + 0 as weight from gf",
    "minvar_weights": f"{STABLE_ALL}, {long_only('', 'st')} select asset, {rounded(6, 'weight', 'weight')} from sw",
    "mean_variance_weights": f"{STABLE_ALL}, {long_only('', 'st', MU_ALL, 2.0)} select asset, {rounded(6, 'weight', 'weight')} from sw",
    "optimizer_fit": f"{EW_ALL}, {long_only('', 'st')} select asset, {rounded(6, 'weight', 'weight')} from sw",
    "rolling_weights": f"{ROLLING_ALL} select path::int as path, time, asset, {rounded(6, 'weight', 'weight')} from sw",
    "weight_bands": f"{ROLLING_ALL} select time, asset, {bands('weight', 6)} from sw group by time, asset",
    "weight_std": f"{ROLLING_ALL} select time, asset, {rounded(6, 'stddev_samp(weight)', 'std')} from sw where path >= 0 group by time, asset",
    "top6_assets": f"{ROLLING_ALL} select asset, {rounded(6, 'avg(weight)', 'mean_weight')} from sw where path >= 0 group by asset order by avg(weight) desc, asset limit 6",
    "cumulative_portfolio": f"{ROLLING_ALL},\n{HELD_PAIR.replace('pw using', 'sw using')} select path::int as path, time, time_idx::int as time_idx, {rounded(6, 'cumulative', 'cumulative')} from cum join (select distinct path, time, time_idx from ha) using (path, time)",
    "sample_weights": f"{SAMPLE_ALL} select path::int as path, asset, {rounded(6, 'weight', 'weight')} from sw",
    "panel_vwap": f"select time, series, {r('price')} from ({prices('type')})",
    "panel_brand_month": f"select time, series, {r('price')} from ({prices('brand', 'month')})",
    "panel_region_day": f"select time, series, {r('price')} from ({prices('region', 'day')})",
    "log_returns": f"with {log_returns('p', prices('type', 'day'))} select time, series, {r('ret')} from p_l",
    "complete_dates": f"with {log_returns('p', prices('brand'))} select time, series, {r('ret')} from p_r",
    "aligned_returns": f"{panels('region')} select time, time_idx::int as time_idx, asset as series, {r('ret')} from a union all select time, time_idx::int, factor, {r('ret')} from f",
    "simple_returns": f"{panels()} select time, asset, {r('exp(ret) - 1', 'simple')} from a",
    "time_slice": f"{panels()} select time, asset, {r('ret')} from a where time between date '1996-01-01' and date '1996-12-31'",
    "wide_long_round_trip": f"select time, series, {r('price')} from ({prices('flag')})",
    "panel_checks": f"{panels()} select asset, count(*) as n_rows, count(distinct time) as n_times, 0::bigint as n_back from a group by asset",
    "business_windows": f"select time, {business_day_before('time', 251)} as window_start from (select distinct l_shipdate::date as time from lineitem)",
    "sample_ols_k1": f"{BASE},\n{SAMPLE1} select asset, {r('b1')}, {r('alpha')} from k1",
    "sample_ols_fit": f"{BASE},\n{SAMPLE1} select time, asset, {r('fitted')}, {r('residual')} from s1",
    "sample_ols_k2": f"{BASE},\n{SAMPLE2} select asset, {r('b1')}, {r('b2')}, {r('alpha')} from k2",
    "sample_ols_noint": f"{BASE} select asset, {r('sum(ret * f1) / sum(f1 * f1)', 'b1')} from x group by asset",
    "rolling_ols_k1": f"{BASE},\n{rolling1()} select time, asset, {r('alpha')}, {r('b1')}, {r('fitted')}, {r('residual')} from r1",
    "rolling_ols_k2": f"""{BASE}, q2 as (select *, {rolling(TWO)} as b1, {rolling(OTHER)} as b2, {rolling("avg(ret)")} as m, {rolling("avg(f1)")} as m1, {rolling("avg(f2)")} as m2 from x),
r2 as (select *, m - b1 * m1 - b2 * m2 as alpha from q2) select time, asset, {r('alpha')}, {r('b1')}, {r('b2')}, {r('alpha + b1 * f1 + b2 * f2', 'fitted')}, {r('ret - (alpha + b1 * f1 + b2 * f2)', 'residual')} from r2""",
    "rolling_ols_noint": f"{BASE}, q0 as (select *, {rolling('sum(xy) / sum(xx)')} as b1 from (select *, ret * f1 as xy, f1 * f1 as xx from x)) select time, asset, {r('b1')}, {r('b1 * f1', 'fitted')}, {r('ret - b1 * f1', 'residual')} from q0",
    "rolling_risk_k1": f"{BASE},\n{rolling1()},\n{RISK1} select time, asset, {r('sys_var')}, {r('idio_var')}, {r('total_var')}, {r('sys_share')} from risk1",
    "rolling_share": f"{BASE},\n{rolling1()},\n{RISK1} select asset, {r('avg(sys_share)', 'mean_share')}, {r('min(sys_share)', 'least')}, {r('max(sys_share)', 'most')} from risk1 where sys_share is not null group by asset",
    "factor_cov": f"{panels()} select l.factor, q.factor as factor_p, {r('covar_samp(l.ret, q.ret)', 'cov')} from f l join f q using (time_idx) group by all",
    "factor_contrib": f"{BASE},\n{SAMPLE2} select asset, factor, {r('contribution')} from ct",
    "sample_risk": f"{BASE},\n{SAMPLE2} select asset, {r('sys_var')}, {r('idio_var')}, {r('total_var')}, {r('sys_share')} from rk",
    "risk_stack": f"{BASE},\n{SAMPLE2} select asset, {r('sys_var / (sys_var + idio_var)', 'sys_var')}, {r('idio_var / (sys_var + idio_var)', 'idio_var')} from rk",
    "variance_identity": f"{BASE},\n{SAMPLE1}, e as (select asset, abs(var_samp(ret) - (var_samp(fitted) + var_samp(residual))) / var_samp(ret) as error from s1 group by asset) select asset, {r('error')}, error < 1e-2 as ok from e",
    "decomposition_identity": f"{BASE},\n{SAMPLE1} select asset, max(abs(ret - fitted - residual)) < 1e-10 as reconstruction_ok, max(abs(fitted - (alpha + b1 * f1))) < 1e-10 as fit_ok from s1 group by asset",
    "rolling_ols_multi_k1": f"{BASE},\n{rolling1()} select time, asset, {r('alpha')}, {r('b1')}, {r('fitted')}, {r('residual')} from r1 where b1 is not null",
    "mean_hist": f"{panels()} select asset, {r('avg(ret)', 'mu')} from a group by asset",
    "mean_ewma": f"{panels()},\n{EW} select asset, {r('sum(w * ret)', 'mu')} from ew group by asset",
    "mean_shrink_grand": f"{panels()}, m as (select asset, avg(ret) as mu from a group by asset) select asset, {r(f'(1 - {SHRINKAGE}) * mu + {SHRINKAGE} * avg(mu) over ()', 'mu')} from m",
    "mean_shrink_zero": f"{panels()} select asset, {r(f'(1 - {SHRINKAGE}) * avg(ret)', 'mu')} from a group by asset",
    "cov_hist": f"{panels()},\n{COV} select asset_i, asset_j, {r('cov')} from cv",
    "cov_ewma": f"{panels()},\n{EW} select p.asset as asset_i, q.asset as asset_j, {r('(sum(p.w * p.ret * q.ret) - sum(p.w * p.ret) * sum(p.w * q.ret)) / (1 - sum(p.w * p.w))', 'cov')} from ew p join ew q using (time_idx) group by all",
    "cov_shrink_diag": f"{panels()},\n{SHRUNK} select asset_i, asset_j, {r('cov')} from sh",
    "cov_shrink_identity": f"{panels()},\n{COV} select asset_i, asset_j, {r(f'(1 - {SHRINKAGE}) * cov + {SHRINKAGE} * case when asset_i = asset_j then (select avg(cov) from cv where asset_i = asset_j) else 0 end', 'cov')} from cv",
    "cov_stabilized": f"{panels()},\n{STABLE} select asset_i, asset_j, {r('cov')} from st",
    "mean_factor_model": f"""{BASE},\n{SAMPLE2} select asset, {r('s + e + alpha', 'mu')} from (select asset, sum(beta * m) as s from bt join (select factor, avg(ret) as m from f2 group by factor) using (factor) group by asset)
  join (select asset, avg(residual) as e from s2 group by asset) using (asset) join k2 using (asset)""",
    "cov_factor_model": f"""{BASE},\n{SAMPLE2}, sv as (select i.asset as asset_i, j.asset as asset_j, sum(i.beta * cov * j.beta) as s from bt i join sg using (factor) join bt j on j.factor = factor_p group by all)
select asset_i, asset_j, {r('s + case when asset_i = asset_j then d else 0 end', 'cov')} from sv join (select asset, var_samp(residual) as d from s2 group by asset) on asset = asset_i""",
    "bootstrap_draws": f"{BOOT} select path::int as path, block::int as block, start from draws",
    "bootstrap_paths": f"{BOOT} select path::int as path, time, asset, {r('ret')}, source_idx from ba",
    "bootstrap_factor_paths": f"{BOOT} select path::int as path, time, factor, {r('ret')}, source_idx from bf",
    "bootstrap_cumulative": f"{BOOT} select path::int as path, time, asset, {r('(exp(sum(ret) over (partition by path, asset order by time_idx rows unbounded preceding)) - 1) * 100', 'cumulative')} from ha",
    "bootstrap_moments": f"{BOOT} select path::int as path, asset, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')} from ha group by all",
    "path_counts": f"{BOOT} select path::int as path, count(*) as n_rows, count(distinct time_idx) as n_times, count(distinct asset) as n_series from ha group by path",
    "path_lines": f"{BOOT} select path::int as path, time, factor, {r('(exp(sum(ret) over (partition by path order by time_idx rows unbounded preceding)) - 1) * 100', 'cumulative')} from hf where factor = 'R' and path < 5",
    "bootstrap_rolling_ols": f"""{BOOT}, x as (select ha.*, hf.ret as f1 from ha join hf using (path, time_idx) where factor = 'R'),
{rolling1(key='path, ')} select path::int as path, time, asset, {r('alpha')}, {r('b1')}, {r('residual')} from r1""",
    "residual_bootstrap": f"""{BOOT},\n{WIDE},\n{SAMPLE1} select path::int as path, ti.time, asset, {r('alpha + b1 * f1 + residual', 'ret')} from moves join ti using (time_idx) join s1 on s1.time_idx = source_idx""",
    "rebalance_dates": f"{panels()} select time, time_idx::int as time_idx from ti where time_idx >= {WINDOW - 1} and (time_idx - {WINDOW - 1}) % {EVERY} = 0",
    "rebalance_slices": f"""{panels()}, rb as (select time as at_, time - {7 * (WINDOW - 1)} as ws from ti where time_idx >= {WINDOW - 1} and (time_idx - {WINDOW - 1}) % {EVERY} = 0)
select at_ as at, asset, count(*) as n_rows, {r('avg(ret)', 'mean')}, {r('var_samp(ret)', 'var')} from rb join a on a.time between ws and at_ group by at_, asset""",
    "equal_weight_cumulative": f"{BOOT},\n{EQUAL} select path::int as path, time, {r('cumulative')} from cum",
    "cumulative_bands": f"""{BOOT},\n{EQUAL} select time, {r('quantile_cont(cumulative, 0.1) filter (path >= 0)', 'p10')}, {r('quantile_cont(cumulative, 0.5) filter (path >= 0)', 'median')},
  {r('quantile_cont(cumulative, 0.9) filter (path >= 0)', 'p90')}, {r('max(cumulative) filter (path < 0)', 'realized')} from cum group by time""",
    "return_quantiles": f"{BOOT} select asset, {', '.join(r(f'quantile_cont(ret, {q})', n) for q, n in ((0.0, 'least'), (0.1, 'p10'), (0.5, 'median'), (0.9, 'p90'), (1.0, 'most')))} from ba group by asset",
    "terminal_stats": f"""{BOOT},\n{EQUAL}, l as (select path, arg_max(cumulative, time_idx) as x from cum where path >= 0 group by path)
select count(*) as n_paths, {r('avg(x)', 'mean')}, {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr')}, {r('quantile_cont(x, 0.1)', 'worst_decile')} from l""",
    "sharpe_table": f"{BOOT} select path::int as path, asset, {r('avg(ret) / stddev_samp(ret)', 'sharpe')} from ha group by all",
    "factor_heatmap": f"""{BASE}, q2 as (select *, {rolling(TWO)} as b1, {rolling(OTHER)} as b2, {rolling("var_samp(f1)")} as v1, {rolling("var_samp(f2)")} as v2, {rolling("covar_samp(f1, f2)")} as c from x)
select time, asset, {r('b1 * (v1 * b1 + c * b2)', '"c_R"')}, {r('b2 * (c * b1 + v2 * b2)', '"c_A"')} from q2 where b1 is not null""",
    "event_daily_mean": f"select ts::date as time, event_type as series, {r('avg(value)', 'price')} from events group by all",
    "minvar_closed_form_3": f"""{panels(by="flag")},
{STABLE}, o as (select asset, row_number() over (order by asset) as k from (select distinct asset_i as asset from st)),
g as (select max(cov) filter (i.k = 1 and j.k = 1) as a, max(cov) filter (i.k = 1 and j.k = 2) as b, max(cov) filter (i.k = 1 and j.k = 3) as c, max(cov) filter (i.k = 2 and j.k = 2) as d,
  max(cov) filter (i.k = 2 and j.k = 3) as e, max(cov) filter (i.k = 3 and j.k = 3) as f from st join o i on i.asset = asset_i join o j on j.asset = asset_j),
w as (select (d * f - e * e) + (c * e - b * f) + (b * e - c * d) as w1, (c * e - b * f) + (a * f - c * c) + (b * c - a * e) as w2, (b * e - c * d) + (b * c - a * e) + (a * d - b * b) as w3 from g)
select asset, round(case k when 1 then w1 when 2 then w2 else w3 end / (w1 + w2 + w3), 8) + 0 as weight from o, w""",
    "risk_lines": f"{BASE},\n{rolling1()},\n{RISK1} select time, asset, {r('sys_var / (sys_var + idio_var)', 'sys')}, {r('idio_var / (sys_var + idio_var)', 'idio')} from risk1 where asset = (select min(asset) from risk1)",
    "noisy_returns": f"{panels()} select time, asset, {r(f"ret + (cast('0x' || substr(md5(asset || '-' || time_idx::varchar || '-{SEED}'), 1, 8) as bigint) / 4294967296.0 * 2 - 1) * 0.001", 'ret')} from a",
    "volatility_regime": f"{panels()}, m as (select asset, avg(ret) as m from a group by asset) select time, asset, {r("case when time between date '1995-01-01' and date '1995-12-31' then m + 2 * (ret - m) else ret end", 'ret')} from a join m using (asset)",
    "reindexed_means": f"with {log_returns('p', prices('brand', 'month'))} select series, {r('coalesce(mean, 0)', 'mean')} from (select distinct p_brand as series from part) left join (select series, avg(ret) as mean from p_r group by series) using (series)",
    "stored_prices": f"select time, series, 'factor' as kind, {r('price')} from ({prices('flag')})",
    "loaded_slice": f"select time, series, 'asset' as kind, {r('price')} from ({prices('type', 'day')}) where time between date '1995-01-01' and date '1996-12-31'",
    "rolling_ols_multi": f"{orthogonal(True)} select time, asset, {rounded(8, 'alpha', 'alpha')}, {BETAS}, {rounded(8, 'fitted', 'fitted')}, {rounded(8, 'residual', 'residual')} from fit",
    "sample_ols_multi": f"{orthogonal(False)} select asset, {rounded(8, 'alpha', 'alpha')}, {BETAS} from cf",
    "sample_ols_multi_fit": f"{orthogonal(False)} select time, asset, {rounded(8, 'fitted', 'fitted')}, {rounded(8, 'residual', 'residual')} from fit",
    "rolling_risk_multi": f"{orthogonal(True)},\n{ROLLING_RISK} select time, asset, {RISK_COLUMNS} from rr",
    "rolling_contributions_multi": f"""{orthogonal(True)} select time, ko.asset, factor, {rounded(9, f"case i {' '.join(f'when {j} then k{j}' for j in PARTS)} end", "contribution")}
  from ko join (select distinct time, time_idx from a) d on d.time_idx = ko.t cross join fn""",
    "sample_risk_multi": f"{orthogonal(False)}, rr as (select asset, {SYS} as sys_var, idio_var from ko join (select asset, var_samp(residual) as idio_var from fit group by asset) using (asset)) select asset, {RISK_COLUMNS} from rr",
    "compute_mu_multi": f"""{orthogonal(False)}, mu as (select asset, {" + ".join(f"b{j} * a{j}" for j in PARTS)} + e + alpha as mu from cf join (select asset, avg(residual) as e from fit group by asset) using (asset))
select asset, {rounded(8, f"(1 - {SHRINKAGE}) * mu + {SHRINKAGE} * avg(mu) over ()", "mu")} from mu""",
    "compute_cov_multi": f"{orthogonal(False)},\n{MODEL_COV} select asset_i, asset_j, {rounded(9, f'case when asset_i = asset_j then cov + 1e-8 else (1 - {SHRINKAGE}) * cov end', 'cov')} from mc",
    "variance_ewma": f"{panels()},\n{EW} select asset, {r('(sum(w * ret * ret) - sum(w * ret) * sum(w * ret)) / (1 - sum(w * w))', 'variance')} from ew group by asset",
    "mean_factor_model_ewma": f"""{BASE},\n{SAMPLE2}, {EW.replace("ew as (select *", "wt as (select distinct time_idx")} select asset, {r('s + e + alpha', 'mu')} from (select asset, sum(beta * m) as s from bt join (select factor, sum(w * ret) as m from f2 join wt using (time_idx) group by factor) using (factor) group by asset)
  join (select asset, sum(w * residual) as e from s2 join wt using (time_idx) group by asset) using (asset) join k2 using (asset)""",
    "cov_factor_model_ewma": f"""{BASE},\n{SAMPLE2}, {EW.replace("ew as (select *", "wt as (select distinct time_idx")},
fe as (select f2.*, w from f2 join wt using (time_idx)), ge as (select l.factor, q.factor as factor_p, (sum(l.w * l.ret * q.ret) - sum(l.w * l.ret) * sum(l.w * q.ret)) / (1 - sum(l.w * l.w)) as cov from fe l join fe q using (time_idx) group by all),
sv as (select i.asset as asset_i, j.asset as asset_j, sum(i.beta * cov * j.beta) as s from bt i join ge using (factor) join bt j on j.factor = factor_p group by all)
select asset_i, asset_j, {r('s + case when asset_i = asset_j then d else 0 end', 'cov')} from sv join (select asset, (sum(w * residual * residual) - sum(w * residual) * sum(w * residual)) / (1 - sum(w * w)) as d from s2 join wt using (time_idx) group by asset) on asset = asset_i""",
    "minvar_two_asset": pair("greatest(0, least(1, (v2 - c) / (v1 + v2 - 2 * c)))"),
    "mean_variance_two_asset": pair("greatest(0, least(1, (4 * (v2 - c) + m1 - m2) / (4 * (v1 + v2 - 2 * c))))"),
    "max_sharpe_two_asset": pair(SHARPE),
    "long_short_two_asset": pair("greatest(0.1, least(0.9, (2 * (v2 - c) + m1 - m2) / (2 * (v1 + v2 - 2 * c))))"),
    "optimizer_fit_two_asset": pair("greatest(0, least(1, (v2 - c) / (v1 + v2 - 2 * c)))", f"{panels(by='status')},\n{EW_STABLE},\n{PAIR_COV}"),
    "pair_rolling_weights": f"{ROLLING_PAIR} select path::int as path, time, asset, {rounded(4, 'weight', 'weight')} from pw",
    "pair_diagnostic_summary": f"""{ROLLING_PAIR} select case when path >= 0 then 'bootstrap_paths' else 'realized_path' end as kind, count(*) as n_records, 1.0::double as success_rate, 0::bigint as constraint_violations,
  {rounded(4, "median(cond)", "median_cond_number")}, {rounded(4, "max(cond)", "max_cond_number")}, {rounded(4, "median(better)", "median_obj_improvement")}, 0.0::double as max_multi_init_obj_diff from pc group by 1""",
    "pair_weight_bands": f"{ROLLING_PAIR} select time, asset, {bands('weight', 4)} from pw group by time, asset",
    "pair_weight_std": f"{ROLLING_PAIR} select time, asset, {rounded(4, 'stddev_samp(weight)', 'std')} from pw where path >= 0 group by time, asset",
    "pair_top_assets": f"{ROLLING_PAIR} select asset, {rounded(4, 'avg(weight)', 'mean_weight')} from pw where path >= 0 group by asset order by avg(weight) desc, asset limit 6",
    "pair_cumulative": f"{ROLLING_PAIR},\n{HELD_PAIR} select path::int as path, time, {rounded(2, 'cumulative', 'cumulative')} from cum",
    "pair_weights_through_time": f"{ROLLING_PAIR} select time, asset, {rounded(4, 'weight', 'weight')} from pw where path = -1",
    "pair_sample_weights": f"{SAMPLE_PAIR} select path::int as path, asset, {rounded(4, 'weight', 'weight')} from pw",
    "pair_weight_boxes": f"""{SAMPLE_PAIR} select asset, {", ".join(rounded(4, f"quantile_cont(weight, {p}) filter (path >= 0)", n) for p, n in ((0.0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "most")))},
  {rounded(4, "max(weight) filter (path < 0)", "realized")} from pw group by asset""",
}
SQL["many_path_bands"] = SQL["cumulative_bands"]


def drawn_sql(scale: float, seed: int, frequency: str) -> str:
    u = lambda k: f"((cast('0x' || substr(h, {8 * k + 1}, 8) as bigint) + 0.5) / 4294967296.0)"
    rows = f"select time, series, md5('{seed}|' || series || '|' || time::varchar) as h from (select distinct date_trunc('{frequency}', l_shipdate::date)::date as time from lineitem) cross join (select distinct p_type as series from part) where isodow(time) <= 5"
    return f"select time, series, {r(f'sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}) * {scale}', 'ret')} from ({rows})"


SQL["mock_asset_returns"] = drawn_sql(0.01, 1, "day")
SQL["mock_factor_returns"] = drawn_sql(0.008, 2, "week")
SQL["selected_series"] = f"{panels()} select time, factor, {r('ret')} from f where factor in ('A', 'R')"
SQL["missing_series"] = f"select distinct p_brand as series from part where p_brand not in (select series from ({prices('brand')}) where time < date '1992-01-08')"
#: Exponential weights by path: every path has all dates.
EWB = f"""eb as (select ha.*, case when time_idx = 0 then pow(1 - {ALPHA}, m - 1) else {ALPHA} * pow(1 - {ALPHA}, m - 1 - time_idx) end as w from ha, (select max(time_idx) + 1 as m from ha))"""
SQL["bootstrap_mean_ewma"] = f"""{BOOT}, {EWB}, mu as (select path, asset, sum(w * ret) as mu from eb group by all)
select path::int as path, asset, {r(f'(1 - {SHRINKAGE}) * mu + {SHRINKAGE} * avg(mu) over (partition by path)', 'mu')} from mu"""
SQL["bootstrap_cov"] = f"""{BOOT}, cb as (select p.path, p.asset as asset_i, q.asset as asset_j, covar_samp(p.ret, q.ret) as cov from ha p join ha q using (path, time_idx) group by all)
select path::int as path, asset_i, asset_j, {r(f'case when asset_i = asset_j then cov + 1e-8 else (1 - {SHRINKAGE}) * cov end', 'cov')} from cb"""
SQL["bootstrap_cov_ewma"] = f"""{BOOT}, {EWB} select p.path::int as path, p.asset as asset_i, q.asset as asset_j,
  {r('(sum(p.w * p.ret * q.ret) - sum(p.w * p.ret) * sum(p.w * q.ret)) / (1 - sum(p.w * p.w))', 'cov')} from eb p join eb q using (path, time_idx) group by p.path, p.asset, q.asset"""
#: Returns of a brand's own rows, and the positions of the days.
GAPPY = f"""with gp as ({prices('brand', 'day')}), gi as (select time, row_number() over (order by time) - 1 as time_idx from (select distinct time from gp)),
gl as (select *, lag(price) over (partition by series order by time) as before from gp),
gt as (select time_idx, series as asset, ln(price / before) as ret from gl join gi using (time) where price > 0 and before > 0)"""
#: y -> (d y + a x) / (d + a) with d = (1 - a) ** gap: a value's share is a / (d + a) times the shares d / (d + a) of those after it.
SQL["gappy_mean_ewma"] = f"""{GAPPY}, gd as (select *, pow(1 - {ALPHA}, time_idx - lag(time_idx) over (partition by asset order by time_idx)) as d from gt),
gw as (select *, coalesce(exp(sum(ln(d / (d + {ALPHA}))) over (partition by asset order by time_idx rows between 1 following and unbounded following)), 1) as later from gd)
select asset, {r(f'sum(ret * later * coalesce({ALPHA} / (d + {ALPHA}), 1))', 'mu')} from gw group by asset"""
SQL["gappy_cov_hist"] = f"{GAPPY} select p.asset as asset_i, q.asset as asset_j, {r('covar_samp(p.ret, q.ret)', 'cov')} from gt p join gt q using (time_idx) group by p.asset, q.asset"


def improvement(keys: str, cov: str) -> str:
    """The scaled objective of the weights sw, and what it gains on equal weights."""
    both = f"{keys}, " if keys else ""
    one, two = (f"join sw {t} on {' and '.join([f'{t}.asset = c.asset_{t}', *(f'{t}.{k} = c.{k}' for k in keys.split(', ') if k)])}" for t in "ij")
    own = ", ".join(f"c.{k}" for k in keys.split(", ") if k)
    return f"""im as (select {own + ', ' if keys else ''}sum(i.weight * j.weight * cov) / avg(case when asset_i = asset_j then cov end) as f, avg(cov) / avg(case when asset_i = asset_j then cov end) as f0
  from {cov} c {one} {two} {f'group by {own}' if keys else ''})
select {both.replace('path', 'path::int as path')}true as success, 0::int as constraint_violation, {rounded(6, 'f', 'obj_value')}, {rounded(6, '(f - f0) / (abs(f0) + 1e-12)', 'obj_improvement')} from im"""


SQL["minvar_improvement"] = f"{STABLE_ALL}, {long_only('', 'st')}, {improvement('', 'st')}"
SQL["rolling_improvement"] = f"{ROLLING_ALL}, {improvement('path, time', 'rv_')}"
