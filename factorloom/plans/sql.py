"""A batch of expressions as one SQL text, for engines that know framed windows.

The stages of the plan become common table expressions, one on the other. NULL is
the missing value; NaN never leaves a stage.
"""

from __future__ import annotations

from collections import defaultdict

from ..functions.expr import Expr
from .planner import Plan


def _known(x: str) -> str:
    return f"nullif(({x})::double, 'nan'::double)"


def _power(x: str, y: str) -> str:
    return f"case when {y} = 0 or {x} = 1 then 1.0::double else {_known(f'pow({x}, {y})')} end"


ELEMENTWISE = {
    "neg": lambda a: f"-{a}",
    "abs": lambda a: f"abs({a})",
    "log": lambda a: f"case when {a} > 0 then ln(case when {a} > 0 then {a} end) end",
    "sign": lambda a: f"sign({a})::double",
    "power": _power,
    "signed_power": lambda a, b: _known(f"sign({a}) * pow(abs({a}), {b})"),
    "min": lambda a, b: f"case when {a} is not null and {b} is not null then least({a}, {b}) end",
    "max": lambda a, b: f"case when {a} is not null and {b} is not null then greatest({a}, {b}) end",
    "add": lambda a, b: _known(f"{a} + {b}"),
    "sub": lambda a, b: _known(f"{a} - {b}"),
    "mul": lambda a, b: _known(f"{a} * {b}"),
    "div": lambda a, b: f"case when {b} <> 0 then {_known(f'{a} / nullif({b}, 0)')} when {b} = 0 and {a} <> 0 then {a} * pow({b}, -1) end",
    "lt": lambda a, b: f"({a} < {b})::int::double",
    "gt": lambda a, b: f"({a} > {b})::int::double",
    "le": lambda a, b: f"({a} <= {b})::int::double",
    "ge": lambda a, b: f"({a} >= {b})::int::double",
    "eq": lambda a, b: f"({a} = {b})::int::double",
    "where": lambda c, a, b: f"case when {c} > 0 then {a} when {c} <= 0 then {b} end",
}


class Names:
    def __init__(self, symbol: str, time: str, row: str) -> None:
        self.symbol, self.time, self.row = symbol, time, row

    def rows(self, d: int) -> str:
        return f"over (partition by {self.symbol} order by {self.time} rows between {d - 1} preceding and current row)"

    def all_rows(self) -> str:
        return f"over (partition by {self.symbol} order by {self.time} rows between unbounded preceding and current row)"

    def lag(self, x: str, d: int) -> str:
        return f"lag({x}, {d}) over (partition by {self.symbol} order by {self.time})" if d else x


def _residual(args: list[str], w: str) -> str:
    """Residual of the last row: by the rule of Cramer on the centred moments."""
    y, *xs = args
    s = lambda a, b: f"(covar_pop({a}, {b}) {w})"
    m = [[s(a, b) for b in xs] for a in xs]
    r = [s(a, y) for a in xs]
    det = lambda q: f"({q[0][0]} * ({q[1][1]} * {q[2][2]} - {q[1][2]} * {q[2][1]}) - {q[0][1]} * ({q[1][0]} * {q[2][2]} - {q[1][2]} * {q[2][0]}) + {q[0][2]} * ({q[1][0]} * {q[2][1]} - {q[1][1]} * {q[2][0]}))"
    beta = [f"({det([[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)])} / nullif({det(m)}, 0))" for k in range(3)]
    away = lambda x: f"({x} - avg({x}) {w})"
    return f"{away(y)} - " + " - ".join(f"{b} * {away(x)}" for b, x in zip(beta, xs))


def _time_series(op: str, args: list[str], params: tuple, n: Names) -> str:
    x, d = args[0], params[0] if params else 0
    if op == "delay":
        return n.lag(x, d)
    if op == "delta":
        return _known(f"{x} - {n.lag(x, d)}")
    if op == "scan_mul":
        v, c = args
        return f"case when {v} is not null and {c} is not null then product(case when {c} = 1 and {v} is not null then {v} else 1 end) {n.all_rows()} end"
    if op == "sma":
        d, m = params
        a = f"({m}::double / {d}::double)"
        if d == 0 or m > d:
            return "null::double"
        step = f"case when v is null or isinf(v) then null when s is null then v else {a} * v + (1 - {a}) * s end"
        return f"list_reduce(list_prepend(null::double, list({x}) {n.all_rows()}), lambda s, v: {step})"
    if d == 0:
        return "null::double"
    w = n.rows(d)
    if op == "conditional_beta":
        y, x, c = args
        use = lambda q: f"case when {c} = 1 and isfinite({y}) and isfinite({x}) then {q} end"
        return f"case when {n.row} >= {d} and count({use(x)}) {w} >= 2 and var_samp({use(x)}) {w} > 0 then {_known(f'regr_slope({use(y)}, {use(x)}) {w}')} end"
    if op in ("correlation", "covariance", "rolling_beta", "multi_resi"):
        full = f"count(case when {' and '.join(f'{a} is not null' for a in args)} then 1 end) {w} = {d}"
        if op == "multi_resi":
            return f"case when {full} then {_known(_residual(args, w))} end" if d >= 5 else "null::double"
        y = args[1]
        if d == 1:
            return "null::double"
        if op == "covariance":
            return f"case when {full} then {_known(f'covar_samp({x}, {y}) {w}')} end"
        if op == "correlation":
            return f"case when {full} and var_samp({x}) {w} > 0 and var_samp({y}) {w} > 0 then {_known(f'covar_samp({x}, {y}) {w} / (stddev_samp({x}) {w} * stddev_samp({y}) {w})')} end"
        return f"case when {full} and var_samp({y}) {w} > 0 then {_known(f'regr_slope({x}, {y}) {w}')} end"
    one = lambda f: f"{f}({x}) {w}"
    less = lambda test: f"len(list_filter(list({x}) {w}, lambda v: v {test} {x}))"
    slope = f"regr_slope({x}, {n.row}) {w}"
    weights = [0.9**k for k in range(d)]
    value = {
        "ts_sum": lambda: one("sum"),
        "ts_mean": lambda: one("avg"),
        "product": lambda: one("product"),
        "ts_min": lambda: one("min"),
        "ts_max": lambda: one("max"),
        "ts_argmin": lambda: f"list_position(list({x}) {w}, {one('min')}) - 1",
        "ts_argmax": lambda: f"list_position(list({x}) {w}, {one('max')}) - 1",
        "ts_rank": lambda: f"(2 * {less('<')} + 1 + {less('=')}) / {2.0 * d}::double",
        "ts_rank_raw": lambda: less("<"),
        "ts_std": lambda: one("stddev_samp") if d > 1 else "null",
        "quantile": lambda: f"quantile_cont({x}, {params[1]}) {w}" if 0 <= params[1] <= 1 else "null",
        "slope": lambda: slope if d > 1 else "null",
        "rsquare": lambda: f"case when {one('var_samp')} > 0 then regr_r2({x}, {n.row}) {w} end" if d > 1 else "null",
        "resi": lambda: f"{x} - {one('avg')} - ({slope}) * {(d - 1) / 2}" if d > 1 else "null",
        "decay_linear": lambda: "(" + " + ".join(f"{d - k}::double * {n.lag(x, k)}" for k in range(d)) + f") / {d * (d + 1) / 2}::double",
        "wma": lambda: "(" + " + ".join(f"{q!r}::double * {n.lag(x, k)}" for k, q in enumerate(weights)) + f") / {sum(weights)!r}::double",
    }[op]()
    return f"case when count({x}) {w} = {d} then {_known(value)} end"


def _cross_section(op: str, x: str, params: tuple, by: str) -> str:
    if op in ("rank", "group_rank"):
        order = f"(partition by {by} order by {x} nulls last"
        return f"case when {x} is not null then (rank() over {order}) + count({x}) over {order} range between unbounded preceding and current row)) / 2.0::double / count({x}) over (partition by {by}) end"
    if op == "scale":
        total = f"sum(abs({x})) over (partition by {by})"
        return f"case when {total} > 0 then {_known(f'{x} * {params[0]!r}::double / {total}')} end"
    return _known(f"{x} - avg({x}) over (partition by {by})")


def lower(outputs: dict[str, Expr], table: str, symbol: str, time: str, row: str) -> tuple[str, dict[str, str]]:
    """Common table expressions over ``table``, the last of which is ``stages``, and
    the value of each output over it. ``row`` numbers the rows of a symbol from 1."""
    plan, n = Plan(outputs), Names(symbol, time, row)
    steps: dict[tuple, list[Expr]] = defaultdict(list)
    for e in plan.nodes.values():
        if e.key in plan.held:
            steps[plan.at[e.key]].append(e)
    ready: set[int] = set()

    def value(e: Expr) -> str:
        if e.op == "col":
            return e.params[0]
        if e.op == "lit":
            return f"({e.params[0]!r}::double)"
        if e.key in ready:
            return f"n{e.key}"
        return f"({ELEMENTWISE[e.op](*map(value, e.args))})"

    def made(e: Expr) -> str:
        args = [value(a) for a in plan.values(e)]
        if e.op in ELEMENTWISE:
            return ELEMENTWISE[e.op](*args)
        if e.op in ("rank", "scale", "group_rank", "group_neutralize"):
            return _cross_section(e.op, args[0], e.params, ", ".join([time, *(a.params[0] for a in e.args[1:])]))
        return _time_series(e.op, args, e.params, n)

    texts, last = [], table
    for i, step in enumerate(sorted(steps)):
        columns = ", ".join(f"({made(e)})::double as n{e.key}" for e in steps[step])
        texts.append(f"stage{i} as materialized (select *, {columns} from {last})")
        last = f"stage{i}"
        ready |= {e.key for e in steps[step]}
    texts.append(f"stages as (select * from {last})")
    return ",\n".join(texts), {name: value(e) for name, e in outputs.items()}
