"""Formula sheets: expressions written as text.

A sheet has a formula on each line, ``name = formula``; a line without the
sheet's prefix defines a term for the lines below it. The text is read with
Python's own grammar: arithmetic, comparisons, ``and``, ``or``,
``x if condition else y``, numbers, column names and the calls listed here.
"""

from __future__ import annotations

import ast

from . import expr as E
from .expr import Expr, lit

_TIME = "delay delta ts_sum ts_mean product ts_min ts_max ts_argmin ts_argmax ts_rank ts_rank_raw ts_std slope rsquare resi decay_linear wma".split()
_CALLS = {
    **{n: (lambda x, d, n=n: getattr(x, n)(d)) for n in _TIME},
    **{n: (lambda x, n=n: getattr(x, n)()) for n in ("abs", "log", "sign", "rank")},
    **{n: getattr(E, n) for n in ("min", "max", "power", "signed_power", "correlation", "covariance", "conditional_beta", "rolling_beta", "multi_resi", "scan_mul", "group_rank", "group_neutralize")},
    "scale": lambda x, a=1.0: x.scale(a),
    "sma": lambda x, d, m: x.sma(d, m),
    "quantile": lambda x, d, q: x.quantile(d, q),
    "adv": E.adv,
    "mean": lambda x, d: x.ts_sum(d) / lit(d),
    "blend": lambda a, b, w: a * lit(w) + b * lit(1.0 - w),
}
#: Arguments that are plain numbers: windows, weights, quantiles.
_NUMBERS = {**{n: (1,) for n in (*_TIME, "scale", "mean")}, "adv": (0,), "correlation": (2,), "covariance": (2,), "rolling_beta": (2,), "conditional_beta": (3,), "multi_resi": (4,), "sma": (1, 2), "quantile": (1, 2), "blend": (2,)}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__"}
_COMPARE = {ast.Lt: "__lt__", ast.Gt: "__gt__", ast.LtE: "__le__", ast.GtE: "__ge__", ast.Eq: "__eq__"}


def parse(text: str, terms: dict[str, Expr] | None = None) -> Expr:
    """The expression that a formula stands for; ``terms`` are names defined before."""
    terms = terms or {}

    def walk(n: ast.AST) -> Expr:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return lit(n.value)
        if isinstance(n, ast.Name):
            return terms[n.id] if n.id in terms else E.col(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return lit(-n.operand.value) if isinstance(n.operand, ast.Constant) else -walk(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            return getattr(walk(n.left), _ARITHMETIC[type(n.op)])(walk(n.right))
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            return getattr(walk(n.left), _COMPARE[type(n.ops[0])])(walk(n.comparators[0]))
        if isinstance(n, ast.BoolOp):
            join = E.and_ if isinstance(n.op, ast.And) else E.or_
            out = walk(n.values[0])
            for v in n.values[1:]:
                out = join(out, walk(v))
            return out
        if isinstance(n, ast.IfExp):
            return E.where_(walk(n.test), walk(n.body), walk(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS:
            plain = _NUMBERS.get(n.func.id, ())
            return _CALLS[n.func.id](*[ast.literal_eval(a) if i in plain else walk(a) for i, a in enumerate(n.args)])
        raise ValueError(f"not a formula: {ast.unparse(n)}")

    return walk(ast.parse(text.strip(), mode="eval").body)


def read_sheet(text: str, prefix: str) -> dict[str, Expr]:
    """Named expressions of a sheet, in its order."""
    terms: dict[str, Expr] = {}
    out: dict[str, Expr] = {}
    for line in text.strip().splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, formula = line.split("=", 1)
        name = name.strip()
        (out if name.startswith(prefix) else terms)[name] = parse(formula, terms)
    return out
