"""The expression language: immutable trees over the columns of a panel.

An :class:`Expr` is an operator name, argument expressions and plain parameters.
Equal trees compare and hash equal, which is all that common-subexpression
sharing in the planner needs.
"""

from __future__ import annotations

#: Operators by the partitioning that they need. Elementwise ones need none.
ELEMENTWISE = frozenset("neg abs log sign power signed_power min max add sub mul div lt gt le ge eq where".split())
TIME_SERIES = frozenset(
    "delay delta ts_sum ts_mean product ts_min ts_max ts_argmin ts_argmax ts_rank ts_rank_raw ts_std quantile slope rsquare resi decay_linear correlation covariance rolling_beta conditional_beta wma scan_mul".split()
)
RECURSIVE = frozenset("sma multi_resi".split())
CROSS_SECTION = frozenset("rank scale group_rank group_neutralize".split())


class Expr:
    """One node. Nodes are interned: equal trees have the same ``key``, a number,
    so that ``==`` is free to build a comparison."""

    __slots__ = ("op", "args", "params", "name", "key")
    _keys: dict[tuple, int] = {}

    def __init__(self, op: str, args: tuple[Expr, ...] = (), params: tuple = (), name: str | None = None) -> None:
        self.op, self.args, self.params, self.name = op, args, params, name
        self.key = self._keys.setdefault((op, tuple(a.key for a in args), tuple(map(repr, params))), len(self._keys))

    def __hash__(self) -> int:
        return hash(self.key)

    # names ---------------------------------------------------------------
    def alias(self, name: str) -> Expr:
        return Expr(self.op, self.args, self.params, name)

    def output_name(self) -> str | None:
        return self.name

    def collect_inputs(self) -> list[str]:
        """Columns that the expression reads, sorted."""
        found, stack, seen = set(), [self], set()
        while stack:
            e = stack.pop()
            if id(e) in seen:
                continue
            seen.add(id(e))
            if e.op == "col":
                found.add(e.params[0])
            stack += e.args
        return sorted(found)

    def group_inputs(self) -> set[str]:
        """Columns that are used as groups."""
        found, stack = set(), [self]
        while stack:
            e = stack.pop()
            if e.op in ("group_rank", "group_neutralize"):
                if e.args[1].op != "col":
                    raise ValueError("a group must be a bare column")
                found.add(e.args[1].params[0])
                stack.append(e.args[0])
            else:
                stack += e.args
        return found

    def value_inputs(self) -> set[str]:
        """Columns that are used as values."""
        found, stack = set(), [self]
        while stack:
            e = stack.pop()
            if e.op == "col":
                found.add(e.params[0])
            stack += e.args[:1] if e.op in ("group_rank", "group_neutralize") else e.args
        return found

    def replace_inputs(self, names: dict[str, str]) -> Expr:
        """The same expression over renamed columns, groups included."""
        done: dict[int, Expr] = {}

        def walk(e: Expr) -> Expr:
            if e.key not in done:
                params = (names.get(e.params[0], e.params[0]),) if e.op == "col" else e.params
                done[e.key] = Expr(e.op, tuple(map(walk, e.args)), params)
            return done[e.key]

        out = walk(self)
        return out.alias(self.name) if self.name else out

    # methods -------------------------------------------------------------
    def _unary(self, op: str, *params) -> Expr:
        return _make(op, (self,), params)

    def neg(self) -> Expr:
        return self._unary("neg")

    def abs(self) -> Expr:
        return self._unary("abs")

    def log(self) -> Expr:
        return self._unary("log")

    def sign(self) -> Expr:
        return self._unary("sign")

    def rank(self) -> Expr:
        return self._unary("rank")

    def scale(self, a: float = 1.0) -> Expr:
        return self._unary("scale", float(a))

    def delay(self, d: int) -> Expr:
        return self._unary("delay", _days(d))

    def delta(self, d: int) -> Expr:
        return self._unary("delta", _days(d))

    def ts_sum(self, d: int) -> Expr:
        return self._unary("ts_sum", _days(d))

    def ts_mean(self, d: int) -> Expr:
        return self._unary("ts_mean", _days(d))

    def product(self, d: int) -> Expr:
        return self._unary("product", _days(d))

    def ts_min(self, d: int) -> Expr:
        return self._unary("ts_min", _days(d))

    def ts_max(self, d: int) -> Expr:
        return self._unary("ts_max", _days(d))

    def ts_argmin(self, d: int) -> Expr:
        return self._unary("ts_argmin", _days(d))

    def ts_argmax(self, d: int) -> Expr:
        return self._unary("ts_argmax", _days(d))

    def ts_rank(self, d: int) -> Expr:
        return self._unary("ts_rank", _days(d))

    def ts_rank_raw(self, d: int) -> Expr:
        return self._unary("ts_rank_raw", _days(d))

    def ts_std(self, d: int) -> Expr:
        return self._unary("ts_std", _days(d))

    def slope(self, d: int) -> Expr:
        return self._unary("slope", _days(d))

    def rsquare(self, d: int) -> Expr:
        return self._unary("rsquare", _days(d))

    def resi(self, d: int) -> Expr:
        return self._unary("resi", _days(d))

    def quantile(self, d: int, q: float) -> Expr:
        return self._unary("quantile", _days(d), float(q))

    def decay_linear(self, d: int) -> Expr:
        return self._unary("decay_linear", _days(d))

    def wma(self, d: int) -> Expr:
        return self._unary("wma", _days(d))

    def sma(self, d: int, m: int) -> Expr:
        return self._unary("sma", _days(d), _days(m))

    # operators take expressions only -------------------------------------
    def __neg__(self) -> Expr:
        return self.neg()

    def __add__(self, other: Expr) -> Expr:
        return _binary("add", self, other)

    def __sub__(self, other: Expr) -> Expr:
        return _binary("sub", self, other)

    def __mul__(self, other: Expr) -> Expr:
        return _binary("mul", self, other)

    def __truediv__(self, other: Expr) -> Expr:
        return _binary("div", self, other)

    def __lt__(self, other: Expr) -> Expr:
        return _binary("lt", self, other)

    def __gt__(self, other: Expr) -> Expr:
        return _binary("gt", self, other)

    def __le__(self, other: Expr) -> Expr:
        return _binary("le", self, other)

    def __ge__(self, other: Expr) -> Expr:
        return _binary("ge", self, other)

    def __eq__(self, other: Expr) -> Expr:  # type: ignore[override]
        return _binary("eq", self, other)

    def __ne__(self, other: Expr):  # type: ignore[override]
        raise ValueError("!= is not an operator of the expression language")

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use where_")

    def __repr__(self) -> str:
        if self.op == "col":
            return str(self.params[0])
        if self.op == "lit":
            return repr(self.params[0])
        return f"{self.op}({', '.join([*map(repr, self.args), *map(repr, self.params)])})"


def _days(d: int) -> int:
    if isinstance(d, bool) or not isinstance(d, int) or d < 0:
        raise ValueError(f"a window is a whole number of rows, 0 or more: {d!r}")
    return d


def _make(op: str, args: tuple, params: tuple = ()) -> Expr:
    for a in args:
        if not isinstance(a, Expr):
            raise TypeError(f"{op} takes expressions, not {type(a).__name__}; use lit() for numbers")
    return Expr(op, args, params)


def _binary(op: str, a: Expr, b: Expr) -> Expr:
    return _make(op, (a, b))


def col(name: str) -> Expr:
    return Expr("col", (), (name,))


def lit(value: float) -> Expr:
    return Expr("lit", (), (float(value),))


def min(x: Expr, y: Expr) -> Expr:  # noqa: A001
    return _binary("min", x, y)


def max(x: Expr, y: Expr) -> Expr:  # noqa: A001
    return _binary("max", x, y)


def power(x: Expr, y: Expr) -> Expr:
    return _binary("power", x, y)


def signed_power(x: Expr, y: Expr) -> Expr:
    return _binary("signed_power", x, y)


def where_(cond: Expr, a: Expr, b: Expr) -> Expr:
    return _make("where", (cond, a, b))


def and_(a: Expr, b: Expr) -> Expr:
    """``b`` where ``a`` holds, else 0."""
    return where_(a, b, lit(0.0))


def or_(a: Expr, b: Expr) -> Expr:
    """1 where ``a`` holds, else ``b``."""
    return where_(a, lit(1.0), b)


def correlation(x: Expr, y: Expr, d: int) -> Expr:
    return _make("correlation", (x, y), (_days(d),))


def covariance(x: Expr, y: Expr, d: int) -> Expr:
    return _make("covariance", (x, y), (_days(d),))


def rolling_beta(y: Expr, x: Expr, d: int) -> Expr:
    return _make("rolling_beta", (y, x), (_days(d),))


def conditional_beta(y: Expr, x: Expr, cond: Expr, d: int) -> Expr:
    return _make("conditional_beta", (y, x, cond), (_days(d),))


def multi_resi(y: Expr, x1: Expr, x2: Expr, x3: Expr, d: int) -> Expr:
    return _make("multi_resi", (y, x1, x2, x3), (_days(d),))


def scan_mul(value: Expr, cond: Expr) -> Expr:
    return _make("scan_mul", (value, cond))


def group_rank(x: Expr, group: Expr) -> Expr:
    return _make("group_rank", (x, group))


def group_neutralize(x: Expr, group: Expr) -> Expr:
    return _make("group_neutralize", (x, group))


def returns() -> Expr:
    return col("close") / col("close").delay(1) - lit(1.0)


def adv(d: int) -> Expr:
    """Mean traded shares (not money) of d rows."""
    return col("volume").ts_mean(d)
