"""Elementwise arithmetic on double columns where NULL is the missing value.

NaN never leaves an operator: it becomes NULL. Infinities are values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def known(x: Column) -> Column:
    """x, with NaN as NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite, 0 / 0 missing."""
    return F.coalesce(known(F.try_divide(a, b)), known(F.when(b == 0, a * F.pow(b, F.lit(-1.0)))))


def power(x: Column, y: Column) -> Column:
    """x ** y, with x ** 0 = 1 and 1 ** y = 1 even for a missing other side."""
    return F.when(y == 0, 1.0).when(x == 1, 1.0).when((x == -1) & (F.abs(y) == INF), 1.0).otherwise(known(F.pow(x, y)))


def signed_power(x: Column, y: Column) -> Column:
    return known(F.signum(x) * F.pow(F.abs(x), y))


def both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


def where(c: Column, a: Column, b: Column) -> Column:
    return F.when(c > 0, a).when(c <= 0, b)


def finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) < INF)


#: Operators that use an argument more than once; the planner gives them plain
#: columns, or nested ones would double their trees at every level.
REPEATING = frozenset("div power signed_power min max where log".split())

ELEMENTWISE = {
    "neg": lambda a: -a,
    "abs": lambda a: F.abs(a),
    "log": lambda a: F.when(a > 0, F.ln(a)),
    "sign": lambda a: F.signum(a) + F.lit(0.0),
    "power": power,
    "signed_power": signed_power,
    "min": lambda a, b: both(a, b, F.least(a, b)),
    "max": lambda a, b: both(a, b, F.greatest(a, b)),
    "add": lambda a, b: known(a + b),
    "sub": lambda a, b: known(a - b),
    "mul": lambda a, b: known(a * b),
    "div": divide,
    "lt": lambda a, b: (a < b).cast("double"),
    "gt": lambda a, b: (a > b).cast("double"),
    "le": lambda a, b: (a <= b).cast("double"),
    "ge": lambda a, b: (a >= b).cast("double"),
    "eq": lambda a, b: (a == b).cast("double"),
    "where": where,
}


def pearson(n: Column, x: Column, y: Column, over) -> Column:
    """Correlation of x and y by ``over`` (turns an aggregate into a column);
    missing below two rows and for a constant side."""
    vx, vy = over(F.var_samp(x)), over(F.var_samp(y))
    return F.when((n >= 2) & (vx > 0) & (vy > 0), known(over(F.covar_samp(x, y)) / F.sqrt(vx * vy)))
