"""Time-series and cross-sectional operators as window expressions.

A time-series window of d counts the last d rows of a symbol and is missing
until d rows exist and while any value in it is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .columns import INF, finite, known

NOTHING = F.lit


class Frames:
    """Window specifications of a panel."""

    def __init__(self, symbol: str, time: str) -> None:
        self.symbol, self.time = symbol, time
        self.rows = Window.partitionBy(symbol).orderBy(time)
        self.day = Window.partitionBy(time)

    def last(self, d: int):
        return self.rows.rowsBetween(-(d - 1), 0)

    def index(self) -> Column:
        return F.row_number().over(self.rows).cast("double")


def _missing() -> Column:
    return F.lit(None).cast("double")


def _spread_weights(x: Column, d: int, weights: list[float], over) -> Column:
    """Weighted mean of the window, oldest weight first."""
    total = sum(weights)
    listed = over(F.collect_list(x))
    pairs = F.zip_with(listed, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return known(F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / F.lit(total))


def time_series(op: str, args: list[Column], params: tuple, f: Frames, row: Column) -> Column:
    """The operator over ``args`` (plain columns); ``row`` is the running number of
    the row within its symbol, as double."""
    x = args[0]
    if op == "delay":
        return x if params[0] == 0 else F.lag(x, params[0]).over(f.rows)
    if op == "delta":
        return known(x - (x if params[0] == 0 else F.lag(x, params[0]).over(f.rows)))
    if op == "scan_mul":
        v, c = args
        step = F.when((c == 1) & v.isNotNull(), v).otherwise(F.lit(1.0))
        return F.when(v.isNotNull() & c.isNotNull(), known(F.product(step).over(f.rows.rowsBetween(Window.unboundedPreceding, 0))))
    d = params[0]
    if d == 0:
        return _missing()
    w = f.last(d)
    over = lambda c: c.over(w)
    if op == "conditional_beta":
        y, x, c = args
        use = (c == 1) & finite(y) & finite(x)
        y, x = F.when(use, y), F.when(use, x)
        beta = F.when(over(F.var_samp(x)) > 0, over(F.regr_slope(y, x)))
        return F.when((row >= d) & (over(F.count(x)) >= 2), known(beta))
    if op in ("correlation", "covariance", "rolling_beta"):
        pair = F.when(x.isNotNull() & args[1].isNotNull(), F.lit(1))
        full = over(F.count(pair)) == d
        y = args[1]
        if op == "correlation":
            sx, sy = over(F.stddev_samp(x)), over(F.stddev_samp(y))
            return F.when(full & (sx > 0) & (sy > 0), known(over(F.covar_samp(x, y)) / (sx * sy))) if d > 1 else _missing()
        if op == "covariance":
            return F.when(full, known(over(F.covar_samp(x, y)))) if d > 1 else _missing()
        return F.when(full & (over(F.var_samp(y)) > 0), known(over(F.regr_slope(x, y)))) if d > 1 else _missing()
    full = over(F.count(x)) == d
    if op == "ts_sum":
        value = over(F.sum(x))
    elif op == "ts_mean":
        value = over(F.avg(x))
    elif op == "product":
        value = over(F.product(x))
    elif op == "ts_min":
        value = over(F.min(x))
    elif op == "ts_max":
        value = over(F.max(x))
    elif op == "ts_argmin":
        value = over(F.min(F.struct(x.alias("v"), row.alias("i"))))["i"] - (row - F.lit(float(d)) + 1.0)
    elif op == "ts_argmax":
        value = -over(F.max(F.struct(x.alias("v"), (-row).alias("i"))))["i"] - (row - F.lit(float(d)) + 1.0)
    elif op == "ts_rank":
        listed = over(F.collect_list(x))
        value = (2 * F.size(F.filter(listed, lambda v: v < x)) + 1 + F.size(F.filter(listed, lambda v: v == x))) / F.lit(2.0 * d)
    elif op == "ts_rank_raw":
        value = F.size(F.filter(over(F.collect_list(x)), lambda v: v < x)).cast("double")
    elif op == "ts_std":
        value = over(F.stddev_samp(x)) if d > 1 else _missing()
    elif op == "quantile":
        value = over(F.percentile(x, params[1])) if 0 <= params[1] <= 1 else _missing()
    elif op == "slope":
        value = over(F.regr_slope(x, row)) if d > 1 else _missing()
    elif op == "rsquare":
        value = F.when(over(F.var_samp(x)) > 0, over(F.regr_r2(x, row))) if d > 1 else _missing()
    elif op == "resi":
        value = x - over(F.avg(x)) - over(F.regr_slope(x, row)) * F.lit((d - 1) / 2) if d > 1 else _missing()
    elif op == "decay_linear":
        calm = F.when(F.abs(x) < INF, x).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
        up, down = over(F.max((x == INF).cast("int"))), over(F.max((x == -INF).cast("int")))
        plain = (over(F.sum(calm * row)) - (row - F.lit(float(d))) * over(F.sum(calm))) / F.lit(d * (d + 1) / 2)
        value = F.when((up == 1) & (down == 1), _missing()).when(up == 1, F.lit(INF)).when(down == 1, F.lit(-INF)).otherwise(plain)
    elif op == "wma":
        value = _spread_weights(x, d, [0.9 ** (d - 1 - k) for k in range(d)], over)
    else:
        raise ValueError(f"unknown time-series operator {op}")
    return F.when(full, known(value.cast("double")))


def _average_rank(x: Column, keys: list[str]) -> Column:
    """Average rank over the number of values, among non-missing values."""
    up = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(up.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (F.rank().over(up) + upto) / F.lit(2.0) / F.count(x).over(Window.partitionBy(*keys)))


def cross_section(op: str, args: list[Column], params: tuple, f: Frames, group: str | None) -> Column:
    x = args[0]
    if op == "rank":
        return _average_rank(x, [f.time])
    if op == "scale":
        total = F.sum(F.abs(x)).over(f.day)
        return F.when(total > 0, known(x * F.lit(params[0]) / total))
    if op == "group_rank":
        return _average_rank(x, [f.time, group])
    if op == "group_neutralize":
        return known(x - F.avg(x).over(Window.partitionBy(f.time, group)))
    raise ValueError(f"unknown cross-sectional operator {op}")
