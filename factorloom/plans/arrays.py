"""Operators on stacked arrays: many symbols, or many days, one after the other.

NaN is the missing value. A rolling operator costs time in proportion to the rows
for sums, products, extremes and moments: the rows are cut into blocks of the
window's length, and a window is the end of one block and the start of the next,
so nothing is ever subtracted from a running total and no digits cancel.
"""

from __future__ import annotations

import numpy as np

NAN = np.nan
#: Values of windows that are laid out at once, where an operator needs them all.
LAID_OUT = 1 << 21


class Stack:
    """Where the symbols of a stack of rows start; rows are in order of time."""

    def __init__(self, n: int, starts: np.ndarray) -> None:
        self.n, self.starts = n, starts
        self.sizes = np.diff(np.r_[starts, n])
        self.age = np.arange(n) - np.repeat(starts, self.sizes)
        self._blocks: dict[int, Blocks] = {}

    def blocks(self, d: int) -> Blocks:
        if d not in self._blocks:
            self._blocks[d] = Blocks(self, d)
        return self._blocks[d]

    def lag(self, x: np.ndarray, d: int) -> np.ndarray:
        if d == 0:
            return x
        out = np.full(self.n, NAN)
        out[d:] = x[:-d] if d < self.n else out[d:]
        out[self.age < d] = NAN
        return out

    def full(self, x: np.ndarray, d: int) -> np.ndarray:
        """Whether the last d rows are of one symbol and none is missing."""
        bad = np.r_[0, np.cumsum(np.isnan(x))]
        ok = self.age >= d - 1
        ok[d - 1 :] &= bad[d:] == bad[: self.n - d + 1]
        return ok


class Blocks:
    """The rows of each symbol in blocks of d, counted from the symbol's first row,
    so that its values do not depend on what it is stacked with. Symbols of fewer
    rows have no window and are left out."""

    def __init__(self, stack: Stack, d: int) -> None:
        self.n, self.d = stack.n, d
        long = stack.sizes >= d
        self.rows = np.flatnonzero(np.repeat(long, stack.sizes))
        sizes = stack.sizes[long]
        padded = -(-sizes // d) * d
        self.places = np.repeat(np.cumsum(padded) - padded, sizes) + stack.age[self.rows]
        self.count = int(padded.sum()) // d

    def lay(self, x: np.ndarray) -> np.ndarray:
        """d x blocks: the rows of a block below each other; the last are filled up."""
        out = np.zeros(self.count * self.d)
        out[self.places] = x[self.rows]
        return np.ascontiguousarray(out.reshape(self.count, self.d).T)

    def windows(self, whole: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Values by window start, as (offset, block), put at the last row of each."""
        at = np.full((self.d, self.count), NAN)
        at[0] = whole
        at[1:, :-1] = joined
        flat = at.T.ravel()
        out = np.full(self.n, NAN)
        start = self.places - (self.d - 1)
        out[self.rows] = np.where(start >= 0, flat[np.maximum(start, 0)], NAN)
        return out


def fold(x: np.ndarray, d: int, combine: np.ufunc, stack: Stack) -> np.ndarray:
    """``combine`` over the last d rows; only full windows mean anything."""
    blocks = stack.blocks(d)
    if not blocks.count:
        return np.full(stack.n, NAN)
    b = blocks.lay(x)
    up = combine.accumulate(b, axis=0)
    down = combine.accumulate(b[::-1], axis=0)[::-1]
    return blocks.windows(up[-1], combine(down[1:, :-1], up[:-1, 1:]))


def moments(x: np.ndarray, y: np.ndarray, use: np.ndarray, d: int, stack: Stack) -> tuple[np.ndarray, ...]:
    """Of the rows with ``use`` among the last d: their number, the means of x and y,
    and the sums of squares and products of deviations xx, yy, xy. Rows are added
    one by one within a block, and the parts of two blocks are joined."""
    blocks = stack.blocks(d)
    if not blocks.count:
        return tuple(np.full(stack.n, NAN) for _ in range(6))
    w = blocks.lay(use)
    a, b = blocks.lay(np.where(use, x, 0.0)), blocks.lay(np.where(use, y, 0.0))

    def sums(order) -> np.ndarray:
        out = np.empty((6, *w.shape))
        state = np.zeros((6, w.shape[1]))
        n, mx, my, xx, yy, xy = state
        for j in order:
            n += w[j]
            step = w[j] / np.maximum(n, 1)
            dx, dy = a[j] - mx, b[j] - my
            mx += step * dx
            my += step * dy
            rest = b[j] - my
            xx += w[j] * dx * (a[j] - mx)
            yy += w[j] * dy * rest
            xy += w[j] * dx * rest
            out[:, j] = state
        return out

    up, down = sums(range(d)), sums(range(d - 1, -1, -1))
    left, right = down[:, 1:, :-1], up[:, :-1, 1:]
    n = left[0] + right[0]
    some = np.maximum(n, 1)
    dx, dy = right[1] - left[1], right[2] - left[2]
    share = right[0] / some
    both = left[0] * share
    joined = (n, left[1] + dx * share, left[2] + dy * share, left[3] + right[3] + dx * dx * both, left[4] + right[4] + dy * dy * both, left[5] + right[5] + dx * dy * both)
    return tuple(blocks.windows(up[i, -1], joined[i]) for i in range(6))


def _weighted(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the last rows by weight, the oldest first."""
    d = len(weights)
    out = np.full(len(x), NAN)
    if len(x) >= d:
        out[d - 1 :] = np.correlate(x, weights, "valid")
    return out


def _laid_out(x: np.ndarray, d: int, what) -> np.ndarray:
    """``what`` of the windows as rows of a matrix, a bounded part at a time."""
    out = np.full(len(x), NAN)
    if len(x) < d:
        return out
    rows = np.lib.stride_tricks.sliding_window_view(x, d)
    step = max(1, LAID_OUT // d)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        out[at + d - 1 : at + d - 1 + len(part)] = what(part)
    return out


def _quantile(q: float, d: int):
    place = q * (d - 1)
    low = int(place)
    high = min(low + 1, d - 1)

    def what(rows: np.ndarray) -> np.ndarray:
        cut = np.partition(rows, (low, high), axis=1)
        a, b = cut[:, low], cut[:, high]
        return np.where(a == b, a, (high - place) * a + (place - low) * b) if high > low else a

    return what


def sma(values: np.ndarray, d: int, m: int, stack: Stack | None = None) -> np.ndarray:
    """m/d of the value and the rest of the state before; the first finite value
    starts it, a missing or infinite one ends it. All symbols go forward together."""
    stack = stack or Stack(len(values), np.zeros(min(1, len(values)), np.int64))
    out = np.full(len(values), NAN)
    if d == 0 or m > d:
        return out
    a = m / d
    order = np.argsort(-stack.sizes, kind="stable")
    starts, sizes = stack.starts[order], stack.sizes[order]
    state = np.full(len(starts), NAN)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -t, "left"))  # symbols of more than t rows
        v, s = values[starts[:k] + t], state[:k]
        new = np.where(np.isfinite(v), np.where(np.isnan(s), v, a * v + (1.0 - a) * s), NAN)
        out[starts[:k] + t] = new
        state[:k] = np.where(np.isfinite(new), new, NAN)
    return out


def solve(normal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many 4 x 4 systems by elimination with row pivots; NaN where a
    pivot is no greater than the machine epsilon."""
    m = np.concatenate([normal, right[..., None]], axis=-1)
    n = len(m)
    good = np.ones(n, bool)
    each = np.arange(n)
    for p in range(4):
        best = p + np.abs(m[:, p:, p]).argmax(axis=1)
        m[each, best], m[:, p] = m[:, p].copy(), m[each, best].copy()
        pivot = m[:, p, p]
        good &= np.abs(pivot) > np.finfo(float).eps
        m[:, p] = m[:, p] / pivot[:, None]
        for r in range(4):
            if r != p:
                m[:, r] = m[:, r] - m[:, r, p, None] * m[:, p]
    return np.where(good[:, None], m[:, :, 4], NAN)


def multi_resi(y: np.ndarray, x1: np.ndarray, x2: np.ndarray, x3: np.ndarray, d: int, stack: Stack | None = None) -> np.ndarray:
    """Last residual of the regression of y on three factors and a constant."""
    out = np.full(len(y), NAN)
    if d < 5 or len(y) < d:
        return out
    x = np.stack([np.ones(len(y)), x1, x2, x3], axis=1)
    rows = np.lib.stride_tricks.sliding_window_view
    xs, ys = rows(x, d, axis=0), rows(y, d)  # windows x 4 x d, windows x d
    bad = np.r_[0, np.cumsum(~(np.isfinite(x).all(axis=1) & np.isfinite(y)))]
    ok = bad[d:] == bad[:-d]
    if stack is not None:
        ok &= stack.age[d - 1 :] >= d - 1
    found = np.flatnonzero(ok)
    step = max(1, LAID_OUT // (4 * d))
    with np.errstate(all="ignore"):
        for at in range(0, len(found), step):
            part = found[at : at + step]
            a, b = xs[part], ys[part]
            beta = solve(a @ a.transpose(0, 2, 1), (a @ b[..., None])[..., 0])
            out[part + d - 1] = b[:, -1] - (beta * a[:, :, -1]).sum(axis=1)
    return out


def time_series(op: str, args: list[np.ndarray], params: tuple, stack: Stack) -> np.ndarray:
    """The operator over the last rows of each symbol."""
    x, n = args[0], stack.n
    if op == "delay":
        return stack.lag(x, params[0])
    if op == "delta":
        return x - stack.lag(x, params[0])
    if op == "sma":
        return sma(x, *params, stack)
    if op == "multi_resi":
        return multi_resi(*args, params[0], stack)
    if op == "scan_mul":
        v, c = args
        step = np.where((c == 1) & ~np.isnan(v), v, 1.0)
        out = np.concatenate([np.cumprod(step[a : a + k]) for a, k in zip(stack.starts, stack.sizes)]) if n else step
        return np.where(np.isnan(v) | np.isnan(c), NAN, out)
    d = params[0]
    if d == 0 or d > n:
        return np.full(n, NAN)
    if op == "conditional_beta":
        y, x, c = args
        k, _, _, xx, _, xy = moments(x, y, (c == 1) & np.isfinite(x) & np.isfinite(y), d, stack)
        return np.where((stack.age >= d - 1) & (k >= 2) & (xx > 0), xy / np.where(xx > 0, xx, 1.0), NAN)
    if op in ("correlation", "covariance", "rolling_beta"):
        y = args[1]
        if d == 1:
            return np.full(n, NAN)
        full = stack.full(np.where(np.isnan(x) | np.isnan(y), NAN, 0.0), d)
        _, _, _, xx, yy, xy = moments(x, y, ~(np.isnan(x) | np.isnan(y)), d, stack)
        if op == "covariance":
            return np.where(full, xy / (d - 1), NAN)
        if op == "correlation":
            full &= (xx > 0) & (yy > 0)
            return np.where(full, (xy / (d - 1)) / (np.sqrt(np.where(full, xx, 1.0) / (d - 1)) * np.sqrt(np.where(full, yy, 1.0) / (d - 1))), NAN)
        full &= yy > 0
        return np.where(full, xy / np.where(full, yy, 1.0), NAN)
    full = stack.full(x, d)
    middle = np.arange(d) - (d - 1) / 2

    def spread() -> np.ndarray:
        return moments(x, x, ~np.isnan(x), d, stack)[3]

    if op == "ts_sum":
        value = fold(x, d, np.add, stack)
    elif op == "ts_mean":
        value = fold(x, d, np.add, stack) / d
    elif op == "product":
        value = fold(x, d, np.multiply, stack)
    elif op == "ts_min":
        value = fold(x, d, np.minimum, stack)
    elif op == "ts_max":
        value = fold(x, d, np.maximum, stack)
    elif op == "ts_argmin":
        value = _laid_out(x, d, lambda w: w.argmin(axis=1))
    elif op == "ts_argmax":
        value = _laid_out(x, d, lambda w: w.argmax(axis=1))
    elif op in ("ts_rank", "ts_rank_raw"):
        less, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(d):
            old, now = x[: n - k], x[k:]
            less[k:] += old < now
            same[k:] += old == now
        value = less.astype(float) if op == "ts_rank_raw" else (2 * less + 1 + same) / (2.0 * d)
    elif op == "ts_std":
        value = np.sqrt(spread() / (d - 1)) if d > 1 else np.full(n, NAN)
    elif op == "quantile":
        value = _laid_out(x, d, _quantile(params[1], d)) if 0 <= params[1] <= 1 else np.full(n, NAN)
    elif op in ("slope", "resi", "rsquare"):
        if d == 1:
            return np.full(n, NAN)
        square = d * (d * d - 1) / 12
        slope = _weighted(x, middle) / square
        if op == "slope":
            value = slope
        elif op == "resi":
            value = x - fold(x, d, np.add, stack) / d - slope * ((d - 1) / 2)
        else:
            all_ = spread()
            value = np.where(all_ > 0, slope * slope * square / np.where(all_ > 0, all_, 1.0), NAN)
    elif op == "decay_linear":
        value = _weighted(x, np.arange(1.0, d + 1)) / (d * (d + 1) / 2)
    elif op == "wma":
        weights = 0.9 ** np.arange(d - 1, -1, -1.0)
        value = _weighted(x, weights) / weights.sum()
    else:
        raise ValueError(f"unknown time-series operator {op}")
    return np.where(full, value, NAN)


def ranks(x: np.ndarray, group: np.ndarray, share: bool = True) -> np.ndarray:
    """Average rank in each group, over the number of its values with ``share``."""
    out = np.full(len(x), NAN)
    live = np.flatnonzero(~np.isnan(x))
    if not len(live):
        return out
    order = live[np.lexsort((x[live], group[live]))]
    g, v = group[order], x[order]
    place = np.arange(len(order))
    first_of_group = np.r_[True, g[1:] != g[:-1]]
    first = first_of_group | np.r_[True, v[1:] != v[:-1]]
    start = np.maximum.accumulate(np.where(first_of_group, place, 0))
    low = np.maximum.accumulate(np.where(first, place, 0))
    run = np.cumsum(first) - 1
    high = np.r_[np.flatnonzero(first)[1:], len(order)][run]
    size = np.diff(np.r_[np.flatnonzero(first_of_group), len(order)])[np.cumsum(first_of_group) - 1]
    out[order] = ((low - start + 1) + (high - start)) / 2.0 / (size if share else 1)
    return out


def cross_section(op: str, x: np.ndarray, params: tuple, day: np.ndarray, group: np.ndarray | None) -> np.ndarray:
    """The operator over the rows of each day; ``day`` and ``group`` are numbers."""
    key = day if group is None else day * (int(group.max(initial=0)) + 1) + group
    if op in ("rank", "group_rank"):
        return ranks(x, key)
    known = ~np.isnan(x)
    if op == "scale":
        total = np.bincount(key, np.where(known, np.abs(x), 0.0))[key]
        return np.where(total > 0, x * params[0] / np.where(total > 0, total, 1.0), NAN)
    if op == "group_neutralize":
        _, key = np.unique(key, return_inverse=True)
        return x - (np.bincount(key, np.where(known, x, 0.0)) / np.maximum(np.bincount(key, known), 1))[key]
    raise ValueError(f"unknown cross-sectional operator {op}")


def _compare(test):
    return lambda a, b: np.where(np.isnan(a) | np.isnan(b), NAN, test(a, b))


ELEMENTWISE = {
    "neg": np.negative,
    "abs": np.abs,
    "log": lambda a: np.where(a > 0, np.log(np.where(a > 0, a, 1.0)), NAN),
    "sign": lambda a: np.sign(a) + 0.0,
    "power": np.power,
    "signed_power": lambda x, y: np.sign(x) * np.power(np.abs(x), y),
    "min": np.minimum,
    "max": np.maximum,
    "add": np.add,
    "sub": np.subtract,
    "mul": np.multiply,
    "div": np.divide,
    "lt": _compare(np.less),
    "gt": _compare(np.greater),
    "le": _compare(np.less_equal),
    "ge": _compare(np.greater_equal),
    "eq": _compare(np.equal),
    "where": lambda c, a, b: np.where(c > 0, a, np.where(c <= 0, b, NAN)),
}
