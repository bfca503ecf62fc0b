"""From a batch of expressions to a staged plan, and its two ways to run.

Equal subtrees of the whole batch are one node. Every window operator becomes a
column at the earliest step at which its arguments exist. Steps alternate between
two partitionings, by symbol (odd phases) and by time (even phases), and all
operators of a phase share its exchange; operators nested within a phase become
levels of it, which Spark runs on the same partitioning and order. So a batch
costs one exchange for each change of partitioning in its longest chain, however
many factors it has.

Plans of few, cheap operators become Spark windows, which stay in generated code.
Spark goes through the whole window again at every row, and compiles a stage for
every level, so plans of more work run phase by phase on Arrow batches instead
(``phases``), in time that does not grow with the windows' lengths. Results are
the same up to rounding.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ELEMENTWISE, REPEATING, known
from ..functions.expr import CROSS_SECTION, RECURSIVE, TIME_SERIES, Expr
from ..functions.windows import Frames, cross_section, time_series
from . import phases

ROW = "__row"
#: Operators whose window Spark lays out as a list at every row, or has none for.
_LISTED = frozenset("ts_rank ts_rank_raw quantile wma product".split()) | RECURSIVE
#: Rows that the windows of a plan may go through again at every row.
WINDOW_ROWS = 64
_NEEDS_ROW = frozenset("ts_argmin ts_argmax slope rsquare resi decay_linear conditional_beta".split())


class Plan:
    """Nodes of a batch, their steps and their uses."""

    def __init__(self, outputs: dict[str, Expr]) -> None:
        self.outputs = outputs
        self.nodes: dict[int, Expr] = {}
        self.uses: dict[int, int] = defaultdict(int)
        for e in outputs.values():
            self._collect(e)
            self.uses[e.key] += 1
        self.held: set[int] = set()  # nodes that become columns
        self.at: dict[int, tuple[int, int, int]] = {}
        for e in self.nodes.values():  # arguments come first
            self._place(e)

    def _collect(self, root: Expr) -> None:
        stack = [(root, False)]
        while stack:
            e, done = stack.pop()
            if e.key in self.nodes:
                continue
            if done:
                self.nodes[e.key] = e
                for a in self.values(e):
                    self.uses[a.key] += 1
            else:
                stack.append((e, True))
                stack += [(a, False) for a in self.values(e)]

    @staticmethod
    def values(e: Expr) -> tuple[Expr, ...]:
        """Arguments that are values (a group is no value)."""
        return e.args[:1] if e.op in ("group_rank", "group_neutralize") else e.args

    def _place(self, e: Expr) -> None:
        args = [self.at[a.key] for a in self.values(e)]
        phase, level, depth = max(args, default=(0, 0, 0))
        if e.op in ELEMENTWISE:
            if e.op in REPEATING:
                for a in e.args:
                    if a.op in ELEMENTWISE and a.key not in self.held:
                        self._hold(a)
                phase, level, depth = max(self.at[a.key] for a in e.args)
            self.at[e.key] = phase, level, depth
            if self.uses[e.key] > 1:
                self._hold(e)
        elif e.op in ("col", "lit"):
            self.at[e.key] = 0, 0, 0
        else:
            odd = e.op in TIME_SERIES or e.op in RECURSIVE
            if not odd and e.op not in CROSS_SECTION:
                raise ValueError(f"unknown operator {e.op}")
            for a in self.values(e):
                if a.op in ELEMENTWISE and a.key not in self.held:
                    self._hold(a)
            phase, level, depth = max(self.at[a.key] for a in self.values(e))
            same = phase > 0 and phase % 2 == odd
            self.at[e.key] = (phase, level + 1, 0) if same else (phase + 1 + (phase % 2 == odd if phase else not odd), 1, 0)
            self.held.add(e.key)

    def _hold(self, e: Expr) -> None:
        """Make an elementwise node a column, one projection after its arguments."""
        phase, level, depth = self.at[e.key]
        self.held.add(e.key)
        self.at[e.key] = phase, level, depth + 1

    def is_light(self) -> bool:
        """Whether Spark windows are the better way."""
        rows = 0
        for e in self.nodes.values():
            if e.op in _LISTED:
                return False
            if e.op in CROSS_SECTION or e.op in ("delay", "delta", "scan_mul"):
                rows += 4
            elif e.op in TIME_SERIES:
                rows += e.params[0]
        return rows <= WINDOW_ROWS

    def exchanges(self) -> int:
        """Changes of partitioning in the longest chain."""
        return len({p for p, _, _ in self.at.values() if p})


class Lowering:
    """Columns of a plan over a frame with missing values as NULL."""

    def __init__(self, plan: Plan, symbol: str, time: str) -> None:
        self.plan, self.frames = plan, Frames(symbol, time)
        self.ready: set[int] = set()

    def name(self, e: Expr) -> str:
        return f"__n{e.key}"

    def column(self, e: Expr) -> Column:
        if e.op == "col":
            return F.col(f"`{e.params[0]}`")
        if e.op == "lit":
            return F.lit(e.params[0])
        if e.key in self.ready:
            return F.col(self.name(e))
        return ELEMENTWISE[e.op](*map(self.column, e.args)).cast("double")

    def window(self, e: Expr) -> Column:
        args = [self.column(a) for a in self.plan.values(e)]
        if e.op in CROSS_SECTION:
            group = e.args[1].params[0] if len(e.args) > 1 else None
            return cross_section(e.op, args, e.params, self.frames, group)
        return time_series(e.op, args, e.params, self.frames, F.col(ROW))


def evaluate(df: DataFrame, symbol: str, time: str, outputs: dict[str, Expr], keep: list[str], engine: str = "auto") -> DataFrame:
    """``keep`` columns of ``df`` and a column for each output. Value columns of
    ``df`` must be doubles without NaN. ``engine``: windows, arrays or auto."""
    plan = Plan(outputs)
    if engine == "arrays" or engine == "auto" and not plan.is_light():
        return phases.evaluate(plan, df, symbol, time, keep)
    low = Lowering(plan, symbol, time)
    steps: dict[tuple, list[Expr]] = defaultdict(list)
    for e in plan.nodes.values():
        if e.key in plan.held:
            steps[plan.at[e.key]].append(e)
    order = sorted(steps)
    needed_after: list[set] = [set() for _ in order]
    live = {k for e in outputs.values() for k in _reads(plan, e)}
    for i in range(len(order) - 1, -1, -1):
        needed_after[i] = set(live)
        for e in steps[order[i]]:
            for a in plan.values(e):
                live |= _reads(plan, a)
    fields = {e.params[0] for e in plan.nodes.values() if e.op == "col"} | {e.args[1].params[0] for e in plan.nodes.values() if e.op in ("group_rank", "group_neutralize")}
    carried = list(dict.fromkeys([*keep, symbol, time, *sorted(fields)]))
    df = df.select(*[f"`{c}`" for c in carried])
    if any(e.op in _NEEDS_ROW for e in plan.nodes.values()):
        df = df.withColumn(ROW, low.frames.index())
        carried.append(ROW)
    for i, step in enumerate(order):
        todo = steps[step]
        if any(e.op in RECURSIVE for e in todo):
            raise ValueError("recursive operators have no Spark window; use engine='arrays'")
        new = {}
        for e in todo:
            if e.op in ELEMENTWISE:
                new[low.name(e)] = ELEMENTWISE[e.op](*map(low.column, e.args)).cast("double")
            else:
                new[low.name(e)] = low.window(e)
        stay = [f"__n{k}" for k in sorted(low.ready) if k in needed_after[i]]
        df = df.select(*[f"`{c}`" for c in carried], *stay, *[c.alias(n) for n, c in new.items()])
        low.ready |= {e.key for e in todo}
    return df.select(*[f"`{c}`" for c in keep], *[known(low.column(e)).alias(n) for n, e in outputs.items()])


def _reads(plan: Plan, e: Expr) -> set[int]:
    """Held nodes that the value of ``e`` is read from."""
    found, stack = set(), [e]
    while stack:
        x = stack.pop()
        if x.key in plan.held:
            found.add(x.key)
        else:
            stack += plan.values(x)
    return found
