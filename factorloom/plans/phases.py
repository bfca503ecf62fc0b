"""A plan as phases on Arrow batches.

All operators of a phase run in one pass over rows that are dealt by symbol, or by
time, and sorted: one exchange, one sort and one Python node for a phase, however
many operators it has. A pass holds whole symbols (or days) of some ten thousand
rows at once; columns that it does not read go through as they are. What a phase
makes for later ones travels as one column of packed doubles, since hundreds of
columns would cost the exchange and its generated code more than the operators.
A phase makes all it can anew from the panel's columns and takes from the phase
before only what is dealt by the other key.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import CROSS_SECTION, Expr
from . import arrays

#: Rows of a pass, at least, unless there are no more; whole symbols or days.
ROWS = 1 << 15
PACK = "__pack"


class Pass:
    """What one phase computes: ``wanted`` expressions by name, from columns and
    from what the phase before packed (``ready``: names by expression). The wanted
    ones are packed, or columns in the last phase; ``kept`` columns go on besides."""

    def __init__(self, by: str, wanted: dict[str, Expr], ready: dict[int, str], values, last: bool) -> None:
        self.by, self.wanted, self.ready, self.values, self.last = by, wanted, ready, values, last
        self.packed = {name: i for i, name in enumerate(ready.values())}
        self.kept: list[str] = []
        self.steps: list[Expr] = []
        seen: set[int] = set()
        stack = [(e, False) for e in reversed(wanted.values())]
        while stack:
            e, done = stack.pop()
            if e.key in seen or e.key in ready or e.op in ("col", "lit"):
                continue
            if done:
                seen.add(e.key)
                self.steps.append(e)
            else:
                stack.append((e, True))
                stack += [(a, False) for a in values(e)]
        self.uses = Counter(a.key for e in self.steps for a in values(e))
        self.uses.update(e.key for e in wanted.values())
        self.groups = sorted({e.args[1].params[0] for e in self.steps if e.op in ("group_rank", "group_neutralize")})

    def names(self) -> list[str]:
        return list(self.wanted) if self.last else [PACK]

    def __call__(self, table: pa.Table) -> list[pa.Array]:
        """What is passed on of a table of whole symbols or days in order."""
        n = table.num_rows
        stack = arrays.Stack(n, starts(table.column(self.by)))
        day = np.repeat(np.arange(len(stack.starts)), stack.sizes)
        groups = {g: table.column(g).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for g in self.groups}
        columns: dict[str, np.ndarray] = {}
        matrix = _unpacked(table.column(PACK), len(self.packed)) if self.packed else None
        made: dict[int, np.ndarray] = {}
        left = Counter(self.uses)

        def read(name: str) -> np.ndarray:
            if name not in columns:
                columns[name] = np.ascontiguousarray(matrix[:, self.packed[name]]) if name in self.packed else table.column(name).to_numpy().astype(float, copy=False)
            return columns[name]

        def value(e: Expr):
            if e.op == "lit":
                return e.params[0]
            if e.key in self.ready:
                return read(self.ready[e.key])
            if e.op == "col":
                return read(e.params[0])
            x = made[e.key]
            left[e.key] -= 1
            if not left[e.key]:
                del made[e.key]
            return x

        with np.errstate(all="ignore"):
            for e in self.steps:
                args = [value(a) for a in self.values(e)]
                if e.op in arrays.ELEMENTWISE:
                    made[e.key] = arrays.ELEMENTWISE[e.op](*map(np.float64, args) if all(np.isscalar(a) for a in args) else args)
                    continue
                args = [np.broadcast_to(np.asarray(a, float), n) for a in args]
                if e.op in CROSS_SECTION:
                    made[e.key] = arrays.cross_section(e.op, args[0], e.params, day, groups[e.args[1].params[0]] if len(e.args) > 1 else None)
                else:
                    made[e.key] = arrays.time_series(e.op, args, e.params, stack)
            out = [np.broadcast_to(np.asarray(value(e), float), n) for e in self.wanted.values()]
        return [pa.array(np.array(x), pa.float64(), mask=np.isnan(x)) for x in out] if self.last else [_packed(out, n)]


def _packed(columns: list[np.ndarray], n: int) -> pa.Array:
    """Doubles side by side, as one binary value a row."""
    data = np.stack(columns, axis=1) if columns else np.empty((n, 0))
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(8 * len(columns))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _unpacked(column: pa.ChunkedArray, k: int) -> np.ndarray:
    whole = column.combine_chunks()
    if not len(whole):
        return np.empty((0, k))
    ends = np.frombuffer(whole.buffers()[1], np.int32)
    return np.frombuffer(whole.buffers()[2], np.float64, k * len(whole), int(ends[whole.offset])).reshape(-1, k)


def starts(column: pa.ChunkedArray) -> np.ndarray:
    """First rows of runs of equal values."""
    if len(column) == 0:
        return np.empty(0, np.int64)
    codes = column.combine_chunks()
    codes = (codes if pa.types.is_integer(codes.type) and not codes.null_count else codes.dictionary_encode("encode").indices).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1]


def whole_runs(batches, by: str):
    """Tables of some ``ROWS`` rows of sorted batches, each of whole runs of ``by``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows + batch.num_rows >= ROWS:  # only the new rows are looked at: a run may be of many batches
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cut = int(starts(pa.Table.from_batches([*before, batch]).column(by))[-1]) - len(before)  # the last run may go on
            if rows + cut > 0 and cut >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows = [], 0
                batch = batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _runner(todo: Pass):
    def run(batches):
        for table in whole_runs(batches, todo.by):
            new = todo(table)
            whole = pa.Table.from_arrays([*(table.column(c) for c in todo.kept), *map(pa.chunked_array, ([x] for x in new))], names=[*todo.kept, *todo.names()])
            yield from whole.combine_chunks().to_batches(max_chunksize=ROWS)

    return run


def run_pass(df: DataFrame, todo: Pass, order: list[str]) -> DataFrame:
    """``df`` by ``todo.by``, sorted by ``order``, with the wanted columns."""
    schema = T.StructType([df.schema[c] for c in todo.kept] + [T.StructField(c, T.DoubleType() if todo.last else T.BinaryType()) for c in todo.names()])
    dealt = df.repartition(F.col(f"`{todo.by}`")).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    return dealt.mapInArrow(_runner(todo), schema)


def evaluate(plan, df: DataFrame, symbol: str, time: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and the outputs of ``plan``, phase by phase."""
    last = max((at[0] for at in plan.at.values()), default=0) or 1
    outputs = plan.outputs
    place = {n: f"__o{i}" for i, n in enumerate(outputs)}
    wanted = {place[n]: e for n, e in outputs.items()}
    todo: list[tuple[dict[str, Expr], dict[int, str]]] = []
    for p in range(last, 0, -1):
        needs = _needs(plan, wanted.values(), p) if p > 1 else {}
        todo.insert(0, (wanted, {k: f"__n{k}" for k in needs}))
        wanted = {f"__n{k}": e for k, e in needs.items()}
    passes = [Pass(time if i % 2 else symbol, wanted, ready, plan.values, i == len(todo) - 1) for i, (wanted, ready) in enumerate(todo)]
    kept = list(dict.fromkeys([*keep, symbol, time]))
    for one in reversed(passes):
        one.kept = kept
        kept = list(dict.fromkeys([*kept, *_inputs(one), *one.groups]))
    passes = [one for one in passes if one.wanted]  # no symbol's operators before the first day's
    for one in passes:
        read = dict.fromkeys([*one.kept, *_inputs(one), *one.groups, *([PACK] if one.packed else [])])
        df = run_pass(df.select(*[F.col(f"`{c}`") for c in read]), one, [symbol, time] if one.by == symbol else [time, symbol])
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(place[n]).alias(n) for n in outputs])


def _needs(plan, wanted, p: int) -> dict[int, Expr]:
    """What phase ``p`` takes from the phase before to make ``wanted``: operators by
    the other key, or what is made of several of them alone. All else a phase makes
    anew from the panel's columns, so no value waits through exchanges for its use."""
    own = lambda e: (e.op in CROSS_SECTION) == (p % 2 == 0)
    near: dict[int, frozenset[int]] = {}  # the operators next below a value
    for e in plan.nodes.values():
        if e.op in arrays.ELEMENTWISE:
            near[e.key] = frozenset().union(*(near[a.key] for a in e.args))
        else:
            near[e.key] = frozenset() if e.op in ("col", "lit") else frozenset([e.key])
    found: dict[int, Expr] = {}
    seen: set[int] = set()
    stack = list(wanted)
    while stack:
        e = stack.pop()
        if e.key in seen or e.op in ("col", "lit"):
            continue
        seen.add(e.key)
        below = near[e.key]
        if below and not any(own(plan.nodes[k]) for k in below) and (len(below) > 1 or e.key in below):
            found[e.key] = e
        else:
            stack += plan.values(e)
    return dict(sorted(found.items()))


def _inputs(todo: Pass) -> list[str]:
    """Columns that the pass reads."""
    found = {}
    for e in [*todo.wanted.values(), *todo.steps]:
        for a in (e, *todo.values(e)):
            if a.key not in todo.ready and a.op == "col":
                found[a.params[0]] = None
    return list(found)
