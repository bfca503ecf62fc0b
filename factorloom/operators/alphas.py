"""``compute_alphas`` and ``with_alphas``: a batch of expressions over a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr
from ..plans.planner import evaluate
from ..sources.panel import check_keys, clean, field, require_double, require_group


def _checked(df: DataFrame, symbol_col: str, time_col: str, alphas: list[Expr], taken: list[str], validate: bool) -> dict[str, Expr]:
    outputs: dict[str, Expr] = {}
    for e in alphas:
        name = e.output_name()
        if name is None:
            raise ValueError("alpha expression is missing an alias")
        if name in outputs or name in taken:
            raise ValueError(f"output column `{name}` conflicts with another column")
        outputs[name] = e
    field(df, symbol_col), field(df, time_col)
    groups = sorted(set().union(*(e.group_inputs() for e in alphas))) if alphas else []
    for name in sorted(set().union(*(e.value_inputs() for e in alphas))) if alphas else []:
        require_double(df, name)
    for name in groups:
        require_group(df, name)
    if validate:
        check_keys(df, symbol_col, time_col, groups)
    return outputs


def _values(alphas: list[Expr]) -> list[str]:
    return sorted(set().union(*(e.value_inputs() for e in alphas))) if alphas else []


def compute_alphas(df: DataFrame, symbol_col: str, time_col: str, alphas: list[Expr], output_path: str | None = None, validate: bool = True, ordered: bool = True, time_major: bool = False):
    """Panel of time, symbol and the alphas, sorted by symbol and time, or by time
    and symbol with ``time_major``; with ``output_path`` it is written as Parquet
    and a summary returned: the path, the files with rows (one for a small panel)
    and the rows. ``validate`` checks the keys, ``ordered=False`` spares the sort."""
    outputs = _checked(df, symbol_col, time_col, alphas, [symbol_col, time_col], validate)
    used = [c for c in _values(alphas) if c not in (symbol_col, time_col)]
    groups = sorted(set().union(*(e.group_inputs() for e in alphas)) - set(used)) if alphas else []
    source = clean(df.select(*dict.fromkeys([time_col, symbol_col, *used, *groups])), used)
    out = evaluate(source, symbol_col, time_col, outputs, [time_col, symbol_col])
    order = [time_col, symbol_col] if time_major else [symbol_col, time_col]
    if output_path is None:
        return out.orderBy(*order) if ordered else out
    out.orderBy(*order).write.mode("overwrite").parquet(output_path)
    batches, rows = df.sparkSession.read.parquet(output_path).agg(F.countDistinct("_metadata.file_path"), F.count(F.lit(1))).first()
    return {"output_path": output_path, "n_observations": batches, "n_rows": rows}


def with_alphas(df: DataFrame, symbol_col: str, time_col: str, alphas: list[Expr], validate: bool = True, order_col: str | None = None) -> DataFrame:
    """All columns of ``df`` and the alphas. Spark frames have no row order;
    ``order_col`` names a column of ``df`` that numbers its rows, by which the result
    is sorted."""
    outputs = _checked(df, symbol_col, time_col, alphas, df.columns, validate)
    used = [c for c in _values(alphas) if c not in (symbol_col, time_col)]
    if order_col is not None:
        field(df, order_col)
    out = evaluate(clean(df, used), symbol_col, time_col, outputs, df.columns)
    return out if order_col is None else out.orderBy(order_col)
