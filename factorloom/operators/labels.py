"""``with_labels``: forward returns on the panel-wide grid of dates.

A label looks up grid slots, not rows, so a day that a symbol misses makes its
labels missing instead of shifting them. Slots are read with RANGE frames over
the slot number, so one exchange by symbol serves all horizons.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divide, known
from ..sources.panel import check_keys, clean, field, require_boolean, require_double

SLOT = "__slot"


def day_index(df: DataFrame, time_col: str) -> DataFrame:
    """time, __slot: running number of the distinct times, from 0. It is as long as
    the calendar, whatever the number of symbols."""
    return df.select(time_col).distinct().withColumn(SLOT, F.row_number().over(Window.orderBy(time_col)) - 1)


def _grid(df: DataFrame, time_col: str, calendar) -> tuple[DataFrame, list[str]]:
    if calendar is None:
        return day_index(df, time_col), []
    spark = df.sparkSession
    days = [r[0] for r in calendar.collect()] if isinstance(calendar, DataFrame) else list(calendar)
    kind = field(df, time_col)
    frame = calendar.toDF(time_col) if isinstance(calendar, DataFrame) else spark.createDataFrame([(d,) for d in days], f"`{time_col}` {kind.simpleString()}")
    if frame.schema[0].dataType != kind:
        raise ValueError(f"calendar is {frame.schema[0].dataType.simpleString()}, the time column {kind.simpleString()}")
    if any(not a < b for a, b in zip(days, days[1:])):
        raise ValueError("calendar must be strictly increasing")
    seen = [r[0] for r in df.select(time_col).distinct().collect()]  # one value a day
    place = {d: i for i, d in enumerate(days)}
    for t in seen:
        if t not in place:
            raise ValueError(f"time {t} of the panel is not in the calendar")
    if not seen:
        return day_index(df, time_col), []
    first, last = min(map(place.get, seen)), max(map(place.get, seen))
    missing = sorted(set(days[first : last + 1]) - set(seen))
    grid = spark.createDataFrame([(d, i) for i, d in enumerate(days[first : last + 1])], f"`{time_col}` {kind.simpleString()}, {SLOT} int")
    return grid, list(map(str, missing))


def with_labels(df: DataFrame, symbol_col: str, time_col: str, horizons: list[int], entry_lag: int = 1, entry_col: str = "close", exit_col: str = "close", tradable_col: str | None = None, calendar=None, validate: bool = True) -> DataFrame:
    """``df`` with ``ret_{h}``: exit at slot g + entry_lag + h over entry at slot
    g + entry_lag, less 1; and ``tradable_entry`` if ``tradable_col`` is given.
    Values beyond the grid and of missing rows are missing; an entry that cannot
    be looked up is not tradable."""
    if not horizons or len(set(horizons)) != len(horizons) or any(not isinstance(h, int) or h <= 0 for h in horizons):
        raise ValueError("horizons must be non-empty, positive, and unique")
    if entry_lag < 0:
        raise ValueError("entry_lag must be 0 or more")
    new = [f"ret_{h}" for h in horizons] + (["tradable_entry"] if tradable_col else [])
    for name in new:
        if name in df.columns:
            raise ValueError(f"column `{name}` already exists in the input DataFrame")
    field(df, symbol_col), field(df, time_col)
    for name in {entry_col, exit_col}:
        require_double(df, name)
    if tradable_col:
        require_boolean(df, tradable_col)
    if validate:
        check_keys(df, symbol_col, time_col)
    grid, missing = _grid(df, time_col, calendar)
    if missing:
        shown = ", ".join(missing[:20]) + (" ..." if len(missing) > 20 else "")
        warnings.warn(f"{len(missing)} calendar days have no panel rows: {shown}", UserWarning, stacklevel=2)
    rows = clean(df.withColumns({"__entry": F.col(entry_col), "__exit": F.col(exit_col)}), ["__entry", "__exit"]).join(grid, time_col)
    slots = Window.partitionBy(symbol_col).orderBy(SLOT)
    at = lambda c, k: F.max(c).over(slots.rangeBetween(k, k))
    looked = {"__in": at("__entry", entry_lag)} | {f"__out_{h}": at("__exit", entry_lag + h) for h in horizons}
    if tradable_col:
        looked["tradable_entry"] = F.coalesce(at(tradable_col, entry_lag), F.lit(False))
    rows = rows.withColumns(looked)
    rows = rows.withColumns({f"ret_{h}": known(divide(F.col(f"__out_{h}"), F.col("__in")) - 1.0) for h in horizons})
    return rows.select(*[f"`{c}`" for c in df.columns], *new)
