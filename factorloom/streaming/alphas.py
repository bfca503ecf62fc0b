"""``stream_alphas``: factors of a stream of bars, micro-batch by micro-batch.

A micro-batch brings whole days, later than all days before. Its factors need the
last days of the panel only, as many as the longest chain of windows goes back; they
are kept in a table of their own, written anew with each batch. Both tables carry
the batch's number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import TIME_SERIES, Expr
from ..operators.alphas import with_alphas

_ENDLESS = frozenset(("sma", "scan_mul"))


def lookback(e: Expr) -> int:
    """Rows of a symbol before a row that its value depends on. Operators that go
    back to a symbol's first row have no such number and are an error."""
    done: dict[int, int] = {}

    def walk(x: Expr) -> int:
        if x.key not in done:
            if x.op in _ENDLESS:
                raise ValueError(f"{x.op} depends on all rows before; it has no streaming form")
            own = 0
            if x.op in TIME_SERIES or x.op == "multi_resi":
                own = x.params[0] if x.op in ("delay", "delta") else max(0, x.params[0] - 1)
            done[x.key] = own + max(map(walk, x.args), default=0)
        return done[x.key]

    return walk(e)


def stream_alphas(bars: DataFrame, symbol_col: str, time_col: str, alphas: list[Expr], output_path: str, state_path: str, checkpoint_path: str, days: int | None = None, **trigger) -> StreamingQuery:
    """Start the query: ``bars`` (a streaming frame) with the alphas, written as
    Parquet below ``output_path``, a folder a batch. ``days`` is the number of past
    days kept: the lookback by default, which is right for symbols with a row every
    day; more days cover symbols with gaps. ``trigger``: of writeStream.trigger."""
    kept = max(map(lookback, alphas), default=0) if days is None else days
    columns = bars.columns

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        if new.isEmpty():
            return
        marked = new.select(*[f"`{c}`" for c in columns], F.lit(True).alias("__new"))
        before = _latest(spark, state_path, number)
        if before is not None:
            marked = before.select(*[f"`{c}`" for c in columns], F.lit(False).alias("__new")).unionByName(marked)
        found = with_alphas(marked, symbol_col, time_col, alphas, validate=False).where("__new").drop("__new")
        found.write.mode("overwrite").parquet(f"{output_path}/batch={number}")
        last = marked.select(time_col).distinct().orderBy(F.desc(time_col)).limit(max(1, kept))  # days, not rows
        marked.drop("__new").join(F.broadcast(last), time_col, "left_semi").write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()


def _latest(spark, state_path: str, number: int) -> DataFrame | None:
    """The days kept by the last batch before ``number``; older ones are deleted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = sorted(int(s.getPath().getName()[6:]) for s in files.listStatus(path) if s.getPath().getName().startswith("batch="))
    older = [n for n in found if n < number]
    for n in older[:-1]:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/batch={n}"), True)
    return spark.read.parquet(f"{state_path}/batch={older[-1]}") if older else None
