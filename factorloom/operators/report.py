"""Curves and figures of a report on evaluated factors, as DataFrames, and a small
server of them.

All functions take tables of :func:`..evaluate.evaluate` (any number of factors).
Missing and infinite values are gaps: sums skip them, means leave them out.
"""

from __future__ import annotations

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 30
_KEYS = ("factor", "horizon")


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def _by_day(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def cumulative(table: DataFrame, value: str, keys: tuple[str, ...] = _KEYS, out: str = "total") -> DataFrame:
    """Running sum of ``value`` by day; a day without a value keeps the sum."""
    over = _by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(out, F.sum(F.coalesce(_finite(F.col(value)), F.lit(0.0))).over(over))


def rolling_mean(table: DataFrame, value: str, window: int | None = None, keys: tuple[str, ...] = _KEYS, out: str = "mean") -> DataFrame:
    """Mean of the values of the last ``window`` days, fewer at the start. By default
    a quarter of a series' days, 2 at least and 21 at most."""
    if window is not None:
        return table.withColumn(out, F.avg(_finite(F.col(value))).over(_by_day(*keys).rowsBetween(-(window - 1), 0)))
    days = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    sized = table.withColumn("__w", F.least(F.lit(21), F.greatest(F.lit(2), F.floor(days / 4)))).withColumn("__i", F.row_number().over(_by_day(*keys)))
    recent = F.collect_list(F.struct("__i", _finite(F.col(value)).alias("v"))).over(_by_day(*keys).rowsBetween(-20, 0))
    known = F.filter(recent, lambda x: (x["__i"] > F.col("__i") - F.col("__w")) & x["v"].isNotNull())
    return sized.withColumn("__k", known).withColumn(out, F.when(F.size("__k") > 0, F.aggregate("__k", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("__k"))).drop("__w", "__i", "__k")


def drawdown(table: DataFrame, value: str = "total", keys: tuple[str, ...] = _KEYS, out: str = "drawdown") -> DataFrame:
    """A running sum less its highest point so far."""
    return table.withColumn(out, F.col(value) - F.max(value).over(_by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)))


def histogram(table: DataFrame, value: str = "ic", bins: int = BINS, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """keys, bin (from 0), center, count: ``bins`` bins of equal width between the
    least and the greatest value, which are widened by a half if they are equal."""
    known = table.select(*keys, _finite(F.col(value)).alias("v")).where("v is not null")
    ends = known.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    placed = known.join(ends, list(keys)).groupBy(*keys, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.col("width"))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = ends.select(*keys, "lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(placed, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + F.col("width") * (F.col("bin") + 0.5)).alias("center"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def horizons(quantiles: DataFrame) -> list[int]:
    return sorted(int(c[9:]) for c in quantiles.columns if c.startswith("mean_ret_"))


def _long(quantiles: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), _finite(F.col(f"mean_ret_{h}")).alias("r")) for h in horizons(quantiles)])).alias("x")
    return quantiles.select("date", "factor", "bin", "count", each).select("date", "factor", "bin", "count", "x.*")


def bin_means(quantiles: DataFrame) -> DataFrame:
    """factor, horizon, bin, mean_ret: mean return of each bin, days weighted by their counts."""
    known = _long(quantiles).where("r is not null and count > 0")
    return known.groupBy("factor", "horizon", "bin").agg((F.sum(F.col("r") * F.col("count")) / F.sum("count")).alias("mean_ret"))


def spread_by_horizon(quantiles: DataFrame) -> DataFrame:
    """factor, horizon, spread (highest bin less lowest) and spread for each day of it."""
    ends = quantiles.groupBy("factor").agg(F.max("bin").alias("top"), F.min("bin").alias("bottom"))
    means = bin_means(quantiles).join(ends, "factor")
    at = lambda c: F.max(F.when(F.col("bin") == F.col(c), F.col("mean_ret")))
    out = means.groupBy("factor", "horizon").agg((at("top") - at("bottom")).alias("spread"))
    return out.withColumn("spread_per_day", F.col("spread") / F.col("horizon"))


def quantile_curves(quantiles: DataFrame) -> DataFrame:
    """date, factor, bin, ret, total: running return of each bin at the shortest
    horizon, for every day of the factor."""
    h = horizons(quantiles)[0]
    grid = quantiles.select("factor", "date").distinct().join(quantiles.select("factor", "bin").distinct(), "factor")
    daily = quantiles.select("date", "factor", "bin", F.col(f"mean_ret_{h}").alias("ret"))
    return cumulative(grid.join(daily, ["factor", "date", "bin"], "left"), "ret", ("factor", "bin"))


def long_short(portfolio: DataFrame) -> DataFrame:
    """The portfolio with the running net return and its drawdown."""
    return drawdown(cumulative(portfolio, "net"))


def center(table: DataFrame, value: str = "ic", keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """keys, n, mean, median and share of positive values."""
    x = _finite(F.col(value))
    return table.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.avg((x > 0).cast("double")).alias("positive"))


def _json(value):
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def _columns(table: DataFrame) -> dict:
    rows = table.collect()  # one factor: a row for each day, horizon and bin
    return {c: [_json(r[c]) for r in rows] for c in table.columns}


class Report:
    """What a page on factors asks for. ``result``: of evaluate, or of load_result."""

    def __init__(self, result) -> None:
        self.result = result
        self.summary = [{k: _json(v) for k, v in r.asDict().items()} for r in result.tables["summary"].collect()]  # a row for each factor and horizon
        self.factors = list(dict.fromkeys(r["factor"] for r in self.summary))

    def meta(self) -> dict:
        return self.result.meta | {"factors": self.factors}

    def bundle(self, factor: str) -> dict:
        """Every series of one factor, by table and column."""
        if factor not in self.factors:
            raise KeyError(factor)
        out: dict = {"factor": factor}
        for name, table in (("ic", "ic"), ("quantiles", "quantile_returns"), ("portfolio", "portfolio"), ("monthly", "ic_monthly")):
            df = self.result.tables.get(table)
            order = [c for c in ("date", "year", "month", "horizon", "bin") if df is not None and c in df.columns]
            out[name] = None if df is None else _columns(df.where(F.col("factor") == factor).orderBy(*order))
        return out

    def answer(self, path: str):
        """Status and content of a route."""
        if path == "/api/meta":
            return 200, self.meta()
        if path == "/api/summary":
            return 200, self.summary
        if path.startswith("/api/factor/"):
            try:
                return 200, self.bundle(unquote(path[len("/api/factor/") :]))
            except KeyError as e:
                return 404, {"error": f"no factor {e}"}
        return 404, {"error": f"no route {path}"}


def serve(result, port: int = 8080) -> ThreadingHTTPServer:
    """A server of the routes on this machine, not yet running: call serve_forever.
    POST /api/shutdown ends it."""
    report = Report(result)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, content) -> None:
            body = json.dumps(content).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            self._send(*report.answer(self.path.split("?")[0]))

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/api/shutdown":
                return self._send(404, {"error": f"no route {self.path}"})
            self._send(200, {"ok": True})
            threading.Thread(target=self.server.shutdown).start()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(args: list[str] | None = None) -> None:
    """Serve a saved result: --dir DIRECTORY [--port 8080] [--open]."""
    import argparse
    import webbrowser

    from pyspark.sql import SparkSession

    from .evaluate import load_result

    parser = argparse.ArgumentParser(description="Serve a saved evaluation.")
    parser.add_argument("--dir", required=True)
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--open", action="store_true")
    given = parser.parse_args(args)
    server = serve(load_result(SparkSession.builder.getOrCreate(), given.dir), given.port)
    if given.open:
        webbrowser.open(f"http://127.0.0.1:{given.port}/api/summary")
    server.serve_forever()


if __name__ == "__main__":
    main()
