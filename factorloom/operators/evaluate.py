"""``evaluate``: how well factors rank future returns, as DataFrames.

The panel is read once. Tables of a day's own rows come from one pass over whole days,
those that follow a symbol from day to day from one over whole symbols behind it; each
pass makes sums for days, which are written, and the tables are made from those when
they are asked for. The daily tables are dense: a row for each day and factor, missing
where a day is too thin.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field as datafield
from functools import cache, cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import divide, known
from ..plans import arrays, phases
from ..sources import panel as P
from ..sources.scratch import written
from .labels import SLOT, day_index

LAGS = (1, 5, 10, 20)
DAYS_A_YEAR = 252.0
TABLES = ("summary", "rank_autocorr", "ic", "quantile_returns", "coverage", "turnover", "portfolio", "ic_monthly")
SUMMARY = "factor horizon n_days ic_mean ic_std ic_ir ic_t_nw ic_win_rate rank_ic_mean rank_ic_std rank_ic_ir rank_ic_t_nw rank_ic_win_rate spread_mean spread_t_nw monotonicity avg_coverage ls_gross_ann ls_net_ann ls_ir ls_turnover top_turnover bottom_turnover".split()


class Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers = {n: cache(make) for n, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __contains__(self, name: object) -> bool:
        return name in self._makers


@dataclass
class EvalResult:
    """Tables by name, and a snapshot of the options."""

    tables: Mapping[str, DataFrame]
    meta: dict
    output_dir: str | None = None
    _spark: SparkSession | None = datafield(default=None, repr=False)

    def __getattr__(self, name: str) -> DataFrame | None:
        if name in TABLES:
            return self.tables.get(name)
        raise AttributeError(name)

    def meta_json(self) -> str:
        return json.dumps(self.meta)

    def save(self, directory: str) -> None:
        """One Parquet table each and meta.json."""
        if self.output_dir is not None:
            raise ValueError("save() is only available in memory mode; the tables are already in output_dir")
        save_tables(self._spark, self.tables, self.meta, directory)


def save_tables(spark: SparkSession, tables: Mapping[str, DataFrame], meta: dict, directory: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{directory}/{name}.parquet")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/meta.json")


def load_result(spark: SparkSession, directory: str) -> EvalResult:
    """Tables that :func:`save_tables` wrote; ic_monthly may be absent."""
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{directory}/meta.json").collect()))
    tables = {}
    for name in TABLES:
        if name == "ic_monthly" and not meta.get("has_ic_monthly", True):
            continue
        tables[name] = spark.read.parquet(f"{directory}/{name}.parquet")
    return EvalResult(tables, meta, directory, spark)


def _labels(df: DataFrame, label_cols: list[str] | None, skip: set[str]) -> list[tuple[str, int]]:
    names = label_cols if label_cols is not None else [c for c in df.columns if re.fullmatch(r"ret_[0-9]+", c) and c not in skip]
    found = []
    for name in names:
        m = re.fullmatch(r"ret_([0-9]+)", name)
        if not m or int(m[1]) == 0:
            raise ValueError(f"label column `{name}` is not named ret_<horizon>")
        found.append((name, int(m[1])))
    if not found:
        raise ValueError("no label columns ret_<horizon> found")
    if len({h for _, h in found}) != len(found):
        raise ValueError("label columns have a horizon twice")
    return sorted(found, key=lambda x: x[1])


def global_cuts(values: DataFrame, quantiles: int) -> DataFrame:
    """``values``: factor, x. Returns factor, cuts (the interpolated quantiles k / q),
    least, most. Values are counted, dealt by range and numbered by running sums of
    the counts, so no factor's values meet in one task."""
    counted = values.groupBy("factor", "x").agg(F.count(F.lit(1)).alias("c"))
    ranged = written(counted.repartitionByRange("factor", "x").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("factor", "part").agg(F.sum("c").alias("c"))
    before = Window.partitionBy("factor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("factor", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("factor")).alias("n"))  # a row a part
    upto = F.sum("c").over(Window.partitionBy("factor", "part").orderBy("x"))
    placed = ranged.withColumn("upto", upto).join(sums, ["factor", "part"]).select("factor", "x", "n", (F.col("base") + F.col("upto") - F.col("c")).alias("lo"), (F.col("base") + F.col("upto")).alias("hi"))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(quantiles - 1)), lambda k: F.struct(k.alias("k"), (k / F.lit(float(quantiles)) * (F.col("n") - 1)).alias("at")))
    holds = lambda at: (at >= F.col("lo")) & (at < F.col("hi"))
    met = placed.select("factor", "x", "n", "lo", "hi", F.explode(F.filter(wanted, lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))).alias("w"))
    side = lambda f: F.max(F.when(holds(f(F.col("w.at"))), F.col("x")))
    ends = met.groupBy("factor", "w.k", "w.at").agg(side(F.floor).alias("a"), side(F.ceil).alias("b"))
    part = F.col("at") - F.floor("at")
    cut = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    cuts = ends.groupBy("factor").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", cut.alias("cut")))), lambda c: c["cut"]).alias("cuts"))
    return cuts.join(ranged.groupBy("factor").agg(F.min("x").alias("least"), F.max("x").alias("most")), "factor")


class _Base:
    """What all tables are made from."""

    def __init__(self, df, symbol, time, factors, labels, quantiles, binning, group, tradable, demean, weighting, gate) -> None:
        self.factors, self.q, self.weighting, self.gate = factors, quantiles, weighting, gate
        self.horizons = [h for _, h in labels]
        names = [n for n, _ in labels]
        rows = P.clean(df.select(*dict.fromkeys([symbol, time, *factors, *names, *([tradable] if tradable else []), *([group] if group else [])])), [*factors, *names]).where(F.col(f"`{time}`").isNotNull())
        live = F.coalesce(F.col(f"`{tradable}`"), F.lit(False)) if tradable else F.lit(True)
        rows = rows.withColumn("__live", live)
        ys = {f"__y{h}": F.col(f"`{n}`") for n, h in labels}
        if demean != "none":
            over = Window.partitionBy(time) if demean == "universe" else Window.partitionBy(time, group)
            ys = {k: y - F.coalesce(F.avg(F.when(F.col("__live"), y)).over(over), F.lit(0.0)) for k, y in ys.items()}
        rows = written(rows.select(F.col(f"`{symbol}`").alias("s"), F.col(f"`{time}`").alias("date"), "__live", *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(factors)], *[y.alias(k) for k, y in ys.items()]), "rows")
        self.days = written(day_index(rows, "date"), "days")
        self.n_days, self.n_rows = self.days.count(), rows.count()
        self.rows = rows.join(self.days, "date")
        self.cuts: dict[str, tuple] = {}
        if binning == "global":
            long = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"f{i}").alias("x")) for i, f in enumerate(factors)])).alias("fx")
            cuts = global_cuts(rows.where("__live").select(long).select("fx.*").where("x is not null"), quantiles)
            self.cuts = {c["factor"]: (c["cuts"], c["least"], c["most"]) for c in cuts.collect()}  # a row a factor
        self.global_bins = binning == "global"

    def by_day(self) -> DataFrame:
        """The rows, whole days together and in order of symbols."""
        return self.rows.drop("date").repartition(SLOT).sortWithinPartitions(SLOT, "s")

    @cached_property
    def daily(self) -> DataFrame:
        """A row for each day and factor: counts, correlations by horizon, bins."""
        bins = ", ".join(["bucket: int, lo: double, hi: double, count: int", *[f"s{h}: double, n{h}: bigint" for h in self.horizons]])
        schema = f"{SLOT} int, factor string, n_rows long, n_valid int, n_masked int, ic array<struct<horizon: int, ic: double, rank_ic: double, spread: double>>, bins array<struct<{bins}>>"
        found = self.by_day().drop("s").mapInArrow(_day_tables(_Days(self)), schema)
        return written(found.join(self.days, SLOT), "daily")

    @cached_property
    def flows(self) -> DataFrame:
        """Sums over symbols by factor, slot and horizon, or lag: ``SUMS``, ``MOMENTS``."""
        n = len(self.factors)
        symbol = self.rows.schema["s"].dataType.simpleString()
        ranked = self.by_day().mapInArrow(_day_ranks(_Days(self)), f"s {symbol}, {SLOT} int, {phases.PACK} binary")
        sums = ", ".join(f"v{i} double" for i in range(len(SUMS)))
        moved = ranked.repartition("s").sortWithinPartitions("s", SLOT).mapInArrow(_symbol_flows(self.factors, self.horizons, self.q, self.n_days, 3 * n + 1), f"lagged boolean, factor string, k int, {SLOT} int, {sums}")
        return written(moved.groupBy("lagged", "factor", "k", SLOT).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(SUMS))]), "flows")

    def dense(self) -> DataFrame:
        wanted = [(f, h) for f in self.factors for h in self.horizons]
        grid = self.days.sparkSession.createDataFrame(wanted, "factor string, horizon int")
        return self.days.crossJoin(F.broadcast(grid))  # days x the list of factors and horizons


class _Days:
    """A day's bins, ranks and weights, factor by factor."""

    def __init__(self, b: _Base) -> None:
        self.factors, self.horizons, self.q, self.gate, self.weighting = b.factors, b.horizons, b.q, b.gate, b.weighting
        self.cuts, self.global_bins = b.cuts, b.global_bins

    @staticmethod
    def split(batches):
        """Tables of one day each."""
        for table in phases.whole_runs(batches, SLOT):
            at = [*phases.starts(table.column(SLOT)), table.num_rows]
            for a, z in zip(at, at[1:]):
                yield table.slice(a, z - a)

    def binned(self, factor: str, x: np.ndarray) -> np.ndarray:
        """Bins of the values of a day, which are in order of symbols."""
        if self.global_bins:
            return sum((x > c).astype(np.int64) for c in self.cuts[factor][0])
        bucket = np.empty(len(x), np.int64)
        bucket[np.argsort(x, kind="stable")] = np.arange(len(x)) * self.q // len(x)
        return bucket

    def edges(self, factor: str, x: np.ndarray, bucket: np.ndarray, k: int) -> tuple[float, float]:
        if not self.global_bins:
            mine = x[bucket == k]
            return mine.min(), mine.max()
        cuts, least, most = self.cuts[factor]
        return least if k == 0 else cuts[k - 1], most if k == self.q - 1 else cuts[min(k + 1, self.q - 1) - 1]

    def weights(self, x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        if self.weighting == "factor":
            raw = x - x.mean()
            all_ = np.abs(raw).sum()
            return np.zeros(len(x)) if all_ == 0 else raw / all_
        top, bottom = bucket == self.q - 1, bucket == 0
        return np.where(bottom, -0.5 / max(bottom.sum(), 1), np.where(top, 0.5 / max(top.sum(), 1), 0.0))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float, copy=False)


def _flags(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(bool)


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Of at least two rows; missing for a constant side and where it is no number."""
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return None
    with np.errstate(all="ignore"):
        dx, dy = x - x.mean(), y - y.mean()
        n = len(x) - 1
        vx, vy = dx @ dx / n, dy @ dy / n
        c = dx @ dy / n / np.sqrt(vx * vy) if vx > 0 and vy > 0 else np.nan
    return None if np.isnan(c) else float(c)


def _day_tables(days: _Days):
    f, i, n = pa.float64(), pa.int32(), pa.int64()
    line = pa.struct([("horizon", i), ("ic", f), ("rank_ic", f), ("spread", f)])
    bin_ = pa.struct([("bucket", i), ("lo", f), ("hi", f), ("count", i), *[x for h in days.horizons for x in ((f"s{h}", f), (f"n{h}", n))]])
    schema = pa.schema([(SLOT, i), ("factor", pa.string()), ("n_rows", n), ("n_valid", i), ("n_masked", i), ("ic", pa.list_(line)), ("bins", pa.list_(bin_))])

    def run(batches):
        for table in days.split(batches):
            live, n = _flags(table, "__live"), table.num_rows
            ys = {h: _column(table, f"__y{h}") for h in days.horizons}
            out = []
            for i, factor in enumerate(days.factors):
                x = _column(table, f"f{i}")
                there = ~np.isnan(x)
                rows = np.flatnonzero(there & live)
                one = {SLOT: table.column(SLOT)[0].as_py(), "factor": factor, "n_rows": n, "n_valid": len(rows), "n_masked": int((there & ~live).sum())}
                thick = len(rows) >= max(days.gate, 1)
                x = x[rows]
                bucket = days.binned(factor, x) if thick else np.empty(0, np.int64)
                bins = {int(k): dict(zip(("lo", "hi"), map(float, days.edges(factor, x, bucket, k))), bucket=int(k), count=int(c)) for k, c in zip(*np.unique(bucket, return_counts=True))}
                ic = []
                for h, y in ys.items():
                    line: dict = {"horizon": h, "ic": None, "rank_ic": None, "spread": None}
                    if thick:
                        y = y[rows]
                        known = ~np.isnan(y)
                        a, b, place = x[known], y[known], bucket[known]
                        with np.errstate(all="ignore"):
                            sums, counts = np.bincount(place, b, days.q), np.bincount(place, minlength=days.q)
                            for k, found in bins.items():
                                found |= {f"s{h}": float(sums[k]) if counts[k] else None, f"n{h}": int(counts[k])}
                            if len(a) >= max(days.gate, 2):
                                same = np.zeros(len(a), np.int64)
                                spread = sums[-1] / counts[-1] - sums[0] / counts[0] if counts[-1] and counts[0] else np.nan
                                line |= {"ic": _correlation(a, b), "rank_ic": _correlation(arrays.ranks(a, same, share=False), arrays.ranks(b, same, share=False)), "spread": None if np.isnan(spread) else float(spread)}
                    ic.append(line)
                out.append(one | {"ic": ic, "bins": list(bins.values())})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def _day_ranks(days: _Days):
    """Packed for each row: ranks about the day's middle, bins and weights of all
    factors (missing where they are not valid), and the next day's return."""

    def run(batches):
        for table in days.split(batches):
            live, n = _flags(table, "__live"), table.num_rows
            out = np.full((3 * len(days.factors) + 1, n), np.nan)
            for i, factor in enumerate(days.factors):
                x = _column(table, f"f{i}")
                rows = np.flatnonzero(~np.isnan(x) & live)
                if len(rows) < max(days.gate, 1):
                    continue
                x = x[rows]
                bucket = days.binned(factor, x)
                with np.errstate(all="ignore"):
                    out[3 * i : 3 * i + 3, rows] = arrays.ranks(x, np.zeros(len(x), np.int64), share=False) - (len(x) + 1) / 2, bucket, days.weights(x, bucket)
            if 1 in days.horizons:
                out[-1] = _column(table, "__y1")
            whole = pa.Table.from_arrays([table.column("s"), table.column(SLOT), pa.chunked_array([phases._packed(list(out), n)])], names=["s", SLOT, phases.PACK])
            yield from whole.combine_chunks().to_batches(max_chunksize=phases.ROWS)

    return run


#: Sums of a horizon's rows in ``flows``, and of a lag's.
SUMS = ("gross", "moved", "top_kept", "top", "bottom_kept", "bottom", "valid")
MOMENTS = ("n", "a", "p", "aa", "pp", "ap")


def _symbol_flows(factors: list[str], horizons: list[int], q: int, n_days: int, width: int):
    """Sums over the symbols of a task. A symbol's rows lie on a line of slots from its
    first to its last, with room behind for the longest look back."""
    room = max(*horizons, *LAGS)

    def run(batches):
        flow = np.zeros((len(factors), len(horizons), len(SUMS), n_days))
        lags = np.zeros((len(factors), len(LAGS), len(MOMENTS), n_days))
        for table in phases.whole_runs(batches, "s"):
            slot = table.column(SLOT).to_numpy().astype(np.int64)
            first = phases.starts(table.column("s"))
            last = np.r_[first[1:], len(slot)] - 1
            spans = slot[last] - slot[first] + 1 + room
            begin = np.cumsum(spans) - spans - slot[first]  # where slot 0 would be
            place = slot + np.repeat(begin, last - first + 1)
            size = int(spans.sum())
            day = np.arange(size) - np.repeat(begin, spans)
            inside = np.flatnonzero(day < n_days)
            at = day[inside]
            total = lambda v: np.bincount(at, v[inside], n_days)
            packed = phases._unpacked(table.column(phases.PACK), width)

            def line(column: np.ndarray, empty: float) -> np.ndarray:
                out = np.full(size, empty)
                out[place] = column
                return out

            def back(x: np.ndarray, k: int, empty) -> np.ndarray:
                return np.r_[np.full(min(k, size), empty), x[: max(size - k, 0)]] if k else x

            paid = line(packed[:, -1], np.nan)
            for i in range(len(factors)):
                rank, bucket, weight = packed[:, 3 * i : 3 * i + 3].T
                valid = ~np.isnan(bucket)
                rank = line(rank, np.nan)
                top, bottom = line(bucket == q - 1, 0.0) > 0, line(bucket == 0, 0.0) > 0
                w = line(np.where(valid, weight, 0.0), 0.0)
                for j, h in enumerate(horizons):
                    sums = flow[i, j]
                    if 1 in horizons:
                        with np.errstate(all="ignore"):
                            held, some = w.copy(), w != 0
                            for k in range(1, h):
                                held += back(w, k, 0.0)
                                some |= back(w, k, 0.0) != 0
                            held /= np.minimum(h, day + 1)
                            sums[0] += total(np.where(some & ~np.isnan(paid), held * paid, 0.0))
                            sums[1] += total(np.abs(held - back(held, 1, 0.0)))
                    for k, outer in ((2, top), (4, bottom)):
                        sums[k] += total(outer & back(outer, h, False))
                        sums[k + 1] += total(outer)
                    sums[6] += np.bincount(slot[valid], minlength=n_days)
                for j, k in enumerate(LAGS):
                    past = back(rank, k, np.nan)
                    both = ~np.isnan(rank) & ~np.isnan(past)
                    a, p = np.where(both, rank, 0.0), np.where(both, past, 0.0)
                    for v, x in enumerate((both, a, p, a * a, p * p, a * p)):
                        lags[i, j, v] += total(x)
        for lagged, keys, sums in ((False, horizons, flow), (True, LAGS, lags)):
            for i, factor in enumerate(factors):
                for j, k in enumerate(keys):
                    some = np.flatnonzero((sums[i, j] != 0).any(axis=0))
                    if len(some):
                        values = [pa.array(x) for x in sums[i, j][:, some]]
                        values += [pa.nulls(len(some), pa.float64())] * (len(SUMS) - len(values))
                        keyed = [pa.array([lagged] * len(some)), pa.array([factor] * len(some)), pa.array([k] * len(some), pa.int32()), pa.array(some.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*keyed, *values], names=["lagged", "factor", "k", SLOT, *[f"v{v}" for v in range(len(SUMS))]])

    return run


def _flow(b: _Base, lagged: bool) -> DataFrame:
    names = MOMENTS if lagged else SUMS
    return b.flows.where(F.col("lagged") == lagged).select("factor", F.col("k").alias("lag" if lagged else "horizon"), SLOT, *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)])


def _coverage(b: _Base) -> DataFrame:
    return b.daily.select("date", SLOT, "factor", "n_rows", "n_valid", "n_masked")


def _ic(b: _Base) -> DataFrame:
    return b.daily.select("date", SLOT, "factor", F.explode("ic").alias("c")).select("date", SLOT, "factor", "c.*")


def _quantiles(b: _Base) -> DataFrame:
    each = b.daily.select("date", SLOT, "factor", F.explode("bins").alias("b")).select("date", SLOT, "factor", "b.*")
    means = [F.try_divide(F.col(f"s{h}"), F.col(f"n{h}")).alias(f"mean_ret_{h}") for h in b.horizons]
    sums = [x for h in b.horizons for x in (F.col(f"s{h}").alias(f"__s{h}"), F.col(f"n{h}").alias(f"__n{h}"))]
    return each.select("date", SLOT, "factor", "bucket", F.col("lo").alias("bin_lo"), F.col("hi").alias("bin_hi"), "count", *means, *sums)


def newey_west_t(series: np.ndarray, lag: int) -> float:
    """t of the mean with Bartlett weights up to ``lag``."""
    n = len(series)
    if n < 2:
        return float("nan")
    d = series - series.mean()
    top = min(lag, n - 1)
    variance = (d @ d) / n + sum(2 * (1 - k / (top + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, top + 1))
    return float(series.mean() / np.sqrt(variance / n)) if variance > 0 else float("nan")


def kendall_tau(values: np.ndarray) -> float:
    """Tau-a of values against their order."""
    n = len(values)
    if n < 2:
        return float("nan")
    i, j = np.triu_indices(n, 1)
    return float(np.sign(values[j] - values[i]).sum() / (n * (n - 1) / 2))


def _series(group: pd.DataFrame) -> pd.DataFrame:
    """Statistics of the daily series of one factor and horizon."""
    group = group.sort_values(SLOT)
    h = int(group["horizon"].iloc[0])
    out: dict = {"factor": group["factor"].iloc[0], "horizon": h}
    for name in ("ic", "rank_ic", "spread"):
        x = group[name].to_numpy(dtype=float)
        x = x[~np.isnan(x)]
        mean = x.mean() if len(x) else np.nan
        with np.errstate(all="ignore"):
            std = x.std(ddof=1) if len(x) > 1 else np.nan
            ratio = np.float64(mean) / np.float64(std)
        if name == "ic":
            out["n_days"] = len(x)
        out[f"{name}_mean"] = mean
        out[f"{name}_t_nw"] = newey_west_t(x, max(h - 1, 0))
        if name != "spread":
            out |= {f"{name}_std": std, f"{name}_ir": ratio, f"{name}_win_rate": (x > 0).mean() if len(x) else np.nan}
    return pd.DataFrame([out])


_SERIES = "factor string, horizon int, n_days int, " + ", ".join(f"{n} double" for n in SUMMARY[3:15])


def _turnover(b: _Base) -> DataFrame:
    """Share of a day's outer buckets that was not in them ``horizon`` days before."""
    flow = _flow(b, False)
    shares = [F.when(F.col(n) > 0, 1.0 - F.try_divide(F.col(f"{n}_kept"), F.col(n))).alias(f"{n}_turnover") for n in ("top", "bottom")]
    before = flow.where("valid > 0").select("factor", "horizon", F.col(SLOT).alias("was"), F.lit(True).alias("was_valid"))
    out = b.dense().join(flow.select("factor", "horizon", SLOT, *shares), ["factor", "horizon", SLOT], "left")
    out = out.withColumn("was", F.col(SLOT) - F.col("horizon")).join(before, ["factor", "horizon", "was"], "left")
    return out.select("date", SLOT, "factor", "horizon", *[F.when(F.col("was_valid"), F.col(c)).alias(c) for c in ("top_turnover", "bottom_turnover")])


def _portfolio(b: _Base, cost_bps: float) -> DataFrame:
    if 1 not in b.horizons:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("gross", "net", "turnover")]
        return b.dense().select("date", SLOT, "factor", "horizon", *nothing)
    out = b.dense().join(_flow(b, False).select("factor", "horizon", SLOT, "gross", "moved"), ["factor", "horizon", SLOT], "left")
    turnover = F.when(F.col(SLOT) > 0, F.coalesce(F.col("moved") / 2, F.lit(0.0)))
    gross = F.coalesce("gross", F.lit(0.0))
    return out.select("date", SLOT, "factor", "horizon", known(gross).alias("gross"), known(gross - F.coalesce(turnover, F.lit(0.0)) * cost_bps * 1e-4).alias("net"), turnover.alias("turnover"))


def _autocorr(b: _Base) -> DataFrame:
    c = {n: F.col(n) for n in MOMENTS}
    va, vp = c["n"] * c["aa"] - c["a"] * c["a"], c["n"] * c["pp"] - c["p"] * c["p"]
    r = F.when((c["n"] >= 2) & (va > 0) & (vp > 0), known((c["n"] * c["ap"] - c["a"] * c["p"]) / (F.sqrt(va) * F.sqrt(vp))))
    mean = _flow(b, True).groupBy("factor", "lag").agg(F.avg(r).alias("rank_autocorr"))
    grid = b.days.sparkSession.createDataFrame([(f, k) for f in b.factors for k in LAGS if k < b.n_days], "factor string, lag int")
    return grid.join(mean, ["factor", "lag"], "left").select("factor", "lag", "rank_autocorr")


def year_month(df: DataFrame, name: str) -> tuple[Column, Column] | None:
    """Year and month of a date, timestamp, packed YYYYMMDD number, or YYYYMMDD or
    YYYY-MM-DD string; None for other types. Implausible values give NULL."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(c), F.month(c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = c.cast("long")
        year, month = F.floor(n / 10000).cast("int"), (F.floor(n / 100) % 100).cast("int")
    elif isinstance(kind, T.StringType):
        compact = F.when(c.rlike(r"^\d{8}$"), c).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.regexp_replace(c, "-", ""))
        year, month = F.substring(compact, 1, 4).cast("int"), F.substring(compact, 5, 2).cast("int")
    else:
        return None
    ok = year.between(1000, 9999) & month.between(1, 12)
    return F.when(ok, year), F.when(ok, month)


def _monthly(b: _Base) -> DataFrame:
    year, month = year_month(b.days, "date")
    got = _ic(b).groupBy(year.alias("year"), month.alias("month"), "factor", "horizon").agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"))
    return got.where("ic_mean is not null or rank_ic_mean is not null")


def _summary(b: _Base, cost_bps: float) -> DataFrame:
    """A row for each factor and horizon."""
    coverage, quantile, turnover, portfolio = _coverage(b), _quantiles(b), _turnover(b), _portfolio(b, cost_bps)
    tau = F.udf(lambda rows: kendall_tau(np.array([m for _, m in sorted(rows)])), "double")
    pooled = reduce(DataFrame.union, [quantile.groupBy("factor", F.lit(h).alias("horizon"), "bucket").agg((F.sum(f"__s{h}") / F.nullif(F.sum(f"__n{h}"), F.lit(0))).alias("mean")) for h in b.horizons])
    monotone = pooled.where("mean is not null").groupBy("factor", "horizon").agg(F.collect_list(F.struct("bucket", "mean")).alias("means")).select("factor", "horizon", tau("means").alias("monotonicity"))
    covered = coverage.groupBy("factor").agg(F.avg(F.col("n_valid") / F.col("n_rows")).alias("avg_coverage"))
    year = F.lit(DAYS_A_YEAR)
    flows = portfolio.groupBy("factor", "horizon").agg(
        (F.avg("gross") * year).alias("ls_gross_ann"), (F.avg("net") * year).alias("ls_net_ann"), F.avg("net").alias("__mean"), F.stddev_samp("net").alias("__std"), F.avg("turnover").alias("ls_turnover")
    )
    flows = flows.withColumn("ls_ir", known(divide(F.col("__mean"), F.col("__std")) * F.sqrt(year)))
    outer = turnover.groupBy("factor", "horizon").agg(F.avg("top_turnover").alias("top_turnover"), F.avg("bottom_turnover").alias("bottom_turnover"))
    series = _ic(b).groupBy("factor", "horizon").applyInPandas(_series, _SERIES)
    keys = ["factor", "horizon"]
    summary = series.join(monotone, keys, "left").join(covered, "factor", "left").join(flows, keys, "left").join(outer, keys, "left")
    return summary.select("factor", "horizon", "n_days", *[known(F.col(c)).alias(c) for c in SUMMARY[3:]])


def evaluate(df: DataFrame, symbol_col: str, time_col: str, factor_cols: list[str], label_cols: list[str] | None = None, quantiles: int = 10, binning: str = "daily", group_col: str | None = None, tradable_col: str | None = None, demean: str = "none", min_cs_count: int = 30, cost_bps: float = 0.0, weighting: str = "quantile", factor_source: str | None = None, output_dir: str | None = None, validate: bool = True) -> EvalResult:
    """Eight tables on the factors against the labels ``ret_{h}``. ``factor_source``
    reads the factors from Parquet; ``output_dir`` writes the tables as they are
    made and reads them back."""
    for value, known_values, name in ((binning, ("daily", "global"), "binning"), (demean, ("none", "universe", "group"), "demean"), (weighting, ("quantile", "factor"), "weighting")):
        if value not in known_values:
            raise ValueError(f"{name} must be one of {', '.join(known_values)}")
    if quantiles < 2:
        raise ValueError("quantiles must be at least 2")
    if not factor_cols or len(set(factor_cols)) != len(factor_cols):
        raise ValueError("factor_cols must be non-empty and unique")
    labels = _labels(df, label_cols, set(factor_cols))
    if set(factor_cols) & {n for n, _ in labels}:
        raise ValueError("factor_cols must be non-empty and unique; a factor is also a label")
    spark = df.sparkSession
    if demean == "group":
        if group_col is None:
            raise ValueError("demean='group' needs group_col")
        if not isinstance(P.field(df, group_col), T.StringType):
            raise ValueError(f"group column `{group_col}` must be a string")
    for name, _ in labels:
        P.require_double(df, name)
    if tradable_col:
        P.require_boolean(df, tradable_col)
    if validate:
        P.check_keys(df, symbol_col, time_col, [group_col] if demean == "group" else [])
    if factor_source:
        source = P.read_factors(spark, factor_source, symbol_col, time_col, factor_cols)
        P.check_same_keys(df, source, symbol_col, time_col)
        df = df.select(*[f"`{c}`" for c in df.columns if c not in factor_cols]).join(source, [symbol_col, time_col])
    for name in factor_cols:
        P.require_double(df, name)
    b = _Base(df, symbol_col, time_col, factor_cols, labels, quantiles, binning, group_col if demean == "group" else None, tradable_col, demean, weighting, min_cs_count)
    day = ["date", "factor", "horizon"]
    makers: dict[str, Callable[[], DataFrame]] = {
        "summary": lambda: _summary(b, cost_bps),
        "rank_autocorr": lambda: _autocorr(b),
        "ic": lambda: _ic(b).select(*day, "ic", "rank_ic"),
        "quantile_returns": lambda: _quantiles(b).select("date", "factor", (F.col("bucket") + 1).alias("bin"), "bin_lo", "bin_hi", "count", *[f"mean_ret_{h}" for h in b.horizons]),
        "coverage": lambda: _coverage(b).select("date", "factor", "n_valid", "n_masked"),
        "turnover": lambda: _turnover(b).select(*day, "top_turnover", "bottom_turnover"),
        "portfolio": lambda: _portfolio(b, cost_bps).select(*day, "gross", "net", "turnover"),
    }
    months = year_month(b.days, "date")
    monthly = months is not None and not b.days.where(months[0].isNull()).limit(1).collect()
    if monthly:
        makers["ic_monthly"] = lambda: _monthly(b)
    made: Mapping[str, DataFrame] = Tables(makers)
    meta = {
        "symbol_col": symbol_col, "time_col": time_col, "quantiles": quantiles, "binning": binning, "demean": demean, "min_cs_count": min_cs_count, "cost_bps": cost_bps, "weighting": weighting,
        "horizons": b.horizons, "label_cols": [n for n, _ in labels], "factor_count": len(factor_cols), "group_col": group_col, "tradable_col": tradable_col, "n_days": b.n_days, "n_rows": b.n_rows,
        "factor_source": factor_source, "output_dir": output_dir,
    }
    if output_dir is not None:
        save_tables(spark, made, meta | {"has_ic_monthly": monthly}, output_dir)
        made = {n: spark.read.parquet(f"{output_dir}/{n}.parquet") for n in made}
    return EvalResult(made, meta, output_dir, spark)


def _day_correlations(k: int, gate: int):
    """Sums over the days of a task of the correlations of ranks, and their number,
    for each pair of factors: products of the matrices of a day's ranks."""

    def run(batches):
        total, days = np.zeros((k, k)), np.zeros((k, k), np.int64)
        for table in phases.whole_runs(batches, "t"):
            stack = arrays.Stack(table.num_rows, phases.starts(table.column("t")))
            day = np.repeat(np.arange(len(stack.starts)), stack.sizes)
            ranked = np.stack([arrays.ranks(table.column(f"f{i}").to_numpy().astype(float), day, share=False) for i in range(k)], axis=1)
            for at, size in zip(stack.starts, stack.sizes):
                r = ranked[at : at + size]
                live = ~np.isnan(r)
                live &= live.sum(axis=0) >= gate
                m, r = live.astype(float), np.where(live, r, 0.0)
                n, s, q = m.T @ m, r.T @ m, (r * r).T @ m  # ranks are halves: sums are exact
                with np.errstate(all="ignore"):
                    vx, vy, xy = q * n - s * s, q.T * n - s.T * s.T, (r.T @ r) * n - s * s.T
                    c = xy / np.sqrt(vx * vy)
                np.fill_diagonal(c, 1.0)
                known = np.where(np.eye(k, dtype=bool), np.diag(n) > 0, (n >= gate) & (vx > 0) & (vy > 0))
                total += np.where(known, c, 0.0)
                days += known
        i, j = np.nonzero(days)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(days[i, j])], names=["i", "j", "total", "days"])

    return run


def factor_correlation(df: DataFrame, symbol_col: str, time_col: str, factor_cols: list[str], tradable_col: str | None = None, min_cs_count: int = 30, validate: bool = True) -> DataFrame:
    """Mean daily correlation of the factors' ranks: a row and a column for each."""
    if not factor_cols:
        raise ValueError("factor_cols must be non-empty and unique")
    for name in factor_cols:
        P.require_double(df, name)
    if tradable_col:
        P.require_boolean(df, tradable_col)
    if validate:
        P.check_keys(df, symbol_col, time_col)
    gate = max(min_cs_count, 2)
    rows = P.clean(df.select(*dict.fromkeys([symbol_col, time_col, *factor_cols, *([tradable_col] if tradable_col else [])])), list(factor_cols))
    if tradable_col:
        rows = rows.where(F.coalesce(F.col(f"`{tradable_col}`"), F.lit(False)))
    # the columns by number: their names are free, and doubles of one kind go to the workers
    rows = rows.select(F.col(f"`{time_col}`").alias("t"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(factor_cols)])
    sums = rows.repartition("t").sortWithinPartitions("t").mapInArrow(_day_correlations(len(factor_cols), gate), "i int, j int, total double, days long")
    mean = sums.groupBy("i", "j").agg((F.sum("total") / F.nullif(F.sum("days"), F.lit(0).cast("long"))).alias("c"))
    wide = mean.groupBy("i").agg(*[F.max(F.when(F.col("j") == j, F.col("c"))).alias(f) for j, f in enumerate(factor_cols)])
    names = df.sparkSession.createDataFrame(list(enumerate(factor_cols)), "i int, factor string")
    return names.join(wide, "i", "left").orderBy("i").select("factor", *[f"`{f}`" for f in factor_cols])
