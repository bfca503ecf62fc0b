"""Queries over the order-line panel, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation_queries as evaluation
from .functions.formula import parse
from .functions.libraries import gtja_alpha191, qlib_alpha158, worldquant_alpha101
from .operators.alphas import compute_alphas
from .plans.sql import lower
from .rounding import cut_sql, rounded
from .sources.lineitem_panel import SQL as PANEL
from .sources.lineitem_panel import WIDE_SQL, bars
from .sources.panel import check_same_keys, read_factors, roundtrip
from .sources.scratch import new_folder

_W = "(partition by asset order by time)"
_T = "(partition by time)"


def _frame(d: int) -> str:
    return f"(partition by asset order by time rows between {d - 1} preceding and current row)"


def _gate(d: int, value: str, x: str = "close") -> str:
    return f"case when count({x}) over {_frame(d)} = {d} then {value} end"


def _roll(agg: str, d: int, x: str = "close") -> str:
    return _gate(d, f"{agg} over {_frame(d)}", x)


def _rank(x: str, by: str = "time") -> str:
    return f"(rank() over (partition by {by} order by {x}) + count(*) over (partition by {by} order by {x} range between unbounded preceding and current row)) / 2.0 / count(*) over (partition by {by})"


_RET = "(close / lag(close) over (partition by asset order by time) - 1)"

#: operator: (formula, SQL of the same over ``panel``)
OPERATORS: dict[str, tuple[str, str]] = {
    "add": ("close + open", "close + open"),
    "sub": ("close - open", "close - open"),
    "mul": ("close * volume", "close * volume"),
    "div": ("(close - open) / volume", "(close - open) / volume"),
    "neg": ("-close", "-close"),
    "abs": ("abs(close - open)", "abs(close - open)"),
    "log": ("log(close - open)", "case when close - open > 0 then ln(case when close - open > 0 then close - open end) end"),
    "sign": ("sign(close - open)", "sign(close - open)"),
    "power": ("power(close / open, 1.5)", "pow(close / open, 1.5)"),
    "signed_power": ("signed_power(close - open, 0.5)", "sign(close - open) * pow(abs(close - open), 0.5)"),
    "min": ("min(open, close)", "least(open, close)"),
    "max": ("max(open, close)", "greatest(open, close)"),
    "lt": ("close < open", "case when close < open then 1 else 0 end"),
    "gt": ("close > open", "case when close > open then 1 else 0 end"),
    "le": ("close <= open", "case when close <= open then 1 else 0 end"),
    "ge": ("close >= open", "case when close >= open then 1 else 0 end"),
    "eq": ("close == high", "case when close = high then 1 else 0 end"),
    "where": ("high if close > open else low", "case when close > open then high else low end"),
    "and": ("(close > open) and (volume > 150)", "case when close > open and volume > 150 then 1 else 0 end"),
    "or": ("(close > open) or (volume > 150)", "case when close > open or volume > 150 then 1 else 0 end"),
    "delay": ("delay(close, 2)", f"lag(close, 2) over {_W}"),
    "delta": ("delta(close, 3)", f"close - lag(close, 3) over {_W}"),
    "ts_sum": ("ts_sum(volume, 5)", _roll("sum(volume)", 5)),
    "ts_mean": ("ts_mean(close, 5)", _roll("avg(close)", 5)),
    "product": ("product(close / open, 4)", _roll("product(close / open)", 4)),
    "ts_min": ("ts_min(low, 6)", _roll("min(low)", 6)),
    "ts_max": ("ts_max(high, 6)", _roll("max(high)", 6)),
    "ts_argmin": ("ts_argmin(low, 6)", _gate(6, f"list_position(list(low) over {_frame(6)}, min(low) over {_frame(6)}) - 1")),
    "ts_argmax": ("ts_argmax(high, 6)", _gate(6, f"list_position(list(high) over {_frame(6)}, max(high) over {_frame(6)}) - 1")),
    "ts_rank": ("ts_rank(close, 8)", _gate(8, f"(2 * len(list_filter(list(close) over {_frame(8)}, lambda v: v < close)) + 1 + len(list_filter(list(close) over {_frame(8)}, lambda v: v = close))) / 16.0")),
    "ts_rank_raw": ("ts_rank_raw(close, 8)", _gate(8, f"len(list_filter(list(close) over {_frame(8)}, lambda v: v < close))")),
    "ts_std": ("ts_std(close, 10)", _roll("stddev_samp(close)", 10)),
    "quantile": ("quantile(close, 10, 0.8)", _roll("quantile_cont(close, 0.8)", 10)),
    "slope": ("slope(close, 10)", _roll("regr_slope(close, i)", 10)),
    "rsquare": ("rsquare(close, 10)", _roll("regr_r2(close, i)", 10)),
    "resi": ("resi(close, 10)", _gate(10, f"close - avg(close) over {_frame(10)} - (regr_slope(close, i) over {_frame(10)}) * 4.5")),
    "decay_linear": ("decay_linear(close, 5)", _gate(5, f"(sum(close * i) over {_frame(5)} - (i - 5) * sum(close) over {_frame(5)}) / 15.0")),
    "wma": ("wma(close, 4)", f"case when i >= 4 then (close + 0.9 * lag(close, 1) over {_W} + 0.81 * lag(close, 2) over {_W} + 0.729 * lag(close, 3) over {_W}) / 3.439 end"),
    "correlation": ("correlation(close, volume, 12)", _gate(12, f"corr(close, volume) over {_frame(12)}")),
    "covariance": ("covariance(close, volume, 12)", _gate(12, f"covar_samp(close, volume) over {_frame(12)}")),
    "rolling_beta": ("rolling_beta(close, open, 12)", _gate(12, f"regr_slope(close, open) over {_frame(12)}")),
    "conditional_beta": ("conditional_beta(close, vwap, close > open, 20)", f"case when i >= 20 and count(case when close > open then 1 end) over {_frame(20)} >= 2 then regr_slope(case when close > open then close end, case when close > open then vwap end) over {_frame(20)} end"),
    "scan_mul": ("scan_mul(0.9 + volume / 2000, close > open)", f"product(case when close > open then 0.9 + volume / 2000 else 1 end) over {_W}"),
    "adv": ("adv(20)", _roll("avg(volume)", 20)),
    "returns": ("close / delay(close, 1) - 1", _RET),
    "rank": ("rank(close)", _rank("close")),
    "scale": ("scale(close - open, 2)", f"2 * (close - open) / nullif(sum(abs(close - open)) over {_T}, 0)"),
    "group_rank": ("group_rank(close, industry)", _rank("close", "time, industry")),
    "group_neutralize": ("group_neutralize(close, sector)", "close - avg(close) over (partition by time, sector)"),
}
#: Operators without a framed window: recursions, and regressions on three factors.
UNPAIRED = {"sma": "sma(close, 5, 2)", "multi_resi": "multi_resi(close / delay(close, 1) - 1, mkt, smb, hml, 30)"}


def _single(formula: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compute_alphas(bars(spark, sf_dir), "asset", "time", [parse(formula).alias("value")], ordered=False))

    return query


def _sql(body: str) -> str:
    return PANEL.format(unit="month") + body


FLAGSHIP = "rank(ts_mean(close, 5) / close)"


#: Factors whose ranks, at this panel, part values that are equal but for rounding
#: noise (correlations of two rows, sums of ranks); and one of 1e12. They run without SQL.
NOISY = {
    "worldquant_alpha101": "alpha13 alpha15 alpha16 alpha31 alpha45 alpha85 alpha94 alpha98".split(),
    "gtja_alpha191": [f"gtja_alpha{n:03}" for n in (32, 83, 99, 113, 115, 119, 121, 143)],
    "qlib_alpha158": [],
}
BUILDERS = {"qlib_alpha158": qlib_alpha158, "worldquant_alpha101": worldquant_alpha101, "gtja_alpha191": gtja_alpha191}


def _members(name: str, noisy: bool) -> list:
    return [e for e in BUILDERS[name]() if (e.output_name() in NOISY[name]) == noisy]


def _library(name: str, noisy: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compute_alphas(bars(spark, sf_dir), "asset", "time", _members(name, noisy), validate=False, ordered=False), 4)

    return query


def _lowered(outputs: dict, digits: int) -> str:
    """SQL of a batch of expressions over the panel."""
    stages, values = lower(outputs, "wide", "asset", "time", "i")
    columns = ", ".join(f"{cut_sql(v, digits)} as {n}" for n, v in values.items())
    return PANEL.format(unit="month") + WIDE_SQL + f", {stages} select time, asset, {columns} from stages"


def _compute(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return compute_alphas(bars(spark, sf_dir), "asset", "time", [parse(FLAGSHIP).alias("value")], **options)


def _saved_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphas written as Parquet, and read back as the factors of the panel."""
    panel = bars(spark, sf_dir)
    path = new_folder(spark, "alphas") + "/alphas.parquet"
    compute_alphas(panel, "asset", "time", [parse("ts_mean(close, 5)").alias("value")], output_path=path)
    read = read_factors(spark, path, "asset", "time", ["value"])
    check_same_keys(panel, read, "asset", "time")
    return rounded(read.select("time", "asset", "value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    shown = ["asset", "time", "open", "high", "low", "close", "volume", "vwap", "tradable"]
    found: dict = {"panel": lambda spark, d: rounded(bars(spark, d).select(*shown)), "roundtrip": lambda spark, d: rounded(roundtrip(bars(spark, d)).select(*shown))}
    found |= {f"expr_{n}": _single(f) for n, (f, _) in OPERATORS.items()} | {f"expr_{n}": _single(f) for n, f in UNPAIRED.items()}
    found["compute_symbol_major"] = lambda spark, d: rounded(_compute(spark, d))
    found["compute_time_major"] = lambda spark, d: rounded(_compute(spark, d, time_major=True))
    found["compute_top"] = lambda spark, d: rounded(_compute(spark, d, ordered=False).where("value is not null").orderBy(F.desc("value"), "time", "asset").limit(100))
    found["compute_to_parquet"] = _saved_panel
    for name in BUILDERS:
        found[name] = _library(name)
        if NOISY[name]:
            found[f"{name}_noisy"] = _library(name, True)
    return found | evaluation.queries()


def oracle_sql() -> dict[str, str]:
    panel = _sql("select asset, time::varchar as time, open, high, low, close, volume, vwap, tradable from panel")
    found = {"panel": panel, "roundtrip": panel}
    one = lambda s: _sql(f"select time, asset, {cut_sql('v')} as value from (select time, asset, ({s})::double as v from panel)")
    found |= {f"expr_{n}": one(s) for n, (_, s) in OPERATORS.items()}
    found |= {f"expr_{n}": _lowered({"value": parse(f)}, 6) for n, f in UNPAIRED.items()}
    flagship = _lowered({"value": parse(FLAGSHIP)}, 6)
    found |= {"compute_symbol_major": flagship, "compute_time_major": flagship, "compute_to_parquet": _lowered({"value": parse("ts_mean(close, 5)")}, 6)}
    stages, values = lower({"value": parse(FLAGSHIP)}, "wide", "asset", "time", "i")
    found["compute_top"] = PANEL.format(unit="month") + WIDE_SQL + f", {stages}, v as (select time, asset, {values['value']} as v from stages) select time, asset, {cut_sql('v')} as value from (select * from v where v is not null order by v desc, time, asset limit 100)"
    for name in BUILDERS:
        found[name] = _lowered({e.output_name(): e for e in _members(name, False)}, 4)
    found = {n: s if n in ("panel", "roundtrip") else f"select * replace (time::varchar as time) from ({s})" for n, s in found.items()}
    return found | evaluation.oracle_sql()
