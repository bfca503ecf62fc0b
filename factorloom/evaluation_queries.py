"""Queries of labels, evaluation and report over the order-line panel, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formula import parse
from .operators import report
from .operators.alphas import with_alphas
from .operators.evaluate import evaluate, factor_correlation, load_result
from .operators.labels import with_labels
from .rounding import cut_sql as C
from .rounding import rounded
from .sources.lineitem_panel import SQL as PANEL
from .sources.lineitem_panel import bars
from .sources.scratch import new_folder, written

FACTORS = ["f1", "f2"]
OPTIONS = {"quantiles": 4, "tradable_col": "tradable", "min_cs_count": 5, "cost_bps": 10.0, "validate": False}


def eval_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors of the bars with forward returns."""
    panel = bars(spark, sf_dir).select("asset", "time", "open", "close", "volume", "vwap", "tradable", F.col("sector").cast("string").alias("industry"))
    factors = [parse("volume").alias("f1"), parse("delta(close, 1)").alias("f2")]
    # with_labels reads it for the days too
    return with_labels(written(with_alphas(panel, "asset", "time", factors, validate=False), "bars"), "asset", "time", [1, 3], validate=False)


def base_sql(demean: str = "none", binning: str = "daily") -> str:
    """Tables of the evaluation, as common table expressions."""
    over = {"none": None, "universe": "over (partition by time)", "group": "over (partition by time, sector)"}[demean]
    y = lambda c: f"{c} - coalesce(avg(case when tradable then {c} end) {over}, 0)" if over else c
    if binning == "daily":
        bucket = "(pos * 4) // m"
    else:
        bucket = "(x > c1)::int + (x > c2)::int + (x > c3)::int"
    return (
        PANEL.format(unit="month")
        + f""", g as (select time, row_number() over (order by time) - 1 as slot from (select distinct time from panel)),
ps as (select panel.*, slot from panel join g using (time)),
e0 as (select a.asset, a.time, a.slot, a.tradable, a.sector, a.volume as f1, a.close - lag(a.close) over (partition by a.asset order by a.time) as f2,
   x1.close / e.close - 1 as y1, x3.close / e.close - 1 as y3
   from ps a left join ps e on e.asset = a.asset and e.slot = a.slot + 1
   left join ps x1 on x1.asset = a.asset and x1.slot = a.slot + 2 left join ps x3 on x3.asset = a.asset and x3.slot = a.slot + 4),
ev as (select * replace ({y('y1')} as y1, {y('y3')} as y3) from e0),
lf as (select asset, time, slot, tradable, y1, y3, 'f1' as factor, f1 as x from ev union all select asset, time, slot, tradable, y1, y3, 'f2', f2 from ev),
cu as (select factor, quantile_cont(x, 0.25) as c1, quantile_cont(x, 0.5) as c2, quantile_cont(x, 0.75) as c3, min(x) as least, max(x) as most from lf where tradable and x is not null group by factor),
va as (select *, row_number() over (partition by time, factor order by x, asset) - 1 as pos, count(*) over (partition by time, factor) as m,
   (rank() over (partition by time, factor order by x) + count(*) over (partition by time, factor order by x range between unbounded preceding and current row)) / 2.0 as fr
   from lf where tradable and x is not null),
vb as (select va.*, c1, c2, c3, least, most, {bucket} as bucket from va join cu using (factor) where m >= 5),
pr as (select time, slot, factor, asset, x, bucket, 1 as horizon, y1 as y from vb where y1 is not null union all select time, slot, factor, asset, x, bucket, 3, y3 from vb where y3 is not null),
rk as (select *, rank() over (partition by time, factor, horizon order by x) + count(*) over (partition by time, factor, horizon order by x range between unbounded preceding and current row) as rx,
   rank() over (partition by time, factor, horizon order by y) + count(*) over (partition by time, factor, horizon order by y range between unbounded preceding and current row) as ry from pr),
ic0 as (select time, factor, horizon, case when count(*) >= 5 and var_samp(x) > 0 and var_samp(y) > 0 then corr(x, y) end as ic,
   case when count(*) >= 5 and var_samp(rx) > 0 and var_samp(ry) > 0 then corr(rx, ry) end as rank_ic,
   case when count(*) >= 5 then avg(case when bucket = 3 then y end) - avg(case when bucket = 0 then y end) end as spread from rk group by all),
dense as (select time, slot, factor, horizon from g, (values ('f1'), ('f2')) f(factor), (values (1), (3)) h(horizon)),
ict as (select d.time as date, d.slot, d.factor, d.horizon, ic, rank_ic, spread from dense d left join ic0 on d.time = ic0.time and d.factor = ic0.factor and d.horizon = ic0.horizon),
cov as (select time as date, factor, count(case when tradable and x is not null then 1 end)::int as n_valid, count(case when not tradable and x is not null then 1 end)::int as n_masked, count(*) as n_rows from lf group by 1, 2),
qr as (select time as date, factor, (bucket + 1)::int as bin, {'min(x)' if binning == 'daily' else 'case bucket when 0 then any_value(least) when 1 then any_value(c1) when 2 then any_value(c2) else any_value(c3) end'} as bin_lo, {'max(x)' if binning == 'daily' else 'case bucket when 0 then any_value(c1) when 1 then any_value(c2) when 2 then any_value(c3) else any_value(most) end'} as bin_hi, count(*)::int as count, avg(y1) as mean_ret_1, avg(y3) as mean_ret_3 from vb group by time, factor, bucket)
"""
    )


TURNOVER = """, s as (select distinct factor, slot from vb), o as (select factor, slot, asset, bucket from vb where bucket in (0, 3)),
t as (select a.factor, a.slot, h.horizon, a.bucket, 1 - count(p.asset)::double / count(*) as turn from o a cross join (values (1), (3)) h(horizon)
   left join o p on p.factor = a.factor and p.asset = a.asset and p.bucket = a.bucket and p.slot = a.slot - h.horizon group by 1, 2, 3, 4),
tu as (select d.time as date, d.factor, d.horizon, a.turn as top_turnover, b.turn as bottom_turnover from dense d
   left join s on s.factor = d.factor and s.slot = d.slot - d.horizon
   left join t a on a.factor = s.factor and a.slot = d.slot and a.horizon = d.horizon and a.bucket = 3
   left join t b on b.factor = s.factor and b.slot = d.slot and b.horizon = d.horizon and b.bucket = 0)"""

_QUANTILE_WEIGHTS = "select factor, slot, asset, case bucket when 0 then -0.5 / count(case when bucket = 0 then 1 end) over (partition by factor, slot) when 3 then 0.5 / count(case when bucket = 3 then 1 end) over (partition by factor, slot) end as w from vb"
_FACTOR_WEIGHTS = "select factor, slot, asset, coalesce(raw / nullif(sum(abs(raw)) over (partition by factor, slot), 0), 0) as w from (select *, x - avg(x) over (partition by factor, slot) as raw from vb)"


def portfolio_sql(weights: str) -> str:
    return f""", w as ({weights}),
h as (select factor, horizon, slot + k as slot, asset, sum(w) / least(horizon, slot + k + 1) as w from (select w.*, n.horizon, unnest(range(n.horizon)) as k from w, (values (1), (3)) n(horizon) where w is not null) where slot + k <= (select max(slot) from g) group by 1, 2, 3, 4, slot + k),
mv as (select factor, horizon, slot, asset, sum(w) as d from (select factor, horizon, slot, asset, w from h union all select factor, horizon, slot + 1, asset, -w from h where slot < (select max(slot) from g)) group by 1, 2, 3, 4),
mt as (select factor, horizon, slot, sum(abs(d)) / 2 as turnover from mv group by 1, 2, 3),
gr as (select h.factor, h.horizon, h.slot, sum(w * y1) as gross from h join ev on ev.asset = h.asset and ev.slot = h.slot where y1 is not null group by 1, 2, 3),
po as (select d.time as date, d.factor, d.horizon, coalesce(gross, 0) as gross, coalesce(gross, 0) - coalesce(case when d.slot > 0 then coalesce(turnover, 0) end, 0) * 10 * 1e-4 as net, case when d.slot > 0 then coalesce(turnover, 0) end as turnover
   from dense d left join gr on gr.factor = d.factor and gr.horizon = d.horizon and gr.slot = d.slot left join mt on mt.factor = d.factor and mt.horizon = d.horizon and mt.slot = d.slot)"""


def _select(table: str, keys: str, values: str, whole: str = "") -> str:
    return f" select {keys}, {', '.join(f'{C(v)} as {v}' for v in values.split())}{whole} from {table}"


_DAY = "date::varchar as date, factor, horizon"
_IC = _select("ict", _DAY, "ic rank_ic")
_BINS = _select("qr", "date::varchar as date, factor, bin, count", "bin_lo bin_hi mean_ret_1 mean_ret_3")
_PORTFOLIO = _select("po", _DAY, "gross net turnover")
_SUMMARY = (
    TURNOVER
    + portfolio_sql(_QUANTILE_WEIGHTS)
    + f""", lo as (select factor, horizon, slot, 'ic' as m, ic as v from ict union all select factor, horizon, slot, 'rank_ic', rank_ic from ict union all select factor, horizon, slot, 'spread', spread from ict),
nu as (select *, row_number() over (partition by factor, horizon, m order by slot) as k, v - avg(v) over (partition by factor, horizon, m) as d from lo where v is not null),
lg as (select *, lag(d, 1) over (partition by factor, horizon, m order by k) as d1, lag(d, 2) over (partition by factor, horizon, m order by k) as d2 from nu),
st as (select factor, horizon, m, count(*) as n, avg(v) as mean, stddev_samp(v) as sd, avg((v > 0)::int) as win, sum(d * d) / count(*) + case when horizon = 3 then 4.0::double / 3 * sum(d * d1) / count(*) + 2.0::double / 3 * sum(d * d2) / count(*) else 0 end as var from lg group by factor, horizon, m),
sv as (select *, mean / sqrt(var / n) as t, mean / sd as ir from st),
pm as (select factor, horizon, bucket, avg(y) as mean from pr group by all),
mo as (select a.factor, a.horizon, sum(sign(b.mean - a.mean)) / 6.0::double as monotonicity from pm a join pm b on a.factor = b.factor and a.horizon = b.horizon and a.bucket < b.bucket group by all),
ac as (select factor, avg(n_valid / n_rows) as avg_coverage from cov group by factor),
fl as (select factor, horizon, avg(gross) * 252 as ls_gross_ann, avg(net) * 252 as ls_net_ann, avg(net) / stddev_samp(net) * sqrt(252) as ls_ir, avg(turnover) as ls_turnover from po group by all),
ot as (select factor, horizon, avg(top_turnover) as top_turnover, avg(bottom_turnover) as bottom_turnover from tu group by all)
select i.factor, i.horizon, i.n::int as n_days, {C('i.mean')} as ic_mean, {C('i.sd')} as ic_std, {C('i.ir')} as ic_ir, {C('i.t')} as ic_t_nw, {C('i.win')} as ic_win_rate,
  {C('r.mean')} as rank_ic_mean, {C('r.sd')} as rank_ic_std, {C('r.ir')} as rank_ic_ir, {C('r.t')} as rank_ic_t_nw, {C('r.win')} as rank_ic_win_rate, {C('s.mean')} as spread_mean, {C('s.t')} as spread_t_nw,
  {C('monotonicity')} as monotonicity, {C('avg_coverage')} as avg_coverage, {C('ls_gross_ann')} as ls_gross_ann, {C('ls_net_ann')} as ls_net_ann, {C('ls_ir')} as ls_ir, {C('ls_turnover')} as ls_turnover, {C('top_turnover')} as top_turnover, {C('bottom_turnover')} as bottom_turnover
from sv i join sv r on r.factor = i.factor and r.horizon = i.horizon and r.m = 'rank_ic' join sv s on s.factor = i.factor and s.horizon = i.horizon and s.m = 'spread'
  join mo on mo.factor = i.factor and mo.horizon = i.horizon join ac on ac.factor = i.factor join fl on fl.factor = i.factor and fl.horizon = i.horizon join ot on ot.factor = i.factor and ot.horizon = i.horizon where i.m = 'ic'"""
)
_AUTOCORR = f""", c as (select a.factor, l.lag, a.slot, case when count(*) >= 2 and var_samp(a.fr) > 0 and var_samp(p.fr) > 0 then corr(a.fr, p.fr) end as r from vb a cross join (values (1), (5), (10), (20)) l(lag)
   join vb p on p.factor = a.factor and p.asset = a.asset and p.slot = a.slot - l.lag group by 1, 2, 3)
select f.factor, l.lag, {C('avg(r)')} as rank_autocorr from (values ('f1'), ('f2')) f(factor) cross join (values (1), (5), (10), (20)) l(lag) left join c on c.factor = f.factor and c.lag = l.lag where l.lag < (select count(*) from g) group by 1, 2"""
_MONTHLY = f" select year(date)::int as year, month(date)::int as month, factor, horizon, {C('avg(ic)')} as ic_mean, {C('avg(rank_ic)')} as rank_ic_mean from ict group by 1, 2, 3, 4 having count(ic) + count(rank_ic) > 0"
_CORRELATION = f""", c as (select a.time, case when count(*) >= 5 and var_samp(a.fr) > 0 and var_samp(b.fr) > 0 then corr(a.fr, b.fr) end as r from vb a join vb b on a.time = b.time and a.asset = b.asset and a.factor = 'f1' and b.factor = 'f2' group by 1),
k as (select {C('avg(r)')} as r from c)
select 'f1' as factor, 1.0::double as f1, r as f2 from k union all select 'f2', r, 1.0::double from k"""

#: query: (options of evaluate, table, options of the base SQL, the rest of the SQL)
EVALUATION: dict[str, tuple[dict, str, dict, str]] = {
    "coverage": ({}, "coverage", {}, " select date::varchar as date, factor, n_valid, n_masked from cov"),
    "ic": ({}, "ic", {}, _IC),
    "quantile_returns": ({}, "quantile_returns", {}, _BINS),
    "turnover": ({}, "turnover", {}, TURNOVER + _select("tu", _DAY, "top_turnover bottom_turnover")),
    "portfolio": ({}, "portfolio", {}, portfolio_sql(_QUANTILE_WEIGHTS) + _PORTFOLIO),
    "rank_autocorr": ({}, "rank_autocorr", {}, _AUTOCORR),
    "ic_monthly": ({}, "ic_monthly", {}, _MONTHLY),
    "summary": ({}, "summary", {}, _SUMMARY),
    "ic_demean_universe": ({"demean": "universe"}, "ic", {"demean": "universe"}, _IC),
    "ic_demean_group": ({"demean": "group", "group_col": "industry"}, "ic", {"demean": "group"}, _IC),
    "bins_demean_group": ({"demean": "group", "group_col": "industry"}, "quantile_returns", {"demean": "group"}, _BINS),
    "bins_global": ({"binning": "global"}, "quantile_returns", {"binning": "global"}, _BINS),
    "summary_global": ({"binning": "global"}, "summary", {"binning": "global"}, _SUMMARY),
    "portfolio_factor_weights": ({"weighting": "factor"}, "portfolio", {}, portfolio_sql(_FACTOR_WEIGHTS) + _PORTFOLIO),
}


def _result(spark: SparkSession, sf_dir: str, **options):
    return evaluate(eval_panel(spark, sf_dir), "asset", "time", FACTORS, **{**OPTIONS, **options})


def _evaluated(options: dict, table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(_result(spark, sf_dir, **options).tables[table])


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_correlation(eval_panel(spark, sf_dir), "asset", "time", FACTORS, "tradable", 5, validate=False))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result saved and loaded again."""
    folder = new_folder(spark, "result")
    _result(spark, sf_dir).save(folder)
    return rounded(load_result(spark, folder).portfolio)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables written to a directory as they are made."""
    return rounded(_result(spark, sf_dir, output_dir=new_folder(spark, "result")).ic)


def _from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors read from Parquet beside the panel of labels."""
    panel = written(eval_panel(spark, sf_dir), "panel")
    path = new_folder(spark, "factors") + "/factors.parquet"
    panel.select("time", "asset", *FACTORS).write.parquet(path)
    return rounded(evaluate(panel.drop(*FACTORS), "asset", "time", FACTORS, factor_source=path, **OPTIONS).ic)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_labels(bars(spark, sf_dir).select("asset", "time", "open", "close", "tradable"), "asset", "time", [1, 5], entry_lag=1, entry_col="open", exit_col="close", tradable_col="tradable", validate=False)
    return rounded(found.select("asset", "time", "ret_1", "ret_5", "tradable_entry"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on a calendar with days that the panel has lost."""
    panel = bars(spark, sf_dir).select("asset", "time", "open", "close", "tradable")
    days = sorted(r[0] for r in panel.select("time").distinct().collect())  # the calendar
    found = with_labels(panel.where(F.month("time") != 4), "asset", "time", [1, 2], calendar=days, entry_lag=0, entry_col="open", exit_col="close", tradable_col="tradable", validate=False)
    return rounded(found.select("asset", "time", "ret_1", "ret_2", "tradable_entry"))


_LABELS = PANEL.format(unit="month") + ", g as (select time, row_number() over (order by time) - 1 as slot from (select distinct time from panel)), ps as (select panel.*, slot from panel join g using (time)"
_LABELLED = _LABELS + f""")
select a.asset, a.time::varchar as time, {C('x1.close / e.open - 1')} as ret_1, {C('x5.close / e.open - 1')} as ret_5, coalesce(e.tradable, false) as tradable_entry
from ps a left join ps e on e.asset = a.asset and e.slot = a.slot + 1 left join ps x1 on x1.asset = a.asset and x1.slot = a.slot + 2 left join ps x5 on x5.asset = a.asset and x5.slot = a.slot + 6"""
_GAPS = _LABELS + f""" where month(time) <> 4)
select a.asset, a.time::varchar as time, {C('x1.close / a.open - 1')} as ret_1, {C('x2.close / a.open - 1')} as ret_2, coalesce(a.tradable, false) as tradable_entry
from ps a left join ps x1 on x1.asset = a.asset and x1.slot = a.slot + 1 left join ps x2 on x2.asset = a.asset and x2.slot = a.slot + 2"""

_RUN = "over (partition by factor, horizon order by date rows between unbounded preceding and current row)"
_CURVES = portfolio_sql(_QUANTILE_WEIGHTS) + f""", cu2 as (select date, factor, horizon, sum(coalesce(net, 0)) {_RUN} as total from po), dd as (select *, total - max(total) {_RUN} as drawdown from cu2)"""
_HORIZONS = ", ql as (select date, factor, bin, count, 1 as horizon, mean_ret_1 as r from qr union all select date, factor, bin, count, 3, mean_ret_3 from qr), bm as (select factor, horizon, bin, sum(r * count) / sum(count) as mean_ret from ql where r is not null group by all)"

#: query: (function of the result, the rest of the SQL)
REPORT: dict[str, tuple[Callable, str]] = {
    "long_short": (lambda r: report.long_short(r.portfolio).select("date", "factor", "horizon", "total", "drawdown"), _CURVES + _select("dd", _DAY, "total drawdown")),
    "rolling_mean": (
        lambda r: report.rolling_mean(r.ic, "ic").select("date", "factor", "horizon", "mean"),
        f""", w as (select *, least(21, greatest(2, count(*) over (partition by factor, horizon) // 4)) as w, row_number() over (partition by factor, horizon order by date) as i from ict),
rm as (select a.date, a.factor, a.horizon, avg(b.ic) as mean from w a join w b on a.factor = b.factor and a.horizon = b.horizon and b.i between a.i - a.w + 1 and a.i group by 1, 2, 3)"""
        + _select("rm", _DAY, "mean"),
    ),
    "histogram": (
        lambda r: report.histogram(r.ic, "ic"),
        f""", en as (select factor, horizon, min(ic) as lo, max(ic) as hi from ict where ic is not null group by all), wi as (select *, (hi - lo) / 30 as width from en),
pl as (select i.factor, i.horizon, least(29, floor((ic - lo) / width))::int as bin, count(*) as count from ict i join wi using (factor, horizon) where ic is not null group by all)
select wi.factor, wi.horizon, b.bin::int as bin, {C('lo + width * (b.bin + 0.5)')} as center, coalesce(pl.count, 0)::bigint as count from wi cross join (select unnest(range(30)) as bin) b left join pl on pl.factor = wi.factor and pl.horizon = wi.horizon and pl.bin = b.bin""",
    ),
    "bin_means": (lambda r: report.bin_means(r.quantile_returns), _HORIZONS + _select("bm", "factor, horizon, bin", "mean_ret")),
    "spread_by_horizon": (
        lambda r: report.spread_by_horizon(r.quantile_returns),
        _HORIZONS + ", sp as (select factor, horizon, max(case when bin = 4 then mean_ret end) - max(case when bin = 1 then mean_ret end) as spread from bm group by all), sd as (select *, spread / horizon as spread_per_day from sp)" + _select("sd", "factor, horizon", "spread spread_per_day"),
    ),
    "quantile_curves": (
        lambda r: report.quantile_curves(r.quantile_returns),
        """, gd as (select * from (select distinct factor, date from qr) join (select distinct factor, bin from qr) using (factor)),
qc as (select gd.date, gd.factor, gd.bin, mean_ret_1 as ret, sum(coalesce(mean_ret_1, 0)) over (partition by gd.factor, gd.bin order by gd.date rows between unbounded preceding and current row) as total from gd left join qr on qr.factor = gd.factor and qr.date = gd.date and qr.bin = gd.bin)"""
        + _select("qc", "date::varchar as date, factor, bin", "ret total"),
    ),
    "center": (lambda r: report.center(r.ic, "ic"), f" select factor, horizon, count(ic) as n, {C('avg(ic)')} as mean, {C('quantile_cont(ic, 0.5)')} as median, {C('avg((ic > 0)::int)')} as positive from ict group by 1, 2"),
}


def _reported(curve: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(curve(_result(spark, sf_dir)))


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that a page on one factor asks for, by row."""
    status, found = report.Report(_result(spark, sf_dir)).answer("/api/factor/f2")
    series = found["ic"]
    rows = list(zip(series["date"], series["horizon"], series["ic"], series["rank_ic"]))
    assert status == 200
    return rounded(spark.createDataFrame(rows, "date string, horizon int, ic double, rank_ic double"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {"with_labels": _labelled, "with_labels_calendar": _gaps, "factor_correlation": _correlated}
    found |= {f"evaluate_{n}": _evaluated(options, table) for n, (options, table, *_) in EVALUATION.items()}
    found |= {"evaluate_saved": _saved, "evaluate_output_dir": _streamed, "evaluate_factor_source": _from_source}
    return found | {f"report_{n}": _reported(curve) for n, (curve, _) in REPORT.items()} | {"report_factor_bundle": _bundle}


def oracle_sql() -> dict[str, str]:
    found = {"with_labels": _LABELLED, "with_labels_calendar": _GAPS, "factor_correlation": base_sql() + _CORRELATION}
    found |= {f"evaluate_{n}": base_sql(**base) + rest for n, (_, _, base, rest) in EVALUATION.items()}
    found |= {"evaluate_saved": found["evaluate_portfolio"], "evaluate_output_dir": found["evaluate_ic"], "evaluate_factor_source": found["evaluate_ic"]}
    found |= {f"report_{n}": base_sql() + rest for n, (_, rest) in REPORT.items()}
    return found | {"report_factor_bundle": base_sql() + f" select date::varchar as date, horizon, {C('ic')} as ic, {C('rank_ic')} as rank_ic from ict where factor = 'f2'"}
