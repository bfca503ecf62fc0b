"""Evaluation tables against plain Python."""

import numpy as np
import pandas as pd
import pytest

from factorloom.operators.evaluate import evaluate, factor_correlation, kendall_tau, load_result, newey_west_t


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(1, 13):
        for s in range(8):
            f1 = None if rng.uniform() < 0.1 else float(rng.normal())
            rows.append((f"S{s}", t, f1, float(round(rng.normal(), 0)), None if rng.uniform() < 0.1 else float(rng.normal() / 50), float(rng.normal() / 50), bool(rng.uniform() < 0.85), "uvw"[s % 3]))
    pdf = pd.DataFrame(rows, columns="asset time f1 f2 ret_1 ret_5 live industry".split())
    return spark.createDataFrame(rows, "asset string, time long, f1 double, f2 double, ret_1 double, ret_5 double, live boolean, industry string"), pdf


def test_tables(panel):
    df, pdf = panel
    r = evaluate(df, "asset", "time", ["f1", "f2"], quantiles=3, tradable_col="live", min_cs_count=3, cost_bps=5.0)
    ic = r.ic.toPandas().set_index(["date", "factor", "horizon"])
    q = r.quantile_returns.toPandas()
    turnover = r.turnover.toPandas().set_index(["date", "factor", "horizon"])
    portfolio = r.portfolio.toPandas().set_index(["date", "factor", "horizon"])
    cover = r.coverage.toPandas().set_index(["date", "factor"])
    assert len(ic) == 12 * 2 * 2 == len(turnover) == len(portfolio) and len(cover) == 24
    outer, weights = {}, {}
    for f in ("f1", "f2"):
        for t in range(1, 13):
            day = pdf[(pdf.time == t)].copy()
            day[f] = day[f].astype(float)
            valid = day[day.live & day[f].notna()].sort_values([f, "asset"])
            assert tuple(cover.loc[(t, f)]) == (len(valid), int((day[f].notna() & ~day.live).sum()))
            m = len(valid)
            if m < 3:
                continue
            valid["bucket"] = [i * 3 // m for i in range(m)]
            outer[f, t] = set(valid.asset[valid.bucket == 2]), set(valid.asset[valid.bucket == 0])
            weights[f, t] = {a: (0.5 / len(outer[f, t][0]) if a in outer[f, t][0] else -0.5 / len(outer[f, t][1])) for a in outer[f, t][0] | outer[f, t][1]}
            for b, g in valid.groupby("bucket"):
                row = q[(q.date == t) & (q.factor == f) & (q.bin == b + 1)].iloc[0]
                assert row["count"] == len(g) and row.bin_lo == g[f].min() and row.bin_hi == g[f].max()
                assert (pd.isna(row.mean_ret_1) and g.ret_1.isna().all()) or row.mean_ret_1 == pytest.approx(g.ret_1.mean())
            for h in (1, 5):
                pair = valid[valid[f"ret_{h}"].notna()]
                if len(pair) >= 3 and pair[f].nunique() > 1:
                    assert ic.loc[(t, f, h), "ic"] == pytest.approx(np.corrcoef(pair[f], pair[f"ret_{h}"])[0, 1])
                    assert ic.loc[(t, f, h), "rank_ic"] == pytest.approx(np.corrcoef(pair[f].rank(), pair[f"ret_{h}"].rank())[0, 1])
        for h in (1, 5):
            before: dict = {}
            for t in range(1, 13):
                held: dict = {}
                for k in range(min(h, t)):
                    for a, w in weights.get((f, t - k), {}).items():
                        held[a] = held.get(a, 0) + w / min(h, t)
                paid = pdf[pdf.time == t].set_index("asset").ret_1
                gross = sum(w * paid[a] for a, w in held.items() if not pd.isna(paid[a]))
                turn = sum(abs(held.get(a, 0) - before.get(a, 0)) for a in {*held, *before}) / 2 if t > 1 else None
                row = portfolio.loc[(t, f, h)]
                assert row.gross == pytest.approx(gross, abs=1e-12)
                assert (turn is None and pd.isna(row.turnover)) or row.turnover == pytest.approx(turn, abs=1e-12)
                assert row.net == pytest.approx(gross - (turn or 0) * 5e-4, abs=1e-12)
                before = held
                if (f, t) in outer and (f, t - h) in outer:
                    assert turnover.loc[(t, f, h), "top_turnover"] == pytest.approx(1 - len(outer[f, t][0] & outer[f, t - h][0]) / len(outer[f, t][0]))
    s = r.summary.toPandas().set_index(["factor", "horizon"])
    x = ic.loc[(slice(None), "f1", 5), "ic"].dropna()
    assert s.loc[("f1", 5), "n_days"] == len(x) and s.loc[("f1", 5), "ic_mean"] == pytest.approx(x.mean())
    assert s.loc[("f1", 5), "ic_t_nw"] == pytest.approx(newey_west_t(x.to_numpy(), 4))
    assert list(r.summary.columns)[:4] == ["factor", "horizon", "n_days", "ic_mean"] and len(r.summary.columns) == 23
    assert r.ic_monthly is None and r.meta["n_days"] == 12


def test_options_and_files(panel, tmp_path, spark):
    df, _ = panel
    a = evaluate(df, "asset", "time", ["f1"], quantiles=2, binning="global", demean="group", group_col="industry", weighting="factor", min_cs_count=2)
    assert a.portfolio.where("gross is not null").count() > 0
    with pytest.raises(ValueError):
        evaluate(df, "asset", "time", ["f1"], quantiles=1)
    with pytest.raises(ValueError):
        evaluate(df, "asset", "time", ["f1", "f1"])
    with pytest.raises(ValueError):
        evaluate(df, "asset", "time", ["f1"], binning="weekly")
    df.select("asset", "time", "f1").write.parquet(str(tmp_path / "factors"))
    b = evaluate(df.drop("f1", "f2"), "asset", "time", ["f1"], quantiles=2, min_cs_count=2, factor_source=str(tmp_path / "factors"), output_dir=str(tmp_path / "out"))
    back = load_result(spark, str(tmp_path / "out"))
    assert back.ic.count() == b.ic.count() == 24 and back.meta["factor_count"] == 1
    with pytest.raises(ValueError):
        b.save(str(tmp_path / "again"))


def test_correlation(panel):
    df, pdf = panel
    got = factor_correlation(df, "asset", "time", ["f1", "f2"], "live", 3).toPandas().set_index("factor")
    daily = []
    for _, day in pdf.groupby("time"):
        day = day[day.live]
        r1, r2 = day.f1.astype(float).rank(), day.f2.rank()
        both = r1.notna() & r2.notna()
        if both.sum() >= 3 and r1.notna().sum() >= 3 and r1[both].nunique() > 1 and r2[both].nunique() > 1:
            daily.append(np.corrcoef(r1[both], r2[both])[0, 1])
    assert got.loc["f1", "f2"] == got.loc["f2", "f1"] == pytest.approx(np.mean(daily)) and got.loc["f1", "f1"] == 1


def test_statistics():
    assert kendall_tau(np.array([1.0, 2.0, 3.0])) == 1 and np.isnan(kendall_tau(np.array([1.0])))
    x = np.array([1.0, 2.0, 4.0])
    assert newey_west_t(x, 0) == pytest.approx(x.mean() / np.sqrt(x.var() / 3)) and np.isnan(newey_west_t(np.array([1.0, 1.0]), 1))
