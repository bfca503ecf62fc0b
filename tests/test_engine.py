"""Operators against hand values and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest

from factorloom.functions import expr as E
from factorloom.functions.expr import col, lit
from factorloom.functions.formula import parse
from factorloom.functions.libraries import gtja_alpha191, qlib_alpha158, worldquant_alpha101
from factorloom.operators.alphas import compute_alphas, with_alphas
from factorloom.operators.labels import with_labels
from factorloom.plans.arrays import multi_resi, sma
from factorloom.plans.planner import Plan


def series(spark, values, **exprs):
    df = spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "asset string, time long, x double")
    out = compute_alphas(df, "asset", "time", [e.alias(n) for n, e in exprs.items()]).toPandas()
    return {n: [None if pd.isna(v) else v for v in out[n]] for n in exprs}


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-9)), (got, want)


def test_hand_vectors(spark):
    x = col("x")
    got = series(spark, [3, 1, 2, 2, 5], delta=x.delta(2), lo=x.ts_argmin(3), hi=x.ts_argmax(3), rank=x.ts_rank(3), std=x.ts_std(3), decay=x.decay_linear(3), none=x.ts_sum(0), one=x.ts_std(1))
    close(got["delta"], [None, None, -1, 1, 3])
    close(got["lo"], [None, None, 1, 0, 0])
    close(got["hi"], [None, None, 0, 1, 2])
    close(got["rank"], [None, None, 2 / 3, 5 / 6, 1])
    close(got["std"], [None, None, 1, 1 / math.sqrt(3), math.sqrt(3)])
    close(got["decay"], [None, None, 11 / 6, 11 / 6, 21 / 6])
    assert got["none"] == got["one"] == [None] * 5
    got = series(spark, [1, 3, 5, 7, 8], slope=x.slope(3), r2=x.rsquare(3), resi=x.resi(3), q=x.quantile(3, 0.8))
    close(got["slope"], [None, None, 2, 2, 1.5])
    close(got["r2"], [None, None, 1, 1, 9 / (2 * 14 / 3)])
    assert got["resi"][2] == pytest.approx(0, abs=1e-12) and got["resi"][4] == pytest.approx(-1 / 6)
    close(got["q"], [None, None, 4.2, 6.2, 7.6])
    close(series(spark, [1, 2, 3, 4, 5], s=x.sma(2, 1))["s"], [1, 1.5, 2.25, 3.125, 4.0625])


def test_missing_and_infinite(spark):
    x = col("x")
    got = series(spark, [1, None, 0, -2, float("nan")], div=lit(1.0) / x, self=x / x, log=x.log(), p=E.power(x, lit(0.0)), w=E.where_(x > lit(0.0), lit(1.0), x), m=E.max(x, lit(0.0)), s=x.ts_sum(2))
    assert got["div"] == [1.0, None, math.inf, -0.5, None]
    assert got["self"] == [1.0, None, None, 1.0, None]
    assert got["log"] == [0.0, None, None, None, None]
    assert got["p"] == [1.0] * 5
    assert got["w"] == [1.0, None, 0.0, -2.0, None]
    assert got["m"] == [1.0, None, 0.0, 0.0, None]
    assert got["s"] == [None, None, None, -2.0, None]


def test_kernels():
    close([None if np.isnan(v) else v for v in sma(np.array([1.0, np.nan, 2.0, 4.0]), 2, 1)], [1, None, 2, 3])
    assert np.isnan(sma(np.array([1.0]), 1, 2)).all() and np.isnan(sma(np.array([1.0]), 0, 0)).all()
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    y = 1 + x @ [2.0, 3.0, 4.0]
    y[20] += 1
    got = multi_resi(y, *x.T, 10)
    assert np.isnan(got[:9]).all() and abs(got[15]) < 1e-9
    a = np.c_[np.ones(10), x[11:21]]
    assert got[20] == pytest.approx((y[11:21] - a @ np.linalg.lstsq(a, y[11:21], rcond=None)[0])[-1])
    assert np.isnan(multi_resi(y, x[:, 0], x[:, 0], x[:, 1], 10)[12:]).all()


def test_cross_section_and_groups(spark):
    rows = [("a", 1, 1.0, "u"), ("b", 1, 3.0, "u"), ("c", 1, 3.0, "v"), ("d", 1, None, "v"), ("a", 2, 5.0, "u")]
    df = spark.createDataFrame(rows, "asset string, time long, x double, g string")
    x, g = col("x"), col("g")
    out = with_alphas(df, "asset", "time", [x.rank().alias("r"), x.scale().alias("s"), E.group_rank(x, g).alias("gr"), E.group_neutralize(x, g).alias("gn")]).orderBy("time", "asset").toPandas()
    close([None if pd.isna(v) else v for v in out["r"]], [1 / 3, 2.5 / 3, 2.5 / 3, None, 1])
    close([None if pd.isna(v) else v for v in out["s"]], [1 / 7, 3 / 7, 3 / 7, None, 1])
    close([None if pd.isna(v) else v for v in out["gr"]], [0.5, 1, 1, None, 1])
    close([None if pd.isna(v) else v for v in out["gn"]], [-1, 1, 0, None, 0])


def test_validation(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1)], "asset string, time long, x double, n int")
    for bad, alphas in (("missing column", [col("y").alias("a")]), ("alias", [col("x")]), ("conflicts", [col("x").alias("asset")]), ("f64", [col("n").alias("a")])):
        with pytest.raises(ValueError, match=bad):
            compute_alphas(df, "asset", "time", alphas)
    with pytest.raises(ValueError, match="duplicate"):
        compute_alphas(df.union(df), "asset", "time", [col("x").alias("a")])
    with pytest.raises(ValueError, match="null"):
        compute_alphas(df.selectExpr("cast(null as string) asset", "time", "x"), "asset", "time", [col("x").alias("a")])
    with pytest.raises(ValueError):
        col("x") != col("y")  # noqa: B015
    with pytest.raises(TypeError):
        col("x") + 1
    assert compute_alphas(df.limit(0), "asset", "time", [col("x").rank().alias("a")]).count() == 0


def test_libraries(capsys):
    for build, n in ((worldquant_alpha101, 101), (qlib_alpha158, 158), (gtja_alpha191, 191)):
        found = build()
        assert len({e.output_name() for e in found}) == n
        assert Plan({e.output_name(): e for e in found}).exchanges() <= 5
    assert [e.output_name() for e in worldquant_alpha101(alphas=["alpha3", "alpha1"])] == ["alpha3", "alpha1"]
    with pytest.raises(ValueError, match="not known"):
        qlib_alpha158(alphas=["KMID", "KMID"])
    assert worldquant_alpha101({"open": "o"}, ["alpha101"])[0].collect_inputs() == ["close", "high", "low", "o"]
    assert "input_fields" in capsys.readouterr().out
    assert repr(parse("rank(close) - 0.5")) == "sub(rank(close), 0.5)"


def test_labels_use_the_date_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(f"S{s}", t, float(rng.uniform(1, 2)), bool(rng.uniform() < 0.7)) for s in range(5) for t in range(20) if rng.uniform() < 0.8]
    df = spark.createDataFrame(rows, "asset string, time long, close double, live boolean")
    out = with_labels(df, "asset", "time", [1, 3], entry_lag=1, tradable_col="live").toPandas().set_index(["asset", "time"])
    have = {(a, t): (c, v) for a, t, c, v in rows}
    times = sorted({t for _, t, *_ in rows})
    for (a, t), r in out.iterrows():
        g = times.index(t)
        at = lambda k: have.get((a, times[g + k])) if g + k < len(times) else None  # noqa: E731,B023
        for h in (1, 3):
            want = at(1 + h)[0] / at(1)[0] - 1 if at(1) and at(1 + h) else None
            assert (want is None and pd.isna(r[f"ret_{h}"])) or r[f"ret_{h}"] == pytest.approx(want)
        assert r["tradable_entry"] == bool(at(1) and at(1)[1])
    small = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 4.0)], "asset string, time long, close double")
    with pytest.warns(UserWarning, match="1 calendar"):
        got = with_labels(small, "asset", "time", [1], calendar=[1, 2, 3, 4, 5], entry_lag=0).orderBy("time").toPandas()
    assert got["ret_1"][0] == 1 and got["ret_1"][1:].isna().all()
    for bad in ([], [0], [1, 1]):
        with pytest.raises(ValueError):
            with_labels(small, "asset", "time", bad)
