"""Spark windows and stacked arrays give the same values, operator by operator."""

import math

import numpy as np
import pytest

from factorloom.functions.expr import RECURSIVE
from factorloom.functions.formula import parse
from factorloom.functions.libraries import qlib_alpha158
from factorloom.operators.alphas import compute_alphas, with_alphas
from factorloom.plans.planner import Plan, evaluate
from factorloom.queries import OPERATORS, UNPAIRED
from factorloom.sources.panel import clean

NAMES = ["open", "high", "low", "close", "volume", "vwap"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(7):
        for t in range(int(rng.integers(1, 60))):
            v = rng.choice([math.nan, math.inf, -math.inf, 0.0, 1.0, 5.0], 6)
            x = np.where(rng.uniform(size=6) < 0.03, v, np.round(rng.uniform(1, 9, 6), int(rng.integers(0, 3))))
            rows.append((f"S{s}", t, *map(float, x), int(rng.integers(0, 3)), int(rng.integers(0, 2)), 2**53 + 1 + t))
    return spark.createDataFrame(rows, "asset string, time long, " + ", ".join(f"{n} double" for n in NAMES) + ", sector int, industry int, big long").persist()


def values(df, names):
    return {(r.asset, r.time): [r[n] for n in names] for r in df.collect()}


def test_both_ways(panel):
    formulas = {n: f for n, (f, _) in OPERATORS.items()} | {"m": "ts_mean(rank(delta(close, 1)), 3) / rank(ts_max(high, 4))", "twice": "rank(rank(close) - ts_mean(rank(open), 2))"}
    outputs = {n: parse(f) for n, f in formulas.items()}
    a, b = (values(evaluate(clean(panel, NAMES), "asset", "time", outputs, ["asset", "time"], engine), outputs) for engine in ("windows", "arrays"))
    assert a.keys() == b.keys()
    odd = []
    for k in a:
        for n, x, y in zip(outputs, a[k], b[k]):
            if (x is None) != (y is None) or x is not None and x != y and not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                odd.append((n, k, x, y))
    assert not odd, odd[:20]


def test_cost_decides(panel):
    assert Plan({"a": parse("rank(ts_mean(close, 5) / close)")}).is_light()
    for f in ("ts_rank(close, 3)", "sma(close, 3, 1)", "ts_mean(close, 250)"):
        assert not Plan({"a": parse(f)}).is_light()
    with pytest.raises(ValueError, match="arrays"):
        evaluate(panel, "asset", "time", {"a": parse("sma(close, 3, 1)")}, ["asset"], "windows")
    assert set(UNPAIRED) == RECURSIVE


def test_user_columns_stay_as_they_are(panel):
    got = with_alphas(panel, "asset", "time", [parse("sma(close, 3, 1)").alias("a"), parse("rank(sma(open, 2, 1))").alias("b")])
    assert got.columns == [*panel.columns, "a", "b"]
    assert sorted(r.big for r in got.collect()) == sorted(r.big for r in panel.collect())
    assert compute_alphas(panel.limit(0), "asset", "time", qlib_alpha158()).count() == 0


def test_library_both_ways(panel):
    named = {e.output_name(): e for e in qlib_alpha158()}
    named = {n: e for n, e in list(named.items())[::9]}
    a, b = (values(evaluate(clean(panel, NAMES), "asset", "time", named, ["asset", "time"], engine), named) for engine in ("windows", "arrays"))
    for k in a:
        for n, x, y in zip(named, a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7)), (n, k, x, y)
