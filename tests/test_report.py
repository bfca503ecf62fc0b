"""Row order, batch counts, exact cuts, and the report's routes."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from factorloom.functions.expr import col
from factorloom.operators import report
from factorloom.operators.alphas import compute_alphas, with_alphas
from factorloom.operators.evaluate import evaluate, global_cuts


def test_row_order_and_counts(spark, tmp_path):
    rows = [(i, a, t, float(i)) for i, (a, t) in enumerate([("b", 2), ("a", 3), ("b", 1), ("a", 1), ("a", 2)])]
    df = spark.createDataFrame(rows, "i long, asset string, time long, x double")
    back = with_alphas(df, "asset", "time", [col("x").sma(2, 1).alias("y")], order_col="i").collect()
    assert [r.i for r in back] == [0, 1, 2, 3, 4] and [r.y for r in back] == [1.0, 2.25, 2.0, 3.0, 3.5]
    major = compute_alphas(df, "asset", "time", [col("x").alias("y")], time_major=True).collect()
    assert [(r.time, r.asset) for r in major] == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]
    path = str(tmp_path / "out.parquet")
    assert compute_alphas(df, "asset", "time", [col("x").alias("y")], path) == {"output_path": path, "n_observations": 1, "n_rows": 5}


def test_cuts_are_the_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=400), 1), "c": np.array([1.0]), "d": np.r_[np.zeros(300), 5.0]}
    df = spark.createDataFrame([(f, float(x)) for f, xs in values.items() for x in xs], "factor string, x double")
    for q in (2, 5, 10):
        for r in global_cuts(df, q).collect():
            assert np.allclose(r.cuts, np.quantile(values[r.factor], [k / q for k in range(1, q)])) and len(r.cuts) == q - 1
            assert (r.least, r.most) == (values[r.factor].min(), values[r.factor].max())


def test_curves_skip_gaps(spark):
    net = [1.0, None, -3.0, float("inf"), 1.0]
    df = spark.createDataFrame([("f", 1, d, x) for d, x in enumerate(net)], "factor string, horizon int, date int, net double")
    got = report.long_short(df).orderBy("date").collect()
    assert [r.total for r in got] == [1.0, 1.0, -2.0, -2.0, -1.0] and [r.drawdown for r in got] == [0.0, 0.0, -3.0, -3.0, -2.0]
    assert [r.m for r in report.rolling_mean(df, "net", 2, out="m").orderBy("date").collect()] == [1.0, 1.0, -3.0, -3.0, 1.0]
    (r,) = report.center(df, "net").collect()
    assert (r.n, r.mean, r.median) == (3, pytest.approx(-1 / 3), 1.0) and r.positive == pytest.approx(2 / 3)
    flat = report.histogram(df.where("date = 0"), "net").collect()
    assert len(flat) == 30 and sum(x["count"] for x in flat) == 1


def test_routes(spark):
    rng = np.random.default_rng(5)
    rows = [(f"S{s}", t, float(rng.normal()), float(rng.normal())) for s in range(8) for t in range(6)]
    result = evaluate(spark.createDataFrame(rows, "asset string, time long, f1 double, ret_1 double"), "asset", "time", ["f1"], quantiles=2, min_cs_count=3)
    server = report.serve(result, 0)
    thread = threading.Thread(target=server.serve_forever)
    thread.start()
    base = f"http://127.0.0.1:{server.server_port}"
    read = lambda path: json.load(urllib.request.urlopen(base + path))
    assert read("/api/meta")["factors"] == ["f1"] and len(read("/api/summary")) == 1
    bundle = read("/api/factor/f1")
    assert len(bundle["ic"]["date"]) == 6 and bundle["monthly"] is None and set(bundle["quantiles"]["bin"]) == {1, 2}
    for path in ("/api/factor/none", "/other"):
        with pytest.raises(urllib.error.HTTPError, match="404"):
            read(path)
    urllib.request.urlopen(urllib.request.Request(base + "/api/shutdown", method="POST"))
    thread.join(10)
    assert not thread.is_alive()
