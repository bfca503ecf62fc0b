"""Factors of a stream against those of the whole panel."""

import numpy as np
import pytest

from factorloom.functions.formula import parse
from factorloom.operators.alphas import compute_alphas
from factorloom.streaming.alphas import lookback, stream_alphas

FORMULAS = {"a": "ts_mean(rank(delta(close, 1)), 3)", "b": "rank(ts_max(close, 4) / delay(close, 2))"}


def test_lookback():
    assert lookback(parse(FORMULAS["a"])) == 3 and lookback(parse(FORMULAS["b"])) == 3 and lookback(parse("close + 1")) == 0
    with pytest.raises(ValueError, match="sma"):
        lookback(parse("rank(sma(close, 3, 1))"))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    alphas = [parse(f).alias(n) for n, f in FORMULAS.items()]
    days = [[(f"S{s}", t, float(rng.uniform(1, 9))) for s in range(5)] for t in range(11)]
    schema = "asset string, time long, close double"
    source = str(tmp_path / "in")
    run = lambda: stream_alphas(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "asset", "time", alphas, *(str(tmp_path / p) for p in ("out", "state", "check"))).awaitTermination()
    for part in (days[:4], days[4:5], days[5:]):
        spark.createDataFrame([r for d in part for r in d], schema).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {(r.asset, r.time): (r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = compute_alphas(spark.createDataFrame([r for d in days for r in d], schema), "asset", "time", alphas)
    want = {(r.asset, r.time): (r.a, r.b) for r in whole.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert [None if v is None else pytest.approx(v) for v in values] == list(got[k])
