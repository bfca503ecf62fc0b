"""What phases pass on, and how sorted batches are cut."""

import pyarrow as pa

from factorloom.functions.formula import parse
from factorloom.plans import phases, planner


def test_no_value_waits_through_exchanges(spark, monkeypatch):
    """Finished outputs do not go through the exchanges of later phases."""
    taken = []
    run = phases.run_pass
    monkeypatch.setattr(phases, "run_pass", lambda df, todo, order: taken.append(len(todo.packed)) or run(df, todo, order))
    df = spark.createDataFrame([(s, t, float(s * t % 7)) for s in range(4) for t in range(12)], "asset int, time int, close double")
    formulas = {"a": "ts_mean(close, 5)", "b": "ts_std(close, 6)", "c": "delay(rank(ts_mean(close, 3)), 2)", "d": "rank(close) - rank(delta(close, 1))"}
    found = planner.evaluate(df, "asset", "time", {n: parse(f) for n, f in formulas.items()}, ["asset", "time"], "arrays")
    assert taken == [0, 2, 2]
    windows = planner.evaluate(df, "asset", "time", {n: parse(f) for n, f in formulas.items()}, ["asset", "time"], "windows")
    near = lambda x: [round(v, 9) if isinstance(v, float) else v for v in x]
    assert [near(r) for r in found.orderBy("asset", "time").collect()] == [near(r) for r in windows.orderBy("asset", "time").collect()]


def test_runs_of_many_batches_are_looked_at_once(monkeypatch):
    monkeypatch.setattr(phases, "ROWS", 8)
    seen = []
    find = phases.starts
    monkeypatch.setattr(phases, "starts", lambda column: seen.append(len(column)) or find(column))
    keys = [0, 0, 1, *[2] * 90, 3, 3, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 3], "v": list(range(i, min(i + 3, len(keys))))}) for i in range(0, len(keys), 3)]
    tables = list(phases.whole_runs(iter(batches), "k"))
    assert [v for t in tables for v in t["v"].to_pylist()] == list(range(len(keys)))
    parts = [set(t["k"].to_pylist()) for t in tables]
    assert not any(a & b for a, b in zip(parts, parts[1:])) and len(tables) > 1
    assert sum(seen) < 2 * len(keys)
