"""How often ``evaluate`` reads its input, and what it follows from day to day."""

import math

from factorloom.operators.evaluate import evaluate

SCHEMA = "asset string, time int, f1 double, ret_1 double, ret_3 double"


def counted(spark, rows):
    """The rows as a frame, and a counter of how many of them were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, SCHEMA).mapInArrow(run, SCHEMA), seen


def test_the_panel_is_read_once_for_all_tables(spark, tmp_path):
    rows = [(f"s{i}", t, float(i * 7 % 5), i / 10, t / 10) for i in range(6) for t in range(5)]
    df, seen = counted(spark, rows)
    result = evaluate(df, "asset", "time", ["f1"], quantiles=2, min_cs_count=2, validate=False)
    result.save(f"file://{tmp_path}/result")
    assert seen.value == len(rows)


def test_gaps_and_lone_rows_of_symbols(spark):
    """Weights are held over days that a symbol misses, and never reach the next symbol."""
    rows = [("a", 0, 1.0, 0.1, 0.0), ("b", 0, 2.0, 0.2, 0.0), ("c", 1, 1.0, 0.3, 0.0), ("d", 1, 2.0, 0.4, 0.0), ("b", 2, 1.0, 0.5, 0.0), ("c", 2, 5.0, None, 0.0)]
    df, _ = counted(spark, rows)
    found = evaluate(df, "asset", "time", ["f1"], quantiles=2, min_cs_count=2, validate=False)
    line = {(r["date"], r["horizon"]): r for r in found.portfolio.collect()}
    near = lambda x, y: math.isclose(x, y, abs_tol=1e-12)
    assert near(line[0, 1]["gross"], 0.05) and near(line[1, 1]["gross"], 0.05) and near(line[2, 1]["gross"], -0.25)
    assert near(line[1, 1]["turnover"], 1.0) and near(line[2, 1]["turnover"], 1.0)
    # day 2 at horizon 3: b holds 0.5 - 0.5, c holds -0.5 + 0.5 without a return
    assert near(line[1, 3]["gross"], 0.025) and near(line[2, 3]["gross"], 0.0)
    turned = {(r["date"], r["horizon"]): (r["top_turnover"], r["bottom_turnover"]) for r in found.turnover.collect()}
    assert turned[2, 1] == (1.0, 1.0) and turned[0, 1] == (None, None) and turned[2, 3] == (None, None)
