"""The classifier's sample must not pass through the driver's Python."""

import pyarrow as pa

from factorloom.llm import quality


def test_driver_gets_the_weights_only(spark, monkeypatch):
    """Neither rows nor features of the sample come to the driver, and its model holds no dict."""
    fits = []
    monkeypatch.setattr(quality, "fit", lambda *a, f=quality.fit, **b: fits.append(a) or f(*a, **b))
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("the sample came to the driver")))
    docs = spark.createDataFrame([(i, f"good words {i % 7} here" if i % 2 else f"BUY NOW {i % 5} $$$") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert not fits and "both" not in vars(model) and not any(isinstance(x, dict) for x in vars(model).values())
    assert {r.predicted == r.doc_id % 2 for r in quality.scores(docs, model).collect()} == {True}


def test_order_of_rows_and_chunks_does_not_change_the_model():
    kind = pa.schema({"label": pa.int32(), "features": pa.list_(pa.binary())})
    rows = [{"label": i % 2, "features": [b"a%d" % (i % 3), b" A 0", b"\xff" if i % 2 else b"\x7f"]} for i in range(40)]
    tables = [pa.Table.from_batches([pa.RecordBatch.from_pylist(part, kind) for part in parts], kind) for parts in ([rows], [rows[::-1][:7], [], rows[::-1][7:]])]
    one, two = (quality.fit(*quality._coded(t)) for t in tables)
    assert one.both == two.both and len(one.both) == 6 and (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)
    assert one.score({b"\xff"}) > 0.5 > one.score({b"\x7f"})


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")).score({b"a"}) == 0.5
