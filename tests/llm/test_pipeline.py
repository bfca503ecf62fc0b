"""The pipeline on a small corpus against its stages in plain Python."""

import hashlib
import random

import corpus_pipeline
from factorloom.llm import simhash


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    item = line(20)
    docs, labels = [], []
    for d in range(120):
        bad = d % 4 == 3
        text = "\n".join([line() for _ in range(rng.randint(1, 4))] + (["shared footer line of the site"] if d % 5 == 0 else []))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif d == 40:
            text = text + "\n" + item
        elif d == 60:
            text = docs[0][1].replace("shared footer line of the site", "another footer, longer than the first")
        docs.append((d, text, "en", "s", len(text)))
        labels.append((d, int(not bad), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    seen: set = set()
    want: dict = {}
    prints: dict = {}
    for d, text, *_ in docs:
        if d % 4 == 3:
            continue
        kept = "\n".join(x for x in text.split("\n") if x not in seen)
        seen |= set(text.split("\n"))
        p = simhash.fingerprint(kept.encode())
        if any((p ^ q).bit_count() <= 3 for q in prints.values()):
            continue
        prints[d] = p
        if item not in kept:
            want[d] = hashlib.sha256(kept.encode()).hexdigest()
    assert {d: r.decoded_sha256 for d, r in got.items()} == want
    docs0 = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs0, str(tmp_path)).columns == docs0.columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, `row` string, th long"
ODD = [(1, None), (2, ""), (3, " \r\n\t"), (3, " \r\n\t"), (None, "no id at all here"), (None, "no id at all here"), (None, None), (4, "good words of a text\r\n\r\nwith lines"), (4, "another text of the same id"), (5, "word " * 5000), (6, "word " * 5000)]


def test_stages_on_odd_rows(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([(d, t, None, "s", None, "clash", "clash", 7) for d, t in rows], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "another text of the same id"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda df: sorted((str(r.doc_id), r.text or "", r.gone, r.th) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    odd = frame(ODD)
    want = sorted((str(d), t or "", "clash", 7) for d, t in ODD)
    assert rows(stages["quality_classifier"](spark, odd, str(tmp_path))) == want
    kept = stages["line_dedup"](spark, odd, str(tmp_path))
    assert kept.columns == odd.columns
    assert rows(kept) == sorted((d, "" if d == "6" else t, g, h) for d, t, g, h in want)
    groups = {(str(d), t or "") for d, t in [(1, None), (None, "no id at all here"), (4, ODD[7][1]), (4, ODD[8][1]), (5, "word " * 5000)]}
    assert {x[:2] for x in rows(stages["simhash_near_dedup"](spark, odd, str(tmp_path)))} == groups
    assert rows(stages["benchmark_decontamination"](spark, odd, str(tmp_path))) == [x for x in want if x[1] != "another text of the same id"]
    assert stages["byte_level_bpe"](spark, odd, str(tmp_path)).count() == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame([]), str(tmp_path)).count() == 0
