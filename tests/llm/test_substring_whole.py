"""Passages that substring dedup must not miss."""

import random

from pyspark.sql import functions as F

from factorloom.llm import substring_dedup


def texts(spark, tmp_path, found):
    """Digests of what op2 keeps of each text."""
    rows = [(d, t) for d, t in enumerate(found)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = substring_dedup.op2_substring_dedup(spark, str(tmp_path))
    empty = spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    return {r.doc_id: r.kept_sha256 == empty for r in kept.collect()}, {r.doc_id: r.n_removed for r in kept.collect()}


def test_texts_of_tiny_sentences(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    loud = " ".join(word().upper() + "!!" for _ in range(150))
    menu = "\n".join(word() for _ in range(40))
    short = "Three words only."
    tail = ". ".join(" ".join(word() for _ in range(9)) for _ in range(4)) + ". Yes. No."
    gone, removed = texts(spark, tmp_path, [loud, menu, short, tail, loud, menu, short, tail, "Three words more."])
    assert [gone[d] for d in range(9)] == [False] * 4 + [True] * 4 + [False]
    assert removed[8] == 0


def test_passages_that_begin_within_a_sentence(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    plain, two = line(60), line(30) + ". " + line(25) + "."
    found = [f"{line(lead)} {passage} {line(9)}" for passage in (plain, two) for lead in (0, 3, 5, 7, 18, 29)]
    _, removed = texts(spark, tmp_path, found)
    assert removed[0] == removed[6] == 0
    assert all(removed[d] >= 3 for d in range(12) if d % 6)


def test_any_long_unpunctuated_passage_shares_three_pieces():
    rng = random.Random(7)
    for words in (300, 6):
        for _ in range(300):
            line = lambda n: " ".join(str(rng.randrange(words)) for _ in range(n))
            passage = line(51)
            a, b = (substring_dedup.sentences(f"{line(rng.randint(0, 30))} {passage} {line(rng.randint(0, 30))}") for _ in "ab")
            assert max(len(p.split()) for p in a) <= substring_dedup.LONG
            runs = [{tuple(" ".join(p.split()) for p in x[i : i + 3]) for i in range(len(x) - 2)} for x in (a, b)]
            assert runs[0] & runs[1]
