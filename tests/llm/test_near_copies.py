"""The near-dedup stage of the pipeline against all pairs in plain Python."""

import random

from pyspark.sql import functions as F

from factorloom.llm import near_copies

SCHEMA = "doc_id long, text string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(texts):
    sets, out = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    return out


def test_near_copies_of_similarity_four_fifths(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = ["", None, "  \n", "one two", "ONE  two", "one two three four five", "one two three four five six"]
    common = [word() for _ in range(30)]
    for _ in range(30):
        words = [word() for _ in range(rng.randint(20, 150))] + common * rng.randint(0, 1)
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 30))):
                changed[at] = word()
            texts.append(" ".join(changed))
    got = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    want = sorted(set(roots(texts)))
    assert 20 < len(want) < len(texts) - 20
    assert sorted(r.doc_id for r in got) == want
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    a, b, c, d = (f"text {x} of words that are {x} like no other {x}" for x in "abcd")
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, d), (None, a), (None, d + "!"), (2, b), (3, None), (3, None)]
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.lit(1))).collect()
    want = [(1, a), (1, b), (None, c), (None, d), (None, d + "!"), (3, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in want)
    assert got[0].t == 1
