"""Near copies by the share of common word shingles, with SimHash in front.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of ``4/5`` or more. Texts with equal sets are brought together first.
Then links come from two places: the trie search of ``simhash``, on fingerprints
of the same shingles, and each shingle's least text. They cost as many rows as
there are texts, whatever the size of a group. Few bits do not reach a similarity
of 4/5, so a prefix join finds all that is left: ordered alike, two such sets
share one of their first ``n - ceil(4 n / 5) + 1`` shingles. It looks at pairs
that are not yet in one group. Every link is verified by the two sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, small_batches, text_key, utf8, written
from .components import components
from .simhash import SEED, near_links, print_of

WORDS = 5
#: Texts sampled for the order of shingles, and shingles ordered by it, at most.
SAMPLE, RANKED = 8000, 50_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words (fewer words: all of them)."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype="<u8")
    grams = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) > words else [b" ".join(found)]
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in grams], dtype="<u8")


def _first(values: np.ndarray, hot: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set: shingles that are common in the sample last."""
    n = len(values)
    rank = np.zeros(n, dtype=np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        rank = np.where(hot[at] == values, count[at], 0)
    return values[np.lexsort((values, rank))[: n - (4 * n + 4) // 5 + 1]] if n else values


def _long(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parity(values: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set falls on each of 512 bits, or, of large
    sets, twice as many bits as it has shingles or more. Two sets differ in as
    many shingles as their parities differ in bits, or more. A parity of twice
    the bits folds to the smaller one: its halves differ in that."""
    bits = 1 << max(9, int(2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").view("<i8")


def _folded(parity: Column, words: Column) -> Column:
    """The parity in ``words`` longs, where it has them or twice as many."""
    half = F.zip_with(F.slice(parity, F.lit(1), words), F.slice(parity, words + 1, words), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(parity) > words, half).otherwise(parity)


def _folded_fully(parity: Column) -> Column:
    """The parity in 512 bits."""
    size = F.size(parity)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.sequence(i, size - 1, F.lit(8)), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(parity, j))))


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two parities of sets of like size differ."""
    words = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(_folded(a, words), _folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _rows(hot: np.ndarray, count: np.ndarray):
    def run(batches):
        for batch in batches:
            sid, n, fp, parity, first = [], [], [], [], []
            for text in batch.column("t").to_pylist():
                every = shingles(text)
                values = np.unique(every)
                sid.append(xxhash.xxh3_64_intdigest(values.tobytes()))
                n.append(len(values))
                fp.append(print_of(every))
                parity.append(_parity(values))
                first.append(_first(values, hot, count))
            whole = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sid, n, fp)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *whole, _long(parity), _long(first)], names=["doc_id", "th", "sid", "n", "fp", "parity", "first"])

    return run


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("sid"), _long([np.unique(shingles(t)) for t in batch.column("t").to_pylist()])], names=["sid", "s"])


def _order(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a sample, and their counts. The order
    of shingles is free; common ones late keep the prefix join small."""
    each = max(1, source.count() // SAMPLE)
    some = source.where(F.pmod("th", F.lit(each)) == 0).limit(2 * SAMPLE).select(F.lit(0).cast("long").alias("sid"), "t")
    found = some.mapInArrow(_sets, "sid long, s array<long>").select(F.explode("s").alias("h")).groupBy("h").count().where("count > 3")
    rows = found.orderBy(F.desc("count"), "h").limit(RANKED).collect()
    hot, count = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.int64)
    by = np.argsort(hot)
    return hot[by], count[by]


def _size_fits(a: str, b: str):
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _verified(pairs: DataFrame, source: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs u, v of sets that are similar enough. Sets of n and m shingles may
    differ in (n + m) / 9 of them, so parities tell most of the others apart."""
    side = lambda c: texts.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    pairs = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(_size_fits("nu", "nv")).where(9 * _apart(F.col("pu"), F.col("pv")) <= F.col("nu") + F.col("nv"))
    pairs = written(pairs.select("u", "v"), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(texts.select("sid", "th"), "sid")
    sets = source.select("th", "t").join(wanted, "th").dropDuplicates(["sid"]).select("sid", "t").mapInArrow(_sets, "sid long, s array<long>")
    sets = written(sets, "sets")
    left, right = sets.select(F.col("sid").alias("u"), F.col("s").alias("su")), sets.select(F.col("sid").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    links = written(both.where(9 * F.size(F.array_intersect("su", "sv")) >= 4 * (F.size("su") + F.size("sv"))).select("u", "v"), "links")
    drop(pairs, sets)
    return links


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, th (hash of the text), root (one long for
    each group). Groups are what links of similarity 4/5 or more connect; null and
    empty texts are one group."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t")).select("doc_id", text_key(F.col("t"), 6).alias("th"), "t")
    kinds = "doc_id long, th long, sid long, n long, fp long, parity array<long>, first array<long>"
    every = written(source.mapInArrow(_rows(*_order(source)), kinds), "shingled")
    low = F.min("th").alias("th")
    sets = every.groupBy("sid").agg(low, F.min("n").alias("n"), F.min("fp").alias("fp")).join(every.select("sid", "th", "parity", "first"), ["sid", "th"]).dropDuplicates(["sid"])
    sets = written(sets, "distinct_sets")
    rows = written(every.select("doc_id", "th", "sid"), "grouped_rows")
    drop(every)
    texts = sets.select("sid", "th", "n", "parity")
    each = sets.where("n > 1").select("sid", "n", F.explode("first").alias("h"))
    again = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    shared = written(each.join(again, "h"), "shared_shingles")
    least = shared.groupBy("h").agg(F.min(F.struct("n", "sid")).alias("low"))
    stars = shared.join(least, "h").where("sid <> low.sid").where(_size_fits("n", "low.n")).select(F.col("low.sid").alias("u"), F.col("sid").alias("v"))
    owner = written(sets.groupBy("fp").agg(F.min("sid").alias("sid")), "distinct_fp")
    alike = sets.select("sid", "fp").join(owner.withColumnRenamed("sid", "u"), "fp").where("sid <> u").select("u", F.col("sid").alias("v"))
    own = lambda c: owner.select(F.col("fp").alias(f"f{c}"), F.col("sid").alias(c))
    walked = near_links(owner.select("fp"), max_bits).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    walked = walked.join(own("u"), "fu").join(own("v"), "fv").select("u", "v")
    links = _verified(stars.union(alike).union(walked).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), source, texts)
    drop(owner)
    roots = written(components(links).withColumnRenamed("node", "sid"), "roots")
    rooted = shared.join(roots, "sid", "left").select("h", "sid", "n", F.coalesce("root", "sid").alias("root"))
    mixed = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    rest = written(rooted.join(mixed, "h").join(sets.select("sid", _folded_fully(F.col("parity")).alias("p")), "sid"), "rest")
    drop(shared)
    a, b = (rest.select("h", *(F.col(c).alias(c + side) for c in ("sid", "n", "root", "p"))) for side in "ab")
    apart = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(8)), F.lit(0))
    left = a.join(b, "h").where("sida < sidb and roota <> rootb").where(_size_fits("na", "nb")).where(9 * apart <= F.col("na") + F.col("nb")).select(F.col("sida").alias("u"), F.col("sidb").alias("v"))
    links = links.union(_verified(left, source, texts))
    drop(rest, sets)
    roots = written(components(links).withColumnRenamed("node", "sid"), "roots")
    return rows.join(roots, "sid", "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group, all columns kept: that of the least doc_id (null
    last), then of the least hash of the text; one row of repeated ones."""
    rows = written(near_groups(docs, text, key), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    least = rows.groupBy("root").agg(F.min(order).alias("x"))
    kept = least.select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"))
    times = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("__times"))
    pair = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("th"))
    kept = written(kept.join(times, pair).select("__id", "__th", "__times"), "kept")
    own = docs.withColumn("__own", text_key(utf8(text), 6))
    found = own.join(kept, F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")))
    many = found.where("__times > 1").dropDuplicates(["__id", "__th"])
    if not kept.where("__times > 1").isEmpty():
        found = found.where("__times = 1").union(many)
    return found.select(docs.columns)
