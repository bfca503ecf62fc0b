"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains an item if it holds at least a share ``similarity`` of the
item's distinct word shingles. The items are partitioned by their number of
shingles; an item of q shingles, of which k must be found, is sketched by its
q - k + 1 least hash values, so a document that contains it meets the sketch in
at least one of them, whatever the length of the document: the search misses
nothing. A document looks up, in each size class that fits in it, those of its
shingle hashes that are no greater than the greatest sketch value of the class.
Candidates are verified by exact containment of the shingle
texts. All steps are SQL and DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_key, written

WORDS = 5
SIMILARITY = 0.8
TEXT_SEED = 1
#: Sketch rows and items that are still broadcast: 24 bytes a row; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(clean, " "))


def _starts(w: Column, n: Column) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))


def hashes(w: Column, n: int) -> Column:
    return F.transform(_starts(w, F.lit(n)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))


def shingles(w: Column, n: Column) -> Column:
    """Distinct shingles of n words, as texts."""
    return F.array_distinct(F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " ")))


def _probes(hashed: Column, words_: Column, n: int, size_class: int, need: int, top: int) -> Column:
    """The shingle hashes that a document looks up in a class, with its name."""
    fits = F.when(F.size(words_) >= need + n - 1, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.transform(F.filter(fits, lambda h: h <= top), lambda h: F.struct(F.lit(n).alias("n"), F.lit(size_class).alias("class"), h.alias("h")))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _matched(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_shared, n_shingles, containment."""
    w = F.col("w")
    listed = items.select(F.col(item_key).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    listed = listed.withColumn("n", n).withColumn("s", shingles(w, F.col("n"))).drop("w").distinct()
    q = F.size("s")
    listed = listed.withColumn("q", q).withColumn("need", F.greatest(F.lit(1), F.ceil(q * similarity - 1e-9).cast("int"))).withColumn("item", F.xxhash64("item_id", "s"))
    listed = written(listed, "items")
    hashed = F.array_sort(F.transform("s", lambda x: F.xxhash64(F.split(x, " "))))
    sketch = listed.select("item", "n", "q", "need", F.explode(F.slice(hashed, F.lit(1), F.col("q") - F.col("need") + 1)).alias("h"))
    sketch = written(sketch.withColumn("class", F.length(F.bin(F.col("q").cast("long")))), "sketch")
    # at most 6 x 64 rows: shingle length x bits of the number of shingles
    classes = sketch.groupBy("n", "class").agg(F.max("h").alias("top"), F.min("need").alias("need")).collect()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    source = source.select("doc_id", text_key(F.col("t"), TEXT_SEED).alias("th"), words(F.col("t")).alias("w"))
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, n_shared int, n_shingles int, containment double")
    hashed = source.select("doc_id", "th", "w", *[hashes(w, n).alias(f"h{n}") for n in sorted({c["n"] for c in classes})])
    probes = F.concat(*[_probes(F.col(f"h{c['n']}"), w, c["n"], c["class"], c["need"], c["top"]) for c in classes])
    probed = hashed.select("doc_id", "th", F.explode(probes).alias("p")).select("doc_id", "th", "p.*")
    found = probed.join(_maybe_broadcast(sketch.select("n", "class", "h", "item").distinct()), ["n", "class", "h"]).select("doc_id", "th", "item")
    found = written(found.distinct(), "candidates")
    wanted = found.groupBy("doc_id", "th").agg(F.collect_list("item").alias("wanted"))  # items at most
    wanted = F.broadcast(wanted) if found.count() <= BROADCAST_ROWS // 10 else wanted
    a, b = source.alias("a"), wanted.alias("b")
    near = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("a.doc_id", "a.th", "w", "wanted")
    lengths = sorted({c["n"] for c in classes})
    own = F.create_map(*[x for k in lengths for x in (F.lit(k), shingles(w, F.lit(k)))])
    near = near.withColumn("own", own).select("doc_id", "th", "own", F.explode("wanted").alias("item"))
    checked = near.join(_maybe_broadcast(listed), "item").select("doc_id", "th", "item_id", F.size(F.array_intersect("s", F.col("own")[F.col("n")])).alias("n_shared"), F.col("q").alias("n_shingles"), "need")
    return checked.where("n_shared >= need").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every pair at or above
    ``similarity``. Options: item_text, item_key, similarity, size.

    An item of fewer than ``size`` words has its whole word sequence as its only
    shingle; items and documents without words match nothing, null texts among
    them. Of repeated rows and ids each pair is returned once, with the greatest
    containment; null ids are kept and match like others; empty tables give no
    rows; other columns are not looked at."""
    checked = _matched(docs, items, text, key, **options)
    best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shared", "best.n_shingles", "best.containment")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept, whatever
    their names. Rows of one id are judged each by its own text."""
    hit = _matched(docs, items, text, key, **options).select("doc_id", "th").distinct()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"), text_key(body, TEXT_SEED).alias("th"))
    a, b = rows.alias("a"), hit.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left_anti").select("row.*")


def op1_decontaminate(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (select doc_id as id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents),
i as (select item_id as id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark),
j as (select id, w, least(len(w), 5) as n from i where len(w) > 0),
js as (select distinct id, n, array_to_string(w[k:k + n - 1], ' ') as s from (select id, w, n, unnest(range(1, len(w) - n + 2)) as k from j)),
q as (select id, count(*) as q from js group by id),
ds as (select distinct id, n, array_to_string(w[k:k + n - 1], ' ') as s from (select d.id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as k from d, (select distinct n from j))),
c as (select ds.id as doc_id, js.id as item_id, count(*) as n_shared from ds join js on ds.n = js.n and ds.s = js.s group by 1, 2)
select doc_id, item_id, n_shared::int as n_shared, q::int as n_shingles, n_shared::double / q as containment
from c join q on q.id = item_id where n_shared >= greatest(1, ceil(0.8 * q - 1e-9))
"""
