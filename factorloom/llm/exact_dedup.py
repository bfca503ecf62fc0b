"""Exact deduplication by composable polynomial fingerprints.

A normalised text is cut into chunks. Each chunk is hashed by itself as a
polynomial in a fixed base, and the hashes of neighbouring chunks combine by
shifting the left one by the length of the right one, so that the parts of a
huge text are rows of their own, which tasks hash in any order. Texts of equal fingerprint and length are
then compared chunk by chunk: the least and the greatest content of every chunk
of a group are aggregated (with partial aggregation before the shuffle, so a hot
group moves a row for each task), and a group whose two agree everywhere is one
text. Groups that fail, that is true collisions, are told apart by their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, utf8, written

#: Two prime moduli below 2**31 and a base for each.
FIELDS = ((2147483647, 1000003), (2147483629, 998244353))
#: Bytes in a chunk: for hashing, and for the comparison of contents.
CHUNK = 4096
COMPARED = 1 << 20
#: Texts of more bytes are hashed and compared in parts of so many, by any tasks.
PART = 1 << 22
#: What normalising deletes.
BLANK = b" \t\n\x0b\x0c\r"
#: Bits of the filter that tells which texts the comparison has to read.
FILTER_BITS = 1 << 23


def _powers(n: int, mod: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % mod
    return out


POWERS = [_powers(CHUNK, *f) for f in FIELDS]


def combine(left: int, right: int, right_len: int, mod: int, base: int) -> int:
    """Hash of a text from those of its two parts."""
    return (left * pow(base, right_len, mod) + right) % mod


def fingerprint(data: bytes, fields=FIELDS) -> tuple[int, ...]:
    """Polynomial hash of ``data`` in each field, combined from its chunks."""
    whole = len(data) // CHUNK * CHUNK
    head = np.frombuffer(data, dtype=np.uint8, count=whole).reshape(-1, CHUNK)
    tail = np.frombuffer(data, dtype=np.uint8, offset=whole).astype(np.uint64)
    out = []
    for (mod, base), powers in zip(fields, POWERS):
        h = 0
        step = pow(base, CHUNK, mod)
        for at in range(0, len(head), 64):
            for one in (head[at : at + 64].astype(np.uint64) @ powers) % np.uint64(mod):
                h = (h * step + int(one)) % mod
        if len(tail):
            h = combine(h, int(tail @ powers[CHUNK - len(tail) :]) % mod, len(tail), mod, base)
        out.append(h)
    return tuple(out)


def _joined(pair: tuple[int, ...], bits: int) -> int:
    a, b = pair
    return ((a << 31 | b) * 0x9E3779B97F4A7C15 & (1 << 63) - 1) % (1 << bits) if bits < 62 else a << 31 | b


def _summaries(bits: int):
    def run(batches):
        for batch in batches:
            ids, fps, lengths, points, shas = batch.column(0), [], [], [], []
            for t in batch.column(1).to_pylist():
                data = t.translate(None, BLANK)
                fps.append(_joined(fingerprint(data), bits))
                lengths.append(len(data))
                points.append(len(t.decode()))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.int64()), pa.array(lengths, pa.int64()), pa.array(points, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "fp", "size", "points", "text_sha256"])

    return run


def _part_hashes(batches):
    for batch in batches:
        data = [t.translate(None, BLANK) for t in batch.column("part").to_pylist()]
        a, b = zip(*map(fingerprint, data)) if data else ((), ())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ta", "tb", "k")), *(pa.array(x, pa.int64()) for x in (list(map(len, data)), a, b))], names=["ta", "tb", "k", "size", "a", "b"])


def _combined(bits: int):
    """Fingerprint and length of a text from those of its parts, in any order."""

    def run(batches):
        for batch in batches:
            fps, sizes = [], []
            for parts in batch.column("parts").to_pylist():
                whole, total = [0, 0], 0
                for x in sorted(parts, key=lambda x: x["k"]):
                    whole = [combine(h, x[c], x["size"], *f) for h, c, f in zip(whole, "ab", FIELDS)]
                    total += x["size"]
                fps.append(_joined(tuple(whole), bits))
                sizes.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("ta"), batch.column("tb"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], names=["ta", "tb", "fp", "size"])

    return run


def _huge(source: DataFrame, bits: int, part: int) -> DataFrame:
    """fp, size, points, text_sha256, body (normalised) of the texts of over ``part`` bytes."""
    long = source.where(F.length("t") > part).select("doc_id", F.xxhash64("t").alias("ta"), F.xxhash64(F.lit(1), "t").alias("tb"), "t")
    parts = long.select("ta", "tb", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / part).cast("int"))).alias("k"), "t")
    parts = parts.select("ta", "tb", "k", F.substring("t", F.col("k") * part + 1, F.lit(part)).alias("part")).repartition("ta", "tb", "k")
    hashed = parts.mapInArrow(_part_hashes, "ta long, tb long, k int, size long, a long, b long").groupBy("ta", "tb").agg(F.collect_set(F.struct("k", "size", "a", "b")).alias("parts"))
    found = hashed.mapInArrow(_combined(bits), "ta long, tb long, fp long, size long")
    text = F.col("t").cast("string")
    body = F.translate(text, BLANK.decode(), "")
    return long.join(found, ["ta", "tb"]).select("doc_id", "fp", "size", F.length(text).cast("long").alias("points"), F.sha2(body, 256).alias("text_sha256"), body.cast("binary").alias("body"))


def _chunks(bits: int, wanted):
    def run(batches):
        marks = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                data = t.translate(None, BLANK)
                fp = _joined(fingerprint(data), bits)
                spot = (fp * 0x9E3779B97F4A7C15 >> 20) % FILTER_BITS
                if not marks[spot >> 3] >> (spot & 7) & 1:
                    continue
                for k, at in enumerate(range(0, max(1, len(data)), COMPARED)):
                    yield pa.RecordBatch.from_arrays([pa.array([fp], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([k], pa.int32()), pa.array([data[at : at + COMPARED]], pa.binary())], names=["fp", "size", "chunk", "content"])

    return run


def _filter(groups: DataFrame) -> bytes:
    """A bit for each place that a group's fingerprint falls on: FILTER_BITS / 8
    bytes at most, whatever the size of the corpus. When it fills up, more texts
    are read for the comparison, none is left out."""
    words = groups.mapInArrow(_spots, "word int, mark int").groupBy("word").agg(F.bit_or("mark").alias("mark"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    found = words.toPandas()
    out[found["word"].to_numpy(dtype=np.int64)] = found["mark"].to_numpy(dtype=np.uint8)
    return out.tobytes()


def _spots(batches):
    for batch in batches:
        spots = np.array([(fp * 0x9E3779B97F4A7C15 >> 20) % FILTER_BITS for fp in batch.column("fp").to_pylist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((spots >> 3).astype(np.int32)), pa.array((1 << (spots & 7)).astype(np.int32))], names=["word", "mark"])


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", fingerprint_bits: int = 62, part: int = PART) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ASCII white space is deleted. Of a group
    the row with the most code points, then the smallest doc_id, stays. Null
    counts as empty, and empty and blank texts form one group; a null doc_id sorts
    before all others; of repeated rows that tie in both, one is marked kept; an
    empty table gives no rows. Other columns are not looked at.
    Texts of over ``part`` bytes are hashed in parts. ``fingerprint_bits`` below 62
    weakens the fingerprint, for tests."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t"))
    plain, huge = source.where(F.length("t") <= part), _huge(source, fingerprint_bits, part)
    summaries = plain.mapInArrow(_summaries(fingerprint_bits), "doc_id long, fp long, size long, points long, text_sha256 string")
    rows = written(summaries.union(huge.drop("body")).withColumn("rid", F.monotonically_increasing_id()), "summaries")
    many = written(rows.groupBy("fp", "size").count().where("count > 1"), "groups")
    wanted = spark.sparkContext.broadcast(_filter(many.select("fp")))
    chunks = plain.select("t").mapInArrow(_chunks(fingerprint_bits, wanted), "fp long, size long, chunk int, content binary")
    cuts = huge.join(many, ["fp", "size"], "left_semi").select("fp", "size", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / COMPARED).cast("int"))).alias("chunk"), "body")
    chunks = chunks.union(cuts.select("fp", "size", "chunk", F.substring("body", F.col("chunk") * COMPARED + 1, F.lit(COMPARED)).alias("content")))
    torn = (
        chunks.groupBy("fp", "size", "chunk").agg(F.min("content").alias("a"), F.max("content").alias("b"))
        .where("a <> b").select("fp", "size").distinct()
    )
    torn = written(torn, "collisions")
    rows = rows.withColumn("which", F.lit(""))
    if not torn.isEmpty():
        # true collisions: a fingerprint's texts are told apart by what they are
        rows = rows.join(torn.withColumn("torn", F.lit(True)), ["fp", "size"], "left").withColumn("which", F.when(F.col("torn"), F.col("text_sha256")).otherwise(""))
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id"), F.col("rid"))
    groups = rows.groupBy("fp", "size", "which").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "best_rows")  # a table of its own: Spark splits a hot group in the join
    return rows.join(groups, ["fp", "size", "which"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"), "text_sha256"
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
with n as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body
  from documents),
g as (
  select doc_id, body,
         first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
         count(*) over (partition by body) as group_size
  from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from g
"""
