"""Substring deduplication with sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed; equal runs are brought
together over the whole corpus, and a sentence goes if it is covered by any run
that also occurs earlier. A document sends each of its distinct runs once, with
no text; a run of one place only is dropped by counting before anything is
joined, and the earliest place of the others is a minimum, so a passage that a
third of all documents share is never gathered; the joins that give a run its
earliest place broadcast it, or meet it in a shuffle whose large partitions Spark
splits.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, small_batches, table, text_key, utf8, written

SPAN = 3
#: A sentence of more words is cut and counts as several.
LONG = 16
#: A run of fewer words is no evidence of copying; it takes in more sentences.
LEAST_WORDS = 8
#: Words of a window; a long sentence is cut after the least word of each.
WINDOW = 8
_END = re.compile(r"(?<=[.!?])(?=\s)|(?<=\n)")
_WORD = re.compile(r"\s*\S+\s*")


def pieces(part: str) -> list[str]:
    """A long sentence, cut after the word of least hash (the last of equals) of
    every ``WINDOW`` consecutive words. The words around decide, not how far the
    sentence's start is, so equal passages are cut alike but for their margins;
    a piece has at most ``WINDOW`` words."""
    words = _WORD.findall(part)
    if len(words) <= LONG:
        return [part]
    rank = [xxhash.xxh3_64_intdigest(w.strip()) for w in words]
    out, at, last = [], 0, -1
    for i in range(len(words) - WINDOW + 1):
        if last < i:
            low = min(rank[i : i + WINDOW])
            last = next(k for k in range(i + WINDOW - 1, i - 1, -1) if rank[k] == low)
        elif rank[i + WINDOW - 1] <= rank[last]:
            last = i + WINDOW - 1
        if last >= at:
            out.append("".join(words[at : last + 1]))
            at = last + 1
    return out + ["".join(words[at:])] if at < len(words) else out


def sentences(text: str) -> list[str]:
    """Consecutive parts of ``text`` that add up to it: sentences end after . ! or ?
    before white space and at line ends; those of over ``LONG`` words are cut into
    ``pieces``. Parts without words belong to the one before."""
    out: list[str] = []
    for part in _END.split(text):
        if not part or part.isspace():
            if out:
                out[-1] += part
            elif part:
                out.append(part)
        else:
            if out and out[-1].isspace():
                part = out.pop() + part
            out += pieces(part) if len(part) > 2 * LONG else [part]
    return [] if len(out) == 1 and out[0].isspace() else out


def runs(parts: list[str], span: int, least_words: int, extend: bool) -> list[tuple[int, int, bytes]]:
    """Start, end and 128-bit hash (white space made even) of the run that begins
    at each sentence. A text of fewer sentences is one run.

    ``extend``: a run of fewer words than ``least_words`` goes on until it has
    them, and the last run is the shortest one up to the end of the text; a text
    that has fewer in all is one run. Else runs of too few words are left out."""
    words = [p.split() for p in parts]
    lines = [" ".join(w) for w in words]
    size = list(map(len, words))
    n = len(parts)
    found = []
    if not extend:
        found = [(i, min(n, i + span)) for i in range(max(1, n - span + 1) if n else 0) if sum(size[i : i + span]) >= least_words]
    elif n:
        end = total = 0
        for i in range(n):
            while end < n and (end < i + span or total < least_words):
                total += size[end]
                end += 1
            if i and (end < i + span or total < least_words):
                break
            found.append((i, end))
            total -= size[i]
        if found[-1][1] < n:
            i, total = n - 1, size[n - 1]
            while i and (n - i < span or total < least_words):
                i -= 1
                total += size[i]
            found.append((i, n))
    return [(i, j, xxhash.xxh3_128_digest("\n".join(lines[i:j]))) for i, j in found]


def _hashes(span, least_words, extend):
    def run(batches):
        for batch in batches:
            rows, flat = [], []
            for row, text in enumerate(batch.column("t").to_pylist()):
                found = {h for _, _, h in runs(sentences(text.decode()), span, least_words, extend)}
                rows += [row] * len(found)
                flat += found
            take = pa.array(rows, pa.int64())
            both = memoryview(b"".join(flat)).cast("q") if flat else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(list(both[::2]), pa.int64()), pa.array(list(both[1::2]), pa.int64())], names=["doc_id", "th", "a", "b"])

    return run


def cut(text: str, lost: dict[bytes, int | None], span: int, least_words: int, extend: bool) -> tuple[str, int, int, list]:
    """Kept text, sentences, removed sentences, and the ids that hold the removed
    runs first."""
    parts = sentences(text)
    gone, seen, ids = [False] * len(parts), set(), set()
    for i, j, h in runs(parts, span, least_words, extend):
        if h in lost or h in seen:
            gone[i:j] = [True] * (j - i)
            if h in lost and lost[h] is not None:
                ids.add(lost[h])
        seen.add(h)
    return "".join(p for p, g in zip(parts, gone) if not g) if any(gone) else text, len(parts), sum(gone), sorted(ids)


def _cuts(span, least_words, extend):
    def run(batches):
        for batch in batches:
            out = []
            for text, lost in zip(batch.column("t").to_pylist(), batch.column("lost").to_pylist()):
                found = {x["a"].to_bytes(8, "little", signed=True) + x["b"].to_bytes(8, "little", signed=True): x["first"] for x in lost or ()}
                out.append(cut(text.decode(), found, span, least_words, extend))
            text, n, gone, ids = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "text", "n_sentences", "n_removed", "source_ids"])

    return run


def dedup_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, least_words: int = LEAST_WORDS, extend: bool = False) -> DataFrame:
    """One row per input row: doc_id, text (what is kept), n_sentences, n_removed,
    source_ids (the documents where the removed runs occur first).

    Earlier is the smaller doc_id (null first), then the smaller hash of the text,
    then the place in it. Null counts as empty; a text of fewer than ``span``
    sentences is one run; runs of fewer than ``least_words`` words take in more
    sentences with ``extend`` and are left out without; repeated rows with the same id and text are one document
    and lose nothing to each other; an empty table gives no rows; other columns are
    not looked at."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t")).select("doc_id", text_key(F.col("t"), 2).alias("th"), "t")
    hashed = written(source.mapInArrow(_hashes(span, least_words, extend), "doc_id long, th long, a long, b long"), "runs")
    # tables that a join meets are written before it: a hot run can then be split
    again = written(hashed.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "again")
    shared = written(hashed.join(small(again), "a"), "shared_runs")
    drop(hashed, again)
    first = written(shared.groupBy("a", "b").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "first_runs")
    later = shared.join(small(first), ["a", "b"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
    lost = written(later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b", F.col("first.doc_id").alias("first"))).alias("lost")), "lost_runs")
    drop(shared, first)
    pair = source["doc_id"].eqNullSafe(lost["doc_id"]) & (source["th"] == lost["th"])
    joined = source.join(lost, pair, "left").select(source["doc_id"], "t", "lost")
    return joined.mapInArrow(_cuts(span, least_words, extend), "doc_id long, text string, n_sentences long, n_removed long, source_ids array<long>")


def op2_substring_dedup(spark, sf_dir):
    found = dedup_spans(table(spark, sf_dir, "documents"), extend=True)
    return found.select("doc_id", "n_sentences", "n_removed", "source_ids", F.sha2(F.col("text"), 256).alias("kept_sha256"))
