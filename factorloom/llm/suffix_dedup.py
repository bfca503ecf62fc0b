"""Removal of long repeated byte strings with a run-length suffix index.

A string of ``length`` bytes that starts at two places holds, at both, the same
least k-gram hash (winnowing), so every window belongs to one selected k-gram
and equal windows to equal ones. The windows of a selected k-gram lie in a row
and make up a segment. Segments whose k-gram is selected nowhere else hold no
repeated window. Equal segments hold repeated windows only. The others go, once
each, to buckets by k-gram; a bucket is indexed by a run-compressed
Burrows-Wheeler transform with the suffix positions at the ends of its runs.
From the common prefixes at those ends, the longest match of every position with
any other position of the bucket is streamed in text order (the permuted LCP
array falls by one from a run end to the next), and windows that match in full
are marked. A k-gram with very many different segments would overfill a bucket;
its windows are told apart by their hash and counted instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, small_batches, table, utf8, written

LENGTH = 200
GRAM = 64
#: Bytes that the selection works on at once; positions fit in 20 bits.
SLICE = 1 << 19
#: Bytes of a bucket, about, and different segments of a k-gram that are still indexed.
BUCKET = 1 << 20
MANY = 2000
#: Tasks that the buckets are dealt out over, at most.
MOST_TASKS = 20_000
BETWEEN, END = 0xFF, 0xFE  # never bytes of UTF-8

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers[size]


class Slice:
    """Hashes of the bytes of one slice: of any range, and its k-grams mixed."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        x = (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Segments of the texts that lie in ``data`` one after the other and end at
    ``ends``: arrays first window start, last window start, k-gram hash, hash of
    the segment's bytes."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hashed = Slice(data)
    grams = hashed.grams(k)
    key = grams & ~_LOW | (_LOW - np.arange(len(grams), dtype=np.uint64))
    spot = (_LOW - (_sliding_min(key, length - k + 1) & _LOW)).astype(np.int64)  # the rightmost of the least
    start = np.arange(len(spot))
    start = start[start + length <= ends[np.searchsorted(ends, start, "right")]]
    if not len(start):
        return segments(data[:0], ends, length, k)
    new = np.r_[True, (np.diff(spot[start]) != 0) | (np.diff(start) > 1)]
    first, last = start[new], start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    return first, last, grams[spot[first]], hashed.ranges(first, last + length)


def _pieces(texts: list[bytes], length: int):
    """Texts in slices of bounded size: (row, offset in the text, bytes). A text
    over a slice goes in parts that overlap by length - 1 bytes, so that each of
    its windows is in one part."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            part = text[at : at + SLICE + length - 1]
            if size + len(part) > SLICE and held:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def _select(length: int, k: int):
    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for held in _pieces(texts, length):
                data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
                ends = np.cumsum([len(p) for _, _, p in held])
                first, last, gram, seg = segments(data, ends, length, k)
                which = np.searchsorted(ends, first, "right")
                rows, offset = np.array([r for r, _, _ in held]), np.array([a for _, a, _ in held]) - np.r_[0, ends[:-1]]
                take = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), hashes.take(take), pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(first + offset[which]), pa.array((last - first + length).astype(np.int32))],
                    names=["doc_id", "th", "gram", "seg", "start", "size"],
                )

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling, from eight bytes on. Suffixes that are already apart from
    all others keep their places; a rank is the first place of its group."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    h = 8
    rank = np.zeros(n + 1, np.int64)
    order = np.argsort(key)
    key, places = key[order], np.arange(n)
    at = order
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, places, 0)) + 1
        tied = ~(new & np.r_[new[1:], True])
        places, at = places[tied], at[tied]
        if not len(places) or h >= 2 * n:
            return order
        key = (rank[at] << 32 | rank[np.minimum(at + h, n)]).astype(np.uint64)
        sort = np.argsort(key)
        key, at = key[sort], at[sort]
        order[places] = at
        h *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    padded = np.concatenate([text, np.arange(64, dtype=np.uint8)])
    step = np.arange(32)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        ok = np.maximum(i, j) < len(text)
        live, i, j = live[ok], i[ok], j[ok]
        equal = padded[i[:, None] + step] == padded[j[:, None] + step]
        n = np.where(equal.all(axis=1), 32, equal.argmin(axis=1))
        n = np.minimum(n, len(text) - np.maximum(i, j))
        out[live] += n
        live = live[n == 32]
    return out


class RunLengthIndex:
    """Run-compressed BWT of a text with the suffix positions at run ends."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        order = suffix_array(text)
        bwt = text[order - 1]
        turn = np.flatnonzero(bwt[1:] != bwt[:-1])  # last ranks of runs but the last
        self.symbols = bwt[np.r_[0, turn + 1]]
        self.lengths = np.diff(np.r_[0, turn + 1, len(bwt)])
        self.heads, self.before = order[turn + 1], order[turn]
        self.ends = order[0], order[-1]

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with another one."""
        n = len(self.text)
        shared = np.concatenate([_common(self.text, self.heads[i : i + 65536], self.before[i : i + 65536]) for i in range(0, len(self.heads), 65536)] or [np.empty(0, np.int64)])
        best = np.zeros(n, np.int64)
        for sampled, alone in ((self.heads, self.ends[0]), (self.before, self.ends[1])):
            at = np.r_[sampled, alone]
            value = np.r_[shared, 0]
            drop = np.full(n, -1, np.int64)
            drop[at] = value + at
            seen = np.maximum.accumulate(np.where(drop >= 0, np.arange(n), -1))
            best = np.maximum(best, np.where(seen >= 0, drop[seen] - np.arange(n), 0))
        return best


def _cover(starts: np.ndarray, length: int) -> list[int]:
    """Ranges [from, to) that windows at sorted ``starts`` cover, flattened."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length], 1).ravel().tolist()


def _index(length: int):
    def run(group: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple[bytes, int]] = {}
        for gram, seg, n, content in zip(*(group.column(c).to_pylist() for c in ("gram", "seg", "n", "content"))):
            found[gram, seg] = content, n
        size = np.array([len(c) for c, _ in found.values()])
        text = np.frombuffer(b"".join(c + bytes([BETWEEN]) for c, _ in found.values()) + bytes([END]), np.uint8)
        best = RunLengthIndex(text).matching_statistics()
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        rows = []
        for (gram, seg), (content, n), at in zip(found, found.values(), begin):
            if n == 1 and len(ranges := _cover(np.flatnonzero(best[at : at + len(content) - length + 1] >= length), length)):
                rows.append((gram, seg, ranges))
        grams, segs, covers = zip(*rows) if rows else ((), (), ())
        return pa.table({"gram": pa.array(grams, pa.int64()), "seg": pa.array(segs, pa.int64()), "ranges": pa.array(covers, pa.list_(pa.int32()))})

    return run


def _cut(batches):
    for batch in batches:
        texts, wanted = batch.column("t").to_pylist(), batch.column("wanted").to_pylist()
        rows = [(w["gram"], w["seg"], w["n"], t[w["start"] : w["start"] + w["size"]]) for t, ws in zip(texts, wanted) for w in ws]
        for at in range(0, len(rows), 4096):
            g, s, n, c = zip(*rows[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.binary())], names=["gram", "seg", "n", "content"])


def _windows(length: int):
    """gram, seg, offset, window hash of every window of the segments."""

    def run(batches):
        for batch in batches:
            for gram, seg, n, content in zip(*(batch.column(c).to_pylist() for c in ("gram", "seg", "n", "content"))):
                hashed = Slice(np.frombuffer(content, np.uint8))
                start = np.arange(len(content) - length + 1)
                windows = hashed.ranges(start, start + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), gram)), pa.array(np.full(len(start), seg)), pa.array(start.astype(np.int32)), pa.array(windows)], names=["gram", "seg", "at", "win"])

    return run


def _covers(length: int):
    @F.pandas_udf("array<int>")
    def covers(starts):
        return starts.map(lambda s: _cover(np.sort(np.asarray(s)), length))

    return covers


def _apply(texts: list[bytes], marks: list) -> list[tuple[list[bytes], int, int]]:
    """Kept parts, removed bytes, maximal removed runs of each text."""
    out = []
    for text, found in zip(texts, marks):
        kept, at, spans = [], 0, 0
        ranges = sorted((m["start"] + a, m["start"] + b) for m in found or () for a, b in zip(m["ranges"][::2], m["ranges"][1::2]))
        stop = -1
        for a, b in ranges:
            if a > stop:
                spans += 1
                kept.append(text[at:a])
            stop = at = max(stop, b)
        kept.append(text[at:] if spans else text)
        out.append((kept, len(text) - sum(map(len, kept)), spans))
    return out


def _results(batches):
    for batch in batches:
        texts = batch.column("t").to_pylist()
        done = _apply(texts, batch.column("marks").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64()), pa.array([hashlib.sha256(b"".join(k)).hexdigest() for k, _, _ in done], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeats(source: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """``source``: doc_id long, th long (a hash of the text), t binary. Returns
    doc_id, th, marks: the removed ranges of each text that has any."""
    chosen = source.select("doc_id", "th", "t").mapInArrow(_select(length, gram), "doc_id long, th long, gram long, seg long, start long, size int")
    chosen = written(chosen, "segments")
    # tables that a join meets are written before it: a hot k-gram can then be split
    again = written(chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "again")
    every, chosen = chosen, written(chosen.join(small(again), "gram"), "repeated")
    drop(every, again)
    place = F.struct("doc_id", "th", "start", "size")
    kinds = written(chosen.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "kinds")
    per = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    per = written(per.where("kinds > 1 and single > 0"), "grams")
    asked = kinds.join(small(per), "gram").select("gram", "seg", "n", "kinds", "place.*")
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "seg", "n", "start", "size")).alias("wanted"), F.sum("size").alias("bytes"))
    asked = written(asked, "asked")
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    pair = (asked["doc_id"].eqNullSafe(source["doc_id"])) & (asked["th"] == source["th"])
    contents = written(source.join(asked, pair).select("t", "wanted").mapInArrow(_cut, "gram long, seg long, n long, content binary"), "contents")
    crowded = small(written(per.where(F.col("kinds") > many).select("gram"), "crowded"))
    few, hot = contents.join(crowded, "gram", "left_anti"), contents.join(crowded, "gram", "left_semi")
    buckets = max(1, -(-int(total) // BUCKET))
    dealt = few.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).repartition(min(buckets, MOST_TASKS), "bucket")
    indexed = dealt.groupBy("bucket").applyInArrow(_index(length), "gram long, seg long, ranges array<int>")
    windows = hot.dropDuplicates(["gram", "seg"]).mapInArrow(_windows(length), "gram long, seg long, at int, win long")
    windows = written(windows, "windows")
    twice = written(windows.groupBy("gram", "win").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "win"), "twice")
    counted = windows.join(small(twice), ["gram", "win"]).groupBy("gram", "seg").agg(F.collect_list("at").alias("at")).select("gram", "seg", _covers(length)("at").alias("ranges"))
    whole = kinds.where("n > 1").select("gram", "seg", F.array(F.lit(0), F.col("place.size")).alias("ranges"))
    marks = whole.union(indexed).union(counted.join(kinds.where("n = 1").select("gram", "seg"), ["gram", "seg"], "left_semi"))
    marks = written(marks, "ranges")
    drop(asked, contents, kinds, per, windows, twice)
    marks = chosen.join(marks, ["gram", "seg"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "ranges")).alias("marks"))
    found = written(marks, "marks")
    drop(chosen)
    return found


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t")).select("doc_id", F.xxhash64("t").alias("th"), "t")


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another, is removed; all strings are judged on the
    input. Null counts as empty; texts below ``length`` lose nothing; repeated
    rows repeat each other and lose all their bytes; an empty table gives no rows;
    other columns are not looked at."""
    small_batches(docs.sparkSession)
    source = _source(docs, text, key)
    marks = repeats(source, length, gram, many)
    pair = source["doc_id"].eqNullSafe(marks["doc_id"]) & (source["th"] == marks["th"])
    joined = source.join(marks, pair, "left").select(source["doc_id"], "t", "marks")
    return joined.mapInArrow(_results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark, sf_dir):
    return removed(table(spark, sf_dir, "documents"))
