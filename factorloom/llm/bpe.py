"""Byte-level BPE encoding and decoding in padded numpy matrices.

The pieces that a text is split into are bucketed by length; a bucket is a
matrix of token ids with a row for each piece. In every round each row merges
its leftmost pair of least rank: the rank of a pair comes from a hash table over
pairs of ids, the merged rows close up by one column, and rows without a pair
left are taken out. A piece of over ``LONG`` bytes is a matrix of one row, in
which a round merges all places of the least pair, provided that no pair born
in the round could come before them; else it merges the leftmost alone.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
LONG = 64
#: Rows of one matrix.
ROWS = 1 << 15
#: Pieces whose ids a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000

#: The standard split for letters up to U+024F, where ``re`` and the general
#: pattern agree; a text with any other character takes the general pattern.
_NARROW = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WIDE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by id, of a rank file."""
    found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, data.splitlines()) if a}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class PairTable:
    """Open-addressing hash table from a pair of ids to the id they merge into."""

    def __init__(self, tokens: list[bytes]) -> None:
        ids = {t: i for i, t in enumerate(tokens) if t}
        keys, values = [], []
        for token, i in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        key, value = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        spot = self._spot(key)
        while len(key):
            free = self.keys[spot] == EMPTY
            self.keys[spot[free]] = key[free]
            won = self.keys[spot] == key
            self.values[spot[won]] = value[won]
            key, value, spot = key[~won], value[~won], spot[~won] + 1 & (1 << self.bits) - 1

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where a pair does not merge; negative ids
        are padding."""
        key = a.astype(np.int64).astype(np.uint64) << np.uint64(32) | b.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(key.shape, NONE, dtype=np.int32)
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        key = key.ravel()[left]
        spot = self._spot(key)
        flat = out.ravel()
        while len(left):
            there = self.keys[spot]
            hit = there == key
            flat[left[hit]] = self.values[spot[hit]]
            go = ~hit & (there != EMPTY)
            left, key, spot = left[go], key[go], spot[go] + 1 & (1 << self.bits) - 1
        return flat.reshape(out.shape)


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens, self.pairs = tokens, PairTable(tokens)
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.general = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return (self.general if _WIDE.search(text) else _NARROW).findall(text)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (one := self.whole.get(data)) is not None:
                self.known[piece] = one.to_bytes(4, "little")
            elif len(data) > LONG:
                self.known[piece] = self._merge_long(self.byte[np.frombuffer(data, np.uint8)]).astype("<u4").tobytes()
            else:
                buckets.setdefault(-(-len(data) // 8) * 8, []).append((piece, data))
        for width, rows in buckets.items():
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                flat = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(-1, width)
                size = np.array([len(d) for _, d in part])
                ids = np.where(np.arange(width) < size[:, None], self.byte[flat], -1).astype(np.int32)
                for (piece, _), done in zip(part, self._merge(ids)):
                    self.known[piece] = done

    def _merge(self, ids: np.ndarray) -> list[bytes]:
        out: list = [b""] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            spot = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), spot] if ranks.shape[1] else np.full(len(rows), NONE)
            live = least != NONE
            if not live.all():
                done = ids[~live]
                flat, step = done.astype("<u4").tobytes(), 4 * done.shape[1]
                for at, r, n in zip(range(0, len(flat), step), rows[~live].tolist(), (4 * (done >= 0).sum(axis=1)).tolist()):
                    out[r] = flat[at : at + n]
            rows, ids, ranks, spot, least = rows[live], ids[live], ranks[live], spot[live], least[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            ids[each, spot] = least
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > spot[:, None]), axis=1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols > spot[:, None]), axis=1)
            for near in (spot - 1, spot):  # the pairs on either side are new
                ok = (near >= 0) & (near < ids.shape[1] - 1)
                ranks[each[ok], near[ok]] = self.pairs.ranks(ids[each[ok], near[ok]], ids[each[ok], near[ok] + 1])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            spot = np.flatnonzero(ranks == least)
            start = np.r_[True, np.diff(spot) > 1]  # of pairs that overlap, every second one merges
            spot = spot[(np.arange(len(spot)) - np.maximum.accumulate(np.where(start, np.arange(len(spot)), 0))) % 2 == 0]
            new = self._replace(ids, spot, least)
            put = spot - np.arange(len(spot))
            born = [self.pairs.ranks(new[put[put > 0] - 1], new[put[put > 0]])]
            after = spot + 2 < len(ids)
            born.append(self.pairs.ranks(np.full(after.sum(), least), ids[spot[after] + 2]))
            born.append(self.pairs.ranks(new[put[put < len(new) - 1]], new[put[put < len(new) - 1] + 1]))
            if min(b.min(initial=NONE) for b in born) <= least:
                spot = spot[:1]
                new, put = self._replace(ids, spot, least), spot
            keep = np.ones(len(ranks), bool)
            keep[spot] = False
            ranks, ids = ranks[keep], new
            for near in (put - 1, put):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                ranks[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids

    @staticmethod
    def _replace(ids: np.ndarray, spot: np.ndarray, token: int) -> np.ndarray:
        keep = np.ones(len(ids), bool)
        keep[spot + 1] = False
        new = ids.copy()
        new[spot] = token
        return new[keep]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = list(map(self.split, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {p for pieces in split for p in pieces if p not in self.known}
        if new:
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, Bpe] = {}


def coder(data: bytes, pattern: str) -> Bpe:
    """The encoder of a rank file, made once in each process."""
    name = hashlib.sha256(data + pattern.encode()).hexdigest()
    if name not in _coders:
        _coders[name] = Bpe(read_ranks(data), pattern)
    return _coders[name]


def _default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _spread(spark, vocabulary: str | None, pattern: str | None):
    path, split = (vocabulary, pattern) if vocabulary and pattern else _default_vocabulary()
    with open(vocabulary or path, "rb") as file:
        return spark.sparkContext.broadcast(file.read()), pattern or split  # a rank file: under 1 MB


def encode(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with column ``out`` added (or replaced): the ids as array<int>;
    null and empty texts give an empty array. All rows, with repetitions, and all
    other columns stay."""
    small_batches(docs.sparkSession)
    ranks, split = _spread(docs.sparkSession, vocabulary, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        return pd.Series([np.frombuffer(x, "<i4") for x in coder(ranks.value, split).encode(texts.tolist())])

    return docs.withColumn(out, ids(F.coalesce(F.col(text).cast("string"), F.lit(""))))


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ranks, split, with_ids):
    def run(batches):
        bpe = coder(ranks.value, split)
        for batch in batches:
            encoded = bpe.encode(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, with the ids
    themselves as array<int> on request; null and empty texts have no tokens and
    the digest of nothing. Repeated rows repeat; other columns are not looked at."""
    small_batches(docs.sparkSession)
    ranks, split = _spread(docs.sparkSession, vocabulary, pattern)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return source.mapInArrow(_digests(ranks, split, with_ids), _RESULT + (", ids array<int>" if with_ids else ""))


def op3_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
