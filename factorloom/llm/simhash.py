"""SimHash near-duplicate detection by a self-join of a binary trie.

Every text gets a 64-bit fingerprint of its three-word shingles. The distinct
fingerprints form a binary trie; pairs of its nodes are walked together from
the top, the bits in which they differ are added up, and a pair of nodes is
dropped as soon as it differs in more than ``max_bits`` bits.

The tries are dealt out by their top bits. Two fingerprints that differ in
``max_bits`` bits are equal in one of ``max_bits + 1`` blocks of bits, so there is
a trie for each block, with that block on top, and only nodes of equal top bits
have to be walked together: a fingerprint goes to as many tasks as there are
blocks, whatever the corpus. A node that holds too many fingerprints is dealt
out again by the blocks of its other bits. A task walks its trie in blocks of
bounded size and passes on a spanning forest of its links, not the links
themselves, so a large group of copies costs as many rows as it has members.
Star contraction joins the forests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, table, utf8, written
from .components import components

BITS = 64
SEED = 42
#: Fingerprints below one node at which a task starts, about, and those at which
#: it is dealt out again.
NODE = 1 << 16
DENSE = 1 << 19
#: Pairs of fingerprints compared at once, and pairs of nodes walked at once.
BLOCK = 1 << 19
#: A pair of nodes with at most so many pairs of fingerprints is compared outright.
LEAF = 64


def fingerprint(text: bytes) -> int:
    """Fingerprint of UTF-8 bytes: A-Z lower-cased, words split at ASCII white
    space, shingles of three words joined by a space (fewer words: all of them;
    none: zero). A bit is set if it is set in over half of the XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    return print_of(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8"))


def print_of(hashed: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 14):
        bits = np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashed), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed 64 bits) of each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t")).mapInArrow(_fingerprints, "doc_id long, fp long")


class _Forest:
    """Union-find over positions; ``parent`` always points at roots."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n, dtype=np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[i], p[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(p, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(q := p[p], p):
                p[:] = q


def _zeros(values: np.ndarray, bit: int) -> np.ndarray:
    """Running counts of values whose ``bit`` is 0."""
    return np.concatenate([[0], np.cumsum(1 - ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))])


def links(values: np.ndarray, split: int, first: int, max_bits: int, spent: int, forest: _Forest) -> None:
    """Join in ``forest`` all positions of ``values`` that differ in at most
    ``max_bits`` bits. ``values[:split]`` and ``values[split:]`` are the sorted
    contents of two trie nodes whose next bit is ``first`` and whose prefixes
    differ in ``spent`` bits; ``split == 0``: one node with itself."""
    n = len(values)
    same = split == 0
    ups: dict[int, np.ndarray] = {}
    start = np.array([[0, n if same else split, 0 if same else split, n, spent]], dtype=np.int64)
    stack = [(first, start)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > BLOCK:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (few <= LEAF) | (bit < 0)
        _compare(values, pairs[leaf], few[leaf], max_bits, forest)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        if bit not in ups:
            ups[bit] = _zeros(values, bit)
        up = ups[bit]
        a, b, c, d, e = pairs.T
        m, k = a + up[b] - up[a], c + up[d] - up[c]
        other = ~((a == c) & (b == d))
        parts = [np.stack([a, m, c, k, e], 1), np.stack([m, b, k, d, e], 1), np.stack([a, m, k, d, e + 1], 1), np.stack([m, b, c, k, e + 1], 1)[other]]
        nxt = np.concatenate(parts)
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= max_bits)]
        if len(nxt):
            stack.append((bit - 1, nxt))


def _compare(values: np.ndarray, pairs: np.ndarray, few: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Compare the fingerprints below each pair of nodes, in blocks."""
    if not len(pairs):
        return
    ends = np.cumsum(few)
    at = 0
    while at < len(pairs):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block, size = pairs[at:to], few[at:to]
        at = to
        for lo in range(0, int(size.max()) if len(size) == 1 else 1, BLOCK):  # a single large pair of nodes goes in slices
            if len(size) == 1:
                which = np.zeros(min(BLOCK, int(size[0]) - lo), dtype=np.int64)
                off = np.arange(lo, lo + len(which))
            else:
                which = np.repeat(np.arange(len(size)), size)
                off = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            width = (block[:, 3] - block[:, 2])[which]
            i, j = block[which, 0] + off // width, block[which, 2] + off % width
            near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
            near &= i != j
            if near.any():
                forest.join(i[near], j[near])


def _walk(fixed: int, max_bits: int):
    def walk(group: pa.Table) -> pa.Table:
        """Links of the fingerprints below one node, ``fixed`` of whose bits are equal."""
        turned = group.column("p").to_numpy().view(np.uint64)
        order = np.argsort(turned)
        values, fps = turned[order], group.column("fp").to_numpy()[order]
        forest = _Forest(len(values))
        if len(values) > 1:
            links(values, 0, BITS - 1 - fixed, max_bits, 0, forest)
        moved = np.flatnonzero(forest.parent != np.arange(len(values)))
        return pa.table({"u": pa.array(fps[moved], pa.int64()), "v": pa.array(fps[forest.parent[moved]], pa.int64())})

    return walk


def _turned(fixed: int, max_bits: int) -> tuple[Column, int]:
    """(route, p) for each block of the bits below the ``fixed`` top ones of p: p with
    that block moved up behind them; and the bits of a block."""
    low = BITS - fixed
    wide = low // (max_bits + 1)
    mask = (1 << low) - 1
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    p = F.col("p")

    def turn(k: int) -> Column:
        if k == 0:
            return p
        rest = p.bitwiseAND(signed(mask))
        moved = F.shiftleft(rest, k).bitwiseOR(F.shiftrightunsigned(rest, low - k)).bitwiseAND(signed(mask))
        return p.bitwiseAND(signed(((1 << 64) - 1) ^ mask)).bitwiseOR(moved)

    return F.array(*[F.struct((F.col("route") * (max_bits + 1) + j).alias("route"), turn(j * wide).alias("p")) for j in range(max_bits + 1)]), wide


def near_links(distinct: DataFrame, max_bits: int = 3, node: int = NODE, dense: int = DENSE) -> DataFrame:
    """Edges u, v of a spanning forest of each task's links among the distinct
    fingerprints in column fp."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("route"), F.col("fp").alias("p"))
    n, fixed, out = distinct.count(), 0, None
    while n:
        blocks, wide = _turned(fixed, max_bits)
        if not wide:
            break
        fixed += min(wide, max(3, math.ceil(math.log2(n / node))))
        rows = rows.select("fp", F.explode(blocks).alias("b")).select("fp", "b.*").withColumn("node", F.shiftrightunsigned("p", BITS - fixed))
        crowded = written(rows.groupBy("route", "node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > dense), "crowded")
        n = crowded.agg(F.sum("c")).first()[0] or 0
        n = n if _turned(fixed, max_bits)[1] else 0  # too few bits are left to deal by
        light = rows.join(small(crowded.select("route", "node")), ["route", "node"], "left_anti") if n else rows
        found = light.groupBy("route", "node").applyInArrow(_walk(fixed, max_bits), "u long, v long")
        out = found if out is None else out.union(found)
        if n:
            rows = written(rows.join(small(crowded.select("route", "node")), ["route", "node"], "left_semi").select("fp", "route", "p"), "dense")
    return out if out is not None else distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows stay repeated; a null doc_id is kept and never the smallest, unless its
    component has no other; an empty table gives no rows. Other columns of
    ``docs`` are not looked at, whatever their names."""
    rows = written(fingerprints(docs, text, key), "fingerprints")
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fp")
    roots = components(near_links(firsts.select("fp"), max_bits))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owned = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(owned, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
