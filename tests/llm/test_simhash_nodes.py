"""Dealing of tries to tasks, and fingerprints by other means."""

import random
import struct

import pytest
import xxhash

from factorloom.llm import simhash


def roots(values, edges):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("bits,node,dense", [(3, 1 << 16, 1 << 19), (3, 4, 40), (1, 8, 30), (0, 8, 20)])
def test_every_link_is_found_however_nodes_are_dealt(spark, bits, node, dense):
    rng = random.Random(bits + node)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):  # dense nodes: many fingerprints that differ in few bits
        c = rng.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
    values = sorted(struct.unpack("<q", struct.pack("<Q", v))[0] for v in values)
    got = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), bits, node, dense).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= bits
    want = roots(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if near(a, b)])
    assert roots(values, [(r.u, r.v) for r in got]) == want


def test_fingerprints_bit_by_bit():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 50, 40_000]:
        words = [rng.choice(["A", "Bc", "é", "Ä", "x\x85y", "\x1c"]) + str(rng.randint(0, 9)) for _ in range(n)]
        text = rng.choice([" ", "\t", "\n \x0b"]).join(words)
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        grams = [" ".join(low[i : i + 3]) for i in range(max(1, n - 2))] if n else []
        hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
        assert simhash.fingerprint(text.encode()) == want
