"""Exact dedup and SimHash near-dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerscope.llm import components, exact_dedup, simhash
from tests.conftest import SF_SMALL


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_exact(rows, best):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        ids = [x for x in own if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_matches_brute_force(odd_docs, clashing, no_docs):
    for df in (odd_docs, clashing):
        for keep, best in (("smallest", min), ("largest", max)):
            got = sorted(map(tuple, exact_dedup.dedup_exact(df, keep=keep).collect()), key=repr)
            assert got == brute_exact(pairs(df), best)
    assert exact_dedup.dedup_exact(no_docs).count() == 0


def test_exact_group_over_many_partitions(docs_of):
    """A group of most rows, and neighbours, over more partitions than texts."""
    rows = [(i, "Same") for i in range(500)] + [(1000 + i, f"sam{i % 7}") for i in range(60)] + [(2000, "samf"), (2001, "SAMe")]
    df = docs_of(rows, 5)
    got = exact_dedup.dedup_exact(df, keep="largest", partitions=23).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows, max)


def brute_fingerprint(text):
    words = lower(text).encode().split()
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))


def brute_components(points, distance=3):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    points = sorted(parent)
    for i, a in enumerate(points):
        for b in points[i + 1:]:
            if bin(a ^ b).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_fingerprint_and_components(spark, odd_docs, clashing, no_docs):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (odd_docs, clashing, small):
        rows = pairs(df)
        fps = [(i, brute_fingerprint(t)) for i, t in rows]
        root = brute_components([f for _, f in fps])
        low = {}
        for i, f in fps:
            if i is not None:
                low[root[f]] = min(i, low.get(root[f], i))
        want = sorted(((i, f"{f:016x}", low.get(root[f])) for i, f in fps), key=repr)
        got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_embedding_bounds_hamming_and_grids_hold_every_pair(spark):
    r = random.Random(5)
    points = [r.getrandbits(64) for _ in range(200)]
    points += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for p in points]
    signed = [simhash._signed(p) for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    e = {x.fp: x.e & (1 << 64) - 1 for x in df.select("fp", simhash.embed(F.col("fp")).alias("e")).collect()}
    counts = lambda p: [bin(p >> 2 * s & 3).count("1") for s in range(32)]
    masks = simhash.grids()
    for a, b in zip(points[:200], points[200:]):
        x, y = e[simhash._signed(a)], e[simhash._signed(b)]
        manhattan = sum(abs(i - j) for i, j in zip(counts(a), counts(b)))
        assert bin(x ^ y).count("1") == manhattan <= bin(a ^ b).count("1") <= 3
        assert any(x & m == y & m for m in masks)


def test_crowded_cells_lose_no_link(spark):
    """Many points round one centre, with blocks far smaller than the cells."""
    r = random.Random(9)
    points = {0} | {sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(400)}
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    links = simhash.near_links(df, block=16)
    assert links.count() < len(points) * 200
    got = {x.node: x.component for x in components.connected_components(links).collect()}
    want = brute_components(points)
    assert {p: got.get(p, p) for p in points} == want


def test_forest_links_are_few():
    near = np.arange(256, dtype=np.uint64)  # all within 8 bits, connected by single bits
    a, b = simhash.forest_links(near, near, 3)
    assert len(a) == len(near) - 1 == len(set(b.tolist()))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    long, rounds = [(i, i + 1) for i in range(1000)], []
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(long, "a long, b long"), rounds).collect()}
    assert got == {i: 0 for i in range(1001)} and len(rounds) < 12 and rounds == sorted(rounds, reverse=True)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates_keeps_one_of_each(clashing, odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = pairs(odd_docs)
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    got = [brute_fingerprint(t) for _, t in pairs(kept)]
    assert sorted(root[f] for f in got) == sorted(set(root.values()))
    ids = {i for i, _ in pairs(kept)}
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 6 in ids
    assert simhash.drop_near_duplicates(clashing).columns == clashing.columns
    assert simhash.drop_near_duplicates(no_docs).count() == 0
