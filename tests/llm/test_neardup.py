import re

import numpy as np
import pytest
import xxhash

from seqloom.llm import neardup
from seqloom.llm.components import components
from seqloom.llm.neardup import fingerprint, links, near_duplicates, op2_simhash, segments


def slow(text, size=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b\x0bC d", "É é\x85x \xa0 y z w", "w " * 2000 + "x y z"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode(), 4) & (1 << 64) - 1 == slow(text)


def test_whole_table_by_brute_force(spark):
    got = op2_simhash(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = {i: slow(t) for i, t in texts.items()}
    ids = np.array(sorted(want))
    codes = np.array([want[i] for i in ids], np.uint64)
    edges = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4) if i < j]
    root = roots(ids, edges)
    assert len(edges) > 20
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (want[i], root[i]) for i in ids}


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_segments_find_every_pair(n):
    plan = segments(n, 4)
    assert sum(w for _, w, _ in segments(n, 4)) <= 64
    rng = np.random.default_rng(1)
    for _ in range(3000):
        bits = rng.choice(64, 4, replace=False)
        assert any(sum(s <= b < s + w for b in bits) <= r for s, w, r in plan)


@pytest.mark.parametrize("block", [50_000, 40])
def test_links_keep_connections(spark, block):
    rng = np.random.default_rng(3)
    center = rng.integers(-(2**62), 2**62, 12)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in center for _ in range(60)}
    values |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    want = roots(values, [(a, b) for a in values for b in values if a < b and near(a, b)])
    found = links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block).collect()
    assert all(near(r.u, r.v) for r in found)
    assert roots(values, [(r.u, r.v) for r in found]) == want


def test_crowded_bucket_is_streamed():
    fp = np.arange(1000, dtype=np.int64)
    u, v = neardup._bucket_links(np.zeros(1000, np.int64), fp, np.ones(1000, bool), 4)
    assert set(roots(fp.tolist(), zip(u.tolist(), v.tolist())).values()) == {0}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 5), (7, 7), (20, 21), (22, 21), (22, 23), (-1, 23), (20, 21)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e} - {7}
    assert got == {n: r for n, r in roots(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    long = "word " * 40_000
    rows = [(3, None, "a"), (2, "", "b"), (9, long, "c"), (8, long, "d"), (8, long, "d"), (None, "only here and there", "e"), (4, "Only here and there", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r.id), r.component_id) for r in near_duplicates(docs).collect())
    assert got == [("2", 2), ("3", 2), ("4", 4), ("8", 8), ("8", 8), ("9", 8), ("None", None)]
    assert near_duplicates(docs.limit(0)).count() == 0
