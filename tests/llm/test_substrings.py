import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import substrings
from seqloom.llm.substrings import op4_substrings, triggers, without_repeats


def slow(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            k = hash(t[p : p + length])
            seen[k] = seen.get(k, 0) + 1
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if seen[hash(t[p : p + length])] > 1:
                gone[p] += 1
                if p + length < len(gone):
                    gone[p + length] -= 1
        gone = (np.cumsum(gone) > 0)[: len(t)]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        yield len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_triggers_depend_on_the_string_alone():
    rnd = random.Random(1)
    a = bytes(rnd.choices(range(97, 101), k=600))
    shared = bytes(rnd.choices(range(97, 123), k=120))
    for length in (40, 100):
        x, y = a[:200] + shared + a[200:], a[300:333] + shared + b"zz"

        def of(t, length=length):
            at, first, last = triggers(t, length)
            assert (np.diff(at) > 0).all() and first[0] == 0 and last[-1] == len(t) - length
            return {p: int(c) for c, i, j in zip(at, first, last) for p in range(i, j + 1)}

        gx, gy = of(x), of(y)
        for p in range(len(shared) - length + 1):
            assert gx[200 + p] - 200 == gy[33 + p] - 33


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, slow([r.text.encode() for r in rows], 400))}
    found = op4_substrings(spark, sf).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in found}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5

    texts = [r.text.encode() for r in rows]
    repeated = {r.doc_id: (r.n_repeated, r.repeated) for r in found}
    for r, n in zip(rows, slow_passages(texts)):
        assert repeated[r.doc_id] == (n, n > 0)


def covered(texts, length):
    """For each text, runs of bytes that strings of this length cover which start elsewhere too."""
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        runs = []
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        yield runs


def slow_passages(texts, length=200, words=50):
    for t, runs in zip(texts, covered(texts, length)):
        places = [m.span() for m in re.finditer(rb"\S+", t)]
        yield sum(z - a for a, z in runs if sum(a <= i and j <= z for i, j in places) >= words)


def test_passages_shorter_than_what_is_removed(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 7)))
    shared = " ".join(word() for _ in range(55))
    assert 200 < len(shared) < 400
    texts = [" ".join([*(word() for _ in range(k)), shared, *(word() for _ in range(40))]) for k in (3, 90)]
    texts += [" ".join(word() for _ in range(200)), None, "", shared[:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in without_repeats(docs).collect()}
    want = list(slow_passages([(t or "").encode() for t in texts]))
    assert [got[i].n_repeated for i in range(len(texts))] == want and want[0] >= len(shared) and want[1] >= len(shared)
    assert sum(want[2:]) == 0 and all(got[i].n_removed == 0 for i in range(len(texts)))


def mess(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passages = [prose(n) for n in (5, 12, 25, 60, 200)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else prose(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 7))]
        t = list("".join(parts))
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[0]] * 3 + ["a" * 500, "a" * 90, "ab" * 300, "", None, "x" * 39, "\0" * 130 + prose(5), "\0" * 120]
    return texts


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"sort_bytes": 300}), (3, {"group_bytes": 200}), (4, {"sort_bytes": 1, "group_bytes": 900}), (5, {"crowd": 1}), (6, {"crowd": 3, "group_bytes": 300})])
def test_messy_texts(spark, seed, limits):
    for length in (40, 100):
        texts = mess(seed)
        docs = spark.createDataFrame([(i if i != 5 else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
        want = dict(zip([i if i != 5 else None for i in range(len(texts))], slow([(t or "").encode() for t in texts], length)))
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(docs, length=length, **limits).collect()}
        assert got == want


def test_small_groups_of_rows(spark, monkeypatch):
    """The streamed path for phrases of very many rows, within one process."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "GROUP_ROWS", 3)
    monkeypatch.setattr(substrings, "COMBINE_ROWS", 1)
    texts = [(t or "").encode() for t in mess(6)]
    length = 60
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int32()), pa.array([t], pa.binary())], ["h", "tag", "text"]) for i, t in enumerate(texts)]
    import pyarrow.compute as pc

    cut = pa.Table.from_batches(list(substrings._cut(length)(iter(batches)))).combine_chunks()
    cut = cut.take(pc.sort_indices(cut, [("e", "ascending"), ("c", "ascending")]))
    sifted = pa.Table.from_batches(list(substrings._sift(iter(cut.to_batches(max_chunksize=2))))).to_pylist()
    gone = {i: set() for i in range(len(texts))}
    rows = []
    for r in sifted:
        if r["kind"] == substrings._DONE:
            gone[r["h"]].update(range(r["place"] >> 32, (r["place"] & 0xFFFFFFFF) + 1))
        else:
            _, _, first, last = (int(x[0]) for x in substrings._unpack(np.array([r["place"]])))
            rows.append((r["e"], r["h"], r["place"], r["kind"] == substrings._SAMPLE, texts[r["h"]][first : last + length]))
    rows.sort(key=lambda r: r[0])
    row, start = substrings.repeated_starts(np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), [r[4] for r in rows], length)
    for i, p in zip(row, start):
        gone[rows[i][1]].add(int(p))
    for (i, starts), (_, removed, _, _) in zip(gone.items(), slow(texts, length)):
        assert len({b for p in starts for b in range(p, p + length)}) == removed


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(docs).count() == 0
