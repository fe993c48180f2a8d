import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from seqloom.llm.toxicity import fit_chain, linear_model, op7_toxicity, score_toxicity, train


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op7_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    test = np.array([(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels])
    found, clean = test[test[:, 0] == 1][:, 1].mean(), 1 - test[test[:, 0] == 0][:, 1].mean()
    print("found", found, "clean kept", clean)
    assert found > 0.88 and clean > 0.995


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    n = 2000
    rows = [sorted(rng.choice(6, rng.integers(0, 4), replace=False)) for _ in range(n)]
    first = np.array([(0 in r) or (1 in r) for r in rows], float)
    second = first * np.array([2 in r for r in rows])
    chain = fit_chain(["a", "b"], [10, 11, 12, 13, 14, 15], rows, np.column_stack([first, second]), np.arange(n) % 4)
    assert len(chain.weights[1]) == 8 and chain.weights[1][6] > 0
    p = np.array([chain.probabilities(r) for r in rows])
    assert ((p[:, 0] > 0.5) == first).mean() > 0.95 and ((p[:, 1] > 0.5) == second).mean() > 0.95


def test_linear_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.5)))).astype(float)
    assert np.allclose(linear_model(x, y, penalty=1e-6), [1, -2, 0, 0.5], atol=0.25)


def test_edges(spark):
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} number w{i}", "k") for i in range(90)] + [(None, None, "k"), (91, "", "k"), (91, "", "k"), (92, "idiot " * 50_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.is_toxic for r in score_toxicity(docs, train(docs, labels, ["toxic"])).collect()}
    assert got[3] == 1 and got[4] == 0 and got[92] == 1
    none = score_toxicity(docs, train(docs, labels.limit(0), ["toxic"])).collect()
    assert len(none) == len(rows) and {r.p_toxic for r in none} == {0.5}
    assert score_toxicity(docs.limit(0), train(docs.limit(0), labels, ["toxic"])).count() == 0


def test_whole_query_against_a_plain_version(spark, sf):
    """Words, counts, features, folds and scores by single rows; the linear models are the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    label = {r.doc_id: (1 - r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    crc = lambda t: zlib.crc32(t.encode())
    parts = {}
    for d in docs:
        words = set(re.findall("[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or "")))
        words = {w.encode() for w in words}
        parts[d.doc_id] = words | {w[:n] + b"*" for w in words for n in (4, 5, 6, 7) if len(w) > n}
    known = [d.doc_id for d in docs if d.doc_id in label and crc(str(d.doc_id)) % 4 != 2]
    y = np.array([label[i] for i in known], float)
    count = Counter(p for i in known for p in parts[i])
    hits = [Counter(p for i in known if label[i][k] for p in parts[i]) for k in range(2)]
    share = y.mean(axis=0)
    best = lambda p: max(abs(hits[k][p] - count[p] * share[k]) / np.sqrt(count[p] * (share[k] * (1 - share[k])) + 1.0) for k in range(2))
    code = lambda p: (c := xxhash.xxh3_64_intdigest(p)) - ((c >> 63) << 64)
    chosen = sorted((p for p in count if count[p] >= 4), key=lambda p: (-best(p), code(p)))[:512]
    at = {p: k for k, p in enumerate(chosen)}
    cols = lambda i: sorted(at[p] for p in parts[i] if p in at)
    chain = fit_chain(["junk", "toxic"], list(range(len(chosen))), [cols(i) for i in known], y, np.array([crc(f"fold{i}") % 4 for i in known]))
    got = {r.doc_id: r for r in op7_toxicity(spark, sf).collect()}
    assert len(got) == len(docs) and len(known) > 20
    for d in docs:
        p = chain.probabilities(cols(d.doc_id))
        assert abs(got[d.doc_id].p_junk - p[0]) < 1e-3 and abs(got[d.doc_id].score - p[1]) < 1e-3


def test_texts_that_share_an_id(spark):
    """One row of the sample, however many texts have the id."""
    rows = [(1, f"idiot {'w' * (i % 9 + 1)}") for i in range(300)] + [(i, f"{'idiot' if i % 2 else 'friend'} n{i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    got = score_toxicity(docs, train(docs, labels, ["toxic"])).collect()
    assert len(got) == len(rows) and {r.is_toxic for r in got if "idiot" in r.text} == {1}
