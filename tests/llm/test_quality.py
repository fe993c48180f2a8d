import re
import zlib
from collections import Counter

import numpy as np

from seqloom.llm.quality import FEATURES, discriminant, good_documents, op5_quality, score_documents, statistics


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op5_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in test]) > 0.98
    assert np.mean([b for a, b in test if a]) > 0.99


def test_log_density_by_hand():
    rng = np.random.default_rng(2)
    parts = [rng.normal(k, 1 + k, (400, FEATURES)) for k in range(2)]
    model = discriminant(np.array([400, 400]), np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts]), shrinkage=0.0)
    x = rng.normal(size=(5, FEATURES))
    logs = []
    for p in parts:
        cov, d = np.cov(p.T, bias=True), x - p.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    assert np.allclose(model.scores(x), want, atol=1e-4)


def test_edges(spark):
    rows = [(i, f"Good plain text number {'x' * i}. It goes on.", "k") for i in range(60)] + [(100 + i, "## $$ %% ## " * (i + 1), "k") for i in range(60)]
    rows += [(None, None, None), (200, "", "k"), (200, "", "k"), (201, "w " * 50_000, "k"), (202, "é\x00😀", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(60), *range(100, 160)]] + [(1, 1), (2, None)], "doc_id long, quality int")
    got = score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.id: r.predicted for r in got}[3] == 1 and {r.id: r.predicted for r in got}[103] == 0
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and 3 in {r.doc_id for r in kept.collect()}
    assert {r.score for r in score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in score_documents(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert score_documents(docs.limit(0), labels).count() == 0
    assert np.isfinite(statistics(b"")).all()


def plain_statistics(text):
    """The features in words: from single characters, lines and words."""
    text = text or ""
    raw = text.encode()
    kind = lambda b: "lower" if 97 <= b <= 122 or b >= 128 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "space" if b in (9, 11, 12, 32) else "line" if b in (10, 13) else "point" if chr(b) in ".,;:'\"-()" else "loud" if chr(b) in "?!" else "sign"
    share = Counter(map(kind, raw))
    words = [w for w in re.split(rb"[\t\n\x0b\x0c\r ]+", raw) if w]
    n, m = len(raw), len(words)
    low = [w.lower() for w in words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    soft, signs = m + 4, n + 24
    odd = sum(any(kind(b) in ("sign", "digit", "loud") for b in w) for w in words)
    loud = sum(sum(kind(b) == "upper" for b in w) > 1 and not any(kind(b) == "lower" for b in w) for w in words)
    ends = sum(kind(w[-1]) == "point" for w in words)
    entropy = -sum(c / n * np.log(c / n) for c in Counter(raw).values()) if n else 0.0
    most = max(Counter(low).values(), default=0)
    twins = sum(a == b for a, b in zip(low, low[1:]))
    return [np.log1p(m), np.log(signs / soft), np.sqrt((share["upper"] + 0.5) / signs), np.sqrt(share["digit"] / signs), np.sqrt((share["point"] + 0.5) / signs), np.sqrt(share["loud"] / signs), np.sqrt(share["sign"] / signs), np.log((len(set(low)) + 4) / soft), np.sqrt(most / soft), np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 1)), np.log(soft / (len(lines) + 1)), entropy, np.sqrt(odd / soft), np.sqrt((ends + 0.5) / soft), np.sqrt(loud / soft), np.sqrt(twins / soft)]


def test_whole_query_against_a_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = np.array([plain_statistics(r.text) for r in rows])
    out = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows])
    y = np.array([label.get(r.doc_id, -1) for r in rows])
    fit = ~out & (y >= 0)
    center, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z, logs = (x - center) / scale, []
    for k in range(2):
        part = z[fit & (y == k)]
        cov = 0.95 * np.cov(part.T, bias=True)
        cov += 0.05 * np.trace(cov / 0.95) / FEATURES * np.eye(FEATURES)
        d = z - part.mean(axis=0)
        logs.append(np.log(len(part) / fit.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    score = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    got = {r.doc_id: r for r in op5_quality(spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    for r, s, h in zip(rows, score, out):
        g = got[r.doc_id]
        assert abs(g.score - s) < 1e-6 and g.held_out == h and g.predicted == (g.score >= 0.7)
