import hashlib
import random

from seqloom.llm import chunks
from seqloom.llm.chunks import chunk_dedup, cuts, op3_chunks


def slow(docs, min_words=16):
    parts = {}
    for i, (d, t) in enumerate(docs):
        ends = cuts(t)
        parts[i] = list(zip([0, *ends[:-1]], ends))
    where = {}
    for i, (d, t) in sorted(enumerate(docs), key=lambda x: x[1][0]):
        for a, z in parts[i]:
            where.setdefault(t[a:z], []).append((d, i, a))
    for i, (d, t) in enumerate(docs):
        runs = []
        for a, z in parts[i]:
            if len(where[t[a:z]]) > 1:
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], z)
                else:
                    runs.append((a, z))
        passages = [r for r in runs if len(t[r[0] : r[1]].split()) >= min_words]
        kept = b"".join(t[a:z] for a, z in parts[i] if where[t[a:z]][0] == (d, i, a) or not any(p <= a and z <= q for p, q in passages))
        yield d, len(t), sum(q - p for p, q in passages), len(t) - len(kept), len(passages), hashlib.sha256(kept).hexdigest()


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghé", k=rnd.randrange(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(n) for n in (55, 80, 200, 10)]
    out = []
    for i in range(80):
        out.append((i, " ".join(rnd.choice([*shared, prose(60), prose(60)]) for _ in range(rnd.randrange(1, 5)))))
    return out + [(100, ""), (101, "a" * 5000), (102, "x")], shared


def test_cuts_resist_insertions():
    docs, _ = texts()
    t = docs[0][1].encode() + docs[1][1].encode()
    a = {t[i:j] for i, j in zip([0, *cuts(t)], cuts(t))}
    u = t[:100] + b"INSERTED" + t[100:]
    b = {u[i:j] for i, j in zip([0, *cuts(u)], cuts(u))}
    assert len(b - a) <= 6 and cuts(b"") == [] and b"".join(u[i:j] for i, j in zip([0, *cuts(u)], cuts(u))) == u
    assert all(j - i <= 256 for i, j in zip([0, *cuts(u)], cuts(u)))


def test_brute_force(spark, monkeypatch):
    docs, shared = texts()
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in chunk_dedup(table).collect()}
    assert {d: (r.doc_id, r.n_bytes, r.n_repeated, r.n_removed, r.n_passages, r.kept_sha256) for d, r in got.items()} == {w[0]: w for w in slow([(d, t.encode()) for d, t in docs])}
    for d, t in docs:
        if any(s in t for s in shared[:3]):
            assert got[d].n_passages > 0, d


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in op3_chunks(spark, sf).collect()}
    for w in slow([(r.doc_id, r.text.encode()) for r in rows]):
        r = got[w[0]]
        assert (r.doc_id, r.n_bytes, r.n_repeated, r.n_removed, r.n_passages, r.kept_sha256) == w


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (1, None), (2, ""), (None, long), (3, long), (3, long), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_passages) for r in chunk_dedup(docs).collect())
    n = len(long)
    assert got == [("1", 0, 0, 0), ("1", 0, 0, 0), ("2", 0, 0, 0), ("3", n, n, 1), ("3", n, n, 1), ("4", 10, 0, 0), ("None", n, 0, 1)]
    assert chunk_dedup(docs.limit(0)).count() == 0


def test_rows_repeated_without_an_id(spark):
    """Their chunks are one set, however many rows there are; each row has its own result."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen " * 3
    docs = spark.createDataFrame([(None, text)] * 500 + [(1, "short text")], "doc_id long, text string")
    got = chunk_dedup(docs).collect()
    assert len(got) == 501 and len({str(r) for r in got if r.doc_id is None}) == 1
