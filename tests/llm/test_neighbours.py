import numpy as np
import pytest

from seqloom.llm.neighbours import nearest, op8_nearest


def slow(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            out[i] = [j for j in (int(ids[j]) for j in np.lexsort((ids, -s))) if j != i][:k]
    return out


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_recall_on_the_table(spark, cell_rows):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = slow(ids, x)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in nearest(table, cell_rows=cell_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
        q = x[ids == r.query_id][0]
        assert abs(r.score - (x[ids == r.id][0] * q).sum()) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= (0.999 if cell_rows == 4096 else 0.9)


def test_edges(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(i, one.tolist(), "a") for i in range(300)] + [(400 + i, rng.normal(size=8).tolist(), "b") for i in range(50)]
    rows += [(1000, None, None), (1020, [0.0] * 8, "c"), (1040, [float("nan")] * 8, "c"), (1060, [1.0, None] * 4, "c"), (1080, [float("inf")] + [1.0] * 7, "c"), (1100, [], "c"), (1120, [1.0], "c"), (None, one.tolist(), "c"), (20, one.tolist(), "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    x = {r[0]: np.array(r[1]) for r in rows[:350]}
    want = slow(np.array(list(x)), np.array(list(x.values())))
    got = {}
    for r in nearest(table, cell_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got.keys() == want.keys()
    assert all(got[q] == want[q] for q in want if q < 300)  # ties by id, the group over several blocks
    few = nearest(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank, r.id) for r in few] == [(0, 1, 1), (0, 2, 2)]
    assert nearest(table.limit(0)).count() == 0
    assert op8_nearest(spark, "/root/testdata/sf0.001").columns == ["query_id", "rank", "vec_id", "score"]


def test_cells_of_few_rows_give_k_all_the_same(spark):
    """Groups smaller than k, in cells as small: every query has k neighbours, and the right ones."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(150, 16)) * rng.uniform(0.2, 4, size=(150, 1))
    x = (np.repeat(centers, 15, axis=0) + rng.normal(size=(2250, 16)) * 0.01).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = nearest(df, cell_rows=15).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == set(range(0, 2250, 20)) and {len(v) for v in got.values()} == {20}
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(got[q]) & set(best[q].tolist())) / 20 for q in got]) > 0.9
