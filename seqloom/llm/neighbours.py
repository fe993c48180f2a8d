"""Approximate nearest neighbours by randomly rotated one-bit codes within coarse cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import staged, table

#: The index is fitted on at most so many rows and bytes of vectors; all rows are indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16_000_000
MAX_CELLS = 4096
CELL_ROWS = 4096
#: Least bits of a code: short vectors are turned several times, each time anew.
CODE_BITS = 256
#: Bits of a query's coordinate, and width of the error bounds in deviations of the estimate.
QUERY_BITS, EPSILON = 4, 3.0
#: Share of the nearest rows that must lie in the visited cells, as measured on the sample.
IN_CELLS = 0.97
_ASKED, _PAIRS = 64, 50_000


@dataclass(frozen=True)
class Codec:
    """Centres of the cells, random rotations side by side, and the sample with its ids."""

    centers: np.ndarray
    rotation: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centers**2).sum(axis=1) - 2 * x @ self.centers.T, axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the turned offsets from the centres, and two scalars: what a sum over the
        signs is multiplied by to estimate an inner product with the offset, and the deviation of
        that estimate for a query of length one."""
        offset = x - self.centers[cell]
        d, bits = self.rotation.shape
        turned = offset @ self.rotation
        length = np.maximum(np.sqrt((offset**2).sum(axis=1)), 1e-300)
        fit = np.maximum(np.abs(turned).sum(axis=1) / length / (bits / math.sqrt(d)), 1e-6)
        signs = np.where(turned > 0, 1.0, -1.0)
        # What the signs say of the space of the vectors; its part across the offset is the error.
        seen = ((signs @ self.rotation.T) ** 2).sum(axis=1) / (bits * bits / d)
        across = np.sqrt(np.maximum(seen - fit**2, 0)) / fit / math.sqrt(max(d - 1, 1))
        scale = length / fit / (bits / math.sqrt(d))
        pad = np.zeros((len(x), -bits % 64), bool)
        return np.packbits(np.hstack([turned > 0, pad]), axis=1, bitorder="little"), scale, length * across

    def planes(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Turned queries in steps: for each its bit planes as words, the least value, the size of a
        step, and the sum of all values."""
        turned = queries @ self.rotation
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        level = np.hstack([level, np.zeros((len(level), -level.shape[1] % 64), np.uint8)])
        words = [np.packbits(level >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(QUERY_BITS)]
        return np.stack(words), low, step, turned.sum(axis=1)

    def bounds(self, queries: np.ndarray, cell: int, words: np.ndarray, scale: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's inner products with the coded vectors, from the words of
        the codes: one AND and one count of bits for each word and plane."""
        planes, low, step, total = self.planes(queries)
        columns = np.ascontiguousarray(words.T)
        hits = np.zeros((len(queries), len(words)), np.uint32)
        ones = np.zeros(len(words), np.uint32)
        for w, column in enumerate(columns):
            ones += np.bitwise_count(column)
            for j in range(QUERY_BITS):
                hits += np.bitwise_count(column & planes[j, :, w, None]).astype(np.uint32) << np.uint32(j)
        # sum of sign * value = 2 * (sum of the values at set bits) - sum of all values
        guess = hits.astype(np.float32)
        guess *= (2 * step).astype(np.float32)[:, None]
        guess += (2 * low).astype(np.float32)[:, None] * ones.astype(np.float32)
        guess -= total.astype(np.float32)[:, None]
        guess *= scale.astype(np.float32)
        size = np.sqrt((queries**2).sum(axis=1)).astype(np.float32)
        guess += (EPSILON * size)[:, None] * slack.astype(np.float32)
        guess += (queries @ self.centers[cell]).astype(np.float32)[:, None]
        return guess

    def least_score(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best inner product of each query with the sample, without the query itself: no
        worse row can be among its k nearest."""
        if len(self.sample) <= k:
            return np.full(len(queries), -np.inf)
        out = []
        for a in range(0, len(queries), 256):
            score = queries[a : a + 256].astype(np.float32) @ self.sample.T
            score[ids[a : a + 256, None] == self.ids] = -np.inf
            out.append(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        size = np.sqrt((queries**2).sum(axis=1)) * np.sqrt((self.sample**2).sum(axis=1).max())
        return np.concatenate(out).astype(float) - 1e-5 * size if out else np.empty(0)

    def visits(self, k: int, n: int, asked: int = 500) -> int:
        """How many cells a query must visit to find ``IN_CELLS`` of its ``k`` nearest of ``n`` rows,
        measured with queries from the sample. The sample's nearest few stand for them: they
        are as far away as the ``k`` nearest of all."""
        cells, few = len(self.centers), max(1, math.ceil(k * len(self.sample) / n))
        if cells == 1 or len(self.sample) <= few:
            return cells
        x = self.sample[:asked].astype(float)
        score = x @ self.sample.T
        np.fill_diagonal(score, -np.inf)
        near = np.argpartition(-score, few - 1, axis=1)[:, :few]
        order = np.argsort(-(x @ self.centers.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(cells)[None, :], axis=1)
        found = np.take_along_axis(rank, self.cells(self.sample)[near], axis=1)
        return int(np.searchsorted(np.cumsum(np.bincount(found.ravel(), minlength=cells)), IN_CELLS * found.size) + 1)


def fit_codec(ids: np.ndarray, sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 10) -> Codec:
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    turns = max(1, math.ceil(CODE_BITS / d))
    rotation = np.hstack([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(turns)])
    different = np.unique(sample, axis=0).astype(float)
    centers = different[rng.permutation(len(different))[:cells]]
    for _ in range(rounds if len(centers) > 1 else 0):
        at = Codec(centers, rotation, ids, sample).cells(different)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, different)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return Codec(centers, rotation, ids, sample.astype(np.float32))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of rows that have an id and a vector that is neither null nor zero nor holds
    nulls or non-finite numbers. Of rows that repeat an id the greatest vector is used. Vectors of
    floats stay floats, others become doubles."""
    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def _stack(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float) if len(col) else np.empty((0, 1))


def _words(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(len(col), -1)


def _best(ids: np.ndarray, near: np.ndarray, score: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best pairs of each query; ties go to the smaller id."""
    order = np.lexsort((ids[near], -score, asked))
    rank = np.arange(len(order)) - np.searchsorted(asked[order], asked[order], "left")
    return order[rank < k]


def _search(shared, k: int):
    """Compares a block of queries with a block of one cell's vectors."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        codec, out = shared.value, []
        if len(queries) and len(block):
            ids, words = block.column("id").to_numpy(), _words(block.column("code"))
            x, cell = _stack(block.column("v")), block.column("cell")[0].as_py()
            scale, slack = block.column("scale").to_numpy(), block.column("slack").to_numpy()
            me, q, least = queries.column("id").to_numpy(), _stack(queries.column("v")), queries.column("least").to_numpy()
            for a in range(0, len(me), _ASKED):
                some = slice(a, a + _ASKED)
                high = codec.bounds(q[some], cell, words, scale, slack)
                asked, near = np.nonzero((high >= least[some, None]) & (me[some, None] != ids))
                asked += a
                score = np.concatenate([np.empty(0), *((q[asked[i : i + _PAIRS]] * x[near[i : i + _PAIRS]]).sum(axis=1) for i in range(0, len(near), _PAIRS))])
                best = _best(ids, near, score, asked, k)
                out.append((me[asked[best]], ids[near[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each query (a row whose id, a whole number, is divisible by ``query_every``) the ``k`` rows
    found with the largest inner product, without the row itself: ``query_id``, ``rank`` from 1,
    ``id``, ``score``.

    Every row is coded with one bit for each randomly turned dimension: the sign of its offset from
    the centre of its cell. A query visits the cells whose centres have the largest inner product
    with it, as many as the sample shows to be needed (see ``IN_CELLS``). There its inner products
    are estimated from the packed bits of the codes and two scalars a vector; only vectors whose
    upper bound reaches the k-th best score that the query has in the sample are computed in double
    precision. A query whose cells gave fewer than ``k`` rows is compared with all rows, without a
    bound, so each has ``k``, or all there are. Cells are cut into blocks of about ``cell_rows`` vectors and as many queries, so no
    task holds more, however alike the vectors are.

    Ties go to the smaller id. See :func:`usable` for rows that take no part; vectors of another
    length than most take none either. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col).withColumn("id", F.col("id").cast("long")), "vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    d, n = dims["d"], dims["count"]
    rows = rows.where(F.size("v") == d)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * d)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.col("v").cast("array<float>").alias("v")).toArrow()
    sample = _stack(chosen.column("v"))
    codec = fit_codec(chosen.column("id").to_numpy(), sample, max(1, min(MAX_CELLS, n // cell_rows, len(sample) // 8)))
    visits = codec.visits(k, n)
    shared = spark.sparkContext.broadcast(codec)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _stack(b.column("v"))
                cell = shared.value.cells(x)
                bits, scale, slack = shared.value.encode(x, cell)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(scale), pa.array(slack)], ["id", "v", "cell", "code", "scale", "slack"])

    coded = staged(rows.mapInArrow(code, T.StructType([*rows.schema.fields, *T._parse_datatype_string("cell int, code binary, scale double, slack double").fields])), "codes")

    # Cells and their rows: MAX_CELLS at most.
    sizes = np.zeros(len(codec.centers), np.int64)
    for r in coded.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]

    def probe(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _stack(b.column("v"))
                    least = np.full(len(x), -np.inf) if whole else shared.value.least_score(b.column("id").to_numpy(), x, k)
                    best = np.argsort(-(x @ shared.value.centers.T), axis=1, kind="stable")
                    # As many cells as are needed, but enough to hold k rows besides the query.
                    held = np.cumsum(sizes[best], axis=1)
                    many = np.full(len(x), len(sizes)) if whole else np.maximum(visits, (held < k + 1).sum(axis=1) + 1).clip(max=len(sizes))
                    at = pa.array(np.repeat(np.arange(len(x)), many))
                    cells = best[np.arange(len(sizes))[None, :] < many[:, None]]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(least).take(at), pa.array(cells, pa.int32())], ["id", "v", "least", "cell"])

        return run

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cell", "block", "turn"]

    def compared(queries: DataFrame, whole: bool) -> DataFrame:
        asked = queries.mapInArrow(probe(whole), T.StructType([*rows.schema.fields, *T._parse_datatype_string("least double, cell int").fields]))
        asked = staged(asked, "asked")
        parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("blocks"))
        parts = F.broadcast(parts.join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("turns")), "cell"))
        stored = coded.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("turn", numbers("turns")).drop("blocks", "turns")
        asked = asked.join(parts, "cell").withColumn("turn", F.pmod(F.xxhash64("id"), "turns").cast("int")).withColumn("block", numbers("blocks")).drop("blocks", "turns")
        found = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_search(shared, k), "query_id long, id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    queries = rows.where(F.col("id") % query_every == 0)
    found = staged(compared(queries, False), "found")
    # Queries whose cells gave too few are compared with all rows; there are few of them, if any.
    enough = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, n - 1)).select("id")
    short = staged(queries.join(enough, "id", "left_anti"), "short")
    if n == 1 or short.isEmpty():
        return found
    return found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(compared(short, True))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
