"""Document quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import spread, table, text_batches

THRESHOLD = 0.7
#: Weight of the spherical part in each class covariance, and scale of the log-density difference.
SHRINKAGE, TEMPERATURE = 0.05, 1.0
#: Ratios count as if so many words (or bytes) of ordinary text were there too.
PRIOR_WORDS = 4
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _LOUD, _SIGN = range(8)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = _LOWER
_KIND[range(65, 91)] = _UPPER
_KIND[range(48, 58)] = _DIGIT
_KIND[[9, 11, 12, 32]] = _SPACE
_KIND[[10, 13]] = _LINE
_KIND[list(b".,;:'\"-()")] = _POINT
_KIND[list(b"?!")] = _LOUD
FEATURES = 16
#: The model is fitted on the texts of at most so many labelled ids.
FIT_LABELS = 20_000


def statistics(text: bytes | None) -> np.ndarray:
    """Transformed statistics of one whole text: sizes as logarithms, ratios as square roots."""
    raw = np.frombuffer(text or b"", np.uint8)
    n = len(raw)
    count = np.bincount(raw, minlength=256)
    kind = _KIND[raw]
    share = np.bincount(kind, minlength=8)
    inside = (kind != _SPACE) & (kind != _LINE)
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    stops = np.flatnonzero(inside & ~np.r_[inside[1:], False])
    words, m = (text or b"").lower().split(), len(starts)
    seen = Counter(words)
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    if m:
        per_word = lambda flag: np.add.reduceat(flag, starts)
        odd = np.count_nonzero(per_word((kind == _SIGN) | (kind == _DIGIT) | (kind == _LOUD)))
        upper, lower = per_word(kind == _UPPER), per_word(kind == _LOWER)
        loud = np.count_nonzero((upper > 1) & ~lower)
        ends = np.count_nonzero(kind[stops] == _POINT)
    else:
        odd = loud = ends = 0
    p = count[count > 0] / max(n, 1)
    soft, signs = m + PRIOR_WORDS, n + 6 * PRIOR_WORDS
    return np.array(
        [
            np.log1p(m),
            np.log((n + 6 * PRIOR_WORDS) / soft),
            np.sqrt((share[_UPPER] + 0.5) / signs),
            np.sqrt(share[_DIGIT] / signs),
            np.sqrt((share[_POINT] + 0.5) / signs),
            np.sqrt(share[_LOUD] / signs),
            np.sqrt(share[_SIGN] / signs),
            np.log((len(seen) + PRIOR_WORDS) / soft),
            np.sqrt(max(seen.values(), default=0) / soft),
            np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 1)),
            np.log(soft / (len(lines) + 1)),
            -float((p * np.log(p)).sum()),
            np.sqrt(odd / soft),
            np.sqrt((ends + 0.5) / soft),
            np.sqrt(loud / soft),
            np.sqrt(sum(map(operator.eq, words, words[1:])) / soft),
        ]
    )


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts]).reshape(-1, FEATURES)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors of the shrunken covariances, and log weights of the classes
    0 and 1, over standardised features. ``constant`` is the score if a class had no rows."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        logs = []
        for mean, inverse, weight in zip(self.means, self.inverses, self.weights, strict=True):
            d = (z - mean) @ inverse.T  # its squared length is the Mahalanobis distance
            logs.append(weight + np.log(np.diag(inverse)).sum() - 0.5 * (d * d).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -30, 30)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """The model of two classes from their numbers of rows, sums and sums of outer products."""
    total = n.sum()
    if not n.all():
        return Discriminant(np.zeros(FEATURES), np.ones(FEATURES), constant=float(n[1] / total) if total else 0.5)
    center = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / total - center**2, 0)) + 1e-6
    means, inverses, weights = [], [], []
    for k in range(2):
        mean = sums[k] / n[k]
        cov = (products[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / FEATURES, 1e-3) * np.eye(FEATURES)
        means.append((mean - center) / scale)
        inverses.append(np.linalg.inv(np.linalg.cholesky(cov)))
        weights.append(float(np.log(n[k] / total)))
    return Discriminant(center, scale, tuple(means), tuple(inverses), tuple(weights))


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = SHRINKAGE, sample: int = FIT_LABELS) -> Discriminant:
    """Learns from the texts of ids with a label that are not held out: of ``sample`` of them at most,
    those with the smallest hashes. Labels that repeat or disagree count once, by the lowest; null
    ones not at all. The labels travel to the documents, and tasks send sums only."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("long").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for b in batches:
            x, y = _matrix(b.column("text")), b.column("label").to_numpy()
            for k in range(2):
                part = x[y == k]
                total[k] += np.r_[len(part), part.sum(axis=0), (part.T @ part).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    text_batches(docs.sparkSession)
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))
    rows = texts.join(F.broadcast(known), "id").select("text", "label").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for r in rows:
        total.ravel()[r["at"]] = r["value"]
    return discriminant(total[:, 0], total[:, 1 : 1 + FEATURES], total[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES), shrinkage)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``held_out``, ``score`` (0 to 1, higher for label 1) and ``predicted`` of every row.

    Scores depend on texts alone. Null texts count as empty and have a score like any other. Rows
    with a null or repeated id are scored too. Without labels all scores are 0.5; with labels of
    one class all are that class. Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.scores(_matrix(b.column("text"))))], ["id", "score"])

    scored = texts.mapInArrow(run, T.StructType([texts.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, whole and without a shuffle. Null texts
    are scored as empty ones, and rows with a null or repeated id like any other; columns may have
    any names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = shared.value.scores(_matrix(b.column(text_col).cast(pa.binary()))) >= threshold
            yield b.filter(pa.array(keep))

    return spread(docs).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
