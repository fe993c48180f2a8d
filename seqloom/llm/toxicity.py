"""Toxicity by a classifier chain of sparse linear models over words and word stems."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import held_out
from .tables import spread, staged, table, text_batches

WORD = re.compile(rb"[a-z\x80-\xff]+")
STEMS = (4, 5, 6, 7)
#: Bounds of the sample of labelled rows that training uses, and of the features that it selects.
SAMPLE_LABELS, FEATURES = 20_000, 512
MIN_ROWS = 4
FOLDS = 4
PENALTY, ROUNDS = 3e-3, 300
#: Columns are divided by their deviation, but by no less than this.
LEAST_SPREAD = 0.1
THRESHOLD = 0.4
_MEMO = 300_000


def codes_of(word: bytes) -> list[int]:
    """Signed 64-bit codes of a word and its stems."""
    parts = [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]
    return [c - (1 << 64) if (c := xxhash.xxh3_64_intdigest(p)) >> 63 else c for p in parts]


def words_of(text: bytes | None) -> set[bytes]:
    return set(WORD.findall((text or b"").lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def linear_model(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty, the last one the intercept, by
    accelerated gradient steps."""
    n, d = x.shape
    center, spread = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SPREAD).astype(x.dtype)
    x = (x - center) / spread
    w, ahead = np.zeros(d + 1), np.zeros(d + 1)
    # The largest curvature, by a few power steps, sets the step size. Vectors take the type of x,
    # or each product would copy it.
    v, norm = np.ones(d, x.dtype), 1.0
    for _ in range(8):
        v = x.T @ (x @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (0.25 * (norm / n + 1) + penalty)
    for k in range(rounds):
        error = _sigmoid(x @ ahead[:-1].astype(x.dtype) + ahead[-1]) - y
        grad = np.r_[x.T @ error.astype(x.dtype) / n + penalty * ahead[:-1], error.mean()]
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    w = w / np.r_[spread, 1.0]
    w[-1] -= w[:-1] @ center
    return w


@dataclass
class Chain:
    """Features and, for each category in order, weights of the features, of the log-odds of the
    categories before it, and the intercept."""

    categories: list[str]
    features: list[int]
    weights: list[np.ndarray]
    memo: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.index = {c: i for i, c in enumerate(self.features)}

    def _columns(self, word: bytes) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(self.index[c] for c in codes_of(word) if c in self.index)
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def columns(self, text: bytes | None) -> list[int]:
        return sorted({c for w in words_of(text) for c in self._columns(w)})

    def probabilities(self, columns: Sequence[int]) -> list[float]:
        at, odds = list(columns), []
        n = len(self.features)
        for w in self.weights:
            odds.append(float(w[at].sum() + w[n:-1] @ np.array(odds) + w[-1]))
        return _sigmoid(np.array(odds)).tolist()


def fit_chain(categories: list[str], features: list[int], rows: list[list[int]], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Trains the models in order. What a later model sees of an earlier one in training are
    predictions for rows that the earlier one, fitted without their fold, did not see."""
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, cols in enumerate(rows):
        x[i, cols] = 1
    weights, earlier = [], np.zeros((len(rows), 0), np.float32)
    for k in range(len(categories)):
        z, y = np.hstack([x, earlier]), labels[:, k]
        weights.append(linear_model(z, y))
        if k + 1 < len(categories):
            out = np.zeros(len(y))
            for f in range(FOLDS):
                w = linear_model(z[folds != f], y[folds != f]) if (folds != f).any() else weights[-1]
                out[folds == f] = np.clip(z[folds == f] @ w[:-1] + w[-1], -30, 30)
            earlier = np.hstack([earlier, out[:, None].astype(np.float32)])
    return Chain(categories, features, weights)


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_LABELS, features: int = FEATURES) -> Chain:
    """Fits a chain on at most ``sample`` labelled rows, those with the smallest hashes, none of them
    held out. The sample travels to the documents, not the documents to it. Of texts that share an id
    one is used. Features are the words and stems that tell a category best; they are counted on
    the executors."""
    text_batches(docs.sparkSession)
    categories = list(categories)
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    known = known.dropna(subset=categories).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))).join(F.broadcast(known), "id")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list({c for w in words_of(t.as_py()) for c in codes_of(w)}) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fold"), b.column("labels"), pa.array([sorted(c) for c in found], pa.list_(pa.int64()))], ["id", "fold", "labels", "codes"])

    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int")
    kind = T.StructType([texts.schema["id"], *T._parse_datatype_string("fold int, labels array<int>, codes array<long>").fields])
    rows = texts.select("id", "text", fold.alias("fold"), F.array(*[F.col(f"`{c}`") for c in categories]).alias("labels")).mapInArrow(coded, kind)
    # An id is one row of the sample, however many texts have it.
    rows = rows.groupBy("id", "fold", "labels").agg(F.min("codes").alias("codes"))
    rows = staged(rows.select("fold", *[F.col("labels")[k].alias(f"y{k}") for k in range(len(categories))], "codes"), "sample")
    names, columns = list(categories), [f"y{k}" for k in range(len(categories))]
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]).first()
    if not totals["n"]:
        return Chain(names, [], [np.zeros(1 + k) for k in range(len(names))])
    counts = rows.select(*columns, F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])
    score = F.lit(0.0)
    for c in columns:  # how far from chance the feature and the category meet
        share = totals[c] / totals["n"]
        deviation = F.sqrt(F.col("n") * (share * (1 - share)) + 1.0)
        score = F.greatest(score, F.abs(F.col(c) - F.col("n") * share) / deviation)
    chosen = [r["code"] for r in counts.where(F.col("n") >= MIN_ROWS).orderBy(score.desc(), "code").limit(features).collect()]
    index = F.array(*[F.lit(c) for c in chosen]) if chosen else F.array().cast("array<long>")
    sampled = rows.select("fold", *columns, F.array_intersect("codes", index).alias("codes")).collect()
    at = {c: i for i, c in enumerate(chosen)}
    return fit_chain(names, chosen, [[at[c] for c in r["codes"]] for r in sampled], np.array([[r[c] for c in columns] for r in sampled], float), np.array([r["fold"] for r in sampled]))


def score_toxicity(docs: DataFrame, chain: Chain, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``p_<category>`` and ``is_<category>`` for each category to every row, from the whole text.

    Null texts count as empty. Repeated rows stay; columns with these names are replaced, all others
    kept, whatever their names. Without training rows every probability is 0.5.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    new = [f"p_{c}" for c in chain.categories]
    flags = [f"is_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in (*new, *flags)]
    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = shared.value
            p = [model.probabilities(model.columns(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p, pa.list_(pa.float64()))], ["row", "p"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("p", T.ArrayType(T.DoubleType()))]))
    score = [F.col("p")[k] for k in range(len(new))]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[x.alias(c) for x, c in zip(score, new, strict=True)], *[(x >= threshold).cast("int").alias(c) for x, c in zip(score, flags, strict=True)])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels tell toxic documents from others, but no kinds of toxicity. So the chain has the two
    categories that they do name: low quality, which comes first, and toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic"))
    found = score_toxicity(docs, train(docs, labels, ["junk", "toxic"]))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_junk", F.col("p_toxic").alias("score"), F.col("is_toxic").alias("predicted"))
