"""The training-data pipeline: bad documents go, then near copies and benchmark passages, secrets
are masked, and what is left is tokenised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.decontaminate import decontaminated
from seqloom.llm.nearcopies import near_copies
from seqloom.llm.quality import good_documents
from seqloom.llm.secrets import mask_secrets
from seqloom.llm.tables import shared_dir, shuffles_dropped, staged, table
from seqloom.llm.tokenise import default_model, digests
from seqloom.llm.urls import sifted

#: Words in a shingle, and the least similarity of the shingle sets of near copies.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts. Null and empty texts have a score too."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, which share
    ``SIMILARITY`` of their shingles at least. Of repeated rows one stays; rows of different texts
    are not repeated, even if they share an id. Rows without id belong to no group and all stay."""
    key = ["id", "text_key"]
    with shuffles_dropped(spark):
        found = staged(near_copies(docs, size=SHINGLE, similarity=SIMILARITY), "near-copies")
        first = found.groupBy("component").agg(F.min(F.struct(*key)).alias("at")).select("at.*", F.lit(True).alias("stays"))
        known = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(first, key, "left")
        doubt = staged(known.where("stays IS NULL OR n > 1").select(*key, F.coalesce("stays", F.lit(False)).alias("stays")), "doubt")
        # Most rows are alone in their group; only others are shuffled with their texts.
        rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        rows = sifted(rows, doubt, key)
    kept = rows.where("_passes").join(doubt, key, "left").where("stays IS NULL OR stays").dropDuplicates(key).select("row").unionAll(rows.where("NOT _passes").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionAll(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold ten words in a row of a benchmark item, or a whole shorter one."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets that look live and that few owners have; all documents stay."""
    out = mask_secrets(docs, repo_cols=["lang"])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them."""
    return digests(docs, default_model()).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokenise", tokenise),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/seqloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
