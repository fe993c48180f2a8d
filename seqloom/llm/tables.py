"""Reading inputs and writing intermediate tables to the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A folder of our own is used only where that
    setting is empty and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="seqloom-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps then neither recompute it
    nor depend on the executors that made it. The files stay until the folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/seqloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends, so that steps that are ``staged`` one after
    the other need the disk of one; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: Column) -> Column:
    """A digest of some columns; rows that agree in all of them share it. Nulls and empty
    strings differ."""
    parts = [F.coalesce(F.concat(F.lit("1"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("0")) for c in cols]
    return F.md5(F.concat(*parts))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many rows travel to Python at once: texts may be long, and ten thousand of
    them, Spark's default, need not fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it has fewer partitions than there are, as one small file
    has; else as it is. Work on whole texts is then never left to a few tasks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
