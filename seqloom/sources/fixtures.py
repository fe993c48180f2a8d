"""Views over the given tables that stand in for frames, cells, timelines, tracks and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import over

SIDE = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("label").alias("clip_id"), (F.row_number().over(over(["label"], ["vec_id"])) - 1).alias("frame_no"), F.col("vec_id").alias("grid_id"), gray.alias("gray"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row a pixel; needs no order of frames, so no window."""
    gray = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))).cast("int"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_id"), F.posexplode(gray).alias("pos", "v"))
    return rows.select("grid_id", F.expr(f"cast(pos div {SIDE} AS int)").alias("y"), (F.col("pos") % SIDE).alias("x"), F.col("v").cast("double").alias("v"))


def alpha(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).withColumn("v", F.col("v") / 255)


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Frames 3k, 3k+1 and 3k+2 of a clip as the channels of image k."""
    f = frames(spark, sf).select("clip_id", F.expr("cast(frame_no div 3 AS int)").alias("k"), (F.col("frame_no") % 3).alias("c"), F.posexplode("gray").alias("pos", "v"))
    wide = f.groupBy("clip_id", "k", "pos").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).cast("double").alias(n) for i, n in enumerate("rgb")]).where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    return wide.select((F.col("clip_id") * 100_000 + F.col("k")).alias("grid_id"), F.expr(f"cast(pos div {SIDE} AS int)").alias("y"), (F.col("pos") % SIDE).alias("x"), "r", "g", "b")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    w = over(["user_id"], ["ts"])
    rows = table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(w) - 1).alias("frame_no"), seconds("ts").alias("ts"), (F.lead(seconds("ts")).over(w) - seconds("ts")).alias("dur"), F.col("value").alias("metric"))
    return rows.where("dur IS NOT NULL")


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).select("clip_id", "frame_no", (F.col("dur") / 3600).alias("g"))


def wave(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("track_id"), (F.row_number().over(over(["event_type"], ["ts", "event_id"])) - 1).cast("long").alias("i"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 500)).alias("v"))


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".PNG")).alias("path"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey").distinct().select(F.concat(F.lit("out/"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 9 == 0, ".gif").when(F.col("l_orderkey") % 9 == 1, ".jpg.TIFF").otherwise(".jpg")).alias("path"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    t1 = 1 + F.col("o_totalprice") % 3
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("model"),
        (1 + F.col("o_orderkey") % 4).cast("int").alias("scale"),
        (F.col("o_custkey") % 7).cast("string").alias("machine"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("backend"),
        F.col("o_orderdate").alias("measured_at"),
        (F.col("o_totalprice") * 10).cast("long").alias("pixels"),
        (2 + F.col("o_orderkey") % 8).cast("int").alias("n"),
        t1.alias("t1"),
        (t1 + F.col("o_totalprice") % 5).alias("tn"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.floor(seconds("ts")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("note"))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    w = over(["user_id"], ["ts"])
    e = table(spark, sf, "events").select("user_id", seconds("ts").alias("t"), F.row_number().over(w).alias("done"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"), F.min("ts").over(Window.partitionBy("user_id")).alias("first"))
    return e.select(F.col("user_id").alias("job"), F.col("done").cast("long").alias("done"), F.col("n").alias("total"), (F.col("t") - seconds("first")).alias("elapsed"))


VIEWS_SQL = """
v_frames AS (SELECT label AS clip_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_no, vec_id AS grid_id,
    list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT) AS gray FROM embeddings),
v_cells AS (SELECT vec_id AS grid_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
    least(255, greatest(0, floor(embedding[i]::DOUBLE * 255 + 128)))::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
v_alpha AS (SELECT grid_id, y, x, v / 255 AS v FROM v_cells),
v_rgb AS (SELECT clip_id * 100000 + (frame_no // 3)::INT AS grid_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
    max(gray[i]) FILTER (frame_no % 3 = 0)::DOUBLE AS r, max(gray[i]) FILTER (frame_no % 3 = 1)::DOUBLE AS g, max(gray[i]) FILTER (frame_no % 3 = 2)::DOUBLE AS b
    FROM v_frames, range(1, 65) t(i) GROUP BY ALL HAVING count(*) = 3),
v_seq AS (SELECT * FROM (SELECT user_id AS clip_id, (row_number() OVER w - 1)::INT AS frame_no, epoch_us(ts) / 1e6 AS ts,
    epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS dur, value AS metric FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE dur IS NOT NULL),
v_gaps AS (SELECT clip_id, frame_no, dur / 3600 AS g FROM v_seq),
v_wave AS (SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 500)) AS v FROM events),
v_inputs AS (SELECT o_orderkey || '.PNG' AS path FROM orders),
v_outputs AS (SELECT DISTINCT 'out/' || l_orderkey || CASE l_orderkey % 9 WHEN 0 THEN '.gif' WHEN 1 THEN '.jpg.TIFF' ELSE '.jpg' END AS path FROM lineitem),
v_prices AS (SELECT o_orderkey AS seq, o_orderpriority AS model, (1 + o_orderkey % 4)::INT AS scale, (o_custkey % 7)::VARCHAR AS machine,
    CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS backend, o_orderdate AS measured_at, trunc(o_totalprice * 10)::BIGINT AS pixels,
    (2 + o_orderkey % 8)::INT AS n, 1 + o_totalprice % 3 AS t1, 1 + o_totalprice % 3 + o_totalprice % 5 AS tn FROM orders),
v_attempts AS (SELECT user_id::VARCHAR AS key, floor(epoch_us(ts) / 1e6)::BIGINT AS at, event_id AS seq, event_type <> 'error' AS ok, event_type AS note FROM events),
v_progress AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS done, count(*) OVER (PARTITION BY user_id) AS total,
    epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS elapsed FROM events)
"""
