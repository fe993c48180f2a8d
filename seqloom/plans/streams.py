"""Queries of the streaming operators: the given tables read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import over
from ..operators import frames as fr
from ..sources import fixtures as fx
from ..sources.scratch import shared_folder, staged
from ..streaming import stateful as op
from .ledgers import ETA, eta_floor
from .registry import query


def events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def streamed(spark, rows, name, part, keys, files=4):
    """A table that Spark made, read as a stream of three micro-batches: rows whose ``part`` is 0, 1 and
    2, in this order, each in ``files`` files by key. For rows that take windows to make."""
    path = shared_folder(spark, name)
    rows = staged(rows.withColumn("_part", part), name)
    for k in range(3):
        rows.where(F.col("_part") == k).drop("_part").repartition(files, *keys).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(path)


def third(by, order):
    """Which third of its key a row lies in."""
    return F.ntile(3).over(over(by, order)) - 1


def smooth_rows(spark, sf):
    """Two tiles a frame, as arrays of pixels."""
    f = fr.pair_diff(fx.frames(spark, sf), ["clip_id"], ["frame_no"], "gray").withColumn("reset", F.coalesce(F.col("diff") >= 36, F.lit(False)))
    tiles = F.explode(F.array(*[F.struct(F.lit(k).alias("tile"), F.transform(F.slice("gray", 32 * k + 1, 32), lambda v: v / F.lit(255.0)).alias("v")) for k in range(2)]))
    return f.select("clip_id", "frame_no", "reset", tiles.alias("t")).select("clip_id", "frame_no", "reset", "t.*")


@query("t01_temporal_smooth_stream", """p AS (SELECT clip_id, frame_no, grid_id, gray, lag(gray) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prev FROM v_frames),
a AS (SELECT p.clip_id, p.frame_no, c.y * 8 + c.x AS pos, c.v, coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(gray[i] - prev[i])))::DOUBLE / 64 >= 36, false) AS reset FROM p JOIN v_alpha c USING (grid_id)),
f AS (SELECT clip_id, pos, frame_no, v AS o, v AS raw FROM a WHERE frame_no = 0 UNION ALL SELECT a.clip_id, a.pos, a.frame_no, CASE WHEN a.reset OR a.v <= 0.001 OR a.v >= 0.999 OR f.o <= 0.001 OR f.o >= 0.999 THEN a.v
 ELSE f.o + (a.v - f.o) * (1 - 0.63::DOUBLE * (1 - least(1.0::DOUBLE, 3.5 * abs(a.v - f.raw)))) END, a.v FROM f JOIN a ON a.clip_id = f.clip_id AND a.pos = f.pos AND a.frame_no = f.frame_no + 1)
SELECT clip_id, pos, frame_no::BIGINT AS frame_no, round(o, 6) AS v FROM f""")
def t01(spark, sf):
    start, state, out = op.SMOOTH
    stream = streamed(spark, smooth_rows(spark, sf), "cells", third(["clip_id", "tile"], ["frame_no"]), ["clip_id", "tile"])
    made = op.drained(op.keyed_fold(stream, ["clip_id", "tile"], ["frame_no"], start, op.smooth_step(70), state, out, frames=True))
    made = made.select("clip_id", "frame_no", "tile", F.posexplode("v").alias("at", "v"))
    return made.select("clip_id", (F.col("tile") * 32 + F.col("at")).alias("pos"), "frame_no", F.round("v", 6).alias("v"))


@query("t02_verdict_state_stream", """n AS MATERIALIZED (SELECT key, at, seq, note = 'signup' AS exempt, note <> 'error' AND note <> 'purchase' AS ok, note = 'purchase' AS deny, row_number() OVER (PARTITION BY key ORDER BY at, seq) AS i FROM v_attempts),
f AS (SELECT key, i, seq, exempt, CASE WHEN NOT exempt THEN at END AS last, CASE WHEN NOT exempt THEN ok END AS was, CASE WHEN exempt OR ok THEN 0 WHEN deny THEN 2 ELSE 1 END AS failures, CASE WHEN exempt OR ok THEN 0 WHEN deny THEN 2 ELSE 1 END AS shown FROM n WHERE i = 1 UNION ALL
 SELECT key, i, seq, exempt, CASE WHEN exempt THEN last ELSE at END, CASE WHEN exempt THEN was ELSE ok END, CASE WHEN exempt THEN failures ELSE fresh END, CASE WHEN exempt THEN CASE WHEN lives THEN failures ELSE 0 END ELSE fresh END FROM (
 SELECT *, CASE WHEN ok THEN 0 WHEN deny THEN 2 WHEN lives AND NOT was THEN failures + 1 ELSE 1 END AS fresh FROM (
 SELECT n.key, n.i, n.seq, n.at, n.ok, n.deny, n.exempt, f.last, f.was, f.failures, coalesce(n.at - f.last BETWEEN 0 AND CASE WHEN f.was THEN 86400 ELSE 604800 END, false) AS lives FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)))
SELECT key, seq, shown::INT AS failures, NOT exempt AND shown >= 2 AS denied FROM f""")
def t02(spark, sf):
    """Failures live for a week, successes for a day; purchases are denials, signups have no device."""
    start, state, out = op.VERDICT
    days, kind = fx.table(spark, sf, "events"), F.col("event_type")
    stream = streamed(spark, days, "events", F.expr("least(2, (day(ts) - 1) div 10)"), ["user_id"])
    rows = stream.select(F.col("user_id").cast("string").alias("key"), F.floor(fx.seconds("ts")).alias("at"), F.col("event_id").alias("seq"), (kind != "error").alias("ok"), (kind == "purchase").alias("deny"), F.when(kind == "signup", -1).otherwise(0).alias("device"), F.col("ts").cast("timestamp").alias("time"))
    folded = op.keyed_fold(rows.withWatermark("time", "7 days"), ["key"], ["at", "seq"], start, op.verdict_step(604_800, 2, 86_400), state, out, keep_ms=604_800_000, time="time")
    return op.drained(folded)


def requests(spark, sf):
    """Tenths of hours stand for milliseconds, so that steps as long as the limits occur. Positions may
    be missing, targets may be negative."""
    w = over(["user_id"], ["ts"])
    pos = F.when(F.col("event_type").isin("purchase", "signup"), F.lag("value", 2).over(w))
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), (F.floor(fx.seconds("ts") / 3600) * 10).alias("at_ms"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("value") - 20).alias("target"), pos.alias("pos"), (F.col("event_id") % 5 == 0).alias("immediate"))


@query("t03_coalesce_requests_stream", """r AS (SELECT user_id AS key, floor(epoch_us(ts) / 1e6 / 3600)::BIGINT * 10 AS t, event_id, event_id % 5 = 0 AS now, CASE WHEN event_type <> 'view' THEN value - 20 END AS target,
 CASE WHEN event_type IN ('purchase', 'signup') THEN lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) END AS pos FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS i FROM r),
f AS (SELECT key, i, t, target IS NOT NULL AS ran, CASE WHEN target IS NOT NULL THEN t END AS last, target IS NOT NULL AS busy, greatest(0.0::DOUBLE, target) AS goal, coalesce(pos, -1.0::DOUBLE) AS began, NULL::DOUBLE AS parked FROM n WHERE i = 1
 UNION ALL SELECT key, i, t, ran, CASE WHEN ran THEN t ELSE last END, busy OR ran, CASE WHEN ran THEN greatest(0.0::DOUBLE, parked) ELSE goal END, CASE WHEN ran THEN coalesce(pos, -1.0::DOUBLE) ELSE began END, CASE WHEN NOT ran THEN parked END FROM (
 SELECT *, parked IS NOT NULL AND NOT busy AND (now OR last IS NULL OR t - last >= 110) AS ran FROM (
 SELECT n.key, n.i, n.t, n.pos, n.now AND n.target IS NOT NULL AS now, f.last, f.goal, f.began, coalesce(n.target, f.parked) AS parked,
 f.busy AND NOT (n.t - f.last > 900 OR coalesce(abs(n.pos - f.goal) < 0.35 OR (f.began >= 0 AND abs(n.pos - f.began) > 0.05), false)) AS busy FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)))
SELECT key, t AS at_ms, goal AS ran FROM f WHERE ran""")
def t03(spark, sf):
    start, state, out = op.COALESCE
    stream = streamed(spark, requests(spark, sf), "requests", third(["key"], ["at_ms", "seq"]), ["key"])
    return op.drained(op.keyed_fold(stream, ["key"], ["at_ms", "seq"], start, op.coalesce_step(), state, out))


@query("t04_latest_per_key_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def t04(spark, sf):
    out = op.drained(op.latest_per_key(events(spark, sf), ["user_id"], "event_id", ["event_type", "value"]), mode="update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("s")).select("user_id", "s.*")


@query("t05_live_eta_stream", f"""{ETA}, fl AS (SELECT job, done, eta, CASE WHEN done % 9 < 4 THEN 0 ELSE (total - done) * 9000.0::DOUBLE END AS floor FROM e),
s AS (SELECT job, done, CASE WHEN eta >= 0 THEN greatest(eta, floor) END AS shown FROM fl WHERE done = 1 UNION ALL
 SELECT fl.job, fl.done, CASE WHEN eta < 0 THEN s.shown WHEN s.shown IS NULL OR s.shown <= 0 THEN greatest(eta, floor) ELSE greatest(least(s.shown, eta), floor) END FROM s JOIN fl ON fl.job = s.job AND fl.done = s.done + 1)
SELECT job, done, round(shown, 3) AS shown FROM s""")
def t05(spark, sf):
    start, state, out = op.ETA
    rows = fx.progress(spark, sf).withColumn("floor", eta_floor())
    stream = streamed(spark, rows, "progress", third(["job"], ["done"]), ["job"])
    return op.drained(op.keyed_fold(stream, ["job"], ["done"], start, op.eta_step(5, 30.0), state, out)).withColumn("shown", F.round("shown", 3))
