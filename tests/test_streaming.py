"""Streams: state that outlives a query, ledgers as the batch has them, tiles of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import grids, ledgers
from seqloom.streaming import stateful as st

DAY = 86_400


def fed(spark, df, path, parts):
    """A stream over ``path``, and feeds that add one part each."""
    feeds = [lambda p=p: p.write.mode("append").parquet(path) for p in parts]
    feeds[0]()
    return spark.readStream.schema(df.schema).parquet(path), [lambda: None, *feeds[1:]]


def ledger_rows(seed, n=240):
    rng, rows, at = random.Random(seed), [], 100 * DAY
    for i in range(n):
        at += rng.choice([0, 3600, 20 * 3600, 2 * DAY, 9 * DAY])
        rows.append((f"k{rng.randrange(4)}", at, i, rng.random() < 0.3, rng.random() < 0.1, rng.choice([-1, 0, 0, 0, None])))
    return rows


def test_verdicts_survive_a_restart(spark, tmp_path):
    """Each run starts from the checkpoint of the one before; the ledger goes on where it was."""
    df = spark.createDataFrame(ledger_rows(1), "key string, at long, seq long, ok boolean, deny boolean, device int").withColumn("time", F.col("at").cast("timestamp"))
    start, state, out = st.VERDICT
    stream, feeds = fed(spark, df, str(tmp_path / "in"), [df.where(F.expr(f"seq div 80 = {k}")) for k in range(3)])
    step = st.verdict_step(7 * DAY, 3, DAY)
    folded = st.keyed_fold(stream.withWatermark("time", "1 day"), ["key"], ["at", "seq"], start, step, state, out, keep_ms=8 * DAY * 1000, time="time")
    got = sorted(map(tuple, st.drained(folded, feeds=feeds).collect()))
    assert got == sorted(map(tuple, st.batch_fold(df, ["key"], ["at", "seq"], start, step, out).collect())) and len(got) == 240


@pytest.mark.parametrize("seed", [2, 3])
def test_verdict_steps_are_the_batch_ledger(spark, seed):
    """After each attempt the fold says what ``verdict_state`` says of the attempts up to then."""
    rows = ledger_rows(seed, 40)
    df = spark.createDataFrame(rows, "key string, at long, seq long, ok boolean, deny boolean, device int")
    start, _, out = st.VERDICT
    folded = {r.seq: r for r in st.batch_fold(df, ["key"], ["at", "seq"], start, st.verdict_step(7 * DAY, 3, DAY), out).collect()}
    for k in (5, 13, 24, 39):
        key, at, seq, *_, device = rows[k]
        if device == -1:
            assert not folded[seq].denied
            continue
        state = ledgers.verdict_state(df.where((F.col("key") == key) & (F.col("seq") <= seq)), ["key"], ["at", "seq"], F.lit(at), 7 * DAY, 3, F.col("deny"), DAY, "device").first()
        assert (state.failures, state.denied) == (folded[seq].failures, folded[seq].denied)


def test_progress_keeps_its_last_rows(spark, tmp_path):
    """Value and list states across runs."""
    rows = [(j, d, 60, d * (1.0 + (d % 5) / 7), 0.0) for j in ("a", "b") for d in range(1, 61)]
    df = spark.createDataFrame(rows, "job string, done long, total long, elapsed double, floor double")
    start, state, out = st.ETA
    stream, feeds = fed(spark, df, str(tmp_path / "in"), [df.where(f"done > {20 * k} AND done <= {20 * k + 20}") for k in range(3)])
    got = st.drained(st.keyed_fold(stream, ["job"], ["done"], start, st.eta_step(5), state, out), feeds=feeds)
    want = st.batch_fold(df, ["job"], ["done"], start, st.eta_step(5), out)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_requests_that_do_not_wait(spark):
    rows = [(0, 0, 0, 1.0, None, False), (0, 50, 1, 2.0, 1.0, True), (0, 60, 2, 3.0, 2.0, False), (0, 70, 3, None, 2.0, True), (0, 160, 4, None, 2.0, False)]
    df = spark.createDataFrame(rows, "key int, at_ms long, seq long, target double, pos double, immediate boolean")
    start, _, out = st.COALESCE
    got = [(r.at_ms, r.ran) for r in st.batch_fold(df, ["key"], ["at_ms", "seq"], start, st.coalesce_step(), out).orderBy("at_ms").collect()]
    assert got == [(0, 1.0), (50, 2.0), (160, 3.0)]


def plain_smooth(frames, stability):
    """Pixel by pixel."""
    k, held, out = stability / 100 * 0.9, {}, {}
    for at, reset, pixels in frames:
        if reset:
            held = {}
        for p, v in pixels.items():
            new = v
            if p in held:
                before, raw = held[p]
                if not (v <= 0.001 or v >= 0.999 or before <= 0.001 or before >= 0.999):
                    new = before + (v - before) * (1 - k * (1 - min(max(3.5 * abs(v - raw), 0), 1)))
            held[p] = (new, v)
            out[(at, *p)] = new
    return out


@pytest.mark.parametrize("tile", [4, 256])
def test_tiles_are_smoothed_as_pixels_are(spark, tile):
    rng = random.Random(tile)
    frames = [(t, t in (9, 17), {(y, x): rng.choice([0.0, 1.0, rng.random(), 0.5 + rng.random() / 20]) for y in range(11) for x in range(9) if rng.random() < 0.97}) for t in range(30)]
    # Forgetting is for the pixels that a frame has; others were not there before either.
    frames = [(t, r, {(y, x): rng.random() for y in range(11) for x in range(9)} if r else p) for t, r, p in frames]
    rows = [(c, t, r, y, x, v) for c in ("a", None) for t, r, px in frames for (y, x), v in px.items()]
    df = spark.createDataFrame(rows, "clip string, frame int, reset boolean, y int, x int, v double").repartition(7)
    got = grids.temporal_smooth(df, ["clip"], "frame", "reset", 70, tile=tile)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    want = plain_smooth(frames, 70)
    for clip in ("a", None):
        have = {(r.frame, r.y, r.x): r.v for r in got.collect() if r.clip == clip}
        assert have.keys() == want.keys() and max(abs(have[k] - want[k]) for k in want) < 1e-12
