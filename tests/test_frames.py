import math
from random import Random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import frames as op


def test_cut_rule(spark):
    rows = [(58.68, 7237.0, 3430.0, True), (51.0, None, None, True), (30.0, 1000.0, 500.0, True), (30.0, 1000.0, 900.0, False), (5.0, 1000.0, 10.0, False), (0.871, None, None, False), (0.150, None, None, False), (float("nan"), 1.0, 1.0, False), (None, 1.0, 1.0, False), (30.0, None, None, True), (30.0, 0.0, 5.0, True)]
    df = spark.createDataFrame(rows, "diff double, a double, b double, want boolean")
    got = df.withColumn("got", op.is_cut(F.col("diff"), F.col("a"), F.col("b")))
    assert got.where("got IS NULL OR got <> want").count() == 0


def test_strictness_snaps():
    assert op.cut_thresholds(0.30)[:2] == (25.0, 50.0)
    assert op.cut_thresholds(0.0) == op.cut_thresholds(0.15) and op.cut_thresholds(2.0) == op.cut_thresholds(0.90)
    assert abs(op.cut_thresholds(0.325)[0] - 25 * 0.35 / 0.30) < 1e-9


def spaced(spark, at, n):
    df = spark.createDataFrame([("c", i, True) for i in at], "clip_id string, i int, f boolean")
    return sorted(r.i for r in op.min_spacing(df, ["clip_id"], "i", "f", n).collect())


def test_min_spacing(spark):
    assert spaced(spark, [29, 30], 15) == [29]
    assert [spaced(spark, [0, d], 15) for d in (14, 15, 16)] == [[0], [0, 15], [0, 16]]
    got = spaced(spark, range(479), 15)
    assert len(got) == 32 and got[0] == 0 and got[-1] == 465 and all(b - a == 15 for a, b in zip(got, got[1:]))
    assert len(spaced(spark, range(479), 1)) == 479


def test_near_black(spark):
    rows = [("a", y, x, 0 if y * 10 + x < 95 else 300) for y in range(10) for x in range(10)] + [("b", y, x, 0 if y * 10 + x < 94 else 300) for y in range(10) for x in range(10)]
    rows += [("c", y, x, 0 if y < 3 else 300) for y in range(9) for x in range(10)]
    got = {r.f: r.defective for r in op.defective_frames(spark.createDataFrame(rows, "f string, y int, x int, sum_rgb int"), ["f"], 9, 10).collect()}
    assert got["a"] and got["c"]
    few = op.band_black(spark.createDataFrame(rows, "f string, y int, x int, sum_rgb int"), ["f"], 10, 10)
    assert {r.f: r.band_dark for r in few.collect()}["c"] is False  # too few samples to say


def test_constant_grid_has_no_noise(spark):
    cells = spark.createDataFrame([(0, y, x, 50.0) for y in range(8) for x in range(8)] + [(1, y, x, 50.0 + (x * 7 + y * 13) % 11) for y in range(8) for x in range(8)], "grid_id int, y int, x int, v double")
    got = {r.grid_id: r.grain for r in op.grain(cells, ["grid_id"]).collect()}
    assert got[0] == 0 and got[1] > 0
    block = {r.grid_id: r.blocking for r in op.blocking(cells, ["grid_id"], 4).collect()}
    assert block[0] is None and block[1] is not None


def test_dedup_compares_with_the_last_kept(spark):
    rows = [(0, i, [float(10 * v)] * 4 + [0.0] * 4) for i, v in enumerate([0, 0.1, 0.2, 0.3, 0.4, 0.5])]
    df = spark.createDataFrame(rows, "c int, i int, gray array<double>")
    adjacent = [r.keep for r in op.dedup_adjacent(df, ["c"], ["i"], "gray", 1.0, -1.0).orderBy("i").collect()]
    last = [r.keep for r in op.dedup_frames(df, ["c"], "i", "gray", 1.0, -1.0).orderBy("i").collect()]
    assert adjacent == [True, False, False, False, False, True]
    assert last == [True, False, True, False, True, True] or last == [True, False, False, True, False, True]
    assert op.dedup_thresholds(3, 0.98, 0.2, 4, 1) == (4.5, 0.985, pytest.approx(0.3), 6.0)
    assert op.dedup_thresholds(20, 0.9, 0.9, 1, 0) == (7.0, 0.99, 0.60, 2.0) and op.dedup_thresholds(3, 0.98, 0.2, 4, 2)[1] == 0.995


def test_noise_probe_leaves_out_frames_of_another_size(spark):
    rows = [(f, y, x, float((f * 31 + y * 7 + x * 13) % 17)) for f in range(9) for y in range(4) for x in range(4) if (f, y, x) != (4, 3, 3)]
    cells = spark.createDataFrame(rows, "i int, y int, x int, v double").withColumn("c", F.lit(0))
    got = op.noise_probe(cells, ["c"], "i", 4, 4, burst=5, block=2).first()
    rest = op.noise_probe(cells.where("i <> 4").withColumn("i", F.when(F.col("i") > 4, F.col("i") - 1).otherwise(F.col("i"))), ["c"], "i", 4, 4, burst=5, block=2).first()
    assert got.n_frames == 8 and got.flicker == rest.flicker > 0
    assert op.noise_probe(cells, ["c"], "i", 4, 4, burst=2, block=2).first().flicker == 0  # no burst is long enough
    assert op.noise_probe(cells.where("i < 2"), ["c"], "i", 4, 4).count() == 0


def test_variance_is_of_all_channels_together(spark):
    red = spark.createDataFrame([(1, 255, 0, 0)] * 9, "g int, r int, b int, x int").select("g", "r", F.lit(0).alias("b"), F.col("x").alias("g2")).select(F.col("g").alias("id"), "r", F.col("g2").alias("g"), "b")
    row = op.frame_stats(red, ["id"]).first()
    assert (row.mean_r, row.mean_g, row["var"]) == (255.0, 0.0, 14450.0)


def test_flicker_takes_frames_in_order(spark):
    """Held against a fold in plain Python: deviations that tie but for their last bits choose the quarter."""
    random = Random(5)
    shuffled = lambda b: random.sample([b, 3 * b + 11, 97, 2 * b + 130, 201], 5)
    pixels = {(b, y, x): [50] * 5 if y == 0 and x < 3 else shuffled(b) for b in range(20) for y in range(4) for x in range(4)}
    rows = [(b, f, y, x, float(v)) for (b, y, x), values in pixels.items() for f, v in enumerate(values)]
    of = {}
    for b, f, y, x, v in rows:
        of.setdefault(b, {}).setdefault((y, x), []).append(v)

    def deviation(values):
        mean = m2 = 0.0
        for n, v in enumerate(values, 1):
            last, mean = mean, mean + (v - mean) / n
            m2 += (v - mean) * (v - last)
        return math.sqrt(m2 / len(values))

    want = {}
    for b, pixels in of.items():
        spread = sorted(map(deviation, pixels.values()))
        low = [s for s in spread if s <= spread[len(spread) // 4]]
        want[b] = sum(low) / len(low)
    cells = spark.createDataFrame(rows, "b int, f int, y int, x int, v double").repartition(3, "f")
    got = {r.b: r.flicker for r in op.flicker(cells, ["b"], order="f").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    plain = {r.b: r.flicker for r in op.flicker(cells, ["b"]).collect()}
    assert any(abs(plain[b] - want[b]) > 1e-6 for b in want)  # such ties are in the rows
