import pytest
from pyspark.sql import functions as F

from seqloom.operators import timelines as op

G = "clip_id string, i int, g double"
# Fixed vectors of gaps and durations: see FIXTURES.md, part A.


def gaps(spark, values):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], G)


@pytest.mark.parametrize(("values", "period"), [([2, 2, 4, 2, 6, 2, 2, 4, 2], 3), ([3] * 8, 3), ([10, 11, 10, 12, 10, 11, 10], 11), ([3] * 6 + [30], 3)])
def test_cadence(spark, values, period):
    r = op.cadence(gaps(spark, values), ["clip_id"], "g", 24.0).first()
    assert not r.continuous and r.period in (period, period - 1) and 0.5 <= r.fps <= 24 and 0 <= r.conf <= 1
    if len(set(values)) == 1:
        assert r.conf == 1 and r.fps == 24 / values[0]


def test_cadence_of_few(spark):
    r = op.cadence(gaps(spark, [2, 2]), ["clip_id"], "g", 30.0).first()
    assert (r.continuous, r.fps, r.period, r.conf) == (True, 30.0, 1, 0.25)
    assert op.cadence(gaps(spark, []), ["clip_id"], "g", 30.0).count() == 0


def test_upper_median(spark):
    assert op.upper_medians(gaps(spark, [1, 2, 3, 4]), ["clip_id"], "g").first().median == 3
    assert op.upper_medians(gaps(spark, [5, 1, 2, 4, 2]), ["clip_id"], "g").first().median == 2


@pytest.mark.parametrize(("durs", "reason"), [([0.033], "short"), ([0.033, 0.05, float("nan")], "bad"), ([0.04] * 9, "even"), ([0.04] * 8 + [0.2], None)])
def test_flatten(spark, durs, reason):
    r = op.flatten_plan(gaps(spark, durs), ["clip_id"], "i", "g", 25, 2).first()
    assert r.reason == reason
    if reason is None:
        assert r.frames == round(sum(durs) * 50)


def test_durations_are_conserved(spark):
    df = spark.createDataFrame([("c", i, 0.1 * (i % 3 + 1), i in (1, 2, 5)) for i in range(8)], "clip_id string, i int, d double, kept boolean")
    merged = op.merge_durations(df, ["clip_id"], "i", "d", "kept").collect()
    assert abs(sum(r.d for r in merged) - sum(0.1 * (i % 3 + 1) for i in range(1, 8))) < 1e-9 and len(merged) == 3
    for n in (5, 8, 13, 50):
        rows = op.expand_durations_exact(df.withColumn("last", F.lit(n % 2 == 0)), ["clip_id"], "i", "d", F.lit(n), "last").collect()
        assert len(rows) == max(n, 8) and abs(sum(r.slot_dur for r in rows) - sum(0.1 * (i % 3 + 1) for i in range(8))) < 1e-9
    layout = op.interp_layout(df, ["clip_id"], "i", F.lit(29), F.lit(8)).orderBy("i").collect()
    assert sum(r.slots for r in layout) == 28 and [r["first"] for r in layout][:2] == [1, 1 + layout[0].slots]


def test_mapping_is_monotone(spark):
    df = spark.createDataFrame([("c", i, [0.5, 0.1, 0.4][i % 3]) for i in range(9)], "clip_id string, i int, d double")
    rows = op.map_target_frames(df, ["clip_id"], "i", "d", 10.0, 60).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(31))  # the end itself is the last frame
    place = [r.i0 + (r.phi if r.i1 != r.i0 else 0) for r in rows]
    assert place == sorted(place) and rows[5].exact and rows[5].i0 == 1
    assert rows[30].exact and rows[30].i0 == rows[30].i1 == 8 and rows[30].phi == 0
    assert op.map_target_frames(df, ["clip_id"], "i", "d", 10.0).count() == 30  # as many as fit the time
    assert op.map_target_frames(df.where("i = 0"), ["clip_id"], "i", "d", 10.0, 5).count() == 0
    long = spark.createDataFrame([("c", 0, 1e6), ("c", 1, 1e6)], "clip_id string, i int, d double")
    near = op.map_target_frames(long, ["clip_id"], "i", "d", 1 / 999_999.5, 2).where("k = 1").first()
    assert near.exact and near.phi == 1 and near.i0 == near.i1 == 1  # within a millionth of the way


def test_start_times_have_an_end(spark):
    df = spark.createDataFrame([("c", 0, 0.5), ("c", 1, -1.0), ("c", 2, 0.25)], "clip_id string, i int, d double")
    assert [(r.i, r.pts) for r in op.cumulative_times(df, ["clip_id"], "i", "d").orderBy("i").collect()] == [(0, 0.0), (1, 0.5), (2, 0.5), (3, 0.75)]


def test_batches(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "clip_id string, i int")
    sizes = spark.createDataFrame([("a", 0, 4), ("a", 1, 0), ("a", 2, 3), ("b", 0, 9)], "clip_id string, nb int, size int")
    got = sorted((r.clip_id, r.i, r.nb) for r in op.assign_batch(df, ["clip_id"], "i", sizes, "nb", "size").collect())
    assert got == [("a", i, 0) for i in range(4)] + [("a", i, 2) for i in range(4, 7)] + [("b", i, 0) for i in range(3)]
    whole = op.assign_batch(df.where("clip_id = 'a'"), [], "i", sizes.where("clip_id = 'a'").drop("clip_id"), "nb", "size").collect()
    assert sorted((r.i, r.nb) for r in whole) == [(i, 0) for i in range(4)] + [(i, 2) for i in range(4, 7)]


def test_runs_within_tolerance(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 1.5, 2.0, 2.5, 3.0, 3.0])], "clip_id string, i int, v double")
    runs = [(r.start, r.stop, r.offset) for r in op.run_length_within(df, ["clip_id"], "i", "v", 1.0).orderBy("start").collect()]
    assert runs == [(0, 2, 0.0), (2, 4, 2.0), (4, 6, 6.0)]  # just as far as the tolerance is another run
    assert op.run_length_within(df, ["clip_id"], "i", "v", 0.0, max_runs=3).count() == 0
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        more = df.unionAll(spark.createDataFrame([("c", 9, bad)], df.schema))
        assert op.run_length_within(more, ["clip_id"], "i", "v", 1.0).count() == 0


def test_collisions(spark):
    df = spark.createDataFrame([("a", i, 0.001) for i in range(10)] + [("b", i, 0.04) for i in range(10)] + [("c", i, -1.0 if i == 3 else 0.001) for i in range(10)], "clip_id string, i int, d double")
    got = {r.clip_id: r for r in op.timestamp_collisions(df, ["clip_id"], "i", "d", 100.0).collect()}
    assert got["a"].collisions == 9 and got["a"].time_base >= 1000 and got["b"].collisions == 0 and got["c"].collisions == 0


def test_collisions_do_not_sum_up(spark):
    """A frame's time is its run's start and so many times one duration."""
    df = spark.createDataFrame([("a", i, 0.1) for i in range(60)] + [("b", 0, 0.1), ("b", 1, float("nan"))] + [("c", 0, 0.1)], "clip_id string, i int, d double")
    got = {r.clip_id: (r.collisions, r.time_base) for r in op.timestamp_collisions(df, ["clip_id"], "i", "d", 10.0).collect()}
    assert got == {"a": (1, 20), "b": (0, 20), "c": (0, 20)}


def test_exact_slots(spark):
    """Only a clip's last segment has a tail of one slot."""
    df = spark.createDataFrame([("c", i, 0.3, last) for i in range(3) for last in (False, True)], "clip_id string, i int, d double, last boolean")
    for last, want in ((False, [3, 3, 3]), (True, [4, 4, 1])):
        rows = op.expand_durations_exact(df.where(F.col("last") == last), ["clip_id"], "i", "d", F.lit(9), "last").groupBy("i").count().orderBy("i").collect()
        assert [r["count"] for r in rows] == want
    assert op.expand_durations_exact(df.where("i = 0"), ["clip_id", "last"], "i", "d", F.lit(9), "last").count() == 2


@pytest.mark.parametrize("sizes,slots,want", [([4, 4, 2], 25, [9, 11, 5]), ([1], 25, [2]), ([5, 1, 4], 0, [6, 2, 5]), ([3, 1, 6], 30, [7, 1, 22]), ([6, 6], 4, [7, 7]), ([10, 10, 10], 72, [23, 25, 24])])
def test_segment_targets_add_up(spark, sizes, slots, want):
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate(sizes)], "clip_id string, s int, n long")
    got = [r.target for r in op.segment_targets_exact(df, ["clip_id"], "s", "n", slots).orderBy("s").collect()]
    assert got == want


def test_expected_frames(spark):
    df = spark.createDataFrame([(0, None), (1, 0), (10, 0), (10, 7), (10, -1), (-3, None)], "n long, own long")
    rows = df.select(op.expected_frames(F.col("n"), 2, F.col("own")).alias("e"), op.expected_frames(F.col("n"), 0.5).alias("f"), op.count_mismatch(F.col("n"), op.expected_frames(F.col("n"), 2, F.col("own")), 1).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, False), (1, 1, False), (19, 10, True), (7, 10, True), (19, 10, True), (0, 0, False)]


def test_spread_sample(spark):
    df = spark.createDataFrame([("c", i) for i in range(40)], "clip_id string, i int")
    assert [r.i for r in op.spread_sample(df, ["clip_id"], "i", 1).collect()] == [20]
    got = sorted(r.i for r in op.spread_sample(df, ["clip_id"], "i", 5).collect())
    assert got[0] == 10 and got[-1] == 29 and len(set(got)) == 5
    assert op.spread_sample(df, ["clip_id"], "i", 100).count() == 40


def test_carried_values_are_those_of_the_join(spark):
    """Slots that carry their frames' values give what joins give, and targets are never shuffled."""
    rows = [(c, i, [0.5, 0.0, 0.13, 0.4][(i + c) % 4] * (30 if i == 5 else 1), float(i * i % 17)) for c in range(5) for i in range(c * 4 + 1)]
    df = spark.createDataFrame(rows, "clip_id int, i int, d double, m double")
    plain = op.cut_aware_plan(op.map_target_frames(df, ["clip_id"], "i", "d", 10.0), df.where("m > 8"), ["clip_id"], "i")
    joined = op.blend(plain, df, ["clip_id"], "i", "m")
    carried = op.cut_aware_plan(op.map_target_frames(df, ["clip_id"], "i", "d", 10.0, values=["m"]), F.col("m_0") > 8, ["clip_id"], "i")
    mixed = op.blend(carried, None, ["clip_id"], "i", "m").select(joined.columns)
    got = sorted(map(str, mixed.collect()))
    assert got == sorted(map(str, joined.collect())) and len(got) > 300
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Join" not in plan and "Exchange" not in plan.split("Generate explode")[0]
