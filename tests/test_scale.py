"""Forms for keys and tables that one task should not hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import core
from seqloom.functions import texts as tx
from seqloom.operators import frames, timelines


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def one_key(spark):
    """A key that holds nearly all rows, a null key and a small one."""
    rng = random.Random(4)
    rows = [("huge", i, rng.choice([0.25, 0.5, 1.0, -1.0]), rng.random() < 0.3) for i in range(3000)] + [(None, i, 0.5, i == 2) for i in range(5)] + [("small", 7, 2.0, True)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, d double, kept boolean")


def test_scan_in_pieces(spark, one_key):
    """A key over many tasks gives the sums that one window gives."""
    got = core.sum_before(one_key, ["k"], ["i"], F.col("d"), "s", pieces=12)
    assert got.columns == [*one_key.columns, "s"]
    want = core.sum_before(one_key, ["k"], ["i"], F.col("d"), "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert core.sum_before(one_key.limit(0), ["k"], ["i"], F.col("d"), "s", pieces=3).count() == 0
    tasks = one_key.repartitionByRange(12, "k", "i").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in tasks) < 1000


def test_operators_in_pieces(one_key):
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for pieces in (5,):
        assert same(timelines.start_times(one_key, ["k"], "i", "d"), timelines.start_times(one_key, ["k"], "i", "d", pieces))
        assert same(timelines.cumulative_times(one_key, ["k"], "i", "d"), timelines.cumulative_times(one_key, ["k"], "i", "d", pieces))
        assert same(timelines.merge_durations(one_key, ["k"], "i", "d", "kept"), timelines.merge_durations(one_key, ["k"], "i", "d", "kept", pieces))
        args = (["k"], "i", F.lit(9000), F.lit(3000))
        assert same(timelines.interp_layout(one_key, *args), timelines.interp_layout(one_key, *args, pieces))
        cuts = one_key.where("kept").select("k", "i")
        assert same(frames.scene_segments(one_key, cuts, ["k"], "i"), frames.scene_segments(one_key, cuts, ["k"], "i", pieces))


def test_targets_in_pieces(spark, one_key):
    """An as-of join whose one clip lies in many tasks."""
    df = one_key.select(F.col("k").alias("clip"), F.col("i") * 3, "d").toDF("clip", "i", "d")  # frames need not be numbered without gaps
    whole = timelines.map_target_frames(df, ["clip"], "i", "d", 2.0)
    parts = timelines.map_target_frames(df, ["clip"], "i", "d", 2.0, pieces=9)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and whole.count() > 2000
    for after in (False, True):
        args = (["k"], ["i"], F.when(F.col("kept"), F.col("i")), "near")
        got = core.beside(one_key, *args, pieces=7, after=after)
        assert sorted(map(str, got.collect())) == sorted(map(str, core.beside(one_key, *args, after=after).collect()))


@pytest.mark.parametrize("values", ["uniform", "ties", "far apart", "same", "two"])
def test_selection_by_counts(spark, values):
    rng = np.random.default_rng(5)
    v = {"uniform": rng.random(4000), "ties": rng.integers(0, 7, 4000) / 3, "far apart": 10.0 ** rng.uniform(-300, 300, 4000) * rng.choice([-1, 1], 4000), "same": np.full(4000, 2.5), "two": np.r_[np.full(3999, 1.0), 1.0 + 2**-52]}[values]
    rows = [("a", float(x)) for x in v] + [(None, float(x)) for x in v[:11]] + [("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for share in (0.2, 1.0):
        got = {r.k: (r.n, r.at) for r in core.at_rank(df, ["k"], "v", lambda n: F.floor(n * share), most=50, cells=512).collect()}
        want = {k: (len(x), float(np.sort(x)[min(int(len(x) * share), len(x) - 1)])) for k, x in (("a", v), (None, v[:11]))}
        assert got == want
    medians = {r.k: r.median for r in timelines.upper_medians(df, ["k"], "v").collect()}
    assert medians["b"] == 0.0 and medians["a"] == np.sort(v)[2000]
    assert "collect_list" not in plan(timelines.upper_medians(df, ["k"], "v"))


def test_fingerprints_are_sums_of_parts(spark):
    df = spark.createDataFrame([("a", i, f"line {i}") for i in range(40)], "k string, i int, t string")
    one = tx.content_fingerprint(df, ["k"], "t", ["i"])
    assert "partial_sum" in plan(one) and "collect_list" not in plan(one)
    assert tx.content_fingerprint(df, ["k"], "t", ["i"], pieces=6).first() == one.first()
    swapped = df.withColumn("i", F.when(F.col("i") == 3, 4).when(F.col("i") == 4, 3).otherwise(F.col("i")))
    assert tx.content_fingerprint(swapped, ["k"], "t", ["i"]).first() != one.first()
    spaced = df.withColumn("i", F.col("i") * 10)
    assert tx.content_fingerprint(spaced, ["k"], "t", ["i"]).first() == one.first()


def test_ten_thousand_rules(spark):
    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choices("abcde ", k=rng.randint(a, b)))
    rules = list({word(5, 9): None for _ in range(10_400)})[:10_000]
    table = [(rng.randrange(3000), f"r{i}", t.upper() if i % 3 else t) for i, t in enumerate(rules)] + [(1, "none", ""), (None, "no place", "abc")]
    texts = [(i, word(20, 400)) for i in range(150)] + [(150, None), (151, ""), (151, ""), (152, "ZZZ")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("label", F.lit("mine"))
    r = spark.createDataFrame(table, "priority long, label string, text string")
    want = sorted((i, min(((p, x.lower(), name) for p, name, x in table if x and p is not None and x.lower() in (t or "").lower()), default=(0, "", None))[2]) for i, t in texts)
    for block in (100_000, 3000):
        got = [tuple(x) for x in tx.classify_by_substrings(df, "text", r, ["id"], block=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {x.label for x in tx.classify_by_substrings(df, "text", r.limit(0), ["id"]).collect()} == {None}


def plain_segments(values, w, h, block, sad, ssim, protect, segment):
    """Pixel by pixel."""

    def like(a, b):
        n = len(a)
        ma, mb = sum(a) / n, sum(b) / n
        va, vb, cov = sum((x - ma) ** 2 for x in a) / n, sum((x - mb) ** 2 for x in b) / n, sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / n
        return (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))

    def away(a, b):
        return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)

    def moving(a, b):
        shares = []
        for top in range(0, h, block):
            for left in range(0, w, block):
                cells = [abs(a[y * w + x] - b[y * w + x]) for y in range(top, min(h, top + block)) for x in range(left, min(w, left + block))]
                shares.append(sum(cells) / len(cells) >= sad)
        return sum(shares) / len(shares)

    out, held, head, number = [], None, None, 0
    for i, f in enumerate(values):
        if held is None:
            held = head = f
            out.append((i, 1.0, True, 0))
            continue
        share = moving(f, held)
        keep = i == len(values) - 1 or not (away(f, held) < sad and like(f, held) >= ssim and share < protect)
        if keep and (away(f, head) >= segment or moving(f, head) >= protect):
            head, number = f, number + 1
        held = f if keep else held
        out.append((i, share, keep, number))
    return out


def test_local_motion_and_still_segments(spark):
    rng = random.Random(8)
    w, h = 7, 5
    scene, rows = [100] * (w * h), []
    for i in range(120):
        if rng.random() < 0.05:
            scene = [rng.randrange(256)] * (w * h)
        f = [v + rng.choice([0, 0, 0, 1]) for v in scene]
        if rng.random() < 0.3:  # something small moves
            x, y = rng.randrange(w), rng.randrange(h)
            for dy in range(2):
                for dx in range(2):
                    if x + dx < w and y + dy < h:
                        f[(y + dy) * w + x + dx] += 60
        rows.append(f)
    sad, ssim, protect, segment = frames.dedup_thresholds(4.0, 0.2, 0.2, 7.0)
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(rows)] + [("one", 0, [1] * 35)], "clip string, i int, gray array<int>").repartition(4)
    marked = frames.dedup_segments(df, ["clip"], "i", "gray", w, sad, 0.2, protect, segment, block=3)
    got = sorted(tuple(r)[1:] for r in marked.where("clip = 'c'").collect())
    want = plain_segments(rows, w, h, 3, sad, 0.2, protect, segment)
    assert [(a, round(b, 9), c, d) for a, b, c, d in got] == [(a, round(b, 9), c, d) for a, b, c, d in want]
    assert {c for _, _, c, _ in got} == {True, False} and len({d for *_, d in got}) > 3
    parts = frames.still_segments(marked, ["clip"], "i").where("clip = 'c'").orderBy("segment").collect()
    assert sum(p.n for p in parts) == 120 and parts[0].start == 0 and all(a.stop + 1 == b.start for a, b in zip(parts, parts[1:]))
