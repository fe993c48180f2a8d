"""Queries of the timeline operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import over, r6
from ..operators import frames as fr
from ..operators import timelines as op
from ..sources import fixtures as fx
from .frames import SPACED
from .registry import query

KEY, NO = ["clip_id"], "frame_no"
RATE = 1 / 3600  # the fixture timelines run over days; an hour is their frame


@query("s18_merge_durations", """r AS (SELECT *, sum((metric > 20)::INT) OVER (PARTITION BY clip_id ORDER BY frame_no) AS kept_id FROM v_seq)
SELECT clip_id, kept_id::BIGINT AS kept_id, min(frame_no) AS frame_no, round(sum(dur), 6) AS dur FROM r WHERE kept_id > 0 GROUP BY clip_id, kept_id""")
def s18(spark, sf):
    rows = fx.timeline(spark, sf).withColumn("kept", F.col("metric") > 20)
    return op.merge_durations(rows, KEY, NO, "dur", "kept").withColumn("dur", r6("dur"))


CAD = """a AS (SELECT clip_id, list_sort(list(g)) AS xs FROM v_gaps GROUP BY clip_id), m AS (SELECT *, xs[len(xs) // 2 + 1] AS m FROM a),
k AS (SELECT *, CASE WHEN len(list_filter(xs, lambda g: g >= 0.5 * m AND g <= 2 * m)) < 3 THEN xs ELSE list_filter(xs, lambda g: g >= 0.5 * m AND g <= 2 * m) END AS ks FROM m),
s AS (SELECT *, list_avg(ks) AS mean, list_sort(list_transform(ks, lambda g: abs(g - m)))[len(ks) // 2 + 1] AS mad FROM k)"""


@query("s19_cadence", f"""{CAD} SELECT clip_id, len(xs) < 3 OR mean < 1.2 AS continuous, round(CASE WHEN len(xs) < 3 OR mean < 1.2 THEN 24.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(24.0::DOUBLE, 24 / mean)) END, 6) AS fps,
CASE WHEN len(xs) < 3 OR mean < 1.2 THEN 1 ELSE round_even(mean, 0)::BIGINT END AS period, round(CASE WHEN len(xs) < 3 OR mean < 1.2 THEN 0.25::DOUBLE ELSE
greatest(0.0::DOUBLE, least(1.0::DOUBLE, len(list_filter(ks, lambda g: abs(g - m) <= greatest(1.0::DOUBLE, 0.2 * m))) / len(ks) * greatest(0.0::DOUBLE, 1 - mad / m) * sqrt(len(ks) / len(xs)))) END, 6) AS conf FROM s""")
def s19(spark, sf):
    return op.cadence(fx.gaps(spark, sf), KEY, "g", 24.0).select("clip_id", "continuous", r6("fps").alias("fps"), "period", r6("conf").alias("conf"))


@query("s20_upper_median", "SELECT clip_id, round(list_sort(list(g))[count(*) // 2 + 1], 6) AS median FROM v_gaps GROUP BY clip_id")
def s20(spark, sf):
    return op.upper_medians(fx.gaps(spark, sf), KEY, "g").withColumn("median", r6("median"))


@query("s21_gap_stats", """g AS (SELECT clip_id, lead(ts) OVER (PARTITION BY clip_id ORDER BY frame_no) - ts AS g FROM v_seq),
s AS (SELECT clip_id, count(g) FILTER (g > 0) AS n, min(g) AS lo, max(g) AS hi, avg(g) AS av, stddev_pop(g) AS sd FROM g GROUP BY clip_id)
SELECT clip_id, n, round(lo, 6) AS gap_min, round(hi, 6) AS gap_max, round(av, 6) AS gap_avg, round(hi / lo, 6) AS ratio, round(sd / av, 6) AS cv, hi > 1.5 * lo AND hi > 0.0005 AS by_ratio, sd / av > 0.25 AS by_cv, (hi > 1.5 * lo AND hi > 0.0005) OR sd / av > 0.25 AS variable FROM s""")
def s21(spark, sf):
    out = op.gap_stats(fx.timeline(spark, sf), KEY, [NO], "ts")
    return out.withColumns({c: r6(c) for c in ("gap_min", "gap_max", "gap_avg", "ratio", "cv")})


@query("s21_rates_differ", "SELECT o_orderkey, 24.0 / (o_totalprice % 50) >= 2.0 AND o_totalprice % 50 > 0 AS variable FROM orders")
def s21b(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.coalesce(op.rates_differ(F.lit(24.0), F.col("o_totalprice") % 50), F.lit(False)).alias("variable"))


@query("s22_flatten_plan", """a AS (SELECT clip_id, list(dur ORDER BY frame_no) AS d, bool_or(dur <= 0) AS bad FROM v_seq GROUP BY clip_id), m AS (SELECT *, list_sort(d)[len(d) // 2 + 1] AS m FROM a),
g AS (SELECT *, len(list_filter(d, lambda x: abs(x - m) / m > 0.25)) AS gaps, CASE WHEN len(d) < 3 THEN 'short' WHEN bad THEN 'bad' WHEN NOT m > 0 THEN 'median' END AS r FROM m)
SELECT clip_id, gaps::INT AS gaps, coalesce(r, CASE WHEN gaps = 0 THEN 'even' END) AS reason, CASE WHEN r IS NULL AND gaps > 0 THEN 0.01::DOUBLE END AS target_fps,
CASE WHEN r IS NULL AND gaps > 0 THEN greatest(2, round_even(list_sum(d) * 0.01::DOUBLE, 0)::BIGINT) END AS frames FROM g""")
def s22(spark, sf):
    return op.flatten_plan(fx.timeline(spark, sf), KEY, NO, "dur", 0.005, 2)


PTS = "p AS (SELECT clip_id, frame_no, dur, coalesce(sum(greatest(dur, 0.0::DOUBLE)) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS pts FROM v_seq)"


@query("s23_cumulative_times", f"{PTS} SELECT clip_id, frame_no::BIGINT AS frame_no, round(pts, 6) AS pts FROM p UNION ALL SELECT clip_id, count(*), round(sum(greatest(dur, 0.0::DOUBLE)), 6) FROM p GROUP BY clip_id")
def s23(spark, sf):
    return op.cumulative_times(fx.timeline(spark, sf), KEY, NO, "dur").select("clip_id", NO, r6("pts").alias("pts"))


SLOTS = f"""{PTS}, q AS (SELECT clip_id, frame_no, pts, lead(pts) OVER w AS p1, lead(frame_no) OVER w AS nxt, sum(greatest(dur, 0.0::DOUBLE)) OVER (PARTITION BY clip_id) AS stop, count(*) OVER (PARTITION BY clip_id) AS n, pts - 1e-6::DOUBLE AS at FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no)),
c0 AS (SELECT DISTINCT clip_id, stop, greatest(2, round_even(stop * (1 / 3600::DOUBLE), 0)::BIGINT) AS targets FROM q WHERE n > 1),
t AS (SELECT * FROM (SELECT clip_id, stop, unnest(range(0, targets)) AS k, k / (1 / 3600::DOUBLE) AS tt FROM c0) WHERE tt <= stop + 1e-6::DOUBLE),
j AS (SELECT t.clip_id, t.k, t.tt, q.frame_no AS i0, q.pts AS p0, q.p1, q.nxt, abs(t.tt - q.pts) <= 1e-6 OR q.nxt IS NULL OR q.p1 - q.pts <= 1e-6 AS here FROM t ASOF JOIN q ON t.clip_id = q.clip_id AND t.tt >= q.at),
f AS (SELECT *, CASE WHEN here THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (tt - p0) / (p1 - p0))) END AS f FROM j),
sl AS (SELECT clip_id, k, CASE WHEN f >= 1 - 1e-6::DOUBLE THEN nxt ELSE i0 END AS i0, here OR f >= 1 - 1e-6::DOUBLE AS exact, coalesce(nxt, i0) AS i1, CASE WHEN f >= 1 - 1e-6::DOUBLE THEN 1.0::DOUBLE ELSE f END AS phi FROM f)"""


def slots(spark, sf, values=()):
    return op.map_target_frames(fx.timeline(spark, sf), KEY, NO, "dur", RATE, values=values)


@query("s24_map_target_frames", f"{SLOTS} SELECT clip_id, k::BIGINT AS k, i0::BIGINT AS i0, i1::BIGINT AS i1, round(phi, 6) AS phi, exact FROM sl")
def s24(spark, sf):
    return slots(spark, sf).withColumn("phi", r6("phi"))


PLAN = f"""{SLOTS}, c AS (SELECT clip_id, frame_no AS i0, true AS cut FROM v_seq WHERE metric > 40),
pl AS (SELECT sl.*, coalesce(cut, false) AND i1 = i0 + 1 AS at_cut FROM sl LEFT JOIN c USING (clip_id, i0)),
pp AS (SELECT *, CASE WHEN exact OR phi <= 0 THEN i0 WHEN phi >= 1 THEN i1 WHEN at_cut AND phi < 0.5 THEN i0 WHEN at_cut THEN i1 END AS cp FROM pl)"""


def planned(spark, sf):
    return op.cut_aware_plan(slots(spark, sf, ["metric"]), F.col("metric_0") > 40, KEY, NO)


@query("s25_cut_aware_plan", f"{PLAN} SELECT clip_id, k::BIGINT AS k, cp::BIGINT AS copy, at_cut, CASE WHEN cp IS NULL THEN 'blend' ELSE 'copy' END AS action, at_cut AND cp IS NOT NULL AND NOT exact AS forced FROM pp")
def s25(spark, sf):
    return planned(spark, sf).select("clip_id", "k", "copy", "at_cut", "action", "forced")


@query("s26_blend", f"""{PLAN} SELECT pp.clip_id, k::BIGINT AS k, round(CASE WHEN cp IS NOT NULL THEN a.metric ELSE (1 - phi) * a.metric + phi * b.metric END, 6) AS metric
FROM pp JOIN v_seq a ON a.clip_id = pp.clip_id AND a.frame_no = coalesce(cp, i0) JOIN v_seq b ON b.clip_id = pp.clip_id AND b.frame_no = coalesce(cp, i1)""")
def s26(spark, sf):
    return op.blend(planned(spark, sf), None, KEY, NO, "metric").select("clip_id", "k", r6("metric").alias("metric"))


@query("s27_expand_durations", """e AS (SELECT clip_id, frame_no, dur, CASE WHEN frame_no = max(frame_no) OVER (PARTITION BY clip_id) AND (clip_id % 2 = 0 OR frame_no = 0) THEN 1 ELSE 3 END AS n FROM v_seq)
SELECT clip_id, frame_no, slot::INT AS slot, round(greatest(0.0005::DOUBLE, dur / n), 6) AS slot_dur FROM e, range(1, 4) r(slot) WHERE slot <= n""")
def s27(spark, sf):
    rows = fx.timeline(spark, sf).withColumn("last", F.col("clip_id") % 2 == 0)
    return op.expand_durations(rows, KEY, NO, "dur", 3, "last").select("clip_id", NO, "slot", r6("slot_dur").alias("slot_dur"))


@query("s28_expand_durations_exact", """e AS (SELECT clip_id, frame_no // 30 AS seg, frame_no, dur, row_number() OVER w AS i, count(*) OVER (PARTITION BY clip_id, frame_no // 30) AS len, (frame_no // 30 = max(frame_no // 30) OVER (PARTITION BY clip_id))::INT AS tail FROM v_seq WINDOW w AS (PARTITION BY clip_id, frame_no // 30 ORDER BY frame_no)),
r AS (SELECT *, (greatest(70, len) - tail) / nullif(len - tail, 0)::DOUBLE AS r FROM e), n AS (SELECT *, CASE WHEN len = 1 OR i > len - tail THEN 1 ELSE (round(i * r) - round((i - 1) * r))::INT END AS n FROM r)
SELECT clip_id, frame_no, slot::INT AS slot, round(greatest(0.0005::DOUBLE, dur / n), 6) AS slot_dur FROM n, range(1, 71) t(slot) WHERE slot <= n""")
def s28(spark, sf):
    """Segments of thirty frames into seventy slots each; only a clip's last one has a tail."""
    rows = fx.timeline(spark, sf).withColumn("seg", F.expr("frame_no div 30"))
    rows = rows.withColumn("last", F.col("seg") == F.max("seg").over(Window.partitionBy("clip_id")))
    return op.expand_durations_exact(rows, [*KEY, "seg"], NO, "dur", F.lit(70), "last").select("clip_id", NO, "slot", r6("slot_dur").alias("slot_dur"))


def segments(spark, sf):
    f = fx.frames(spark, sf).select("clip_id", NO, "gray")
    return fr.scene_segments(f, fr.detect_cuts(f, KEY, NO, "gray", 8, 8), KEY, NO)


SEG = f"""{SPACED}, s AS (SELECT v.clip_id, v.frame_no, sum(CASE WHEN k.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY v.clip_id ORDER BY v.frame_no)::INT AS segment FROM v_frames v LEFT JOIN k ON k.clip_id = v.clip_id AND k.i + 1 = v.frame_no),
g AS (SELECT clip_id, segment, count(*) AS n, segment = max(segment) OVER (PARTITION BY clip_id) AS last FROM s GROUP BY clip_id, segment)"""


@query("s29_segment_targets", f"{SEG} SELECT clip_id, segment, n, (CASE WHEN n = 1 THEN 3 WHEN last THEN (n - 1) * 3 + 1 ELSE n * 3 END)::BIGINT AS target FROM g")
def s29(spark, sf):
    return op.segment_targets(segments(spark, sf), "n", "last", 3).select("clip_id", "segment", "n", "target")


EXACT = """a AS (SELECT clip_id, frame_no // 7 AS segment, count(*) AS n FROM v_seq GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY clip_id) AS total, sum(n) OVER (PARTITION BY clip_id ORDER BY segment) AS seen FROM a),
d AS (SELECT *, CASE WHEN total <= 1 THEN NULL WHEN seen >= total THEN 260 ELSE round((seen - 1) * (259.0::DOUBLE / (total - 1)))::BIGINT + 1 END AS due FROM b),
f AS (SELECT clip_id, segment, CASE WHEN due IS NULL THEN n + 1 WHEN n = 1 THEN 1 ELSE greatest(n + 1, due) END::BIGINT AS target, CASE WHEN due IS NULL THEN n + 1 WHEN n = 1 THEN 1 ELSE greatest(n + 1, due) END::BIGINT AS made FROM d WHERE segment = 0
 UNION ALL SELECT clip_id, segment, t, made + t FROM (SELECT d.clip_id, d.segment, f.made, CASE WHEN due IS NULL THEN n + 1 WHEN n = 1 THEN 1 ELSE greatest(n + 1, due - f.made) END::BIGINT AS t FROM f JOIN d ON d.clip_id = f.clip_id AND d.segment = f.segment + 1))"""


@query("s29_segment_targets_exact", f"{EXACT} SELECT clip_id, segment::BIGINT AS segment, target FROM f")
def s29b(spark, sf):
    parts = op.fixed_segments(fx.timeline(spark, sf), KEY, NO, 7)
    return op.segment_targets_exact(parts, KEY, "segment", "n", 260)


@query("s30_expected_frames", """c AS (SELECT l_orderkey, count(*) - 1 AS n, max(l_linenumber) AS got, CASE WHEN l_orderkey % 5 = 0 THEN 9 WHEN l_orderkey % 5 = 1 THEN 0 END AS own FROM lineitem GROUP BY l_orderkey),
e AS (SELECT *, CASE WHEN own > 0 THEN own WHEN n <= 0 THEN 0 ELSE round_even((n - 1) * 2.5::DOUBLE + 1, 0)::BIGINT END AS expected FROM c)
SELECT l_orderkey, n, expected::BIGINT AS expected, expected > 0 AND abs(got - expected) > 1 AS mismatch FROM e""")
def s30(spark, sf):
    """A factor with halves, clips without frames, and overrides of 0."""
    rows = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) - 1).alias("n"), F.max("l_linenumber").alias("got"))
    own = F.when(F.col("l_orderkey") % 5 == 0, F.lit(9).cast("long")).when(F.col("l_orderkey") % 5 == 1, F.lit(0).cast("long"))
    rows = rows.withColumn("expected", op.expected_frames(F.col("n"), 2.5, own))
    return rows.select("l_orderkey", "n", "expected", op.count_mismatch(F.col("got"), F.col("expected"), 1).alias("mismatch"))


@query("s31_timestamp_collisions", """d AS (SELECT clip_id, frame_no, CASE WHEN clip_id % 7 = 3 AND frame_no = 5 THEN 0.0::DOUBLE ELSE round(dur / 36000) / 10 + 0.1::DOUBLE END AS d FROM v_seq),
h AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL OR abs(lag(d) OVER w - d) >= 1e-5 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame_no) AS run FROM h),
u AS MATERIALIZED (SELECT clip_id, run, min(frame_no) AS first, count(*) AS k, any_value(d) AS d FROM r GROUP BY ALL),
s AS (SELECT *, 0.0::DOUBLE AS begun FROM u WHERE run = 1 UNION ALL SELECT u.*, s.begun + s.d * s.k FROM s JOIN u ON u.clip_id = s.clip_id AND u.run = s.run + 1),
t AS (SELECT r.clip_id, r.frame_no, trunc((begun + (r.frame_no - s.first) * s.d) / (1.0::DOUBLE / 10))::BIGINT AS tick FROM r JOIN s USING (clip_id, run)),
c AS (SELECT clip_id, count(*) FILTER (same) AS n FROM (SELECT clip_id, tick = lag(tick) OVER (PARTITION BY clip_id ORDER BY frame_no) AS same FROM t) GROUP BY clip_id),
b AS (SELECT clip_id, bool_or(d <= 0) AS bad, greatest(1, least(100000, ceil(greatest(10.0::DOUBLE, 2 / min(d) FILTER (d > 0)))))::BIGINT AS time_base FROM d GROUP BY clip_id)
SELECT clip_id, CASE WHEN bad THEN 0 ELSE n END AS collisions, time_base FROM b JOIN c USING (clip_id)""")
def s31(spark, sf):
    """Tenths of seconds at ten ticks a second, in runs: summed up one by one they would fall on other
    ticks. Some clips have a bad duration."""
    rows = fx.timeline(spark, sf).withColumn("d", F.when((F.col("clip_id") % 7 == 3) & (F.col(NO) == 5), 0.0).otherwise(F.round(F.col("dur") / 36000) / 10 + 0.1))
    return op.timestamp_collisions(rows, KEY, NO, "d", 10.0)


@query("s32_run_length", """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, event_type AS v FROM events), c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY i) = v THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c) SELECT user_id, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS stop, count(*) AS n, min(v) AS v FROM r GROUP BY user_id, run""")
def s32(spark, sf):
    rows = fx.table(spark, sf, "events").select("user_id", (F.row_number().over(over(["user_id"], ["ts"])) - 1).cast("long").alias("i"), F.col("event_type").alias("v"))
    return op.run_length(rows, ["user_id"], "i", "v")


@query("s32_run_length_within", """a AS (SELECT clip_id, frame_no AS i, round(metric) - 1 AS v FROM v_seq WHERE clip_id NOT IN (SELECT clip_id FROM v_seq WHERE round(metric) - 1 <= 0)), f AS (SELECT clip_id, i, v AS head, i AS start FROM a WHERE i = 0
 UNION ALL SELECT a.clip_id, a.i, CASE WHEN abs(a.v - f.head) < 15 THEN f.head ELSE a.v END, CASE WHEN abs(a.v - f.head) < 15 THEN f.start ELSE a.i END FROM f JOIN a ON a.clip_id = f.clip_id AND a.i = f.i + 1),
g AS (SELECT clip_id, start::BIGINT AS start, (max(i) + 1)::BIGINT AS stop, any_value(head) AS value FROM f GROUP BY clip_id, start)
SELECT *, coalesce(sum(value * (stop - start)) OVER (PARTITION BY clip_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS "offset" FROM g""")
def s32b(spark, sf):
    """Whole numbers, so that values just as far apart as the tolerance occur; clips with one of 0 or
    less have no runs."""
    return op.run_length_within(fx.timeline(spark, sf).withColumn("metric", F.round("metric") - 1), KEY, NO, "metric", 15.0)


@query("s33_interp_layout", """n AS (SELECT clip_id, frame_no, count(*) OVER (PARTITION BY clip_id) AS pairs FROM v_seq), s AS (SELECT *, (1 + greatest(0, 199 // pairs - 1) + CASE WHEN frame_no < 199 % pairs THEN 1 ELSE 0 END)::BIGINT AS slots FROM n)
SELECT clip_id, frame_no, slots, (1 + coalesce(sum(slots) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM s""")
def s33(spark, sf):
    rows = fx.timeline(spark, sf).select("clip_id", NO, F.count(F.lit(1)).over(Window.partitionBy("clip_id")).alias("pairs"))
    return op.interp_layout(rows, KEY, NO, F.lit(200), F.col("pairs")).drop("pairs")


@query("s34_fixed_segments", "SELECT clip_id, (frame_no // 20)::BIGINT AS segment, min(frame_no) AS start, count(*) AS n FROM v_seq GROUP BY ALL")
def s34(spark, sf):
    return op.fixed_segments(fx.timeline(spark, sf), KEY, NO, 20)


@query("s34_segment_size", "SELECT o_orderkey, CASE WHEN floor(o_totalprice * 1024 * 0.65::DOUBLE / (50000 * 3)) < 50 THEN 0 ELSE least(2000, floor(o_totalprice * 1024 * 0.65::DOUBLE / (50000 * 3))) END::BIGINT AS frames FROM orders")
def s34b(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", op.segment_size(F.col("o_totalprice"), F.lit(50000), F.lit(2)).alias("frames"))


@query("s34_assign_batch", """b AS (SELECT clip_id, nb, 10 + clip_id % 3 + nb AS size, sum(10 + clip_id % 3 + nb) OVER (PARTITION BY clip_id ORDER BY nb) AS stop FROM (SELECT DISTINCT clip_id FROM v_seq), range(0, 8) t(nb))
SELECT v.clip_id, v.frame_no, nb::INT AS nb FROM v_seq v JOIN b ON b.clip_id = v.clip_id AND v.frame_no >= stop - size AND v.frame_no < stop""")
def s34c(spark, sf):
    rows = fx.timeline(spark, sf).select("clip_id", NO)
    sizes = rows.select("clip_id").distinct().withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("size", 10 + F.col("clip_id") % 3 + F.col("nb"))
    return op.assign_batch(rows, KEY, NO, sizes, "nb", "size").select("clip_id", NO, "nb")


@query("s35_spread_sample", """n AS (SELECT clip_id, frame_no, count(*) OVER (PARTITION BY clip_id) AS n FROM v_seq), t AS (SELECT DISTINCT clip_id, n, k, n // 4 AS lo, n - 1 - n // 4 AS hi FROM n, range(0, 6) r(k)),
p AS (SELECT clip_id, round(CASE WHEN hi - lo + 1 < 6 THEN k * (n - 1) / 5.0::DOUBLE ELSE lo + k * (hi - lo) / 5.0::DOUBLE END)::BIGINT AS i FROM t) SELECT clip_id, i::INT AS frame_no FROM p""")
def s35(spark, sf):
    return op.spread_sample(fx.timeline(spark, sf), KEY, NO, 6).select("clip_id", NO)
