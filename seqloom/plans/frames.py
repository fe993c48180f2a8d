"""Queries of the frame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import frames as op
from ..sources import fixtures as fx
from .registry import query

KEY, NO = ["clip_id"], "frame_no"

DIFF = "list_sum(list_transform(range(1, 65), lambda i: abs(gray[i] - prev[i])))::DOUBLE / 64"
PREV = "p AS (SELECT *, lag(gray) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prev, lag(grid_id) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prev_id, lead(frame_no) OVER (PARTITION BY clip_id ORDER BY frame_no) IS NULL AS tail FROM v_frames)"
LAP = """n AS (SELECT grid_id, y, x, 4 * v - lag(v) OVER r - lead(v) OVER r - lag(v) OVER c - lead(v) OVER c AS d FROM v_cells
    WINDOW r AS (PARTITION BY grid_id, y ORDER BY x), c AS (PARTITION BY grid_id, x ORDER BY y)),
l AS (SELECT grid_id, greatest(0.0::DOUBLE, var_pop(d)) AS lap FROM n WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY grid_id)"""
PAIRS = f"""{PREV}, {LAP},
m AS (SELECT clip_id, frame_no, {DIFF} AS diff, a.lap AS lap_prev, b.lap AS lap_cur FROM p JOIN l a ON a.grid_id = prev_id JOIN l b ON b.grid_id = p.grid_id WHERE prev IS NOT NULL)"""
CUT = "CASE WHEN diff < 25 THEN false WHEN diff >= 50 THEN true WHEN lap_prev > 0 AND lap_cur >= 0 THEN lap_cur / lap_prev <= 0.6 ELSE true END"
SPACED = f"""{PAIRS}, f AS (SELECT clip_id, frame_no - 1 AS i FROM m WHERE {CUT}),
k AS (SELECT clip_id, min(i) AS i FROM f GROUP BY clip_id UNION ALL SELECT k.clip_id, min(f.i) AS i FROM k JOIN f ON f.clip_id = k.clip_id AND f.i >= k.i + 15 GROUP BY k.clip_id)"""


@query("s01_pair_diff", f"{PREV} SELECT clip_id, frame_no, round(CASE WHEN prev IS NOT NULL THEN {DIFF} END, 6) AS diff FROM p")
def s01(spark, sf):
    return op.pair_diff(fx.frames(spark, sf), KEY, [NO], "gray").select("clip_id", NO, r6("diff").alias("diff"))


@query("s02_lap_var", f"{LAP} SELECT grid_id, round(lap, 6) AS lap FROM l")
def s02(spark, sf):
    return fx.frames(spark, sf).select("grid_id", r6(op.lap_var(F.col("gray"), 8, 8)).alias("lap"))


@query("s03_measure_pairs", f"{PAIRS} SELECT clip_id, frame_no, round(diff, 6) AS diff, round(lap_prev, 6) AS lap_prev, round(lap_cur, 6) AS lap_cur FROM m")
def s03(spark, sf):
    return op.measure_pairs(fx.frames(spark, sf), KEY, [NO], "gray", 8, 8).select("clip_id", NO, *[r6(c).alias(c) for c in ("diff", "lap_prev", "lap_cur")])


@query("s04_is_cut", f"{PAIRS} SELECT clip_id, frame_no, {CUT} AS cut FROM m")
def s04(spark, sf):
    pairs = op.measure_pairs(fx.frames(spark, sf), KEY, [NO], "gray", 8, 8)
    return pairs.select("clip_id", NO, op.is_cut(F.col("diff"), F.col("lap_prev"), F.col("lap_cur")).alias("cut"))


@query("s05_min_spacing", """f AS (SELECT clip_id, frame_no AS i FROM v_seq WHERE metric > 40),
k AS (SELECT clip_id, min(i) AS i FROM f GROUP BY clip_id UNION ALL SELECT k.clip_id, min(f.i) AS i FROM k JOIN f ON f.clip_id = k.clip_id AND f.i >= k.i + 5 GROUP BY k.clip_id)
SELECT clip_id, i AS frame_no FROM k""")
def s05(spark, sf):
    rows = fx.timeline(spark, sf).withColumn("flag", F.col("metric") > 40)
    return op.min_spacing(rows, KEY, NO, "flag", 5)


@query("s06_detect_cuts", f"{SPACED} SELECT clip_id, i AS frame_no FROM k")
def s06(spark, sf):
    return op.detect_cuts(fx.frames(spark, sf), KEY, NO, "gray", 8, 8)


@query("s07_scene_segments", f"""{SPACED}, s AS (SELECT v.clip_id, v.frame_no, sum(CASE WHEN k.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY v.clip_id ORDER BY v.frame_no)::INT AS segment
    FROM v_frames v LEFT JOIN k ON k.clip_id = v.clip_id AND k.i + 1 = v.frame_no)
SELECT clip_id, segment, min(frame_no) AS start, count(*) AS n, segment = max(segment) OVER (PARTITION BY clip_id) AS last FROM s GROUP BY clip_id, segment""")
def s07(spark, sf):
    f = fx.frames(spark, sf).select("clip_id", NO, "gray")
    return op.scene_segments(f, op.detect_cuts(f, KEY, NO, "gray", 8, 8), KEY, NO)


def samples(spark, sf, base=380):
    return fx.rgb(spark, sf).select("grid_id", "y", "x", (F.col("r") + F.col("g") + F.col("b") - base).alias("sum_rgb"))


def _dark(base=380, extra=""):
    return f"SELECT grid_id{extra}, count(*) FILTER (r + g + b - {base} < 24) AS n_dark, count(*) AS n, n_dark >= 0.95 * n AS dark FROM v_rgb GROUP BY ALL"


def _defect(base):
    return f"SELECT grid_id, count(*) FILTER (r + g + b - {base} < 24) >= 0.95 * count(*) OR any_value(bd) AS defective FROM v_rgb JOIN (SELECT grid_id, bool_or(dark) AS bd FROM ({_dark(base, ', CASE WHEN y < 2 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END AS band')}) GROUP BY grid_id) USING (grid_id) GROUP BY grid_id"


@query("s08_near_black", _dark())
def s08(spark, sf):
    return op.near_black(samples(spark, sf), ["grid_id"])


@query("s09_band_black", """b AS (SELECT grid_id, CASE WHEN y < 2 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END AS band, count(*) AS n, count(*) FILTER (r + g + b - 380 < 24) AS dark FROM v_rgb WHERE r + g + b - 380 < 250 GROUP BY ALL)
SELECT grid_id, sum(n) >= 64 AND bool_or(dark >= 0.95 * n) AS band_dark FROM b GROUP BY grid_id""")
def s09(spark, sf):
    """Samples near white are missing, and frames that lack any are not called dark."""
    return op.band_black(samples(spark, sf).where("sum_rgb < 250"), ["grid_id"], 8, 8)


@query("s10_defective_frame", _defect(420))
def s10(spark, sf):
    return op.defective_frames(samples(spark, sf, 420), ["grid_id"], 8, 8)


@query("s11_silent_failure", f"SELECT o.grid_id FROM ({_defect(430)}) o JOIN ({_defect(400)}) i USING (grid_id) WHERE o.defective AND NOT i.defective")
def s11(spark, sf):
    made = op.defective_frames(samples(spark, sf, 430), ["grid_id"], 8, 8)
    return op.silent_failures(op.defective_frames(samples(spark, sf, 400), ["grid_id"], 8, 8), made, ["grid_id"])


@query("s12_sample_grid", """SELECT p_partkey, greatest(4, least(p_size, 40) // 32)::INT AS step, len(range(step, 40, step))::INT AS rows, gy::INT AS gy, gx::INT AS gx
FROM part, (SELECT unnest(range(0, 200)) AS gy), (SELECT unnest(range(0, 200)) AS gx)
WHERE gy >= step AND gy < 40 AND (gy - step) % step = 0 AND gx >= step AND gx < p_size AND (gx - step) % step = 0""")
def s12(spark, sf):
    return op.sample_grid(fx.table(spark, sf, "part").select("p_partkey", "p_size", F.lit(40).alias("h")), "p_size", "h").select("p_partkey", "step", "rows", "gy", "gx")


STATS = "s AS (SELECT grid_id // 100000 AS clip, grid_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, greatest(0.0::DOUBLE, sum(r * r + g * g + b * b) / (3 * count(*)) - ((avg(r) + avg(g) + avg(b)) / 3) ** 2) AS var FROM v_rgb GROUP BY ALL)"


@query("s13_frame_stats", f"{STATS} SELECT grid_id, round(mr, 6) AS mean_r, round(mg, 6) AS mean_g, round(mb, 6) AS mean_b, round(var, 6) AS var, greatest(mr, mg, mb) - least(mr, mg, mb) <= 12 AS achromatic FROM s")
def s13(spark, sf):
    return op.frame_stats(fx.rgb(spark, sf), ["grid_id"]).select("grid_id", *[r6(c).alias(c) for c in ("mean_r", "mean_g", "mean_b", "var")], op.is_achromatic().alias("achromatic"))


@query("s13_plausible_between", f"""{STATS}, w AS (SELECT *, (mr + mg + mb) / 3 AS level FROM s),
e AS (SELECT *, (lag(level) OVER q + lead(level) OVER q) / 2 AS wl, (lag(var) OVER q + lead(var) OVER q) / 2 AS wv FROM w WINDOW q AS (PARTITION BY clip ORDER BY grid_id))
SELECT clip, grid_id, greatest(mr, mg, mb) - least(mr, mg, mb) <= 12 AND abs(level - wl) <= 24 AND NOT (wv > 0 AND var < 0.25 * wv) AS plausible FROM e WHERE wl IS NOT NULL""")
def s13b(spark, sf):
    stats = op.frame_stats(fx.rgb(spark, sf), ["grid_id"]).withColumn("clip", F.expr("grid_id div 100000"))
    return op.plausible_between(stats, ["clip"], ["grid_id"]).select("clip", "grid_id", "plausible")


def sql_box3(src, cols, keep):
    """Two nested selects: the 3-mean along rows, then along columns."""
    inner = ", ".join(f"(coalesce(lag({c}) OVER r, {c}) + {c} + coalesce(lead({c}) OVER r, {c})) / 3 AS {c}_h" for c in cols)
    outer = ", ".join(f"(coalesce(lag({c}_h) OVER c, {c}_h) + {c}_h + coalesce(lead({c}_h) OVER c, {c}_h)) / 3 AS {c}_m" for c in cols)
    return f"(SELECT *, {outer} FROM (SELECT {keep}, {inner} FROM {src} WINDOW r AS (PARTITION BY grid_id, y ORDER BY x)) WINDOW c AS (PARTITION BY grid_id, x ORDER BY y))"


GRAIN = f"""sq AS (SELECT *, v * v AS q FROM v_cells), lv AS (SELECT grid_id, greatest(0.0::DOUBLE, q_m - v_m * v_m) AS d FROM {sql_box3('sq', ['v', 'q'], 'grid_id, y, x, v, q')}),
lim AS (SELECT grid_id, list_sort(list(d))[(count(*) * 0.2)::DOUBLE::INT - CASE WHEN (count(*) * 0.2)::DOUBLE::INT > count(*) * 0.2 THEN 1 ELSE 0 END + 1] AS cap FROM lv GROUP BY grid_id),
gr AS (SELECT grid_id, sqrt(avg(d)) AS grain FROM lv JOIN lim USING (grid_id) WHERE d <= cap GROUP BY grid_id)"""
BLOCK = """st AS (SELECT grid_id, x % 4 = 3 AS edge, abs(lead(v) OVER (PARTITION BY grid_id, y ORDER BY x) - v) AS s FROM v_cells),
bl AS (SELECT grid_id, CASE WHEN avg(s) FILTER (NOT edge) > 1e-9 THEN avg(s) FILTER (edge) / avg(s) FILTER (NOT edge) END AS blocking FROM st WHERE s IS NOT NULL GROUP BY grid_id)"""
FLICK = """fc AS (SELECT clip_id, frame_no, grid_id, y, x, v FROM v_cells JOIN v_frames USING (grid_id)),
sd AS (SELECT clip_id, frame_no // 5 AS burst, y, x, stddev_pop(v) AS sd, count(*) AS nf FROM fc GROUP BY ALL),
sl AS (SELECT clip_id, burst, list_sort(list(sd))[floor(count(*) * 0.25)::INT + 1] AS cap FROM sd WHERE nf >= 3 GROUP BY ALL),
fl AS (SELECT clip_id, burst, avg(sd) AS flicker FROM sd JOIN sl USING (clip_id, burst) WHERE sd <= cap GROUP BY ALL)"""


@query("s14_grain", f"{GRAIN} SELECT grid_id, round(grain, 6) AS grain FROM gr")
def s14(spark, sf):
    return op.grain(fx.cells(spark, sf), ["grid_id"]).select("grid_id", r6("grain").alias("grain"))


@query("s15_blocking", f"{BLOCK} SELECT grid_id, round(blocking, 6) AS blocking FROM bl")
def s15(spark, sf):
    return op.blocking(fx.cells(spark, sf), ["grid_id"], 4).select("grid_id", r6("blocking").alias("blocking"))


def frame_cells(spark, sf):
    return fx.frames(spark, sf).select("clip_id", NO, F.posexplode("gray").alias("pos", "v")).select("clip_id", NO, F.expr("cast(pos div 8 AS int)").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("v"))


@query("s16_flicker", f"{FLICK} SELECT clip_id, burst, round(flicker, 6) AS flicker FROM fl")
def s16(spark, sf):
    cells = frame_cells(spark, sf).withColumn("burst", F.expr("frame_no div 5"))
    size = cells.groupBy("clip_id", "burst").agg(F.count_distinct(NO).alias("n")).where("n >= 3")
    return op.flicker(cells, ["clip_id", "burst"], order=NO).join(size, ["clip_id", "burst"], "left_semi").select("clip_id", "burst", r6("flicker").alias("flicker"))


@query("s16_noise_probe", f"""{GRAIN}, {BLOCK}, ok AS (SELECT clip_id, grid_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) - 1 AS i FROM v_frames WHERE list_max(gray) < 240),
sd AS (SELECT clip_id, i // 5 AS burst, y, x, stddev_pop(v) AS sd, count(*) AS nf FROM v_cells JOIN ok USING (grid_id) GROUP BY ALL), sl AS (SELECT clip_id, burst, list_sort(list(sd))[floor(count(*) * 0.25)::INT + 1] AS cap FROM sd WHERE nf >= 3 GROUP BY ALL),
fl AS (SELECT clip_id, burst, avg(sd) AS flicker FROM sd JOIN sl USING (clip_id, burst) WHERE sd <= cap GROUP BY ALL),
g AS (SELECT clip_id, avg(grain) AS grain, avg(blocking) AS blocking, count(*) AS n_frames FROM ok JOIN gr USING (grid_id) JOIN bl USING (grid_id) GROUP BY clip_id HAVING count(*) >= 3)
SELECT clip_id, round(grain, 6) AS grain, round(blocking, 6) AS blocking, round(coalesce((SELECT avg(flicker) FROM fl WHERE fl.clip_id = g.clip_id), 0.0::DOUBLE), 6) AS flicker, n_frames, CASE WHEN grain < 2.2 THEN 0 WHEN grain < 5 THEN 1 ELSE 2 END AS level FROM g""")
def s16b(spark, sf):
    """Cells near white are missing, and frames that lack any are left out."""
    return op.noise_probe(frame_cells(spark, sf).where("v < 240"), KEY, NO, 8, 8, burst=5, block=4).select("clip_id", *[r6(c).alias(c) for c in ("grain", "blocking", "flicker")], "n_frames", "level")


SSIM = """list_avg(gray) AS ma, list_avg(prev) AS mb"""


@query("s17_dedup_adjacent", f"""{PREV}, q AS (SELECT clip_id, frame_no, tail, prev, gray, {DIFF} AS diff, list_aggregate(gray, 'avg') AS ma, list_aggregate(prev, 'avg') AS mb, list_aggregate(gray, 'var_pop') AS va, list_aggregate(prev, 'var_pop') AS vb FROM p),
z AS (SELECT *, list_sum(list_transform(range(1, 65), lambda i: (gray[i] - ma) * (prev[i] - mb))) / 64 AS cov FROM q)
SELECT clip_id, frame_no, tail OR prev IS NULL OR NOT (diff < 36 AND (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) >= 0.1) AS keep FROM z""")
def s17(spark, sf):
    f = fx.frames(spark, sf).withColumn("gray", F.col("gray").cast("array<double>"))
    return op.dedup_adjacent(f, KEY, [NO], "gray", 36, 0.1).select("clip_id", NO, "keep")


def _like(a, b):
    """Whether lists a and b of 64 values are one frame: small difference, and similarity over the whole."""
    ma, mb = f"list_avg({a})", f"list_avg({b})"
    cov = f"(list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))::DOUBLE / 64 - {ma} * {mb})"
    return f"""list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i])))::DOUBLE / 64 < 36 AND
 (2 * {ma} * {mb} + 6.5025) * (2 * {cov} + 58.5225) / (({ma} * {ma} + {mb} * {mb} + 6.5025) * (list_var_pop({a}) + list_var_pop({b}) + 58.5225)) >= 0.1"""


@query("s17_dedup_frames", f"""n AS MATERIALIZED (SELECT clip_id, frame_no, gray, frame_no = max(frame_no) OVER (PARTITION BY clip_id) AS tail FROM v_frames),
f AS (SELECT clip_id, frame_no, gray AS held, true AS keep FROM n WHERE frame_no = 0
 UNION ALL SELECT clip_id, frame_no, CASE WHEN keep THEN gray ELSE held END, keep FROM (SELECT n.clip_id, n.frame_no, n.gray, f.held, n.tail OR NOT ({_like('n.gray', 'f.held')}) AS keep FROM f JOIN n ON n.clip_id = f.clip_id AND n.frame_no = f.frame_no + 1))
SELECT clip_id, frame_no, keep FROM f""")
def s17b(spark, sf):
    return op.dedup_frames(fx.frames(spark, sf), KEY, NO, "gray", 36, 0.1)


def _diff(a, b):
    return f"(list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i])))::DOUBLE / 64)"


def _moving(a, b):
    """Share of the four blocks of 4 x 4 whose mean absolute difference reaches 36."""
    blocks = [f"(list_sum(list_transform([{', '.join(str(1 + y * 8 + x) for y in range(by, by + 4) for x in range(bx, bx + 4))}], lambda i: abs({a}[i] - {b}[i])))::DOUBLE / 16 >= 36)::INT" for by in (0, 4) for bx in (0, 4)]
    return f"(({' + '.join(blocks)}) / 4.0::DOUBLE)"


_SEGMENTS = f"""n AS MATERIALIZED (SELECT clip_id, frame_no, gray, frame_no = max(frame_no) OVER (PARTITION BY clip_id) AS tail FROM v_frames),
f AS (SELECT clip_id, frame_no, gray AS held, gray AS head, 0 AS segment, 1.0::DOUBLE AS moving, true AS keep FROM n WHERE frame_no = 0
 UNION ALL SELECT clip_id, frame_no, CASE WHEN keep THEN gray ELSE held END, CASE WHEN keep AND fresh THEN gray ELSE head END, segment + (keep AND fresh)::INT, moving, keep FROM (
 SELECT *, tail OR NOT (alike AND moving < 0.75) AS keep, away >= 38 OR drift >= 0.75 AS fresh FROM (
 SELECT n.clip_id, n.frame_no, n.gray, n.tail, f.held, f.head, f.segment, {_like('n.gray', 'f.held')} AS alike, {_moving('n.gray', 'f.held')} AS moving, {_diff('n.gray', 'f.head')} AS away, {_moving('n.gray', 'f.head')} AS drift FROM f JOIN n ON n.clip_id = f.clip_id AND n.frame_no = f.frame_no + 1)))"""


def segmented(spark, sf):
    return op.dedup_segments(fx.frames(spark, sf), KEY, NO, "gray", 8, 36, 0.1, 0.75, 38, block=4)


@query("s17_dedup_segments", f"{_SEGMENTS} SELECT clip_id, frame_no, moving, keep, segment::BIGINT AS segment FROM f")
def s17c(spark, sf):
    return segmented(spark, sf)


@query("s17_still_segments", f"{_SEGMENTS} SELECT clip_id, segment::BIGINT AS segment, min(frame_no) AS start, max(frame_no) AS stop, count(*) AS n, count(*) FILTER (keep) AS kept FROM f GROUP BY ALL")
def s17d(spark, sf):
    return op.still_segments(segmented(spark, sf), KEY, NO)
