"""Queries of the grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import frames as fr
from ..operators import grids as op
from ..sources import fixtures as fx
from .registry import query

G = ["grid_id"]
AT = "grid_id, y, x"


def passes(src, cols, rule, keep=AT, times=1):
    """SQL of a rule along rows, then columns. ``rule`` has {v} and {w}."""
    for _ in range(times):
        for by in ("grid_id, y ORDER BY x", "grid_id, x ORDER BY y"):
            made = ", ".join(rule.replace("{v}", c).replace("{w}", f"(PARTITION BY {by})").replace("{p}", f"PARTITION BY {by}") + f" AS {c}" for c in cols)
            src = f"(SELECT {keep}, {made} FROM {src})"
    return src


BYTES = "floor((sum({v}) OVER ({p} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 1) / count(*) OVER ({p} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
BYTE = "greatest(0, least(255, round_even({}, 0)))"
LUMA = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
NEAR = "(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)"


def nine(src, col, name="nn"):
    """A CTE: the nine values around each pixel by a join on clamped places."""
    return f"{name} AS (SELECT a.grid_id, a.y, a.x, list(b.{col} ORDER BY d.dy, d.dx) AS n FROM {src} a, (VALUES {NEAR}) d(dy, dx), {src} b WHERE b.grid_id = a.grid_id AND b.y = greatest(0, least(7, a.y + d.dy)) AND b.x = greatest(0, least(7, a.x + d.dx)) GROUP BY ALL)"


def out(df, cols=("v",)):
    return df.select("grid_id", "y", "x", *[r6(c).alias(c) for c in cols])


RGB = ("r", "g", "b")


@query("d01_box3", f"SELECT {AT}, round(v, 6) AS v FROM {passes('v_cells', ['v'], '((coalesce(lag({v}) OVER {w}, {v}) + {v} + coalesce(lead({v}) OVER {w}, {v})) / 3)')}")
def d01(spark, sf):
    return out(op.box3(fx.cells(spark, sf), G))


@query("d02_box_mean", f"SELECT {AT}, round(v, 6) AS v FROM {passes('v_cells', ['v'], '(avg({v}) OVER ({p} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))')}")
def d02(spark, sf):
    return out(op.box_mean(fx.cells(spark, sf), G, 2))


@query("d03_box3_bytes", f"SELECT {AT}, v FROM {passes('v_cells', ['v'], BYTES, times=3)}")
def d03(spark, sf):
    return out(op.box3_bytes(fx.cells(spark, sf), G, 3))


MIN = "(min({v}) OVER ({p} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"


@query("d04_erode", f"SELECT {AT}, v FROM {passes('v_cells', ['v'], MIN)}")
def d04a(spark, sf):
    return op.erode(fx.cells(spark, sf), G, 1)


@query("d04_open", f"SELECT {AT}, v FROM {passes(passes('v_cells', ['v'], MIN), ['v'], MIN.replace('min', 'max'))}")
def d04b(spark, sf):
    return op.opened(fx.cells(spark, sf), G, 1)


STRETCH = "(SELECT grid_id, y, x, CASE WHEN v <= 0.3 THEN 0.0::DOUBLE WHEN v >= 0.7 THEN 1.0::DOUBLE ELSE (v - 0.3::DOUBLE) / (0.7::DOUBLE - 0.3::DOUBLE) END AS v FROM v_alpha)"
MEAN1 = "(avg({v}) OVER ({p} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"


@query("d05_alpha_stretch", f"SELECT {AT}, round(v, 6) AS v FROM {passes(passes(passes(STRETCH, ['v'], MEAN1), ['v'], MIN), ['v'], MIN.replace('min', 'max'))}")
def d05(spark, sf):
    return out(op.alpha_stretch(fx.alpha(spark, sf), G, 0.7, 0.3, feather=1, morph=10))


@query("d06_composite", f"SELECT {AT}, " + ", ".join(f"greatest(0, least(255, floor(v / 255 * {c} + (1 - v / 255) * (255 - {c}) + 0.5)))::DOUBLE AS {c}" for c in RGB) + " FROM (SELECT grid_id, y, x, r, g, b, (r * 3 + g * 5 + b * 7) % 256 AS v FROM v_rgb)")
def d06(spark, sf):
    rgb = fx.rgb(spark, sf)
    alpha = rgb.select("grid_id", "y", "x", (((F.col("r") * 3 + F.col("g") * 5 + F.col("b") * 7) % 256) / 255).alias("v"))
    return op.composite(rgb, alpha, rgb.withColumns({c: 255 - F.col(c) for c in RGB}), G)


@query("d07_otsu", """e AS (SELECT grid_id, CASE WHEN grid_id % 13 = 5 THEN NULL WHEN grid_id % 13 = 7 THEN 0.2::DOUBLE ELSE v END AS v FROM v_alpha),
p AS (SELECT grid_id, t, count(*) FILTER (b <= t) AS wb, count(*) FILTER (b > t) AS wf, avg(b) FILTER (b <= t) AS mb, avg(b) FILTER (b > t) AS mf FROM (SELECT grid_id, floor(v * 255 + 0.5)::BIGINT AS b FROM e WHERE v IS NOT NULL), range(0, 256) r(t) GROUP BY ALL),
b AS (SELECT grid_id, arg_max(t, (wb::DOUBLE * wf * (mb - mf) * (mb - mf), -t)) FILTER (wb > 0 AND wf > 0) AS best, true AS has FROM p GROUP BY grid_id),
f AS (SELECT grid_id, CASE WHEN has THEN coalesce(best, 128) END AS threshold FROM (SELECT DISTINCT grid_id FROM e) LEFT JOIN b USING (grid_id)),
l AS (SELECT *, CASE WHEN threshold IS NULL THEN 0.78::DOUBLE ELSE greatest(0.35::DOUBLE, least(0.95::DOUBLE, threshold / 255)) END AS fg FROM f)
SELECT grid_id, threshold, round(fg, 6) AS fg, round(CASE WHEN threshold IS NULL THEN 0.42::DOUBLE ELSE greatest(0.03::DOUBLE, least(0.85::DOUBLE, fg - 0.14::DOUBLE)) END, 6) AS bg FROM l""")
def d07(spark, sf):
    """Some grids hold no value and some a single one."""
    kind = F.col("grid_id") % 13
    cells = fx.alpha(spark, sf).withColumn("v", F.when(kind == 7, 0.2).when(kind != 5, F.col("v")))
    return op.otsu(cells, G).select("grid_id", "threshold", r6("fg").alias("fg"), r6("bg").alias("bg"))


_M = "(SELECT grid_id, ty, tx, bin, m FROM maps)"


@query("d08_tile_equalise", f"""l AS (SELECT *, {BYTE.format(LUMA)}::INT AS lum FROM v_rgb), h AS (SELECT grid_id, y // 4 AS ty, x // 4 AS tx, lum AS bin, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT grid_id, ty, tx, sum(n) AS cnt, sum(greatest(n - 1, 0)) AS excess FROM h GROUP BY ALL),
lv AS (SELECT t.*, k AS bin, least(coalesce(n, 0), 1) AS kept FROM t CROSS JOIN range(0, 256) r(k) LEFT JOIN h ON h.grid_id = t.grid_id AND h.ty = t.ty AND h.tx = t.tx AND h.bin = k),
maps AS (SELECT grid_id, ty, tx, bin, {BYTE.format("(sum(kept) OVER (PARTITION BY grid_id, ty, tx ORDER BY bin) + (bin + 1) * (excess // 256) + least(bin + 1, excess % 256)) * 255.0::DOUBLE / cnt")} AS m FROM lv),
f AS (SELECT *, (y - 2.0::DOUBLE) / 4 AS fy, (x - 2.0::DOUBLE) / 4 AS fx FROM l), w AS (SELECT *, fy - floor(fy) AS wy, fx - floor(fx) AS wx,
 greatest(0, least(1, floor(fy)))::INT AS ya, greatest(0, least(1, floor(fy) + 1))::INT AS yb, greatest(0, least(1, floor(fx)))::INT AS xa, greatest(0, least(1, floor(fx) + 1))::INT AS xb FROM f),
n AS (SELECT w.*, ((p.m * (1 - wx) + q.m * wx) * (1 - wy) + (s.m * (1 - wx) + u.m * wx) * wy) / greatest(1.0::DOUBLE, lum) AS sc FROM w
 JOIN maps p ON p.grid_id = w.grid_id AND p.ty = ya AND p.tx = xa AND p.bin = lum JOIN maps q ON q.grid_id = w.grid_id AND q.ty = ya AND q.tx = xb AND q.bin = lum
 JOIN maps s ON s.grid_id = w.grid_id AND s.ty = yb AND s.tx = xa AND s.bin = lum JOIN maps u ON u.grid_id = w.grid_id AND u.ty = yb AND u.tx = xb AND u.bin = lum)
SELECT {AT}, """ + ", ".join(BYTE.format(f"{c} + (round_even({c} * sc, 0) - {c}) * 0.16::DOUBLE") + f"::DOUBLE AS {c}" for c in RGB) + " FROM n")
def d08(spark, sf):
    return out(op.tile_equalise(fx.rgb(spark, sf), G, 8, 8, 80, tiles=2, least_side=8), RGB)


MIN2 = "(min({v}) OVER ({p} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"


@query("d09_dehaze", f"""d AS (SELECT grid_id, y, x, least(r, g, b) AS v FROM v_rgb), e AS (SELECT * FROM {passes('d', ['v'], MIN2, times=6)}),
a AS (SELECT grid_id, r AS ar, g AS ag, b AS ab FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY v DESC, y, x) AS k FROM v_rgb JOIN e USING (grid_id, y, x)) WHERE k = 1),
t AS (SELECT *, greatest(0.868::DOUBLE, least(1.0::DOUBLE, 1.0 - 0.95::DOUBLE * least(1.0::DOUBLE, v / (255.0 * 0.9::DOUBLE + 1.0)))) AS t FROM v_rgb JOIN e USING (grid_id, y, x) JOIN a USING (grid_id))
SELECT {AT}, """ + ", ".join(f"greatest(0, least(255, trunc({c} * (1 - 0.33::DOUBLE) + trunc(({c} - 0.33::DOUBLE * a{c}) / t) * 0.33::DOUBLE)))::DOUBLE AS {c}" for c in RGB) + " FROM t")
def d09(spark, sf):
    return out(op.dehaze(fx.rgb(spark, sf), G, 60), RGB)


@query("d10_median3", f"{nine('v_cells', 'v')}, m AS (SELECT grid_id, y, x, list_sort(n)[5] AS v FROM nn), {nine('m', 'v', 'n2')} SELECT {AT}, {BYTE.format('v + (list_sort(n)[5] - v) * 0.7::DOUBLE')}::DOUBLE AS v FROM n2 JOIN v_cells USING ({AT})")
def d10(spark, sf):
    return out(op.median3(fx.cells(spark, sf), G, 70, ["v"]))


@query("d11_unsharp", f"bl AS MATERIALIZED (SELECT grid_id, y, x, v AS s FROM {passes('v_cells', ['v'], BYTES, times=2)}) SELECT {AT}, (CASE WHEN abs(v - s) > 5 THEN greatest(0, least(255, trunc(v + 1.5::DOUBLE * (v - s)))) ELSE v END)::DOUBLE AS v FROM v_cells JOIN bl USING ({AT})")
def d11(spark, sf):
    return out(op.unsharp(fx.cells(spark, sf), G, 1.5, 5, 2))


@query("d12_midtone_clarity", f"bl AS (SELECT grid_id, y, x, r AS sr, g AS sg, b AS sb FROM {passes('v_rgb', RGB, BYTES, times=8)}), k AS (SELECT *, 0.8::DOUBLE * 0.5 * greatest(0.0::DOUBLE, 1 - (abs({LUMA} - 128) / 140) * (abs({LUMA} - 128) / 140)) AS k FROM v_rgb JOIN bl USING ({AT})) SELECT {AT}, " + ", ".join(BYTE.format(f"{c} + k * ({c} - s{c})") + f"::DOUBLE AS {c}" for c in RGB) + " FROM k")
def d12(spark, sf):
    return out(op.midtone_clarity(fx.rgb(spark, sf), G, 0.8), RGB)


INNER = "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"


@query("d13_high_freq_boost", f"{nine('v_cells', 'v')}, h AS (SELECT *, v - list_sum(n) / 9 AS hp FROM nn JOIN v_cells USING ({AT})) SELECT {AT}, (CASE WHEN {INNER} THEN {BYTE.format('v + 1.2::DOUBLE * hp * CASE WHEN abs(hp) > 4 THEN (abs(hp) - 4) / abs(hp) ELSE 0 END')} ELSE v END)::DOUBLE AS v FROM h")
def d13(spark, sf):
    return out(op.high_freq_boost(fx.cells(spark, sf), G, 8, 8, 1.2))


EDGE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, sqrt((n[3] + 2 * n[6] + n[9] - n[1] - 2 * n[4] - n[7]) ** 2 + (n[7] + 2 * n[8] + n[9] - n[1] - 2 * n[2] - n[3]) ** 2) / 4 / 48))"


@query("d14_edge_gated_sharpen", f"l AS (SELECT grid_id, y, x, {BYTE.format(LUMA)}::DOUBLE AS v FROM v_rgb), bl AS (SELECT * FROM {passes('l', ['v'], BYTES, times=2)}), {nine('bl', 'v')}, k AS (SELECT r.*, 0.9::DOUBLE * 1.5 * (l.v - bl.v) * (0.25 + 0.75 * {EDGE}) AS k FROM v_rgb r JOIN l USING ({AT}) JOIN bl USING ({AT}) JOIN nn USING ({AT})) SELECT {AT}, " + ", ".join(f"(CASE WHEN {INNER} THEN {BYTE.format(f'{c} + k')} ELSE {c} END)::DOUBLE AS {c}" for c in RGB) + " FROM k")
def d14(spark, sf):
    return out(op.edge_gated_sharpen(fx.rgb(spark, sf), G, 8, 8, 0.9), RGB)


@query("d14_edge_enhance", f"l AS (SELECT grid_id, y, x, {BYTE.format(LUMA)}::DOUBLE AS v FROM v_rgb), bl AS (SELECT * FROM {passes('l', ['v'], BYTES)}), {nine('bl', 'v')}, " + ", ".join(nine("v_rgb", c, f"n{c}") for c in RGB) + f", k AS (SELECT r.*, {EDGE.replace('n[', 'nn.n[')} AS w, " + ", ".join(f"(9 * {c} - list_sum(n{c}.n)) / 8 AS l{c}" for c in RGB) + f" FROM v_rgb r JOIN nn USING ({AT}) JOIN nr USING ({AT}) JOIN ng USING ({AT}) JOIN nb USING ({AT})) SELECT {AT}, " + ", ".join(f"(CASE WHEN {INNER} THEN {BYTE.format(f'{c} + 0.9::DOUBLE * 0.5 * l{c} * w')} ELSE {c} END)::DOUBLE AS {c}" for c in RGB) + " FROM k")
def d14b(spark, sf):
    return out(op.edge_enhance(fx.rgb(spark, sf), G, 8, 8, 0.9), RGB)


@query("d15_edge_smooth", f"{nine('v_cells', 'v')} SELECT {AT}, (CASE WHEN list_max(n) - v >= 16 OR v - list_min(n) >= 16 THEN greatest(0, least(255, v + round_even((floor(list_sum(n) / 9) - v) * (60 / 100::DOUBLE * 0.55::DOUBLE), 0))) ELSE v END)::DOUBLE AS v FROM nn JOIN v_cells USING ({AT})")
def d15(spark, sf):
    return out(op.edge_smooth(fx.cells(spark, sf), G, 60))


@query("d16_temporal_smooth", """p AS (SELECT clip_id, frame_no, grid_id, gray, lag(gray) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prev FROM v_frames),
a AS (SELECT p.clip_id, p.frame_no, c.y, c.x, c.v, coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(gray[i] - prev[i])))::DOUBLE / 64 >= 36, false) AS reset FROM p JOIN v_alpha c USING (grid_id)),
f AS (SELECT clip_id, y, x, frame_no, v AS o, v AS raw FROM a WHERE frame_no = 0 UNION ALL SELECT a.clip_id, a.y, a.x, a.frame_no, CASE WHEN a.reset OR a.v <= 0.001 OR a.v >= 0.999 OR f.o <= 0.001 OR f.o >= 0.999 THEN a.v
 ELSE f.o + (a.v - f.o) * (1 - 0.63::DOUBLE * (1 - least(1.0::DOUBLE, 3.5 * abs(a.v - f.raw)))) END, a.v FROM f JOIN a ON a.clip_id = f.clip_id AND a.y = f.y AND a.x = f.x AND a.frame_no = f.frame_no + 1)
SELECT clip_id, y, x, frame_no::BIGINT AS frame_no, round(o, 6) AS v FROM f""")
def d16(spark, sf):
    f = fr.pair_diff(fx.frames(spark, sf), ["clip_id"], ["frame_no"], "gray").withColumn("reset", F.coalesce(F.col("diff") >= 36, F.lit(False)))
    cells = f.select("clip_id", "frame_no", "reset", F.posexplode("gray").alias("pos", "v")).select("clip_id", "frame_no", "reset", F.expr("cast(pos div 8 AS int)").alias("y"), (F.col("pos") % 8).alias("x"), (F.col("v") / 255).alias("v"))
    return op.temporal_smooth(cells, ["clip_id"], "frame_no", "reset", 70).withColumn("v", r6("v"))


TILES = "t AS (SELECT c.grid_id, c.y, c.x, ty, tx, c.y - ty * 2 AS py, c.x - tx * 2 AS px, least(255, v + tx * 3 + ty * 5) AS v FROM v_cells c, range(0, 4) a(ty), range(0, 4) b(tx) WHERE c.y BETWEEN ty * 2 AND ty * 2 + 3 AND c.x BETWEEN tx * 2 AND tx * 2 + 3)"


def tiles(spark, sf):
    return op.tile_split(fx.cells(spark, sf), 8, 8, 4, 2, least_stride=2).withColumn("v", F.least(F.lit(255.0), F.col("v") + F.col("tx") * 3 + F.col("ty") * 5))


@query("d17_tile_split", f"{TILES} SELECT grid_id, y, x, ty, tx, py::BIGINT AS py, px::BIGINT AS px, v FROM t")
def d17(spark, sf):
    return tiles(spark, sf).select("grid_id", "y", "x", "ty", "tx", "py", "px", "v")


@query("d17_tile_stitch", f"""{TILES}, w AS (SELECT *, row_number() OVER (PARTITION BY grid_id, y, x ORDER BY ty, tx) AS k, (CASE WHEN tx > 0 AND px < 2 THEN ((px + 1) / 2::DOUBLE) ** 2 * (3 - (px + 1)) ELSE 1 END) * (CASE WHEN ty > 0 AND py < 2 THEN ((py + 1) / 2::DOUBLE) ** 2 * (3 - (py + 1)) ELSE 1 END) AS w FROM t),
f AS (SELECT grid_id, y, x, k, CASE WHEN w >= 1 THEN v ELSE trunc(v * w) END AS o FROM w WHERE k = 1 UNION ALL SELECT w.grid_id, w.y, w.x, w.k, CASE WHEN w.w >= 1 THEN w.v ELSE trunc(f.o * (1 - w.w) + w.v * w.w) END FROM f JOIN w ON w.grid_id = f.grid_id AND w.y = f.y AND w.x = f.x AND w.k = f.k + 1)
SELECT grid_id, y, x, arg_max(o, k) AS v FROM f GROUP BY ALL""")
def d17b(spark, sf):
    return op.tile_stitch(tiles(spark, sf), G, 2)


@query("d18_orient", """c AS (SELECT *, (grid_id % 9)::INT AS code, 8 AS w, 8 AS h FROM v_cells) SELECT grid_id, code, v, CASE WHEN code IN (3, 4) THEN 7 - y WHEN code IN (5, 6) THEN x WHEN code IN (7, 8) THEN 7 - x ELSE y END AS y,
CASE code WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END AS x FROM c""")
def d18(spark, sf):
    cells = fx.cells(spark, sf).withColumns({"code": (F.col("grid_id") % 9).cast("int"), "w": F.lit(8), "h": F.lit(8)})
    return op.orient(cells, "code", "w", "h").select("grid_id", "code", "v", "y", "x")
