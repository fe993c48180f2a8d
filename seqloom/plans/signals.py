"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import signals as op
from ..sources import fixtures as fx
from .registry import query

T = ["track_id"]
N = "n AS (SELECT track_id, max(i) + 1 AS n FROM v_wave GROUP BY track_id)"


def _values(rows):
    return ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


_TAPS = op.resample_taps(3, 2, 8)
RESAMPLE = f"""{N}, t(phase, k, c) AS (VALUES {_values([(p, k - 8, float(_TAPS[p, k])) for p in range(3) for k in range(17)])}),
o AS (SELECT track_id, n, o, o * 2 // 3 AS fl, o * 2 % 3 AS phase FROM n, range(0, 200000) r(o) WHERE o < round_even(n * 3 / 2, 0)),
j AS (SELECT o.track_id, o.o, greatest(0, least(n - 1, fl + k)) AS i, c FROM o JOIN t USING (phase))
SELECT j.track_id, o::BIGINT AS i, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(v * c) / sum(c))), 6) AS v FROM j JOIN v_wave w ON w.track_id = j.track_id AND w.i = j.i GROUP BY j.track_id, o"""


def out(df, *cols):
    return df.select(*cols, r6("v").alias("v"))


@query("w01_resample", RESAMPLE)
def w01(spark, sf):
    return out(op.resample(fx.wave(spark, sf), T, 3, 2, half=8, chunk=500), "track_id", "i")


@query("w01_resample_by_join", RESAMPLE)
def w01b(spark, sf):
    return out(op.resample_by_join(fx.wave(spark, sf), T, 3, 2, 8), "track_id", "i")


_FIR = op.lowpass_taps(0.3, 0.1, 2000)


@query("w02_spectral_merge", f"""h(k, c) AS (VALUES {_values([(k - len(_FIR) // 2, float(c)) for k, c in enumerate(_FIR)])}), b AS (SELECT track_id, i, v AS a, CASE WHEN i % 3 = 0 THEN -v ELSE v / 2 END AS b FROM v_wave),
s AS (SELECT x.track_id, x.i + k AS i, sum(c * (x.a - x.b)) AS low FROM b x, h GROUP BY ALL)
SELECT b.track_id, b.i, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, b.b + low)), 6) AS v FROM b JOIN s ON s.track_id = b.track_id AND s.i = b.i""")
def w02(spark, sf):
    a = fx.wave(spark, sf)
    b = a.withColumn("v", F.when(F.col("i") % 3 == 0, -F.col("v")).otherwise(F.col("v") / 2))
    return out(op.spectral_merge(a, b, T, _FIR, chunk=500), "track_id", "i")


FRAMES = f"""{N}, f AS (SELECT track_id, f FROM n, range(0, 100000) r(f) WHERE f < greatest(1, 1 + (n - 8) // 4)),
x AS (SELECT f.track_id, f.f, k, coalesce(v, 0.0::DOUBLE) * 0.5 * (1 - cos(2 * pi() * k / 7)) AS x FROM f CROSS JOIN range(0, 8) r(k) LEFT JOIN v_wave w ON w.track_id = f.track_id AND w.i = f.f * 4 + k)"""
DFT = f"{FRAMES}, z AS (SELECT track_id, f, b AS k, sum(x * cos(2 * pi() * b * x.k / 8)) AS re, -sum(x * sin(2 * pi() * b * x.k / 8)) AS im FROM x, range(0, 5) r(b) GROUP BY track_id, f, b)"


@query("w03_frame_signal", f"{FRAMES} SELECT track_id, f::BIGINT AS f, k::INT AS k, round(x, 6) + 0.0 AS x FROM x")
def w03(spark, sf):
    return op.frame_signal(fx.wave(spark, sf), T, 8, 4).select("track_id", "f", F.posexplode("x").alias("k", "x")).withColumn("x", r6("x"))


@query("w04_stft", f"{DFT} SELECT track_id, f::BIGINT AS f, k::INT AS k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM z")
def w04(spark, sf):
    return op.stft(fx.wave(spark, sf), T, 8, 4).select("track_id", "f", "k", r6("re").alias("re"), r6("im").alias("im"))


@query("w05_istft", f"""{FRAMES}, q AS (SELECT track_id, f * 4 + k AS i, sum(0.5 * (1 - cos(2 * pi() * k / 7)) * x) AS s, sum((0.5 * (1 - cos(2 * pi() * k / 7))) ** 2) AS q FROM x GROUP BY track_id, f * 4 + k)
SELECT w.track_id, w.i, round(CASE WHEN q > 1e-8 THEN s / q ELSE 0 END, 6) + 0.0 AS v FROM v_wave w LEFT JOIN q ON q.track_id = w.track_id AND q.i = w.i""")
def w05(spark, sf):
    wave = fx.wave(spark, sf)
    lengths = wave.groupBy("track_id").agg((F.max("i") + 1).alias("n"))
    return out(op.istft(op.stft(wave, T, 8, 4), T, 8, 4, lengths), "track_id", "i")


_MEL = op.mel_weights(16000, 8, 3, 0.0, 8000.0)


@query("w06_mel_spectrum", f"{DFT}, fb(m, k, w) AS (VALUES {_values(_MEL)}) SELECT track_id, f::BIGINT AS f, m::INT AS m, round(sum(sqrt(re * re + im * im) * w), 6) AS mel FROM z JOIN fb USING (k) GROUP BY track_id, f, m")
def w06(spark, sf):
    return op.mel_spectrum(op.stft(fx.wave(spark, sf), T, 8, 4), T, 16000, 8, 3, 0.0, 8000.0).withColumn("mel", r6("mel"))


@query("w07_envelope", f"{N}, b AS (SELECT track_id, i // greatest(1, n // 50) AS bucket, v FROM v_wave JOIN n USING (track_id)) SELECT track_id, bucket::BIGINT AS bucket, round(least(1.0::DOUBLE, avg(abs(v))), 8) AS level FROM b WHERE bucket < 50 GROUP BY ALL")
def w07(spark, sf):
    return op.envelope(fx.wave(spark, sf), T, 50).withColumn("level", F.round("level", 8))


LEV = "l AS (SELECT track_id, 20 * log10(max(abs(v))) AS p, 20 * log10(sqrt(avg(v * v))) AS m FROM v_wave GROUP BY track_id)"


@query("w08_levels", f"{LEV} SELECT track_id, round(p, 6) AS peak_db, round(m, 6) AS mean_db FROM l")
def w08(spark, sf):
    return op.levels(fx.wave(spark, sf), T).select("track_id", r6("peak_db").alias("peak_db"), r6("mean_db").alias("mean_db"))


@query("w09_loudness_gate", f"{LEV} SELECT track_id, i, round(v * CASE WHEN m > -14 THEN 1 ELSE 10 ** ((-16 - m) / 20) END, 6) + 0.0 AS v FROM v_wave JOIN l USING (track_id)")
def w09(spark, sf):
    return out(op.loudness_gate(fx.wave(spark, sf), T), "track_id", "i")


@query("w10_mix", "s AS (SELECT i, sum(v * CASE track_id WHEN 'click' THEN 0.5 WHEN 'view' THEN 4 ELSE 1 END) AS v FROM v_wave GROUP BY i) SELECT s.i, round(greatest(-0.98::DOUBLE, least(0.98::DOUBLE, s.v)), 6) + 0.0 AS v FROM s JOIN v_wave w ON w.i = s.i WHERE w.track_id = 'click'")
def w10(spark, sf):
    return out(op.mix(fx.wave(spark, sf), "track_id", {"click": 0.5, "view": 9.0}, "click"), "i")


@query("w11_trim", "SELECT track_id, i - 50 AS i, round(v, 6) + 0.0 AS v FROM v_wave WHERE i >= 50 AND i - 50 < 100")
def w11(spark, sf):
    return out(op.trim(fx.wave(spark, sf), T, 0.5, 1.5, 100), "track_id", "i")


OVER = f"""{N}, c AS (SELECT w.track_id, w.i, v, c, w.i - c * 75 AS k FROM v_wave w JOIN n USING (track_id) CROSS JOIN range(0, 5000) r(c) WHERE w.i >= c * 75 AND w.i < c * 75 + 100 AND c < greatest(1, ceil(n / 75))),
w AS (SELECT *, CASE WHEN k < 25 THEN k / 25 WHEN 99 - k < 25 THEN (99 - k) / 25 ELSE 1 END AS w FROM c)"""


@query("w12_chunk_overlap", f"{OVER} SELECT track_id, i, c::BIGINT AS c, k::BIGINT AS k, round(w, 6) AS w FROM w")
def w12(spark, sf):
    return op.chunk_overlap(fx.wave(spark, sf), T, 100, 25).select("track_id", "i", "c", "k", r6("w").alias("w"))


@query("w12_overlap_add", f"{OVER} SELECT track_id, i, round(sum(w * v * (1 + c % 3)) / greatest(sum(w), 1e-8), 8) + 0.0 AS v FROM w GROUP BY track_id, i")
def w12b(spark, sf):
    chunks = op.chunk_overlap(fx.wave(spark, sf), T, 100, 25)
    return op.overlap_add(chunks.withColumn("v", F.col("v") * (1 + F.col("c") % 3)), T).withColumn("v", F.round("v", 8) + F.lit(0.0))
