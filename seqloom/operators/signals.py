"""Operators on sample tables: a row a sample with its track, index ``i`` (from 0) and value ``v``.

Long filters work on chunks that carry a halo of their neighbours' samples, so a track of any
length is many groups of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import Names, clamp

CHUNK = 65_536


def kaiser_beta(decibels: float) -> float:
    if decibels > 50:
        return 0.1102 * (decibels - 8.7)
    return 0.5842 * (decibels - 21) ** 0.4 + 0.07886 * (decibels - 21) if decibels >= 21 else 0.0


def bessel_i0(x: float) -> float:
    """Power series, up to terms under 1e-9."""
    out = term = 1.0
    k = 1
    while term >= 1e-9:
        term *= (x / 2 / k) ** 2
        out += term
        k += 1
    return out


def resample_taps(up: int, down: int, half: int, decibels: float = 80.0) -> np.ndarray:
    """Windowed sinc for each phase between samples: ``up / gcd`` rows of ``2 * half + 1``."""
    ratio = up / down
    cutoff = ratio * 0.95 if ratio < 1 else 0.99
    beta = kaiser_beta(decibels)
    phases = up // math.gcd(up, down)
    d = np.arange(-half, half + 1)[None, :] - np.arange(phases)[:, None] / phases
    edge = (d / half) ** 2
    window = np.array([[bessel_i0(beta * math.sqrt(1 - e)) if e < 1 else 0.0 for e in row] for row in edge]) / bessel_i0(beta)
    return np.sinc(d * cutoff) * 2 * cutoff * window


def lowpass_taps(cutoff: float, transition: float, n: int) -> np.ndarray:
    """Odd low-pass of unit gain; ``cutoff`` as a share of half the rate, ``transition`` of the rate.
    A rectangular window where the filter is long for the signal of ``n`` samples, else Kaiser."""
    cutoff, transition = min(max(cutoff, 1e-4), 0.999), max(transition, 1e-4)
    taps = round(4 / transition)
    taps = min(max(taps + (taps % 2 == 0), 31), 4001)
    taps = min(taps, max(31, n // 3 | 1)) if n > 0 else taps
    m = (taps - 1) // 2
    k = np.arange(-m, m + 1)
    h = cutoff * 2 * np.sinc(2 * cutoff * k)
    if not (taps - 1) / 2 / max(n, 1) > 0.2:
        h = h * np.array([bessel_i0(6.0 * math.sqrt(max(0.0, 1 - (x / m) ** 2))) for x in k]) / bessel_i0(6.0)
    return h / h.sum() if abs(h.sum()) > 1e-12 else h


def halo_chunks(samples: DataFrame, size: int, halo: int, i: str = "i") -> DataFrame:
    """Each sample once for every chunk of ``size`` that it lies in or within ``halo`` of: ``chunk``."""
    first, last = F.floor((F.col(i) - halo) / size), F.floor((F.col(i) + halo) / size)
    return samples.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def _with_length(samples: DataFrame, by: Names) -> DataFrame:
    sizes = samples.groupBy(*by).agg((F.max("i") + 1).alias("n"))
    return samples.join(sizes, list(by))


def _schema(df: DataFrame, by: Names) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", i long, v double"


def resample(samples: DataFrame, by: Names, up: int, down: int, half: int = 256, chunk: int = CHUNK) -> DataFrame:
    """Values at ``i * down / up``; borders repeat, results stay within -1 and 1."""
    if up == down:
        return samples
    taps, phases, g = resample_taps(up, down, half), up // math.gcd(up, down), math.gcd(up, down)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, c = int(pdf["n"].iloc[0]), int(pdf["chunk"].iloc[0])
        base, v = int(pdf["i"].iloc[0]), pdf["v"].to_numpy(float)
        total = int(np.round(n * up / down))
        out = np.arange(-(-c * chunk * up // down), min(-(-(c + 1) * chunk * up // down), total))
        at, phase = out * down // up, out * down % up // g
        y = np.empty(len(out))
        for a in range(0, len(out), 4096):
            part = slice(a, a + 4096)
            idx = np.clip(at[part, None] + np.arange(-half, half + 1), 0, n - 1) - base
            t = taps[phase[part]]
            norm = t.sum(axis=1)
            y[part] = (v[idx] * t).sum(axis=1) / np.where(np.abs(norm) > 1e-6, norm, 1.0)
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "i": out, "v": np.clip(y, -1, 1)})

    rows = halo_chunks(_with_length(samples.select(*by, "i", "v"), by), chunk, half + 1)
    rows = rows.where(F.col("chunk") * chunk < F.col("n"))
    return rows.groupBy(*by, "chunk").applyInPandas(run, _schema(samples, by))


def resample_by_join(samples: DataFrame, by: Names, up: int, down: int, half: int, chunk: int | None = None) -> DataFrame:
    """:func:`resample` as a join with the taps; for short filters, and to check the other by.

    Samples meet in arrays of a chunk and its halo, and the places between them join the taps of their
    phase beside these, so samples are shuffled and not their products with the taps."""
    taps, phases, g = resample_taps(up, down, half), up // math.gcd(up, down), math.gcd(up, down)
    if taps.size > 100_000:
        raise ValueError("too many taps for a join; use resample")
    chunk = chunk or max(64, 4 * half)
    rows_of = [(p, [(k - half, float(taps[p, k])) for k in range(2 * half + 1)]) for p in range(phases)]
    table = F.broadcast(samples.sparkSession.createDataFrame(rows_of, "phase long, taps array<struct<k: long, c: double>>"))
    rows = halo_chunks(_with_length(samples.select(*by, "i", F.col("v").cast("double").alias("v")), by), chunk, half + 1)
    # The work lies after the shuffle and is far more than its bytes tell, so its partitions are not coalesced.
    rows = rows.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "chunk")
    held = rows.groupBy(*by, "chunk").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "v"))).alias("s"))
    first, last = F.get("s", F.lit(0))["i"], F.element_at("s", -1)["i"]
    known = F.map_from_entries(F.transform("s", lambda x: F.struct(x["i"], x)))
    held = held.withColumn("s", F.when(F.size("s") == last - first + 1, F.col("s")).otherwise(F.transform(F.sequence(first, last), lambda i: F.try_element_at(known, i))))
    start = F.ceil(F.col("chunk") * chunk * up / down)
    stop = F.least(F.ceil((F.col("chunk") + 1) * chunk * up / down), F.bround(F.col("n") * up / down).cast("long"))
    out = held.where(start < stop).withColumns({"first": first, "o": F.explode(F.sequence(start, stop - 1))})
    out = out.withColumns({"fl": F.floor(F.col("o") * down / up), "phase": F.floor(F.col("o") * down % up / g)}).join(table, "phase")

    def step(acc: Column, tap: Column) -> Column:
        at = F.greatest(F.lit(0).cast("long"), F.least(F.col("n") - 1, F.col("fl") + tap["k"]))
        x = F.get("s", (at - F.col("first")).cast("int"))
        more = lambda name, v: F.coalesce(acc[name] + v, v, acc[name]).alias(name)
        return F.struct(more("sum", x["v"] * tap["c"]), more("weight", F.when(x.isNotNull(), tap["c"])))

    none = F.lit(None).cast("double")
    sums = out.select(*by, "o", F.aggregate("taps", F.struct(none.alias("sum"), none.alias("weight")), step).alias("y")).where("y.weight IS NOT NULL")
    weight = F.when(F.abs("y.weight") > 1e-6, F.col("y.weight")).otherwise(1.0)
    return sums.select(*by, F.col("o").alias("i"), clamp(F.col("y.sum") / weight, -1, 1).alias("v"))


def filtered(samples: DataFrame, by: Names, taps: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Convolution with odd, centred taps; outside a track is silence."""
    m = len(taps) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["chunk"].iloc[0])
        low = c * chunk - m
        v = np.zeros(chunk + 2 * m)
        v[pdf["i"].to_numpy() - low] = pdf["v"].to_numpy(float)
        own = np.sort(pdf["i"].to_numpy())
        own = own[(own >= c * chunk) & (own < (c + 1) * chunk)]
        y = np.convolve(v, taps, mode="valid")
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "i": own, "v": y[own - c * chunk]})

    return halo_chunks(samples.select(*by, "i", "v"), chunk, m).groupBy(*by, "chunk").applyInPandas(run, _schema(samples, by))


def spectral_merge(a: DataFrame, b: DataFrame, by: Names, taps: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Low band of ``a``, high band of ``b``: ``b`` and the low band of the difference, within -1 and
    1. The shorter track counts."""
    both = a.select(*by, "i", F.col("v").alias("va")).join(b.select(*by, "i", F.col("v").alias("vb")), [*by, "i"])
    low = filtered(both.select(*by, "i", (F.col("va") - F.col("vb")).alias("v")), by, taps, chunk)
    return low.withColumnRenamed("v", "low").join(both, [*by, "i"]).select(*by, "i", clamp(F.col("vb") + F.col("low"), -1, 1).alias("v"))


def hann(i: Column, n: int) -> Column:
    return 0.5 * (1.0 - F.cos(2.0 * math.pi * i / (n - 1)))


def frame_signal(samples: DataFrame, by: Names, nfft: int, hop: int) -> DataFrame:
    """Windowed frames of ``nfft`` samples every ``hop``: ``f`` and ``x``; the end of a short track is
    silence."""
    rows = _with_length(samples.select(*by, "i", "v"), by).withColumn("frames", F.greatest(F.lit(1).cast("long"), 1 + F.floor((F.col("n") - nfft) / hop)))
    first, last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - nfft + 1) / hop)), F.least(F.floor(F.col("i") / hop), F.col("frames") - 1)
    rows = rows.where(first <= last).withColumn("f", F.explode(F.sequence(first, last))).withColumn("k", (F.col("i") - F.col("f") * hop).cast("int"))
    values = rows.groupBy(*by, "f").agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("v") * hann(F.col("k"), nfft)))).alias("m"))
    return values.select(*by, "f", F.transform(F.sequence(F.lit(0), F.lit(nfft - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("x"))


def stft(samples: DataFrame, by: Names, nfft: int, hop: int) -> DataFrame:
    """Spectrum of each frame: a row a bin ``k`` with ``re`` and ``im``."""
    frames = frame_signal(samples, by, nfft, hop)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                z = np.fft.rfft(np.stack(pdf["x"].to_numpy()), axis=1)
                yield pdf.drop(columns="x").assign(re=list(z.real), im=list(z.imag))

    kinds = dict(frames.dtypes)
    spec = frames.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "f"]) + ", re array<double>, im array<double>")
    return spec.select(*by, "f", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select(*by, "f", "k", "z.re", "z.im")


def istft(spec: DataFrame, by: Names, nfft: int, hop: int, lengths: DataFrame) -> DataFrame:
    """Samples of a spectrum, overlapped, added and divided by the windows' squares; ``lengths`` has
    ``n`` of each track."""
    z = F.array_sort(F.collect_list(F.struct("k", "re", "im")))
    rows = spec.groupBy(*by, "f").agg(z.alias("z")).select(*by, "f", F.transform("z", lambda s: s["re"]).alias("re"), F.transform("z", lambda s: s["im"]).alias("im"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.fft.irfft(np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy()), n=nfft, axis=1)
                yield pdf.drop(columns=["re", "im"]).assign(x=list(x))

    kinds = dict(rows.dtypes)
    back = rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "f"]) + ", x array<double>")
    flat = back.select(*by, "f", F.posexplode("x").alias("k", "x")).withColumn("i", F.col("f") * hop + F.col("k")).withColumn("w", hann(F.col("k"), nfft))
    sums = flat.groupBy(*by, "i").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    every = lengths.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return every.join(sums, [*by, "i"], "left").select(*by, "i", F.when(F.col("q") > 1e-8, F.col("s") / F.when(F.col("q") > 1e-8, F.col("q"))).otherwise(0.0).alias("v"))


def mel_weights(rate: int, nfft: int, mels: int, low: float, high: float) -> list[tuple[int, int, float]]:
    """Sparse weights (mel, bin, weight) of triangles on a scale that is linear to 1 kHz and
    logarithmic beyond."""
    per, knee, step = 200 / 3, 1000.0, math.log(6.4) / 27
    to = lambda f: f / per if f < knee else knee / per + math.log(f / knee) / step
    of = lambda m: m * per if m < knee / per else knee * math.exp(step * (m - knee / per))
    edges = [of(to(low) + (to(high) - to(low)) * i / (mels + 1)) for i in range(mels + 2)]
    bins, out = nfft // 2 + 1, []
    for m in range(mels):
        a, b, c = edges[m : m + 3]
        for k in range(bins):
            f = rate / 2 * k / (bins - 1)
            if a < b < c and (w := min((f - a) / (b - a), (c - f) / (c - b))) > 0:
                out.append((m, k, w * 2 / max(1e-8, c - a)))
    return out


def mel_spectrum(spec: DataFrame, by: Names, rate: int, nfft: int, mels: int, low: float, high: float) -> DataFrame:
    """Weighted sums of magnitudes. The weights are at most two for each bin, so they are broadcast."""
    weights = spec.sparkSession.createDataFrame(mel_weights(rate, nfft, mels, low, high), "m int, k int, w double")
    rows = spec.withColumn("mag", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).join(F.broadcast(weights), "k")
    return rows.groupBy(*by, "f", "m").agg(F.sum(F.col("mag") * F.col("w")).alias("mel"))


def envelope(samples: DataFrame, by: Names, buckets: int) -> DataFrame:
    """Mean size of the samples in each of so many buckets; 1 at most."""
    rows = _with_length(samples, by).withColumn("size", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / buckets)))
    rows = rows.withColumn("bucket", F.floor(F.col("i") / F.col("size"))).where(F.col("bucket") < buckets)
    return rows.groupBy(*by, "bucket").agg(F.least(F.lit(1.0), F.avg(F.abs("v"))).alias("level"))


def levels(samples: DataFrame, by: Names) -> DataFrame:
    """Peak and mean level in decibels; null for silence."""
    g = samples.groupBy(*by).agg(F.max(F.abs("v")).alias("p"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("m"))
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(F.when(F.col(c) > 0, F.col(c))))
    return g.select(*by, db("p").alias("peak_db"), db("m").alias("mean_db"))


def loudness_gate(samples: DataFrame, by: Names, loud: float = -14, target: float = -16) -> DataFrame:
    """Brings tracks that are not loud already to a mean level; others stay."""
    gain = F.when(F.col("mean_db") > loud, 1.0).otherwise(F.pow(F.lit(10.0), (target - F.col("mean_db")) / 20))
    return samples.join(levels(samples, by).withColumn("gain", F.coalesce(gain, F.lit(1.0))).select(*by, "gain"), list(by)).withColumn("v", F.col("v") * F.col("gain"))


def mix(samples: DataFrame, track: str, gains: dict, first, limit: float = 0.98) -> DataFrame:
    """All tracks in one, as long as the first; gains from 0 to 4 (1 where none is given)."""
    gain = F.lit(1.0)
    for t, g in gains.items():
        gain = F.when(F.col(track) == t, min(max(g, 0.0), 4.0)).otherwise(gain)
    sums = samples.withColumn("v", F.col("v") * gain).groupBy("i").agg(F.sum("v").alias("v"))
    return samples.where(F.col(track) == first).select("i").join(sums, "i").select("i", clamp(F.col("v"), -limit, limit).alias("v"))


def trim(samples: DataFrame, by: Names, start: float, stop: float, rate: float) -> DataFrame:
    """The samples from ``start`` to ``stop`` seconds, numbered anew; a tenth of a second at least. A
    bound of a hundredth or less is none."""
    low = math.ceil(start * rate) if start > 0.01 else 0
    rows = samples.where(F.col("i") >= low).withColumn("i", F.col("i") - low)
    return rows.where(F.col("i") < max(0.1, stop - start) * rate) if stop > 0.01 else rows


def ramp(k: Column, n: int, overlap: int) -> Column:
    """Weight within a chunk: rising over the overlap at its start, falling at its end."""
    return F.when(k < overlap, F.least(k, F.lit(n - 1) - k) / overlap if n < 2 * overlap else k / overlap).when(n - 1 - k < overlap, (n - 1 - k) / overlap).otherwise(1.0)


def chunk_overlap(samples: DataFrame, by: Names, n: int, overlap: int) -> DataFrame:
    """Each sample in every chunk of ``n`` that holds it; chunks start every ``n - overlap``."""
    stride = n - overlap
    rows = _with_length(samples, by)
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / stride) - 1)
    low, high = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - n + 1) / stride)), F.least(F.floor(F.col("i") / stride), last)
    rows = rows.where(low <= high).withColumn("c", F.explode(F.sequence(low, high)))
    return rows.withColumn("k", F.col("i") - F.col("c") * stride).withColumn("w", ramp(F.col("k"), n, overlap)).drop("n")


def overlap_add(chunks: DataFrame, by: Names) -> DataFrame:
    """Samples of chunks, weighted and divided by the weights."""
    g = chunks.groupBy(*by, "i").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("q"))
    return g.select(*by, "i", (F.col("s") / F.greatest("q", F.lit(1e-8))).alias("v"))
