"""Operators on ordered frames: differences, cuts, scenes, defects, noise and near-duplicates.

Frames are rows with a key, an order column and a row-major array of gray values; pixels are rows
with a grid, ``y``, ``x`` and values. Keys and orders are arguments, so any ordered records will do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import Names, item, ordered_fold, over, sum_before, total, variance


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference over the shorter length; 0 if that is empty."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y).cast("double"))
    return F.when(n > 0, total(pairs) / n).otherwise(0.0)


def pair_diff(df: DataFrame, by: Names, order: Names, gray: str) -> DataFrame:
    """``diff`` of each row to the one before; null for the first."""
    before = F.lag(gray).over(over(by, order))
    return df.withColumn("diff", F.when(before.isNotNull(), mean_abs_diff(F.col(gray), before)))


def lap_var(gray: Column, w: int, h: int) -> Column:
    """Variance of the Laplacian over inner pixels; null if a side is under 3."""
    if w < 3 or h < 3:
        return F.lit(None).cast("double")
    inner = F.array(*[F.lit(y * w + x) for y in range(1, h - 1) for x in range(1, w - 1)])
    at = lambda p: item(gray, p)
    return F.greatest(F.lit(0.0), variance(F.transform(inner, lambda p: (4 * at(p) - at(p - 1) - at(p + 1) - at(p - w) - at(p + w)).cast("double"))))


def measure_pairs(df: DataFrame, by: Names, order: Names, gray: str, w: int, h: int) -> DataFrame:
    """``diff``, ``lap_prev`` and ``lap_cur`` of every row with one before it."""
    rows = pair_diff(df, by, order, gray).withColumn("lap_cur", lap_var(F.col(gray), w, h))
    return rows.withColumn("lap_prev", F.lag("lap_cur").over(over(by, order))).where("diff IS NOT NULL")


def cut_thresholds(strictness: float) -> tuple[float, float, float]:
    """Difference that may be a cut, difference that is one, and largest ratio of structure."""
    steps = int(min(max(strictness, 0.15), 0.90) / 0.05 + 0.5)
    k = steps / 6  # of 0.05, against 0.30
    return 25 * k, 50 * k, min(max(0.6 / k, 0.2), 1.0)


def is_cut(diff: Column, lap_prev: Column, lap_cur: Column, strictness: float = 0.30) -> Column:
    """A strong difference is a cut; a weaker one is if structure drops or is not known."""
    weak, strong, ratio = cut_thresholds(strictness)
    known = F.coalesce((lap_prev > 0) & (lap_cur >= 0), F.lit(False))
    return (
        F.when(diff.isNull() | F.isnan(diff) | (F.abs(diff) == float("inf")) | (diff < weak), False)
        .when(diff >= strong, True)
        .when(known, lap_cur / F.when(known, lap_prev).otherwise(1.0) <= ratio)
        .otherwise(True)
    )


def min_spacing(df: DataFrame, by: Names, order: str, flag: str, spacing: int = 15) -> DataFrame:
    """The flagged rows that are at least ``spacing`` after the last one kept. Only flagged rows are
    dealt out."""
    flagged = df.where(F.col(flag)).select(*by, F.col(order).cast("long").alias(order))
    if spacing <= 1:
        return flagged

    def step(last: int | None, row: tuple) -> tuple[int, tuple | None]:
        keep = last is None or row[0] - last >= spacing
        return (row[0], row) if keep else (last, None)

    return ordered_fold(flagged, by, [order], [], step, f"`{order}` long")


def detect_cuts(df: DataFrame, by: Names, order: str, gray: str, w: int, h: int, strictness: float = 0.30, spacing: int = 15) -> DataFrame:
    """Rows before which a scene ends and that keep the spacing: the pair's first frame number."""
    pairs = measure_pairs(df, by, [order], gray, w, h)
    flags = pairs.select(*by, (F.col(order) - 1).alias(order), is_cut(F.col("diff"), F.col("lap_prev"), F.col("lap_cur"), strictness).alias("cut"))
    return min_spacing(flags, by, order, "cut", spacing)


def scene_segments(frames: DataFrame, cuts: DataFrame, by: Names, order: str, pieces: int | None = None) -> DataFrame:
    """The runs of frames between cuts, numbered from 0: ``start``, ``n`` and ``last``. ``pieces`` as in
    ``core.sum_before``."""
    begin = cuts.select(*by, (F.col(order) + 1).alias(order), F.lit(1).alias("_cut"))
    runs = frames.select(*by, order).join(begin, [*by, order], "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    runs = sum_before(runs, by, [order], F.col("_cut"), "segment", pieces).withColumn("segment", (F.col("segment") + F.col("_cut")).cast("int"))
    out = runs.groupBy(*by, "segment").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("last", F.lead("segment").over(over(by, ["segment"])).isNull())


def near_black(samples: DataFrame, by: Names, total_col: str = "sum_rgb") -> DataFrame:
    """``dark``: 95 % or more of a frame's sampled pixels have R+G+B under 24."""
    return samples.groupBy(*by).agg(F.count_if(F.col(total_col) < 24).alias("n_dark"), F.count(F.lit(1)).alias("n")).withColumn("dark", F.col("n_dark") >= 0.95 * F.col("n"))


def band_black(samples: DataFrame, by: Names, rows: int, cols: int, y: str = "y", total_col: str = "sum_rgb") -> DataFrame:
    """``band_dark``: one of three bands of rows is near black. Frames with fewer samples than ``rows``
    times ``cols`` are never called so."""
    band = F.when(F.col(y) < rows // 3, 0).when(F.col(y) < 2 * rows // 3, 1).otherwise(2)
    bands = near_black(samples.withColumn("band", band), [*by, "band"], total_col)
    return bands.groupBy(*by).agg((F.bool_or("dark") & (F.sum("n") >= rows * cols) & F.lit(rows > 0 and cols > 0)).alias("band_dark"))


def defective_frames(samples: DataFrame, by: Names, rows: int, cols: int) -> DataFrame:
    return near_black(samples, by).join(band_black(samples, by, rows, cols), list(by)).select(*by, (F.col("dark") | F.col("band_dark")).alias("defective"))


def silent_failures(inputs: DataFrame, outputs: DataFrame, on: Names) -> DataFrame:
    """Keys whose output is defective though their input is not."""
    return outputs.where("defective").join(inputs.where("NOT defective"), list(on), "left_semi").select(*on)


def sample_grid(df: DataFrame, w: str, h: str) -> DataFrame:
    """Sample points of every row's ``w`` x ``h`` grid: ``gx`` and ``gy`` at a step of a 32nd of the
    shorter side, 4 at least; and the number of ``rows``."""
    step = F.greatest(F.lit(4), F.expr(f"cast(least(`{w}`, `{h}`) div 32 AS int)"))
    points = lambda n: F.when(F.col(n) > F.col("step"), F.sequence(F.col("step"), F.col(n) - 1, F.col("step"))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("step", step)
    return rows.withColumn("rows", F.size(points(h))).withColumn("gy", F.explode(points(h))).withColumn("gx", F.explode(points(w)))


def frame_stats(samples: DataFrame, by: Names) -> DataFrame:
    """Mean R, G, B and the variance of all values of the three channels together."""
    squares = sum((F.avg(F.col(c) * F.col(c)) for c in "rgb"), F.lit(0.0)) / 3
    out = samples.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"], squares.alias("_squares"))
    level = (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3
    return out.withColumn("var", F.greatest(F.lit(0.0), F.col("_squares") - level * level)).drop("_squares")


def is_achromatic() -> Column:
    return F.greatest("mean_r", "mean_g", "mean_b") - F.least("mean_r", "mean_g", "mean_b") <= 12


def plausible_between(stats: DataFrame, by: Names, order: Names) -> DataFrame:
    """Whether a frame may lie between its neighbours: achromatic, near their mean brightness, and not
    far flatter than they are. Frames without two neighbours are left out."""
    w = over(by, order)
    level = (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3
    rows = stats.withColumn("level", level)
    around = lambda c: (F.lag(c).over(w) + F.lead(c).over(w)) / 2
    rows = rows.withColumns({"want_level": around("level"), "want_var": around("var")}).where("want_level IS NOT NULL")
    flat = (F.col("want_var") > 0) & (F.col("var") < 0.25 * F.col("want_var"))
    return rows.withColumn("plausible", is_achromatic() & (F.abs(F.col("level") - F.col("want_level")) <= 24) & ~flat)


def low_mean(df: DataFrame, by: Names, value: str, share: float) -> DataFrame:
    """``low``: the mean of each key's values up to the one at this share of them in order. Values are
    sorted, not gathered."""
    w, whole = over(by, [value]), Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(whole)
    rows = df.withColumn("_at", (F.row_number().over(w) - 1 == F.least(F.floor(n * share), n - 1)))
    rows = rows.withColumn("_limit", F.max(F.when(F.col("_at"), F.col(value))).over(whole))
    return rows.where(F.col(value) <= F.col("_limit")).groupBy(*by).agg(F.avg(value).alias("low"))


def grain(cells: DataFrame, grid: Names, value: str = "v") -> DataFrame:
    """Noise level of each grid: root of the mean local variance over its flattest fifth."""
    from .grids import _three, on_grids

    def rule(a: dict) -> dict:
        mean = _three(a[value])
        return {"_var": np.maximum(0.0, _three(a[value] * a[value]) - mean * mean)}

    local = on_grids(cells.select(*grid, "y", "x", value), grid, 1, [value], ["_var"], rule)
    return low_mean(local, grid, "_var", 0.2).select(*grid, F.sqrt("low").alias("grain"))


def blocking(cells: DataFrame, grid: Names, block: int = 8, value: str = "v") -> DataFrame:
    """Mean step across block borders over the mean step elsewhere; null without either."""
    step = F.abs(F.lead(value).over(over([*grid, "y"], ["x"])) - F.col(value))
    rows = cells.withColumn("_step", step).where("_step IS NOT NULL").withColumn("_edge", F.col("x") % block == block - 1)
    sides = rows.groupBy(*grid).agg(F.avg(F.when(F.col("_edge"), F.col("_step"))).alias("_at"), F.avg(F.when(~F.col("_edge"), F.col("_step"))).alias("_off"))
    return sides.select(*grid, F.when(F.col("_off") > 1e-9, F.col("_at") / F.col("_off")).alias("blocking"))


def _running_deviation(values: Column) -> Column:
    """Population deviation of an array around a running mean, null without values. Its last bits
    depend on the order of the values alone."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - mean) * (x - acc["mean"])).alias("m2"))

    return F.aggregate(values, start, step, lambda a: F.sqrt(a["m2"] / F.when(a["n"] > 0, a["n"])))


def flicker(cells: DataFrame, by: Names, value: str = "v", order: str | None = None) -> DataFrame:
    """Mean temporal deviation over each group's steadiest quarter of pixels.

    Pixels whose deviations are equal but for their last bits may lie on either side of the quarter.
    With ``order`` a pixel's values are taken in order of the frames, so that runs agree to the
    last bit; they are one array then, for groups of few frames."""
    if order is None:
        spread = cells.groupBy(*by, "y", "x").agg(F.stddev_pop(value).alias("_sd"))
    else:
        seen = F.when(F.col(value).isNotNull(), F.struct(order, F.col(value).cast("double").alias("_v")))
        values = F.transform(F.array_sort(F.collect_list(seen)), lambda s: s["_v"])
        spread = cells.groupBy(*by, "y", "x").agg(_running_deviation(values).alias("_sd"))
    return low_mean(spread, by, "_sd", 0.25).withColumnRenamed("low", "flicker")


def noise_probe(cells: DataFrame, by: Names, order: str, w: int, h: int, burst: int = 5, block: int = 8) -> DataFrame:
    """``grain``, ``blocking`` and ``flicker`` of each key with three frames at least, and the
    ``level`` of denoising (0 to 2) that they call for. Frames without ``w`` times ``h`` cells are
    left out; bursts are ``burst`` frames in a row of those left (all of them, if it is 1 or less).
    A burst of under three frames has no flicker; without any it is 0."""
    frame = [*by, order]
    whole = cells.groupBy(*frame).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") == w * h)
    whole = whole.select(*frame, (F.row_number().over(over(by, [order])) - 1).alias("_i"))
    cells = cells.join(whole, frame)
    still = grain(cells, frame).join(blocking(cells, frame, block), frame)
    still = still.groupBy(*by).agg(F.avg("grain").alias("grain"), F.avg("blocking").alias("blocking"), F.count(F.lit(1)).alias("n_frames")).where("n_frames >= 3")
    bursts = cells.withColumn("burst", F.floor(F.col("_i") / burst) if burst > 1 else F.lit(0).cast("long"))
    size = whole.withColumn("burst", F.floor(F.col("_i") / burst) if burst > 1 else F.lit(0).cast("long")).groupBy(*by, "burst").agg(F.count(F.lit(1)).alias("n"))
    moving = flicker(bursts, [*by, "burst"], order=order if burst > 1 else None).join(size.where("n >= 3"), [*by, "burst"])
    moving = moving.groupBy(*by).agg(F.avg("flicker").alias("flicker"))
    level = F.when(F.col("grain").isNull() | F.isnan("grain"), 0).when(F.col("grain") < 2.2, 0).when(F.col("grain") < 5, 1).otherwise(2)
    return still.join(moving, list(by), "left").withColumns({"flicker": F.coalesce("flicker", F.lit(0.0)), "level": level})


# Force and least similarity of the tiers (balanced, aggressive, conservative).
TIERS = ((1.0, 0.99), (1.5, 0.985), (0.7, 0.995))


def dedup_thresholds(sad: float, ssim: float, protect: float, segment: float, tier: int = 0) -> tuple[float, float, float, float]:
    """For a tier's force: the largest difference and least similarity of frames that count as one,
    the share of a frame that must move to protect it, and the largest difference within a
    still segment."""
    force, floor = TIERS[tier]
    within = lambda x, low, high: min(max(x * force, low), high)
    return within(sad, 1.0, 7.0), max(1 - (1 - ssim) * force, floor), within(protect, 0.05, 0.60), within(segment, 2.0, 8.0)


def global_ssim(a: Column, b: Column) -> Column:
    """Structural similarity with one window, the whole frame; sums of bytes are exact."""
    names = ["n", "x", "y", "xx", "yy", "xy"]
    start = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def step(acc: Column, p: Column) -> Column:
        x, y = p["x"].cast("double"), p["y"].cast("double")
        more = [F.lit(1.0), x, y, x * x, y * y, x * y]
        return F.struct(*[(acc[k] + m).alias(k) for k, m in zip(names, more, strict=True)])

    def finish(t: Column) -> Column:
        n = F.when(t["n"] > 0, t["n"])
        ma, mb = t["x"] / n, t["y"] / n
        va, vb, cov = t["xx"] / n - ma * ma, t["yy"] / n - mb * mb, t["xy"] / n - ma * mb
        return ((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))

    return F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), start, step, finish)


def dedup_adjacent(df: DataFrame, by: Names, order: Names, gray: str, sad: float, ssim: float) -> DataFrame:
    """``keep``: false where a frame is like the one before it. The last of a key stays."""
    w = over(by, order)
    before = F.lag(gray).over(w)
    rows = df.withColumns({"_before": before, "_tail": F.lead(F.lit(1)).over(w).isNull()})
    same = (mean_abs_diff(F.col(gray), F.col("_before")) < sad) & (global_ssim(F.col(gray), F.col("_before")) >= ssim)
    return rows.withColumn("keep", F.col("_tail") | F.col("_before").isNull() | ~F.coalesce(same, F.lit(False))).drop("_before", "_tail")


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Mean absolute difference and similarity over the whole frame."""
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    like = (2 * a.mean() * b.mean() + 6.5025) * (2 * cov + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (a.var() + b.var() + 58.5225))
    return float(np.abs(a - b).mean()), float(like)


def dedup_frames(df: DataFrame, by: Sequence[str], order: str, gray: str, sad: float, ssim: float) -> DataFrame:
    """Like :func:`dedup_adjacent`, but each frame is compared with the last one kept. An ordered
    fold over sorted partitions: one frame of a key is held, however long the key is."""

    def step(last: np.ndarray | None, row: tuple) -> tuple[np.ndarray | None, tuple]:
        at, tail, values = row
        f, same = np.asarray(values, float), False
        if last is not None and not tail:
            n = min(len(f), len(last))
            diff, like = _alike(f[:n], last[:n])
            same = bool(diff < sad and like >= ssim)
        return (last if same else f), (at, not same)

    kind = dict(df.dtypes)[order]
    rows = df.select(*by, order, gray, F.lead(F.lit(1)).over(over(by, [order])).isNull().alias("_tail"))
    return ordered_fold(rows, by, [order], ["_tail", gray], step, f"`{order}` {kind}, keep boolean")


def block_means(values: np.ndarray, w: int, block: int) -> np.ndarray:
    """Means over the blocks of a frame of width ``w``; those at the right and the bottom may be
    smaller."""
    frame = values.reshape(-1, w)
    h = len(frame)
    sums = np.add.reduceat(np.add.reduceat(frame, np.arange(0, h, block), axis=0), np.arange(0, w, block), axis=1)
    rows, columns = np.diff(np.r_[np.arange(0, h, block), h]), np.diff(np.r_[np.arange(0, w, block), w])
    return (sums / np.outer(rows, columns)).ravel()


def dedup_segments(df: DataFrame, by: Sequence[str], order: str, gray: str, w: int, sad: float, ssim: float, protect: float, segment: float, block: int = 8) -> DataFrame:
    """Near-duplicates with local motion and still segments, a rule of our own with the thresholds of
    :func:`dedup_thresholds`. For each frame ``moving``, ``keep`` and ``segment``.

    ``moving`` is the share of blocks whose mean absolute difference to the last kept frame reaches
    ``sad``; 1 for the first frame, and where sizes differ. A frame is dropped if it is like the last
    kept one as in :func:`dedup_frames`, unless at least ``protect`` of it moves; the last of a key stays.
    Kept frames begin segments, numbered from 0; one whose difference to the segment's first frame is
    below ``segment``, with less than ``protect`` of it moving, goes on in it, so that a still scene that
    drifts or flickers is one segment. One fold: two frames of a key are held."""

    def shares(f: np.ndarray, other: np.ndarray) -> tuple[float, float, float]:
        if len(f) != len(other) or len(f) % w:
            return np.inf, -1.0, 1.0
        diff, like = _alike(f, other)
        return diff, like, float((block_means(np.abs(f - other), w, block) >= sad).mean())

    # State: the last kept frame, the segment's first one, its number.
    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        at, tail, values = row
        f = np.asarray(values, float)
        if state is None:
            return (f, f, 0), (at, 1.0, True, 0)
        last, head, number = state
        diff, like, moving = shares(f, last)
        if not tail and diff < sad and like >= ssim and moving < protect:
            return state, (at, moving, False, number)
        away, _, drift = shares(f, head)
        if away >= segment or drift >= protect:
            head, number = f, number + 1
        return (f, head, number), (at, moving, True, number)

    kind = dict(df.dtypes)[order]
    rows = df.select(*by, order, gray, F.lead(F.lit(1)).over(over(by, [order])).isNull().alias("_tail"))
    return ordered_fold(rows, by, [order], ["_tail", gray], step, f"`{order}` {kind}, moving double, keep boolean, segment long")


def still_segments(marked: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The segments of :func:`dedup_segments`: ``start``, ``stop`` (the last frame), ``n`` and how many of
    them are kept."""
    return marked.groupBy(*by, "segment").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"))
