"""Operators on frame timelines: durations, cadence, gaps, re-timing and segmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import Names, at_rank, beside, clamp, finite, gathered, half_away, half_even, mean, ordered_fold, over, sum_before, total, upper_median


def merge_durations(df: DataFrame, by: Names, order: str, dur: str, kept: str, pieces: int | None = None) -> DataFrame:
    """A row for each kept frame with its time and that of the dropped ones after it. Dropped frames
    before the first kept one vanish with their time. ``pieces`` as in ``core.sum_before``."""
    runs = sum_before(df, by, [order], F.col(kept).cast("int"), "kept_id", pieces).withColumn("kept_id", F.col("kept_id") + F.coalesce(F.col(kept), F.lit(False)).cast("int"))
    return runs.where("kept_id > 0").groupBy(*by, "kept_id").agg(F.min(order).alias(order), F.sum(dur).alias(dur))


def cadence(gaps: DataFrame, by: Names, gap: str, in_fps: float) -> DataFrame:
    """``fps``, ``period`` and ``conf`` of changing content from the gaps between changes, in
    frames. Under three gaps, or near every frame, content changes continuously."""
    arrays = gaps.groupBy(*by).agg(F.array_sort(F.collect_list(gap)).alias("_all"))
    m = upper_median(F.col("_all"))
    arrays = arrays.withColumn("_m", m).withColumn("_near", F.filter("_all", lambda g: (g >= 0.5 * F.col("_m")) & (g <= 2 * F.col("_m"))))
    arrays = arrays.withColumn("_kept", F.when(F.size("_near") < 3, F.col("_all")).otherwise(F.col("_near")))
    arrays = arrays.withColumns({"_mean": mean(F.col("_kept")), "_mad": upper_median(F.transform("_kept", lambda g: F.abs(g - F.col("_m"))))})
    close = F.size(F.filter("_kept", lambda g: F.abs(g - F.col("_m")) <= F.greatest(F.lit(1.0), 0.2 * F.col("_m"))))
    conf = close / F.size("_kept") * F.greatest(F.lit(0.0), 1 - F.try_divide("_mad", "_m")) * F.sqrt(F.size("_kept") / F.size("_all"))
    still = (F.size("_all") < 3) | (F.col("_mean") < 1.2)
    return arrays.select(
        *by,
        still.alias("continuous"),
        F.when(still, F.lit(float(in_fps))).otherwise(clamp(in_fps / F.col("_mean"), 0.5, in_fps)).alias("fps"),
        F.when(still, F.lit(1).cast("long")).otherwise(half_even(F.col("_mean"))).alias("period"),
        F.when(still, 0.25).otherwise(clamp(F.coalesce(conf, F.lit(0.0)), 0.0, 1.0)).alias("conf"),
    )


def upper_medians(df: DataFrame, by: Names, value: str) -> DataFrame:
    """The middle value of each key, the upper one of an even number, by counts; 0 if there is none."""
    found = at_rank(df, by, value, lambda n: F.floor(n / 2), "median")
    if not df.schema[value].nullable:
        return found.select(*by, "median")
    none = df.groupBy(*by).agg(F.count(F.when(finite(F.col(value).cast("double")), 1)).alias("_n")).where("_n = 0")
    return found.select(*by, "median").unionByName(none.select(*by, F.lit(0.0).alias("median")))


def gap_stats(df: DataFrame, by: Names, order: Names, ts: str) -> DataFrame:
    """Spread of the positive gaps between neighbours; ``variable`` if their range or their
    deviation is large. Fewer than seven gaps say nothing."""
    gap = F.lead(ts).over(over(by, order)) - F.col(ts)
    g = F.when(finite(F.col("_g")) & (F.col("_g") > 0), F.col("_g"))
    rows = df.withColumn("_g", gap).groupBy(*by).agg(F.count(g).alias("n"), F.min(g).alias("gmin"), F.max(g).alias("gmax"), F.avg(g).alias("gavg"), F.stddev_pop(g).alias("gsd"))
    enough = F.col("n") >= 7
    value = lambda c: F.when(enough, c).otherwise(0.0)
    out = rows.select(*by, "n", value(F.col("gmin")).alias("gap_min"), value(F.col("gmax")).alias("gap_max"), value(F.col("gavg")).alias("gap_avg"), value(F.col("gmax") / F.col("gmin")).alias("ratio"), value(F.col("gsd") / F.col("gavg")).alias("cv"))
    by_ratio = (F.col("gap_max") > 1.5 * F.col("gap_min")) & (F.col("gap_max") > 0.0005)
    return out.withColumns({"by_ratio": by_ratio, "by_cv": F.col("cv") > 0.25}).withColumn("variable", F.col("by_ratio") | F.col("by_cv"))


def rates_differ(nominal: Column, average: Column) -> Column:
    return (nominal > 0) & (average > 0) & (nominal / F.when(average > 0, average) >= 2.0)


def flatten_plan(df: DataFrame, by: Names, order: str, dur: str, fps: float, k: int) -> DataFrame:
    """Whether a timeline needs even frames, and how many; ``reason`` says why not."""
    arrays = gathered(df, by, [order], [dur], "_rows").withColumn("_d", F.transform("_rows", lambda r: r[dur].cast("double")))
    bad = F.exists("_d", lambda d: ~finite(d) | (d <= 0))
    arrays = arrays.withColumns({"_m": upper_median(F.col("_d")), "_bad": bad})
    gaps = F.when(F.col("_m") > 0, F.size(F.filter("_d", lambda d: F.abs(d - F.col("_m")) / F.when(F.col("_m") > 0, F.col("_m")) > 0.25)))
    reason = F.when(F.size("_d") < 3, "short").when(F.lit(k < 2), "factor").when(F.lit(fps <= 0), "rate").when(F.col("_bad"), "bad").when(~(F.col("_m") > 0), "median").when(F.col("gaps") == 0, "even")
    out = arrays.withColumn("gaps", F.coalesce(gaps, F.lit(0))).withColumn("reason", reason)
    return out.select(*by, "gaps", "reason", F.when(F.col("reason").isNull(), F.lit(float(fps * k))).alias("target_fps"), F.when(F.col("reason").isNull(), F.greatest(F.lit(2).cast("long"), half_even(total(F.col("_d")) * (fps * k)))).alias("frames"))


def start_times(df: DataFrame, by: Names, order: str, dur: str, pieces: int | None = None) -> DataFrame:
    """``pts``, the start of each frame; negative durations count as 0. ``pieces`` as in
    ``core.sum_before``."""
    return sum_before(df, by, [order], F.greatest(F.col(dur).cast("double"), F.lit(0.0)), "pts", pieces)


def cumulative_times(df: DataFrame, by: Names, order: str, dur: str, pieces: int | None = None) -> DataFrame:
    """``order`` and ``pts``, the start of each frame, and one row more for each key: the end, at the
    place after the last frame. Negative durations count as 0. ``pieces`` as in ``core.sum_before``."""
    rows = start_times(df, by, order, dur, pieces).select(*by, F.col(order).cast("long").alias(order), "pts", F.greatest(F.col(dur), F.lit(0.0)).alias("_d"))
    end = rows.groupBy(*by).agg((F.max(order) + 1).alias(order), F.max_by(F.col("pts") + F.coalesce("_d", F.lit(0.0)), order).alias("pts"))
    return rows.drop("_d").unionByName(end)


def map_target_frames(df: DataFrame, by: Names, order: str, dur: str, fps: float, frames: int | None = None, pieces: int | None = None, values: Names = ()) -> DataFrame:
    """For target times ``k / fps`` the source frames around them and how far between they lie:
    ``i0``, ``i1``, ``phi`` and ``exact``. There are ``frames`` targets for each key, by default as
    many as fit its time, two at least. ``values`` of frames come along as ``<name>_0`` and ``<name>_1``.

    An as-of join by intervals: a frame gives the targets from its start to the next one's, so that
    targets, which may be far more than frames, are never shuffled. A target within a
    millionth of a frame, or of the share of the way to the next, is that frame; without a next
    frame the last is copied. Times past the end have no row, nor have keys of a single frame. With
    ``pieces`` as in ``core.sum_before`` a key's frames lie in many tasks."""
    starts = start_times(df, by, order, dur, pieces)
    own = F.struct(F.col("pts").alias("p"), F.col(order).cast("long").alias("i"), *values)
    starts = beside(starts, by, [order], own, "_next", pieces, after=True).withColumn("_own", own)
    stop, n = F.sum(F.greatest(F.col(dur), F.lit(0.0))), F.count(F.lit(1))
    if pieces is None:
        whole = Window.partitionBy(*by)
        rows = starts.withColumns({"_stop": stop.over(whole), "_n": n.over(whole)})
    else:
        ends = starts.groupBy(*by).agg(stop.alias("_stop"), n.alias("_n")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_stop", "_n")
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        rows = starts.join(ends, same)
    many = F.lit(frames).cast("long") if frames is not None else F.greatest(F.lit(2).cast("long"), half_even(F.col("_stop") * fps))
    rows = rows.where("_n > 1").select(*by, "_own", "_next", "_stop", many.alias("_many")).where("_many > 0")
    # A frame that starts up to a millionth after the target counts as reached.
    at, until = F.col("_own.p") - 1e-6, F.col("_next.p") - 1e-6
    place = lambda t: F.floor(F.greatest(F.lit(0.0), F.least(F.col("_many") - 1.0, t)))
    ks = F.sequence(place(at * fps - 1), place(F.when(F.col("_next").isNull(), F.col("_many") - 1.0).otherwise(until * fps + 1)))
    out = rows.withColumn("k", F.explode(ks)).withColumn("t", F.col("k") / fps)
    out = out.where((at <= F.col("t")) & (F.col("_next").isNull() | (F.col("t") < until)) & (F.col("t") <= F.col("_stop") + 1e-6))
    span = F.col("_next.p") - F.col("_own.p")
    here = (F.abs(F.col("t") - F.col("_own.p")) <= 1e-6) | F.col("_next").isNull() | (span <= 1e-6)
    phi = F.when(here, 0.0).otherwise(clamp((F.col("t") - F.col("_own.p")) / F.when(span > 0, span), 0.0, 1.0))
    there = phi >= 1 - 1e-6
    ends_of = lambda name, i: (F.when(there, F.col("_next")).otherwise(F.col("_own")) if i == 0 else F.coalesce("_next", "_own"))[name]
    sides = [ends_of(v, i).alias(f"{v}_{i}") for v in values for i in (0, 1)]
    return out.select(*by, "k", ends_of("i", 0).alias("i0"), ends_of("i", 1).alias("i1"), F.when(there, 1.0).otherwise(phi).alias("phi"), (here | there).alias("exact"), *sides)


def cut_aware_plan(slots: DataFrame, cuts: DataFrame | Column, by: Names, frame: str) -> DataFrame:
    """What to do for each slot: copy a frame or blend two. Nothing is blended across a cut. ``cuts`` are
    rows, or a condition on the values that slots carry of frame ``i0``."""
    if isinstance(cuts, Column):
        marked = slots.withColumn("_cut", cuts)
    else:
        marked = slots.join(cuts.select(*by, F.col(frame).cast("long").alias("i0"), F.lit(True).alias("_cut")), [*by, "i0"], "left")
    cut = F.coalesce(F.col("_cut"), F.lit(False)) & (F.col("i1") == F.col("i0") + 1)
    copy = F.when(F.col("exact") | (F.col("phi") <= 0), F.col("i0")).when(F.col("phi") >= 1, F.col("i1")).when(cut & (F.col("phi") < 0.5), F.col("i0")).when(cut, F.col("i1"))
    rows = marked.withColumns({"copy": copy, "at_cut": cut}).withColumn("action", F.when(F.col("copy").isNull(), "blend").otherwise("copy"))
    return rows.withColumn("forced", F.col("at_cut") & F.col("copy").isNotNull() & ~F.col("exact")).drop("_cut")


def blend(slots: DataFrame, frames: DataFrame | None, by: Names, frame: str, value: str) -> DataFrame:
    """The values of planned slots: a copy, or the two frames mixed by ``phi``. ``value`` is a number
    or an array of numbers. Without ``frames`` slots carry it, as ``map_target_frames`` gives it."""
    if frames is None:
        first = F.col("copy").isNull() | (F.col("copy") == F.col("i0"))
        rows = slots.withColumns({"_v0": F.when(first, F.col(f"{value}_0")).otherwise(F.col(f"{value}_1")), "_v1": F.col(f"{value}_1")}).drop(f"{value}_0", f"{value}_1")
    else:
        side = lambda i, n: frames.select(*by, F.col(frame).cast("long").alias(i), F.col(value).alias(n))
        rows = slots.withColumn("_a", F.coalesce("copy", "i0")).withColumn("_b", F.coalesce("copy", "i1"))
        rows = rows.join(side("_a", "_v0"), [*by, "_a"]).join(side("_b", "_v1"), [*by, "_b"])
    mix = lambda a, b: (1 - F.col("phi")) * a + F.col("phi") * b
    if dict(rows.dtypes)["_v0"].startswith("array"):
        mixed, copied = F.zip_with("_v0", "_v1", mix), F.transform("_v0", lambda x: x.cast("double"))
    else:
        mixed, copied = mix(F.col("_v0"), F.col("_v1")), F.col("_v0").cast("double")
    return rows.withColumn(value, F.when(F.col("copy").isNotNull(), copied).otherwise(mixed)).drop("_a", "_b", "_v0", "_v1")


def expand_durations(df: DataFrame, by: Names, order: str, dur: str, k: int, last_segment: str) -> DataFrame:
    """Each frame becomes ``k`` slots; a lone frame, and the tail of the last segment, one."""
    w = over(by, [order])
    tail = F.lead(F.lit(1)).over(w).isNull()
    alone = tail & F.lag(F.lit(1)).over(w).isNull()
    copies = F.when(alone | (tail & F.col(last_segment)), 1).otherwise(k)
    rows = df.withColumn("_n", copies).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.withColumn("slot_dur", F.greatest(F.lit(0.0005), F.col(dur) / F.col("_n"))).drop("_n")


def expand_durations_exact(df: DataFrame, by: Names, order: str, dur: str, slots: Column, last_segment: str) -> DataFrame:
    """Spreads ``slots`` over the frames of a segment, one at least for each, evenly by rounding what is
    due up to each frame. A lone frame gets one slot; the tail of the last segment gets one, and the
    frames before it the others."""
    rows = df.withColumns({"_i": F.row_number().over(over(by, [order])), "_len": F.count(F.lit(1)).over(Window.partitionBy(*by)), "_tail": F.coalesce(F.col(last_segment), F.lit(False)).cast("int")})
    body = F.col("_len") - F.col("_tail")
    rows = rows.withColumn("_r", (F.greatest(slots, F.col("_len")) - F.col("_tail")) / F.when(body > 0, body))
    n = F.when((F.col("_len") == 1) | (F.col("_i") > body), 1).otherwise(half_away(F.col("_i") * F.col("_r")) - half_away((F.col("_i") - 1) * F.col("_r")))
    rows = rows.withColumn("_n", n.cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.withColumn("slot_dur", F.greatest(F.lit(0.0005), F.col(dur) / F.col("_n"))).drop("_i", "_len", "_tail", "_r", "_n")


def segment_targets(segments: DataFrame, n: str, last: str, factor: int) -> DataFrame:
    target = F.when(F.col(n) == 1, F.lit(factor)).when(F.col(last), (F.col(n) - 1) * factor + 1).otherwise(F.col(n) * factor)
    return segments.withColumn("target", target.cast("long"))


def segment_targets_exact(segments: DataFrame, by: Names, order: str, n: str, slots: int) -> DataFrame:
    """Targets that add up: the last frame of a segment, the k-th of all from 0, belongs at the place
    ``k`` steps after the first of ``slots``, and the segment gets what brings the frames made so far to
    that place, but one more than it has at least; the last one gets what is left. A lone frame is
    copied once. Without slots, or with a single frame in all, a segment gets one more than it has.
    What was made before decides, so this is a fold."""
    seen, total = F.sum(n).over(over(by, [order])), F.sum(n).over(Window.partitionBy(*by))
    step_size = F.lit(float(slots - 1)) / F.when(total > 1, total - 1)
    due = F.when(seen >= total, F.lit(slots).cast("long")).otherwise(half_away((seen - 1) * step_size) + 1)
    rows = segments.select(*by, F.col(order).cast("long").alias(order), F.col(n).cast("long").alias("_n"), F.when((total > 1) & F.lit(slots > 0), due).alias("_due"))

    def step(made: int, row: tuple) -> tuple[int, tuple]:
        at, own, due = row
        own = max(1, own)
        target = own + 1 if due is None else 1 if own == 1 else max(own + 1, due - made)
        return made + target, (at, target)

    return ordered_fold(rows, by, [order], ["_n", "_due"], step, f"`{order}` long, target long", 0)


def expected_frames(n: Column, factor: float, override: Column | None = None) -> Column:
    """Frames after interpolation by a factor, of which one below 1 counts as 1; 0 without frames. An
    override counts if it is above 0."""
    plain = F.when(n > 0, half_even((n - 1) * F.lit(float(factor) if 1 < factor < float("inf") else 1.0) + 1)).otherwise(F.lit(0).cast("long"))
    return plain if override is None else F.when(override > 0, override).otherwise(plain)


def count_mismatch(actual: Column, expected: Column, tolerance: int) -> Column:
    """Whether counts differ by more than a tolerance; nothing is known where none are expected."""
    return (expected > 0) & (F.abs(actual - expected) > max(0, tolerance))


#: Durations nearer than this to a run's first are one run.
SAME_DURATION = 1e-5


def _good(v: float | None) -> bool:
    return v is not None and math.isfinite(v) and v > 0


def timestamp_collisions(df: DataFrame, by: Names, order: str, dur: str, rate: float) -> DataFrame:
    """``collisions`` of neighbours whose times fall on the same tick of ``rate``, 0 with a bad duration,
    and ``time_base``, a rate that avoids them. In a run of equal durations a frame's time is the run's
    start and so many times its first duration, so that nothing sums up. One fold, no array."""
    tick, usable = 1.0 / rate if rate > 0 else 0.0, rate > 0 and math.isfinite(rate)

    # State: the run's start, length and duration; the last tick, collisions, a bad one seen, the least.
    def step(state: tuple | None, row: tuple) -> tuple[tuple, None]:
        begun, k, head, before, n, bad, least = state or (0.0, 0, None, None, 0, False, None)
        v = row[1]
        least = v if _good(v) and (least is None or v < least) else least
        if bad or not _good(v):
            return (begun, k, head, before, n, True, least), None
        if head is None:
            head = v
        elif abs(v - head) >= SAME_DURATION:
            begun, k, head = begun + head * k, 0, v
        at = int((begun + k * head) / tick) if usable else None
        return (begun, k + 1, head, at, n + (at is not None and at == before), False, least), None

    def finish(state: tuple) -> tuple:
        *_, n, bad, least = state
        base = math.ceil(max(rate if usable else 1.0, 2 / least if least else 0.0))
        return (0 if bad else n, min(max(base, 1), 100_000))

    rows = df.select(*by, order, F.col(dur).cast("double").alias("_dur"))
    return ordered_fold(rows, by, [order], ["_dur"], step, "collisions long, time_base long", None, finish)


def run_length(df: DataFrame, by: Names, order: str, value: str) -> DataFrame:
    """Runs of equal values: ``start``, ``stop`` (exclusive), ``n`` and the value."""
    new = F.coalesce(F.lag(value).over(over(by, [order])) != F.col(value), F.lit(True))
    runs = df.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(over(by, [order])))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count(F.lit(1)).alias("n"), F.min(value).alias(value)).drop("_run")


def run_length_within(df: DataFrame, by: Names, order: str, value: str, tolerance: float = SAME_DURATION, max_runs: int = 400) -> DataFrame:
    """Runs of values nearer than the tolerance to the run's first, as durations have them: ``start``,
    ``stop``, ``value`` and ``offset``, the time before the run. Keys with more runs than allowed, or
    with a value that is not finite or not positive, have none. A run depends on where the last one
    began, so this is a fold, which gives a run once it ends."""

    # State: first value (None for a bad one), start and stop of the run.
    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        at, v = int(row[0]), row[1] if _good(row[1]) else None
        if state is None:
            return (v, at, at + 1), None
        head, start, _ = state
        if v is not None and head is not None and abs(v - head) < tolerance:
            return (head, start, at + 1), None
        return (v, at, at + 1), (start, state[2], head)

    rows = df.select(*by, order, F.col(value).cast("double").alias("_v"))
    runs = ordered_fold(rows, by, [order], ["_v"], step, "start long, stop long, value double", None, lambda s: (s[1], s[2], s[0]))
    whole = Window.partitionBy(*by)
    runs = runs.withColumns({"_n": F.count(F.lit(1)).over(whole), "_bad": F.bool_or(F.col("value").isNull()).over(whole)}).where(~F.col("_bad") & (F.col("_n") <= max_runs)).drop("_n", "_bad")
    before = over(by, ["start"]).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(F.col("value") * (F.col("stop") - F.col("start"))).over(before), F.lit(0.0)))


def interp_layout(df: DataFrame, by: Names, order: str, target: Column, pairs: Column, pieces: int | None = None) -> DataFrame:
    """Slots of each pair of frames, numbered from 0 by ``order``, and the first slot's index. ``pieces``
    as in ``core.sum_before``."""
    extra = F.greatest(F.lit(0), F.floor((target - 1) / pairs) - 1)
    rows = df.withColumn("slots", (1 + extra + F.when(F.col(order) < (target - 1) % pairs, 1).otherwise(0)).cast("long"))
    return sum_before(rows, by, [order], F.col("slots"), "first", pieces).withColumn("first", 1 + F.col("first"))


def fixed_segments(df: DataFrame, by: Names, order: str, n: int) -> DataFrame:
    """Runs of ``n`` frames numbered from 0, the last one shorter."""
    return df.groupBy(*by, F.expr(f"{order} div {n}").alias("segment")).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n"))


def segment_size(free_kb: Column, per_frame: Column, factor: Column) -> Column:
    """Frames that fit into two thirds of the free space; 0 if under 50, 2000 at most."""
    n = F.floor(free_kb * 1024 * 0.65 / (per_frame * (factor + 1)))
    return F.when(n < 50, F.lit(0).cast("long")).otherwise(F.least(n, F.lit(2000).cast("long")))


def assign_batch(df: DataFrame, by: Names, order: str, sizes: DataFrame, number: str, size: str) -> DataFrame:
    """``number`` of the batch that holds each frame, if batches of given sizes follow each other;
    frames past the last batch are left out."""
    w = over(by, [number])
    names = [c for c in df.columns if c != number]
    ends = sizes.withColumn("_stop", F.sum(size).over(w)).withColumn("_start", F.col("_stop") - F.col(size)).where(F.col(size) > 0)
    # Batches and frames in one order, the last batch that began carried on.
    begun = ends.select(*[F.col(c) if c in by else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names], F.col("_start").cast("double").alias("_at"), F.lit(0).alias("_frame"), F.struct(number, "_stop").alias("_batch"))
    rows = df.select(*names, F.col(order).cast("double").alias("_at"), F.lit(1).alias("_frame"), F.lit(None).cast(begun.schema["_batch"].dataType).alias("_batch"))
    carried = begun.unionByName(rows).withColumn("_batch", F.last("_batch", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_frame")))
    return carried.where((F.col("_frame") == 1) & (F.col("_at") < F.col("_batch._stop"))).select(*names, F.col(f"_batch.{number}").alias(number))


def spread_sample(df: DataFrame, by: Names, order: str, need: int) -> DataFrame:
    """``need`` frames of each key, evenly over the middle half, or the whole if that is short."""
    rows = df.withColumns({"_i": F.row_number().over(over(by, [order])) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    if need == 1:
        return rows.where(F.col("_i") == F.expr("_n div 2")).drop("_i", "_n")
    low = F.expr("_n div 4")
    high = F.col("_n") - 1 - low
    short = high - low + 1 < need
    low, high = F.when(short, 0).otherwise(low), F.when(short, F.col("_n") - 1).otherwise(high)
    # The k-th target; rounding may repeat one, and each is one more than the last at least.
    targets = F.transform(F.sequence(F.lit(0), F.lit(need - 1)), lambda k: half_away(low + k * (high - low) / F.lit(float(need - 1))))
    strict = F.aggregate(targets, F.array().cast("array<bigint>"), lambda acc, t: F.concat(acc, F.array(F.when(F.size(acc) == 0, t).otherwise(F.greatest(t, F.element_at(F.when(F.size(acc) == 0, F.array(F.lit(0).cast("long"))).otherwise(acc), -1) + 1)))))
    return rows.where((F.col("_n") <= need) | F.array_contains(strict, F.col("_i").cast("long"))).drop("_i", "_n")
