"""Operators on pixel tables: a row a pixel with its grid, ``y``, ``x`` and values.

Filters of neighbourhoods pack the pixels of a tile, with a border as wide as all their passes reach,
into arrays: whatever the number of passes, pixels are shuffled once, and no task holds more than a
tile of a grid at a time. Missing pixels count as lying outside the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.core import Names, clamp, fold, gathered, ordered_fold, over

CHANNELS = ("r", "g", "b")
#: Side of a tile without its border.
TILE = 256
Arrays = dict[str, np.ndarray]


def _byte(col: Column) -> Column:
    return clamp(F.bround(col), 0, 255)


def _trunc(col: Column) -> Column:
    return col.cast("long").cast("double")


def on_grids(cells: DataFrame, grid: Names, halo: int, values: Sequence[str], outs: Sequence[str], rule: Callable[[Arrays], Arrays], tile: int = TILE) -> DataFrame:
    """``cells`` with the columns ``outs``, which ``rule`` makes of ``values``: arrays of many tiles of one
    shape (tile, row, column), NaN where there is no pixel. What is made of a pixel may depend on
    others up to ``halo`` away. All other columns stay."""
    near = lambda p: F.sequence(F.greatest(F.lit(0), F.floor((F.col(p) - halo) / tile)).cast("int"), F.greatest(F.lit(0), F.floor((F.col(p) + halo) / tile)).cast("int"))
    own = lambda p: F.greatest(F.lit(0), F.floor(F.col(p) / tile)).cast("int")
    keys = [*grid, "_ty", "_tx"]
    dealt = cells.withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x"))).withColumn("_own", (F.col("_ty") == own("y")) & (F.col("_tx") == own("x")))
    dealt = dealt.withColumns({f"_v{k}": F.col(v).cast("double") for k, v in enumerate(values)})
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    kept = [f for f in cells.schema.fields if f.name not in outs]
    schema = T.StructType([*kept, *(T.StructField(o, T.DoubleType()) for o in outs)])

    def made(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        y, x, own = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("y", "x", "_own"))
        given = {v: part.column(f"_v{k}").combine_chunks().to_numpy(zero_copy_only=False) for k, v in enumerate(values)}
        sizes = np.diff(np.r_[starts, len(y)])
        top, left = np.minimum.reduceat(y, starts), np.minimum.reduceat(x, starts)
        shape = np.stack([np.maximum.reduceat(y, starts) - top + 1, np.maximum.reduceat(x, starts) - left + 1], axis=1)
        group = np.repeat(np.arange(len(starts)), sizes)
        at = (y - top[group], x - left[group])
        new = {o: np.empty(len(y)) for o in outs}
        for h, w in np.unique(shape, axis=0):
            some = np.flatnonzero((shape == (h, w)).all(axis=1))
            place = np.full(len(starts), -1)
            place[some] = np.arange(len(some))
            rows = np.flatnonzero(place[group] >= 0)
            spot = (place[group[rows]], at[0][rows], at[1][rows])
            arrays = {}
            for v, data in given.items():
                arrays[v] = np.full((len(some), h, w), np.nan)
                arrays[v][spot] = data[rows]
            for o, data in rule(arrays).items():
                new[o][rows] = data[spot]
        mine = np.flatnonzero(own)
        part = part.select([f.name for f in kept]).take(pa.array(mine)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in part.columns), *(pa.array(new[o][mine], from_pandas=True) for o in outs)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rest = None

        def new_group(table: pa.Table) -> np.ndarray:
            flags = np.zeros(table.num_rows, bool)
            flags[:1] = True
            for k in keys:
                c = table.column(k).combine_chunks()
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                different = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
                flags[1:] |= different
            return np.flatnonzero(flags)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            # Only what may end a group is looked at; a group that goes on is just held.
            if len(held) > 1 and len(new_group(pa.Table.from_batches([held[-2].slice(held[-2].num_rows - 1), b]))) == 1:
                continue
            table = pa.Table.from_batches(held)
            starts = new_group(table)
            cut = int(starts[-1])
            if cut:
                yield made(table.slice(0, cut), starts[:-1])
            rest = table.slice(cut)
            held = rest.to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield made(table, new_group(table))

    return dealt.mapInArrow(run, schema)


def _shifted(a: np.ndarray, axis: int, by: int) -> np.ndarray:
    """The neighbour ``by`` places before (or, if negative, after) each pixel; NaN outside."""
    out = np.full_like(a, np.nan)
    to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    to[axis], of[axis] = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
    if abs(by) < a.shape[axis]:
        out[tuple(to)] = a[tuple(of)]
    return out


def _or(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(a), b, a)


def _three(a: np.ndarray) -> np.ndarray:
    for axis in (-1, -2):
        a = (_or(_shifted(a, axis, 1), a) + a + _or(_shifted(a, axis, -1), a)) / 3
    return a


def _window(a: np.ndarray, radius: int, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    for axis in (-1, -2):
        a = np.where(np.isnan(a), np.nan, join([_shifted(a, axis, k) if k else a for k in range(radius, -radius - 1, -1)]))
    return a


def _mean(parts: list[np.ndarray]) -> np.ndarray:
    total, n = np.zeros_like(parts[0]), np.zeros_like(parts[0])
    for p in parts:
        there = ~np.isnan(p)
        total += np.where(there, p, 0.0)
        n += there
    return total / np.maximum(n, 1)


def _least(parts: list[np.ndarray]) -> np.ndarray:
    return np.fmin.reduce(parts)


def _most(parts: list[np.ndarray]) -> np.ndarray:
    return np.fmax.reduce(parts)


def _bytes3(a: np.ndarray) -> np.ndarray:
    for axis in (-1, -2):
        p, q = _shifted(a, axis, 1), _shifted(a, axis, -1)
        one, other = np.isnan(p), np.isnan(q)
        a = np.where(one & other, a, np.floor(np.where(one, (a + q + 1) / 2, np.where(other, (p + a + 1) / 2, (p + a + q + 1) / 3))))
    return a


def _nine(a: np.ndarray) -> np.ndarray:
    """The nine values around each pixel, row by row, along a new first axis; borders repeat."""
    three = np.stack([_or(_shifted(a, -1, 1), a), a, _or(_shifted(a, -1, -1), a)])
    return np.concatenate([_or(_shifted(three, -2, 1), three), three, _or(_shifted(three, -2, -1), three)])


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255)


def box3(cells: DataFrame, grid: Names, value: str = "v", out: str = "v") -> DataFrame:
    """Mean of three along rows, then columns; borders repeat."""
    return on_grids(cells, grid, 1, [value], [out], lambda a: {out: _three(a[value])})


def box_mean(cells: DataFrame, grid: Names, radius: int, values: Sequence[str] = ("v",)) -> DataFrame:
    """Mean within ``radius`` along rows, then columns; windows shrink at borders."""
    return cells if radius < 1 else on_grids(cells, grid, radius, values, values, lambda a: {v: _window(a[v], radius, _mean) for v in values})


def _repeated(rule: Callable[[np.ndarray], np.ndarray], times: int) -> Callable[[np.ndarray], np.ndarray]:
    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = rule(a)
        return a

    return run


def box3_bytes(cells: DataFrame, grid: Names, passes: int = 1, values: Sequence[str] = ("v",)) -> DataFrame:
    """Integer mean of three along rows, then columns, of two at the ends, rounded up by one unit
    before the division; repeated."""
    rule = _repeated(_bytes3, passes)
    return on_grids(cells, grid, passes, values, values, lambda a: {v: rule(a[v]) for v in values})


def erode(cells: DataFrame, grid: Names, radius: int, values: Sequence[str] = ("v",)) -> DataFrame:
    return cells if radius < 1 else on_grids(cells, grid, radius, values, values, lambda a: {v: _window(a[v], radius, _least) for v in values})


def dilate(cells: DataFrame, grid: Names, radius: int, values: Sequence[str] = ("v",)) -> DataFrame:
    return cells if radius < 1 else on_grids(cells, grid, radius, values, values, lambda a: {v: _window(a[v], radius, _most) for v in values})


def opened(cells: DataFrame, grid: Names, radius: int, values: Sequence[str] = ("v",)) -> DataFrame:
    if radius < 1:
        return cells
    return on_grids(cells, grid, 2 * radius, values, values, lambda a: {v: _window(_window(a[v], radius, _least), radius, _most) for v in values})


def alpha_stretch(cells: DataFrame, grid: Names, fg: float, bg: float, feather: int = 0, morph: int = 0, value: str = "v") -> DataFrame:
    """Maps ``bg`` and below to 0, ``fg`` and above to 1, then blurs and opens as asked, by a cell at
    least if at all."""
    if fg > bg > 0:
        v = F.col(value)
        cells = cells.withColumn(value, F.when(v <= bg, 0.0).when(v >= fg, 1.0).otherwise((v - bg) / (fg - bg)))
    blur, open_by = max(1, feather // 2) if feather > 0 else 0, max(1, morph // 25) if morph > 0 else 0
    if not blur and not open_by:
        return cells

    def rule(a: Arrays) -> Arrays:
        out = _window(a[value], blur, _mean) if blur else a[value]
        return {value: _window(_window(out, open_by, _least), open_by, _most) if open_by else out}

    return on_grids(cells, grid, blur + 2 * open_by, [value], [value], rule)


def composite(fg: DataFrame, alpha: DataFrame, bg: DataFrame, grid: Names, values: Sequence[str] = CHANNELS) -> DataFrame:
    """Foreground over background by alpha, as bytes."""
    on = [*grid, "y", "x"]
    rows = fg.join(alpha.withColumnRenamed("v", "_a"), on).join(bg.select(*on, *[F.col(c).alias(f"_{c}") for c in values]), on)
    return rows.select(*on, *[clamp(F.floor(F.col("_a") * F.col(c) + (1 - F.col("_a")) * F.col(f"_{c}") + 0.5).cast("double"), 0, 255).alias(c) for c in values])


def otsu(cells: DataFrame, grid: Names, value: str = "v") -> DataFrame:
    """Threshold of each grid that parts its histogram best, the lowest of equals, as ``fg`` and ``bg``
    levels; 128 if nothing can be parted. A grid without values has no threshold, and levels of its
    own. Bins without pixels change nothing, so only those with some are looked at."""
    bins = cells.groupBy(*grid, F.floor(clamp(F.col(value), 0, 1) * 255 + 0.5).alias("bin")).agg(F.count(value).alias("n"))
    w, whole = over(grid, ["bin"]), Window.partitionBy(*grid)
    rows = bins.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("n") * F.col("bin")).over(w), "nn": F.sum("n").over(whole), "ss": F.sum(F.col("n") * F.col("bin")).over(whole)})
    wf = F.col("nn") - F.col("wb")
    gap = F.col("sb") / F.when(F.col("wb") > 0, F.col("wb")) - (F.col("ss") - F.col("sb")) / F.when(wf > 0, wf)
    rows = rows.withColumn("between", F.col("wb") * wf * gap * gap)
    best = rows.groupBy(*grid).agg(F.max_by("bin", F.when(F.col("between").isNotNull(), F.struct("between", -F.col("bin")))).alias("b"), F.max("nn").alias("nn"))
    out = best.select(*grid, F.when(F.col("nn") > 0, F.coalesce("b", F.lit(128).cast("long"))).alias("threshold"))
    out = out.withColumn("fg", F.when(F.col("threshold").isNull(), 0.78).otherwise(clamp(F.col("threshold") / 255, 0.35, 0.95)))
    return out.withColumn("bg", F.when(F.col("threshold").isNull(), 0.42).otherwise(clamp(F.col("fg") - 0.14, 0.03, 0.85)))


def luma() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def tile_equalise(cells: DataFrame, grid: Names, w: int, h: int, strength: float, tiles: int = 8, least_side: int = 16) -> DataFrame:
    """Clipped equalisation of luma in each of ``tiles`` x ``tiles`` tiles, mixed bilinearly between
    four tiles and applied to the channels in part. Pixels between the same four tiles meet the
    histograms of these; pixels are shuffled once, and histograms are summed before they travel."""
    if min(w, h) < least_side:
        return cells
    tw, th, amount = -(-w // tiles), -(-h // tiles), strength / 100 * 0.2
    limit = max(1, int(2.0 * (tw * th) / 256))
    rows = cells.select(*grid, "y", "x", *CHANNELS).withColumn("lum", _byte(luma()).cast("int"))
    hist = rows.groupBy(*grid, F.expr(f"y div {th}").cast("int").alias("ty"), F.expr(f"x div {tw}").cast("int").alias("tx"), F.col("lum").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # A field lies between the middles of tiles, and is numbered by the one before it, from -1.
    field = lambda p, size: F.floor((F.col(p) - size / 2.0) / size).cast("int")
    fields = lambda t: F.array(*[c.cast("int") for c in (F.col(t) - 1, F.col(t))])
    sent = hist.withColumn("fy", F.explode(fields("ty"))).withColumn("fx", F.explode(fields("tx")))
    rows = rows.withColumns({"fy": field("y", th), "fx": field("x", tw)})
    keys = [*grid, "fy", "fx"]
    schema = T.StructType([*(cells.schema[c] for c in [*grid, "y", "x"]), *(T.StructField(c, T.DoubleType()) for c in CHANNELS)])

    def equal(n: np.ndarray) -> np.ndarray:
        """The map of levels: pixels up to each after clipping, and its part of what was clipped."""
        kept, excess, level = np.cumsum(np.minimum(n, limit)), int(np.maximum(n - limit, 0).sum()), np.arange(1, 257)
        return _bytes((kept + level * (excess // 256) + np.minimum(level, excess % 256)) * 255.0 / max(1, int(n.sum())))

    def run(pixels: pa.Table, counts: pa.Table) -> pa.Table:
        if not len(pixels):
            return schema_of.empty_table()
        ty, tx, lum, n = (counts.column(c).to_numpy() for c in ("ty", "tx", "bin", "n"))
        maps = {}
        for t in set(zip(ty.tolist(), tx.tolist(), strict=True)):
            own = (ty == t[0]) & (tx == t[1])
            maps[t] = equal(np.bincount(lum[own], n[own], 256).astype(np.int64))
        fy, fx = pixels.column("fy")[0].as_py(), pixels.column("fx")[0].as_py()
        inside_of = lambda k: min(max(k, 0), tiles - 1)
        level, empty = pixels.column("lum").to_numpy(), np.zeros(256)
        at = lambda i, j: maps.get((inside_of(fy + i), inside_of(fx + j)), empty)[level]
        wy, wx = (pixels.column("y").to_numpy() - th / 2.0) / th - fy, (pixels.column("x").to_numpy() - tw / 2.0) / tw - fx
        new = (at(0, 0) * (1 - wx) + at(0, 1) * wx) * (1 - wy) + (at(1, 0) * (1 - wx) + at(1, 1) * wx) * wy
        scale = new / np.maximum(1.0, level)
        out = {c: pixels.column(c) for c in [*grid, "y", "x"]}
        for c in CHANNELS:
            v = pixels.column(c).to_numpy().astype(float)
            out[c] = pa.array(_bytes(v + (np.rint(v * scale) - v) * amount))
        return pa.table(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_of = to_arrow_schema(schema)
    return rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, schema)


def dehaze(cells: DataFrame, grid: Names, strength: float) -> DataFrame:
    """Removes haze by the dark channel. Of equally dark pixels the first by place are brightest."""
    amount = strength / 100 * 0.55
    least = max(0.05, 1.0 - amount * 0.4)
    rule = _repeated(lambda a: _window(a, 2, _least), 6)
    rows = on_grids(cells.withColumn("dark", F.least(*CHANNELS)), grid, 12, ["dark"], ["dark"], lambda a: {"dark": rule(a["dark"])})
    order, whole = Window.partitionBy(*grid).orderBy(F.desc("dark"), "y", "x"), Window.partitionBy(*grid)
    rows = rows.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
    light = F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 1000))
    rows = rows.withColumns({f"a{c}": F.avg(F.when(light, F.col(c))).over(whole) for c in CHANNELS})
    t = clamp(1.0 - 0.95 * F.least(F.lit(1.0), F.col("dark") / (255.0 * 0.9 + 1.0)), least, 1.0)
    clear = lambda c: _trunc((F.col(c) - amount * F.col(f"a{c}")) / t)
    return rows.select(*grid, "y", "x", *[clamp(_trunc(F.col(c) * (1 - amount) + clear(c) * amount), 0, 255).alias(c) for c in CHANNELS])


def _inside(a: np.ndarray, reach: int = 1) -> np.ndarray:
    """Pixels that have all their neighbours."""
    out = ~np.isnan(a)
    for axis in (-1, -2):
        out &= ~np.isnan(_shifted(a, axis, reach)) & ~np.isnan(_shifted(a, axis, -reach))
    return out


def median3(cells: DataFrame, grid: Names, strength: float, values: Sequence[str] = CHANNELS) -> DataFrame:
    """Two passes of the median of nine, mixed with the original."""
    middle = _repeated(lambda a: np.sort(_nine(a), axis=0)[4], 2)
    rule = lambda a: {v: _bytes(a[v] + (middle(a[v]) - a[v]) * (strength / 100)) for v in values}
    return on_grids(cells.select(*grid, "y", "x", *values), grid, 2, values, values, rule)


def unsharp(cells: DataFrame, grid: Names, amount: float, threshold: float, passes: int = 1, value: str = "v") -> DataFrame:
    blur = _repeated(_bytes3, max(1, passes))

    def rule(a: Arrays) -> Arrays:
        diff = a[value] - blur(a[value])
        return {value: np.where(np.abs(diff) > threshold, np.clip(np.trunc(a[value] + amount * diff), 0, 255), a[value])}

    return on_grids(cells, grid, max(1, passes), [value], [value], rule)


def midtone_clarity(cells: DataFrame, grid: Names, amount: float, passes: int = 8) -> DataFrame:
    """Adds what eight blurs take away, most where luma is in the middle."""
    blur = _repeated(_bytes3, passes)

    def rule(a: Arrays) -> Arrays:
        t = np.abs(_luma(a) - 128.0) / 140.0
        k = amount * 0.5 * np.maximum(0.0, 1.0 - t * t)
        return {c: _bytes(a[c] + k * (a[c] - blur(a[c]))) for c in CHANNELS}

    return on_grids(cells.select(*grid, "y", "x", *CHANNELS), grid, passes, CHANNELS, CHANNELS, rule)


def high_freq_boost(cells: DataFrame, grid: Names, w: int, h: int, amount: float, threshold: float = 4.0, value: str = "v") -> DataFrame:
    """Adds the difference to the 3x3 mean, inner pixels only, less where it is small."""

    def rule(a: Arrays) -> Arrays:
        v = a[value]
        hp = v - _sum(_nine(v)) / 9.0
        size = np.abs(hp)
        gate = np.where(size > threshold, (size - threshold) / np.where(size > 0, size, 1.0), 0.0)
        return {value: np.where(_inside(v), _bytes(v + amount * hp * gate), v)}

    return on_grids(cells, grid, 1, [value], [value], rule)


def _sum(parts: np.ndarray) -> np.ndarray:
    total = np.zeros_like(parts[0])
    for p in parts:
        total = total + p
    return total


def _luma(a: Arrays) -> np.ndarray:
    return 0.299 * a["r"] + 0.587 * a["g"] + 0.114 * a["b"]


def _edge_weight(nine: np.ndarray) -> np.ndarray:
    gx = nine[2] + 2 * nine[5] + nine[8] - nine[0] - 2 * nine[3] - nine[6]
    gy = nine[6] + 2 * nine[7] + nine[8] - nine[0] - 2 * nine[1] - nine[2]
    return np.clip(np.sqrt(gx * gx + gy * gy) / 4.0 / 48.0, 0.0, 1.0)


def edge_gated_sharpen(cells: DataFrame, grid: Names, w: int, h: int, amount: float) -> DataFrame:
    """Adds luma less its blur to all channels, most at edges; inner pixels only."""

    def rule(a: Arrays) -> Arrays:
        lum = _bytes(_luma(a))
        blur = _bytes3(_bytes3(lum))
        add = amount * 1.5 * (lum - blur) * (0.25 + 0.75 * _edge_weight(_nine(blur)))
        return {c: np.where(_inside(lum), _bytes(a[c] + add), a[c]) for c in CHANNELS}

    return on_grids(cells.select(*grid, "y", "x", *CHANNELS), grid, 3, CHANNELS, CHANNELS, rule)


def edge_enhance(cells: DataFrame, grid: Names, w: int, h: int, amount: float, gain: float = 0.5) -> DataFrame:
    """Adds each channel's Laplacian of eight neighbours, weighted by the edge strength of luma."""

    def rule(a: Arrays) -> Arrays:
        lum = _bytes(_luma(a))
        weight = _edge_weight(_nine(_bytes3(lum)))
        lap = {c: (9.0 * a[c] - _sum(_nine(a[c]))) / 8.0 for c in CHANNELS}
        return {c: np.where(_inside(lum), _bytes(a[c] + amount * gain * lap[c] * weight), a[c]) for c in CHANNELS}

    return on_grids(cells.select(*grid, "y", "x", *CHANNELS), grid, 2, CHANNELS, CHANNELS, rule)


def edge_smooth(cells: DataFrame, grid: Names, strength: float, threshold: float = 16, value: str = "v") -> DataFrame:
    """Moves pixels that differ much from a neighbour toward the integer mean of the nine."""

    def rule(a: Arrays) -> Arrays:
        v, nine = a[value], _nine(a[value])
        edge = (nine.max(axis=0) - v >= threshold) | (v - nine.min(axis=0) >= threshold)
        mean = np.floor(_sum(nine) / 9)
        return {value: np.where(edge, np.clip(v + np.rint((mean - v) * (strength / 100 * 0.55)), 0, 255), v)}

    return on_grids(cells, grid, 1, [value], [value], rule)


def smoothed(now: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None, stability: float) -> np.ndarray:
    """One frame's pixels after those put out and read for the frame before; no pixel is NaN. Pixels
    at either end of the scale, now or before, are taken as they are, and so is all after a reset."""
    k = stability / 100 * 0.9
    if before is None or k <= 0:
        return now
    out, raw = before
    ends = (now <= 0.001) | (now >= 0.999) | (out <= 0.001) | (out >= 0.999)
    return np.where(ends, now, out + (now - out) * (1 - k * (1 - np.clip(3.5 * np.abs(now - raw), 0.0, 1.0))))


def temporal_smooth(cells: DataFrame, by: Names, order: str, reset: str, stability: float, value: str = "v", tile: int = TILE) -> DataFrame:
    """Steadies each pixel over frames in order; ``reset`` forgets what was. A pixel that a frame lacks
    keeps its last value in mind.

    A fold of tiles: pixels are shuffled once, to their tile and in order of frames; what is held of a
    tile are two arrays of its pixels, and a frame is one step of these."""
    if stability <= 0:
        return cells.select(*by, "y", "x", order, value)
    keys = [*by, "_ty", "_tx"]
    kinds = {f.name: f for f in cells.schema.fields}
    rows = cells.select(*by, F.expr(f"y div {tile}").cast("int").alias("_ty"), F.expr(f"x div {tile}").cast("int").alias("_tx"), F.col(order).cast("long").alias(order), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias(value), F.coalesce(F.col(reset), F.lit(False)).alias(reset))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    schema = T.StructType([*(kinds[c] for c in by), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField(order, T.LongType()), T.StructField(value, T.DoubleType())])
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, raw = None, np.full(tile * tile, np.nan), np.full(tile * tile, np.nan)
        left: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table if left is None else pa.concat_tables([left, table])
            frames = _starts(table, n + 3)
            # The last frame may go on in the next batch.
            left, table = table.slice(frames[-1]), table.slice(0, frames[-1])
            if len(frames) > 1:
                key, made = _fold_frames(table, frames[:-1], n, tile, stability, key, out, raw)
                yield made
        if left is not None and len(left):
            yield _fold_frames(left, np.array([0]), n, tile, stability, key, out, raw)[1]

    def _fold_frames(table: pa.Table, frames: np.ndarray, n: int, tile: int, stability: float, key: tuple | None, out: np.ndarray, raw: np.ndarray) -> tuple[tuple, pa.RecordBatch]:
        plain = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        y, x, now, forget = plain(n + 3), plain(n + 4), plain(n + 5), plain(n + 6)
        at = (y % tile) * tile + x % tile
        new = np.empty(len(now))
        tiles = set(_starts(table, n + 2).tolist())
        for start, stop in zip(frames, [*frames[1:], len(now)], strict=True):
            if start in tiles:
                own = tuple(table.column(c)[int(start)].as_py() for c in range(n + 2))
                if own != key:
                    key = own
                    out.fill(np.nan)
                    raw.fill(np.nan)
            p, v = at[start:stop], now[start:stop]
            known = ~np.isnan(out[p]) & ~forget[start:stop].astype(bool)
            new[start:stop] = np.where(known, smoothed(v, (out[p], raw[p]), stability), v)
            out[p], raw[p] = new[start:stop], v
        columns = [*(table.column(c).combine_chunks() for c in range(n)), table.column(n + 3).combine_chunks(), table.column(n + 4).combine_chunks(), table.column(n + 2).combine_chunks(), pa.array(new)]
        return key, pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _starts(table: pa.Table, columns: int) -> np.ndarray:
    """Where the first ``columns`` of a sorted table change; the first row is one."""
    change = np.zeros(len(table), bool)
    change[:1] = True
    for c in range(columns):
        v = table.column(c).combine_chunks()
        if len(v) > 1:
            a, b = v[:-1], v[1:]
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
            change[1:] |= ~same
    return np.flatnonzero(change)


def tile_split(cells: DataFrame, w: int, h: int, tile: int, overlap: int, least_stride: int = 32) -> DataFrame:
    """A row for each tile that covers a pixel: ``ty``, ``tx``, and the place ``py``, ``px`` in it."""
    stride = max(tile - overlap, least_stride)

    def covering(p: str, size: int) -> Column:
        last = F.least(F.floor(F.col(p) / stride), F.lit((size - 1) // stride))
        first = F.greatest(F.lit(0), F.ceil((F.col(p) - tile + 1) / stride))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))

    rows = cells.withColumn("ty", F.explode(covering("y", h))).withColumn("tx", F.explode(covering("x", w)))
    return rows.withColumns({"py": F.col("y") - F.col("ty") * stride, "px": F.col("x") - F.col("tx") * stride})


def tile_stitch(tiles: DataFrame, grid: Names, fade: int, value: str = "v") -> DataFrame:
    """Lays tiles over each other in order of row and column; each fades in at its left and top."""
    smooth = lambda t: t * t * (3.0 - 2.0 * t)
    side = lambda n, p: F.when((F.col(n) > 0) & (F.col(p) < fade), smooth((F.col(p) + 1) / max(1, fade))).otherwise(1.0)
    rows = tiles.withColumn("_w", side("tx", "px") * side("ty", "py"))
    rows = gathered(rows, [*grid, "y", "x"], ["ty", "tx"], [value, "_w"])
    lay = lambda acc, r: F.when(r["_w"] >= 1.0, r[value].cast("double")).otherwise(_trunc(acc * (1.0 - r["_w"]) + r[value] * r["_w"]))
    return rows.select(*grid, "y", "x", fold(F.col("rows"), F.lit(0.0), lay).alias(value))


#: Turns (clockwise) and mirrors for the eight orientation codes; fixed by the EXIF format.
ORIENTATIONS = {1: (0, False), 2: (0, True), 3: (180, False), 4: (180, True), 5: (90, True), 6: (90, False), 7: (270, True), 8: (270, False)}


def orient(cells: DataFrame, code: str, w: str, h: str) -> DataFrame:
    """Turned and mirrored pixels; unknown codes change nothing."""
    y, x, wide, high = F.col("y"), F.col("x"), F.col(w), F.col(h)
    new_y, new_x = y, x
    for n, (turn, mirror) in ORIENTATIONS.items():
        ty, tx, width = {0: (y, x, wide), 90: (x, high - 1 - y, high), 180: (high - 1 - y, wide - 1 - x, wide), 270: (wide - 1 - x, y, high)}[turn]
        new_y, new_x = F.when(F.col(code) == n, ty).otherwise(new_y), F.when(F.col(code) == n, width - 1 - tx if mirror else tx).otherwise(new_x)
    swap = F.col(code).isin([n for n, (turn, _) in ORIENTATIONS.items() if turn in (90, 270)])
    return cells.withColumns({"y": new_y, "x": new_x, w: F.when(swap, high).otherwise(wide), h: F.when(swap, wide).otherwise(high)})
