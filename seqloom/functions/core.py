"""Small column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

Names = Sequence[str]


def over(by: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def r6(col: Column | str) -> Column:
    """Six places; a zero has no sign."""
    return F.round(col, 6) + F.lit(0.0)


def item(values: Column, index: Column) -> Column:
    """Element at a 0-based index, null outside."""
    return F.get(values, index.cast("int"))


def upper_median(values: Column) -> Column:
    """Middle element of the sorted array, the upper one of an even number; 0 if it is empty."""
    return F.coalesce(item(F.array_sort(values), F.floor(F.size(values) / 2)), F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def variance(values: Column) -> Column:
    """Population variance, in one pass around a running mean."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        n, d = acc["n"] + 1, x - acc["mean"]
        return F.struct(n.alias("n"), (acc["mean"] + d / n).alias("mean"), (acc["m2"] + d * d * (acc["n"] / n)).alias("m2"))

    return F.aggregate(values, start, step, lambda a: F.when(a["n"] > 0, a["m2"] / F.when(a["n"] > 0, a["n"])))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def finite(col: Column) -> Column:
    """True for numbers that are neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(col) & (F.abs(col) < float("inf")), F.lit(False))


def half_even(col: Column) -> Column:
    return F.bround(col).cast("long")


def half_away(col: Column) -> Column:
    return F.round(col).cast("long")


def gathered(df: DataFrame, by: Names, order: Names, values: Names, name: str = "rows") -> DataFrame:
    """A row for each key with its rows as an array of structs in order. For folds whose state
    depends on earlier results; filter to the rows that matter first, for a key's array is one value."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias(name))


def _in_pieces(df: DataFrame, by: Names, order: Names, pieces: int) -> DataFrame:
    """``df`` dealt out by ranges of key and order and written, with the number of its range as ``_piece``."""
    from ..sources.scratch import staged

    return staged(df.repartitionByRange(pieces, *by, *order).withColumn("_piece", F.spark_partition_id()), "pieces")


def _with_earlier(rows: DataFrame, earlier: DataFrame, by: Names) -> DataFrame:
    """``rows`` with ``_earlier`` of their key and range; null keys are keys."""
    earlier = earlier.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_piece").alias("_p"), "_earlier")
    same = F.col("_piece") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(earlier, same)


def sum_before(df: DataFrame, by: Names, order: Names, value: Column, name: str, pieces: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its key before it in order, 0 for the first.

    By default one window, in which a key is one task. With ``pieces`` a scan in two levels, for keys
    larger than a task: rows are dealt out by ranges of key and order, sums within a range come from
    a window over it, and those of earlier ranges of the key from the ranges' totals. Rows that tie in
    ``order`` should not differ."""
    running = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if pieces is None:
        return df.withColumn(name, running(over(by, order), value))
    dealt = _in_pieces(df.withColumn("_scanned", value), by, order, pieces)
    totals = dealt.groupBy(*by, "_piece").agg(F.sum("_scanned").alias("_total"))
    earlier = totals.withColumn("_earlier", running(over(by, ["_piece"]), F.col("_total")))
    within = dealt.withColumn("_within", running(over([*by, "_piece"], order), F.col("_scanned")))
    return _with_earlier(within, earlier, by).withColumn(name, F.col("_earlier") + F.col("_within")).select(*df.columns, name)


def beside(df: DataFrame, by: Names, order: Names, value: Column, name: str, pieces: int | None = None, after: bool = False) -> DataFrame:
    """``df`` with ``name``: the nearest ``value`` that is not null of the rows of its key before it in order
    (or ``after`` it), null if there is none. ``pieces`` as in :func:`sum_before`: what a range's rows do
    not have among them is the last that earlier ranges have."""
    sort = lambda names: [F.desc(c) if after else F.asc(c) for c in names]
    last = lambda keys, names, v: F.last(v, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*sort(names)).rowsBetween(Window.unboundedPreceding, -1))
    if pieces is None:
        return df.withColumn(name, last(by, order, value))
    dealt = _in_pieces(df.withColumn("_seen", value), by, order, pieces)
    place = F.when(F.col("_seen").isNotNull(), F.struct(*order))
    ends = dealt.groupBy(*by, "_piece").agg((F.min_by if after else F.max_by)("_seen", place).alias("_end"))
    earlier = ends.withColumn("_earlier", last(by, ["_piece"], F.col("_end")))
    within = dealt.withColumn("_within", last([*by, "_piece"], order, F.col("_seen")))
    return _with_earlier(within, earlier, by).withColumn(name, F.coalesce("_within", "_earlier")).select(*df.columns, name)


def at_rank(df: DataFrame, by: Names, value: str, rank: Callable[[Column], Column], name: str = "at", most: int = 100_000, cells: int = 1024) -> DataFrame:
    """For each key its number of values, ``n``, and the one at a place (from 0) in their order, which
    ``rank`` makes of the number, as ``name``; values that are null or not finite do not count.

    Selection by counts: values of keys of more than ``most`` are counted in cells of equal width
    between the least and the largest of the key (of their logarithms, while these lie far apart), and
    only those of the cell that holds the place go on, till they are few or all the same: a handful
    of passes for any doubles. Counts are summed before they travel, so no key's values
    meet in a task; only up to ``most`` of them are sorted."""
    from ..sources.scratch import staged

    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    null_safe = lambda keys: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    renamed = lambda t: t.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in t.columns if c not in by])
    plain = lambda t: t.drop(*[f"_{c}" for c in by])
    if not by:
        raise ValueError("a key is needed")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    open_keys = sizes.withColumn("_rank", F.least(F.greatest(rank(F.col("n")), F.lit(0)), F.col("n") - 1).cast("long")).withColumn("_left", F.col("n"))
    crowded = (F.col("_left") > most) & (F.col("_low") < F.col("_high"))
    while True:
        open_keys = staged(open_keys, "ranks")
        if open_keys.where(crowded).isEmpty():
            break
        some = plain(rows.join(renamed(open_keys.where(crowded)), null_safe(by))).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        far = (F.signum("_low") != F.signum("_high")) | (F.greatest(F.abs("_low"), F.abs("_high")) > 4 * F.least(F.abs("_low"), F.abs("_high")))
        scale = lambda v: F.when(far, F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))).otherwise(v)
        low, high = scale(F.col("_low")), scale(F.col("_high"))
        width = high / cells - low / cells
        cell = F.least(F.greatest(F.floor((scale(F.col("_v")) - low) / F.when(width > 0, width)), F.lit(0)), F.lit(cells - 1))
        counts = some.groupBy(*by, F.coalesce(cell, F.lit(0)).alias("_cell")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        counts = counts.withColumn("_until", F.sum("_m").over(over(by, ["_cell"])))
        held = plain(counts.join(renamed(open_keys.where(crowded).select(*by, "n", "_rank")), null_safe(by)))
        held = held.where((F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_m")))
        held = held.select(*by, "n", F.col("_a").alias("_low"), F.col("_b").alias("_high"), (F.col("_rank") - F.col("_until") + F.col("_m")).alias("_rank"), F.col("_m").alias("_left"))
        open_keys = open_keys.where(~crowded).select(*held.columns).unionByName(held)
    last = plain(rows.join(renamed(open_keys.where(F.col("_low") < F.col("_high"))), null_safe(by))).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    last = last.withColumn("_k", F.row_number().over(over(by, ["_v"])) - 1).where(F.col("_k") == F.col("_rank")).select(*by, "n", F.col("_v").alias(name))
    return last.unionByName(open_keys.where(F.col("_low") >= F.col("_high")).select(*by, "n", F.col("_low").alias(name)))


def ordered_fold(df: DataFrame, by: Names, order: Names, values: Names, step: Callable[[object, tuple], tuple[object, tuple | None]], out: str, start: object = None, finish: Callable[[object], tuple | None] | None = None) -> DataFrame:
    """Folds the rows of each key in order. ``step(state, values) -> state, row`` gets the row's
    ``order`` and ``values`` and gives a row of the schema ``out``, or None; ``finish(state)`` gives one
    more at the key's end, or None. Rows flow through sorted partitions, so a key of any length costs
    one pass and no more memory than its state."""
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(kinds[c] for c in by), *T._parse_datatype_string(out).fields])
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        key, state = None, start

        def batch(made: list[tuple]) -> Iterator[pa.RecordBatch]:
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], schema.names)

        def ended() -> list[tuple]:
            last = finish(state) if finish and key is not None else None
            return [] if last is None else [(*key, *last)]

        for b in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != key:
                    made += ended()
                    key, state = row[:n], start
                state, new = step(state, row[n:])
                if new is not None:
                    made.append((*key, *new))
            yield from batch(made)
        yield from batch(ended())

    rows = df.select(*by, *order, *values)
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    return rows.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def fold(rows: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(rows, start, step, finish) if finish else F.aggregate(rows, start, step)
