"""Streaming forms of the ordered folds, with state for each key.

Rows of a key are folded in order within a micro-batch, and batches are taken to follow each other:
a row that comes after a later one of an earlier batch is folded where it comes. Readers that can't
promise that should hold rows back by a delay of their own. State lives in a RocksDB store, which
:func:`drained` asks for; a query that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.grids import smoothed
from ..operators.ledgers import shown_next
from ..sources.scratch import shared_folder

Step = Callable[[tuple, dict], tuple[tuple, list[tuple]]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _records(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, missing values as None; columns are turned into lists once."""
    names = list(pdf.columns)
    columns = [c.astype(object).where(c.notna(), None).tolist() for _, c in pdf.items()]
    return (dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True))


class Fold(StatefulProcessor):
    """Folds a key's rows. Fields of the state that are arrays of structs are list states, the others
    together one value state. With ``keep_ms`` a timer of event time clears the state when the
    watermark is so far past the key's last row. Rows come one by one, or as ``frames`` of pandas."""

    def __init__(self, keys: int, columns: list[str], names: list[str], order: list[str], start: tuple, step: Step, state: T.StructType, keep_ms: int | None, time: str | None, frames: bool) -> None:
        self.keys, self.columns, self.names, self.start, self.step = keys, columns, names, start, step
        self.state, self.keep_ms, self.time, self.frames = state, keep_ms, time, frames
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = self.state.fields
        listed = [isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) for f in fields]
        self.listed = [i for i, one in enumerate(listed) if one]
        self.plain = [i for i, one in enumerate(listed) if not one]
        self.value = handle.getValueState("value", T.StructType([*(fields[i] for i in self.plain), T.StructField("_timer", T.LongType())]))
        self.lists = [handle.getListState(fields[i].name, fields[i].dataType.elementType) for i in self.listed]

    def _held(self) -> tuple[tuple, int | None]:
        found = self.value.get()
        if found is None:
            return self.start, None
        now = list(self.start)
        for i, v in zip(self.plain, found[:-1], strict=True):
            now[i] = v
        for i, held in zip(self.listed, self.lists, strict=True):
            now[i] = [tuple(x) for x in held.get()]
        return tuple(now), found[-1]

    def _hold(self, now: tuple, timer: int | None) -> None:
        self.value.update((*(now[i] for i in self.plain), timer))
        for i, held in zip(self.listed, self.lists, strict=True):
            if now[i]:
                held.put(list(now[i]))
            else:
                held.clear()

    def _rows(self, rows: Iterator) -> Iterator[dict]:
        if self.frames:
            return _records(pd.concat(list(rows)).sort_values(self.order))
        at = [self.columns.index(c) for c in self.order]
        return (dict(zip(self.columns, r, strict=True)) for r in sorted(rows, key=lambda r: [r[i] for i in at]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        (now, timer), made, last = self._held(), [], None
        for row in self._rows(rows):
            now, more = self.step(now, row)
            made += [(*key, *m) for m in more]
            last = row.get(self.time) if self.time else None
        if self.keep_ms is not None and last is not None:
            new = max(int(last.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep_ms
            if new != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(new)
                timer = new
        self._hold(now, timer)
        if not self.frames:
            return map(lambda m: T.Row(*self.names)(*m), made)
        return iter([pd.DataFrame(made, columns=self.names)] if made else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.value.clear()
        for held in self.lists:
            held.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], start: tuple, step: Step, state: str, out: str, keep_ms: int | None = None, time: str | None = None, frames: bool = False) -> DataFrame:
    """Folds each key's rows with ``step(state, row) -> (state, rows out)``. With ``keep_ms`` and a
    ``time`` column under a watermark, a key's state goes when the watermark is that far past its
    last row. ``frames`` hands rows over in pandas frames, for columns of arrays."""
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    out_type = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *T._parse_datatype_string(out).fields])
    fold = Fold(len(keys), stream.columns, [f.name for f in out_type.fields], list(order), start, step, T._parse_datatype_string(state), keep_ms, time, frames)
    mode = "EventTime" if keep_ms is not None else "None"
    groups = stream.groupBy(*keys)
    return (groups.transformWithStateInPandas if frames else groups.transformWithState)(fold, out_type, "Append", mode)


def batch_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: tuple, step: Step, out: str) -> DataFrame:
    """The same fold over a table."""
    kinds = dict(rows.dtypes)
    names = [*keys, *(f.name for f in T._parse_datatype_string(out).fields)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now, made = start, []
        for row in _records(pdf.sort_values(list(order))):
            now, more = step(now, row)
            made += [(*key, *m) for m in more]
        return pd.DataFrame(made, columns=names)

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + out)


# Steadied pixels of a tile: state (values put out, values read) as bytes of doubles, null at first.
SMOOTH = ((None, None), "out binary, raw binary", "frame_no long, v array<double>")


def smooth_step(stability: float) -> Step:
    """One frame of a tile, all its pixels at once, as ``grids.temporal_smooth`` has it."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        now = np.asarray(row["v"], float)
        before = None if row["reset"] or state[0] is None else (np.frombuffer(state[0]), np.frombuffer(state[1]))
        out = smoothed(now, before, stability)
        return (out.tobytes(), now.tobytes()), [(int(row["frame_no"]), out)]

    return step


# Verdicts: state (failures, time of the last attempt, whether it went well).
VERDICT = ((0, None, None), "failures int, last long, ok boolean", "seq long, failures int, denied boolean")


def verdict_step(ttl: int, limit: int, success_ttl: int | None = None) -> Step:
    """The ledger after each attempt (``at``, ``seq``, ``ok``, and if there are such columns ``deny`` and
    ``device``): what ``ledgers.verdict_state`` says of it. A failure counts on from a failure that
    still lives (``ttl``), a denial reaches the limit at once, a success clears; attempts with a
    negative device are let through and change nothing. ``denied`` holds what an attempt at this
    time would meet after it."""

    def lives(last: int | None, ok: bool | None, at: int) -> bool:
        return last is not None and 0 <= at - last <= (success_ttl if ok and success_ttl is not None else ttl)

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        failures, last, was_ok = state
        at, seq, device = int(row["at"]), int(row["seq"]), row.get("device")
        if device is not None and device < 0:
            return state, [(seq, failures if lives(last, was_ok, at) else 0, False)]
        deny = bool(row.get("deny"))
        ok = bool(row["ok"]) and not deny
        n = 0 if ok else limit if deny else failures + 1 if lives(last, was_ok, at) and not was_ok else 1
        return (n, at, ok), [(seq, n, not ok and n >= limit)]

    return step


# Requests: state (last run, whether it is under way, its target, where it began, the parked target).
COALESCE = ((None, False, None, None, None), "last long, busy boolean, target double, began double, parked double", "at_ms long, ran double")


def coalesce_step(gap_ms: int = 110, timeout_ms: int = 900, near: float = 0.35, moved: float = 0.05) -> Step:
    """Runs a request if none is under way and the last one began long enough ago, or if it is
    ``immediate`` (a column that may be missing); else parks it in place of one parked before. A run
    ends near its target, once it has moved from where it is known to have begun, or after a while.
    Targets are 0 at least."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        last, busy, target, began, parked = state
        at, pos = int(row["at_ms"]), row["pos"]
        if busy and (at - last > timeout_ms or (pos is not None and (abs(pos - target) < near or (began >= 0 and abs(pos - began) > moved)))):
            busy = False
        now = row["target"] is not None and bool(row.get("immediate"))
        parked = parked if row["target"] is None else float(row["target"])
        if parked is not None and not busy and (now or last is None or at - last >= gap_ms):
            target = max(0.0, parked)
            return (at, True, target, -1.0 if pos is None else float(pos), None), [(at, target)]
        return (last, busy, target, began, parked), []

    return step


# Progress: state (what was shown last; the last rows).
ETA = ((None, []), "shown double, seen array<struct<done:long,elapsed:double>>", "done long, shown double")


def eta_step(lag: int = 5, overhead: float = 0.0, floor: str = "floor") -> Step:
    """The estimate of ``ledgers.eta_blended`` and what ``ledgers.eta_shown`` shows of it. The state
    holds the last ``lag`` rows besides."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        shown, seen = state
        done, elapsed, total = int(row["done"]), float(row["elapsed"]), row["total"]
        if done >= 4 and elapsed >= 1 and total > done:
            rate = done / elapsed
            if len(seen) >= lag:
                d0, t0 = seen[-lag]
                if 0 < d0 < done and 0.2 < t0 < elapsed:
                    weight = 0.8 * min(max(done / 60, 0.0), 1.0)
                    rate = weight * (done - d0) / (elapsed - t0) + (1 - weight) * rate
            shown = shown_next(shown, (total - done) / rate + max(0.0, overhead), float(row[floor]))
        return (shown, [*seen, (done, elapsed)][-lag:]), [(done, shown)]

    return step


def latest_per_key(stream: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """The newest row of each key, by sequence number; for update or complete mode."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(seq, *values), seq).alias("_s")).select(*keys, "_s.*")


def drained(stream: DataFrame, mode: str = "append", feeds: Sequence[Callable[[], object]] = ()) -> DataFrame:
    """Runs a stream until its source is exhausted; its rows as a table. With ``feeds`` it is run once
    after each of them, from the checkpoint of the run before, so that what a feed adds to the
    source is at least a micro-batch of its own. In update mode rows carry the number of their
    batch as ``_batch``."""
    spark, top = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        for feed in feeds or [lambda: None]:
            feed()
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True)
            if mode == "append":
                query = writer.format("parquet").option("path", f"{top}/rows").start()
            else:
                query = writer.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{top}/rows/b={n}")).start()
            query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{top}/rows")
