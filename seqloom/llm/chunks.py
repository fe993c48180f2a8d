"""Substring dedup by content-defined chunks: cuts by a gear rolling hash, chunks by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, staged, table, text_batches

#: Bytes of a chunk: at least, at most; a cut comes every ``1 << CUT_BITS`` bytes beyond the least.
LEAST, MOST, CUT_BITS = 16, 256, 5
#: Words in a run of repeated chunks that make it a passage.
MIN_WORDS = 16
COMBINE_ROWS, GROUP_ROWS = 1_000_000, 1_000_000
_GEAR = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)
_SINGLE, _SHARED, _FIRST, _LATER = range(4)


def gear(text: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: a sum of shifted table entries of the last 32 bytes."""
    h = _GEAR[text]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift) if len(h) > shift else 0
    return h


def cuts(text: bytes, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks. Where a cut may fall depends on the bytes before it alone, so an insertion
    moves the cuts near it and no others."""
    n = len(text)
    mask = np.uint32((1 << CUT_BITS) - 1 << 16)
    places = (np.flatnonzero(gear(np.frombuffer(text, np.uint8)) & mask == 0) + 1).tolist() if n else []
    out, start = [], 0
    for p in [*places, n]:
        while p - start > most:
            start += most
            out.append(start)
        if p - start >= least or p == n and p > start:
            out.append(p)
            start = p
    return out


_ROWS = ["kind", "digest", "h", "id", "place"]


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _batch(kind, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(kind, np.int8), (len(cols[0]),)).copy()), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols)], _ROWS)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to chunks. Of equal chunks in a task only the first goes on; the others are later
    copies, whatever other tasks find. A place packs start (32 bits), size (10), 22 more bits of digest."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)  # digest, h, id, place
        more = rows[:, 3].view(np.uint64) & np.uint64((1 << 22) - 1)
        rows = rows[order := np.lexsort((rows[:, 3].view(np.uint64) >> np.uint64(32), rows[:, 2], more, rows[:, 0]))]
        new = _heads(rows[:, 0], more[order])
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(rows)])
        yield _batch(np.where(size > 1, _SHARED, _SINGLE), *rows[at].T)
        later = rows[~new]
        if len(later):
            later[:, 0] = later[:, 1]  # dealt by text, for they need no partner
            yield _batch(_LATER, *later.T)

    parts, n = [], 0
    for b in batches:
        for h, i, text in zip(b.column("h").to_pylist(), b.column("id").to_pylist(), b.column("text"), strict=True):
            raw = text.as_py()
            ends = cuts(raw)
            if ends:
                starts = [0, *ends[:-1]]
                codes = [xxhash.xxh3_128_intdigest(raw[a:z]) for a, z in zip(starts, ends, strict=True)]
                rows = np.empty((len(ends), 4), np.int64)
                rows[:, 0] = np.array([c & (1 << 64) - 1 for c in codes], np.uint64).view(np.int64)
                rows[:, 1], rows[:, 2] = h, i
                rows[:, 3] = np.array([a << 32 | (z - a) << 22 | c >> 106 for a, z, c in zip(starts, ends, codes, strict=True)], np.uint64).view(np.int64)
                parts.append(rows)
                n += len(rows)
        if n >= COMBINE_ROWS:
            yield from flush(parts)
            parts, n = [], 0
    if parts:
        yield from flush(parts)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows by digest and id; all but the first of equal chunks are later copies. Holds one
    batch and one row."""
    held = None  # the first row of the group that is open, and whether another was seen
    for b in batches:
        rows = [b.column(n).to_numpy() for n in _ROWS]
        through = rows[0] == _LATER
        if through.any():
            yield b.filter(pa.array(through))
            rows = [x[~through] for x in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = _heads(rows[1], rows[4] & ((1 << 22) - 1))
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(new)])
        shared = (size > 1) | np.logical_or.reduceat(rows[0] == _SHARED, at)
        yield _batch(_LATER, *[x[~new] for x in rows[1:]])
        if len(at) > 1:
            done = at[:-1][shared[:-1]]
            yield _batch(_FIRST, *[x[done] for x in rows[1:]])
        held = [x[at[-1:]].copy() for x in rows]
        held[0][:] = _SHARED if shared[-1] else _SINGLE
    if held is not None and held[0][0] == _SHARED:
        yield _batch(_FIRST, *held[1:])


def _judge(min_words: int, with_kept: bool):
    """Repeated chunks of a text, next to each other, are runs; runs of enough words are passages."""
    names = ["doc_id", "n_bytes", "n_repeated", "n_removed", "n_passages", "longest_words", "kept_sha256", "passages", *(["kept"] if with_kept else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("text"), b.column("found"), strict=True):
                raw, runs = text.as_py(), []
                if found.is_valid:
                    kind, place = found.values.field(0).to_numpy(), found.values.field(1).to_numpy().view(np.uint64)
                    start = (place >> np.uint64(32)).astype(np.int64)
                    stop = start + (place >> np.uint64(22) & np.uint64(1023)).astype(np.int64)
                    # repeated rows bring each chunk twice; it stays if any of them is the first
                    kinds = {(int(a), int(z)): int(k) for k, a, z in sorted(zip(kind, start, stop, strict=True), reverse=True)}
                    for (a, z), k in sorted(kinds.items()):
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = z
                            runs[-1][2].append((a, z, k))
                        else:
                            runs.append([a, z, [(a, z, k)]])
                words = [len(raw[a:z].split()) for a, z, _ in runs]
                passages = [r for r, w in zip(runs, words, strict=True) if w >= min_words]
                gone = [(a, z) for r in passages for a, z, k in r[2] if k == _LATER]
                kept = b"".join([raw[i:j] for i, j in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(raw)], strict=True)])
                row = (len(raw), sum(z - a for a, z, _ in passages), len(raw) - len(kept), len(passages), max(words, default=0), hashlib.sha256(kept).hexdigest(), [[a, z] for a, z, _ in passages])
                rows.append((*row, kept) if with_kept else row)
            types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names)

    return run


def chunk_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, with_kept: bool = True) -> DataFrame:
    """For every row ``doc_id``, ``n_bytes``, ``n_repeated`` (bytes in passages that repeat),
    ``n_removed``, ``n_passages``, ``longest_words``, ``kept_sha256``, ``passages`` ([start, stop]
    in bytes) and, if wanted, ``kept`` (binary).

    Texts are cut where a rolling hash of their last bytes says, so an insertion changes the chunks
    near it only. Chunks with equal digests are one; it stays where it occurs first, by id (ids
    that are not whole numbers by their hashes) and place. Repeated chunks side by side form runs, and runs of ``min_words`` words or
    more are passages. Later copies of chunks within passages are removed.

    A task sends each chunk once, so one that a third of all texts hold is a row for each task.
    Null texts are empty. A null id comes first. Repeated rows are copies: all have what the first
    has. Other columns are left out.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("h"), text.cast("binary").alias("text"))
    whole = keyed.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col("id").cast("long") if whole else F.when(F.col("id").isNotNull(), F.xxhash64("id"))
    numbered = keyed.select("h", F.coalesce(number, F.lit(-(2**63)).cast("long")).alias("id"), "text")
    schema = "kind byte, digest long, h long, id long, place long"
    rows = spread(numbered).mapInArrow(_chunk, schema).withColumn("more", F.col("place").bitwiseAND(F.lit((1 << 22) - 1))).withColumn("start", F.shiftrightunsigned("place", 32))
    rows = rows.repartition("digest").sortWithinPartitions("digest", "more", "id", "start").drop("more", "start")
    found = staged(rows.mapInArrow(_match, schema), "chunks").groupBy("h").agg(F.collect_set(F.struct("kind", "place")).alias("found"))
    out = f"doc_id {keyed.schema['id'].dataType.simpleString()}, n_bytes long, n_repeated long, n_removed long, n_passages long, longest_words long, kept_sha256 string, passages array<array<long>>" + ", kept binary" * with_kept
    return keyed.join(found, "h", "left").select("id", "text", "found").mapInArrow(_judge(min_words, with_kept), out)


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup(table(spark, sf_dir, "documents"), with_kept=False)
    return found.drop("passages").withColumn("repeated", F.col("n_passages") > 0)
