"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import spread, staged, table, text_batches

BITS = 64
#: Rows of one bucket that a task compares on its own; larger buckets are cut into blocks.
BLOCK = 50_000
_SMALL = 64


def fingerprint(text: bytes | None, size: int) -> int:
    """SimHash of the ``size``-word shingles as a signed long; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and cut at 09-0D and 20
    if not words:
        return 0
    if len(words) <= size:
        codes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        of = xxhash.xxh64_intdigest
        codes = [of(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    count, n = np.zeros(BITS, np.int64), len(codes)
    for at in range(0, n, 255 * 256):
        part = np.array(codes[at : at + 255 * 256], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        count += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``id`` and ``fp`` for every row."""
    text_batches(docs.sparkSession)
    kept = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [fingerprint(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, pa.int64())], ["id", "fp"])

    return kept.mapInArrow(run, T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def segments(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. Two fingerprints within ``distance`` are within the
    radius in one segment at least. More segments cost fewer probes but fill their tables more, so
    their number follows the number of fingerprints; any choice finds the same links."""

    def plan(parts: int) -> list[tuple[int, int, int]]:
        radius, extra = divmod(distance, parts)
        widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
        return [(sum(widths[:i]), w, radius - (i > extra)) for i, w in enumerate(widths) if radius - (i > extra) >= 0]

    def cost(parts: int) -> float:
        return sum((1 + n / 2**w) * sum(1 for r in range(radius + 1) for _ in combinations(range(w), r)) for _, w, radius in plan(parts))

    return plan(min(range(2, 6), key=cost))


def _near(f: np.ndarray, g: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((f ^ g).view(np.uint64)) <= distance


def _walk(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all values of a crowded bucket that are connected in it: a node looks
    only at those that no node has reached yet."""
    out, rest = [], np.unique(values)
    while rest.size:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            near = _near(rest, x, distance)
            if near.any():
                hit, rest = rest[near], rest[~near]
                out.append((np.full(len(hit), x), hit))
                todo.extend(hit)
    return out


def _bucket_links(bucket: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each bucket; rows are sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    stop = np.repeat(starts + sizes, sizes)
    out, at = [], np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
    step = 1
    while len(at := at[at + step < stop[at]]):
        near = _near(fp[at], fp[at + step], distance) & (own[at] | own[at + step]) & (fp[at] != fp[at + step])
        out.append((fp[at[near]], fp[at[near] + step]))
        step += 1
    for a, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        out += _walk(fp[a : a + n], distance)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


_LINKS = "u long, v long, bucket long"


def _linker(distance: int, block: int):
    """Streams rows sorted by bucket; a bucket of more than ``block`` rows is passed on (without
    ``v``) instead of compared."""

    def batch(u, v=None, bucket=None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), none if v is None else pa.array(v, pa.int64()), none if bucket is None else pa.array(bucket, pa.int64())], ["u", "v", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        passed = None
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)]
            cols = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if passed is not None and len(cols[0]) and cols[0][0] == passed:
                n = int(np.searchsorted(cols[0], passed, "right"))
                yield batch(cols[1][:n], bucket=cols[0][:n])
                cols = [x[n:] for x in cols]
            if not len(cols[0]):
                rest = cols
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield batch(*_bucket_links(*[x[:cut] for x in cols], distance))
            rest = [x[cut:] for x in cols]
            if len(rest[0]) > block:
                passed = int(rest[0][0])
                yield batch(rest[1], bucket=rest[0])
                rest = [x[:0] for x in rest]
        if len(rest[0]):
            yield batch(*_bucket_links(*rest, distance))

    return run


def links(fps: DataFrame, *, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``u``, ``v`` between different fingerprints (long column ``fp``, distinct) that differ
    in at most ``distance`` bits. Every pair within the distance is connected, by a link of its own
    or, in crowded buckets, through others within the distance.

    Each fingerprint goes to the bucket of its own value in every segment and to those of the
    smaller values within the segment's radius: of two values, the larger looks up the smaller.
    Matches are verified over all bits. A bucket of more than ``block`` rows is dealt out anew, as
    pairs of blocks.
    """
    rows = None
    for k, (shift, width, radius) in enumerate(segments(fps.count(), distance)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        balls = _balls(part, masks)
        key = fps.select("fp", part.alias("part"), F.explode(balls).alias("at")).select((F.lit(k << 40).cast("long") + F.col("at")).alias("bucket"), "fp", (F.col("at") == F.col("part")).alias("own"))
        rows = key if rows is None else rows.unionAll(key)
    found = staged(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linker(distance, block), _LINKS), "links")
    crowded = found.where("v IS NULL").select("bucket", F.col("u").alias("fp"))
    blocks = crowded.groupBy("bucket").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    dealt = (
        crowded.distinct()
        .join(blocks, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp", F.lit(True).alias("own"))
    )
    more = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linker(distance, 1 << 60), _LINKS)
    return found.where("v IS NOT NULL").select("u", "v").unionAll(more.select("u", "v"))


def _balls(part, masks: list[int]):
    """The segment's value and the smaller ones that differ from it by a mask."""
    return F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: part.bitwiseXOR(m)), lambda x: x <= part)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` for every row of ``docs``.

    Documents whose fingerprints differ in at most ``distance`` of 64 bits are linked;
    ``component_id`` is the smallest id that links reach. Equal fingerprints are one node, so a
    group of exact copies costs no more than one document after the first step.

    Null and empty texts have the fingerprint 0 and are linked by it. Repeated rows stay, with one
    component. A row without an id links nothing and has no component. Other columns are left out.
    """
    marked = staged(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    fps = staged(marked.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    found = staged(components(links(fps.select("fp"), distance=distance, block=block)), "components")
    least = found.join(fps.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = found.join(least, "root").select(F.col("node").alias("fp"), "least_id")
    named = staged(fps.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "labels")
    return marked.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
