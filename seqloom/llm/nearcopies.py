"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints find candidates by
multi-index hashing, sets decide."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .tables import spread, staged, text_batches
from .urls import sifted

#: How often a similar pair may share no segment, and how often it may lie beyond the radius.
MISS = 3.5e-6
#: Bits of a fingerprint that are compared as a whole, as three longs.
CHECKED = 192
#: The same in groups of more than ``BLOCK`` documents, at most.
WHOLE = 1152
#: Documents that share a segment by chance, at most: more documents have longer segments.
CHANCE = 4096
#: Rows of a segment's value that a task compares on its own; more are dealt out as pairs of blocks.
CROWD = 100_000
#: Documents of a bucket that a task compares by sets on its own; larger buckets are cut into blocks.
BLOCK = 2000
#: Passes in which segments are compared, one after the other: disk holds the rows of one.
PASSES = 14
#: Documents of large groups whose segments are compared in a pass, if that needs fewer passes.
TURN = 5000
#: How often what leaders leave of large groups is grouped anew.
ROUNDS = 3
_STEPS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int) -> tuple[int, np.ndarray]:
    """A digest of the words, as a signed long, and the sorted hashes of their ``size``-word
    shingles. Fewer words are one shingle; no words, none."""
    words = (text or b"").lower().split()  # as in ``neardup.fingerprint``
    joined = b" ".join(words)
    node = xxhash.xxh64_intdigest(joined, 7)
    node -= (node >> 63) << 64
    if len(words) <= size:
        return node, np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    of = xxhash.xxh64_intdigest
    codes = [of(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    return node, np.unique(np.array(codes, np.uint64))


def _flip(similarity: float) -> float:
    """How often a bit of two similar sets of one size differs, as the angle between them says."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _radius(bits: int, flip: float) -> int:
    """How many of ``bits`` bits differ, but for ``MISS``, where each does as often as ``flip`` says."""
    beyond, radius, logs = 1.0, -1, [math.lgamma(k + 1) for k in range(bits + 1)]
    while beyond > MISS:
        radius += 1
        beyond -= math.exp(logs[bits] - logs[radius] - logs[bits - radius] + radius * math.log(flip) + (bits - radius) * math.log1p(-flip))
    return radius


@functools.cache
def plan(n: int, similarity: float) -> tuple[int, int, int, int]:
    """For ``n`` documents: bits of a segment, segments of a fingerprint and of a small set's, and the
    radius. Bits of two sets of one size differ as often as the angle between them says; of small sets
    up to 6.5 % more often, and 24 % where one has only as many shingles as may be similar at all."""
    width = max(12, (n // CHANCE).bit_length())
    flip = _flip(similarity)
    segments, small = (math.ceil(math.log(MISS) / math.log1p(-((1 - p) ** width))) for p in (1.065 * flip, 1.24 * flip))
    return width, segments, small, _radius(CHECKED, 1.24 * flip)


@functools.cache
def whole(n: int, similarity: float) -> tuple[int, int]:
    """For ``n`` documents: longs that all fingerprints have, ``WHOLE`` bits at most, and the radius in them."""
    width, segments, _, _ = plan(n, similarity)
    longs = min(WHOLE, segments * width) // 64
    return longs, _radius(64 * longs, 1.24 * _flip(similarity))


def simhash(codes: np.ndarray, bits: int) -> bytes:
    """SimHash of ``bits`` bits, rounded up to whole longs: a bit is 1 if it is set in over half of the
    hashes. Each code gives one long after the other, mixed with the long's number."""
    steps = _STEPS[: -(-bits // 64)]
    count = np.zeros(64 * len(steps), np.int64)
    for at in range(0, len(codes), 255):  # sums of 255 bits fit a byte
        x = codes[at : at + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(codes), bitorder="little").tobytes()


def fingerprint(codes: np.ndarray, n: int, similarity: float) -> bytes | None:
    """The SimHash of a set of shingles among ``n`` documents; none without shingles."""
    if not len(codes):
        return None
    width, segments, small, _ = plan(n, similarity)
    least = similarity / (1 - similarity) - 1e-9  # a set of fewer is similar to its equals only
    if len(codes) < least:
        return simhash(np.array([xxhash.xxh64_intdigest(codes.tobytes(), 5)], np.uint64), segments * width)
    return simhash(codes, (small if len(codes) < least + 2 else segments) * width)


def _segments(n: int, similarity: float, turn: int, longs: int = CHECKED // 64, passes: int = PASSES):
    """A row for each segment of a fingerprint in this pass: its bucket, the node, and the ``longs`` that are compared."""
    width, segments, small, _ = plan(n, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_pylist()
            for size in {len(f) for f in fps if f is not None}:
                at = [i for i, f in enumerate(fps) if f is not None and len(f) == size]
                whole = np.frombuffer(b"".join(fps[i] for i in at), np.uint8).reshape(len(at), size)
                count = small if 8 * size >= small * width else segments
                own = np.arange(turn, count, passes)
                bits = np.unpackbits(whole, axis=1, count=count * width, bitorder="little").reshape(len(at), count, width)[:, own]
                value = bits @ (1 << np.arange(width)) + (own << 32)
                checked = np.repeat(np.ascontiguousarray(whole[:, : 8 * longs]).view("<i8"), len(own), axis=0)
                node = np.repeat(b.column(0).to_numpy()[at], len(own))
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel()), pa.array(node), *(pa.array(np.ascontiguousarray(c)) for c in checked.T)], ["bucket", "node", *(f"f{i}" for i in range(longs))])

    return run


def _distances(fps: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ to).sum(axis=0, dtype=np.uint8 if len(fps) < 4 else np.uint16)


def _families(fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """What links of fingerprints (columns) within the radius connect: places, two or more at a time. A
    fingerprint looks only at those that none has reached yet."""
    at = np.arange(fps.shape[1])
    if len(at) <= 512:  # most have none near, which all pairs at once tell sooner
        at = np.flatnonzero((_distances(fps[:, :, None], fps[:, None, :]) <= radius).sum(axis=1) > 1)
    left = fps[:, at]
    while len(at) > 1:
        found, todo, left, at = [at[:1]], [left[:, 0]], left[:, 1:], at[1:]
        while todo and len(at):
            near = _distances(left, todo.pop()[:, None]) <= radius
            if near.any():
                found.append(at[near])
                todo += list(left[:, near].T)
                left, at = left[:, ~near], at[~near]
        if len(found) > 1:
            yield np.concatenate(found)


def _candidates(radius: int, crowd: int):
    """Edges ``u``, ``v`` that connect documents that share a segment and lie within the radius, from
    rows sorted by bucket: ``u`` is the smallest of those that are connected in this bucket. Rows of
    buckets of more than ``crowd`` are passed on (without ``v``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed, out, size = None, None, [], 0

        def emit(bucket: int, u: np.ndarray, v: np.ndarray | None = None) -> None:
            nonlocal size
            out.append((np.full(len(u), bucket, np.int64), u, u if v is None else v, np.full(len(u), v is None)))
            size += len(u)

        def compare(cols: list[np.ndarray]) -> None:
            for some in _families(np.stack(cols[2:]).view(np.uint64), radius):
                nodes = np.sort(cols[1][some])
                emit(int(cols[0][0]), np.full(len(nodes) - 1, nodes[0]), nodes[1:])

        def written() -> pa.RecordBatch:
            nonlocal size
            bucket, u, v, none = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(u), pa.array(v, mask=none)], ["bucket", "u", "v"])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cuts = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist()]
            for a, z in zip(cuts, cuts[1:]):
                if cols[0][a] == passed:
                    emit(passed, cols[1][a:z])
                elif z - a > 1:
                    compare([c[a:z] for c in cols])
            held = [c[cuts[-1] :] for c in cols]
            if len(held[0]) > crowd or held[0][0] == passed:
                passed = int(held[0][0])
                emit(passed, held[1])
                held = None
            if size > 10_000:
                yield written()
        if held is not None and len(held[0]) > 1:
            compare(held)
        if size:
            yield written()

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges that connect the same, from edges ``u`` < ``v`` sorted by both: each ``v`` and what else it
    meets are linked to the smallest that it meets."""
    last, least, held, size = None, 0, [], 0

    def written() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held), axis=0)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], ["u", "v"])

    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(v):
            continue
        first = np.r_[v[0] != last, v[1:] != v[:-1]]
        at = np.maximum.accumulate(np.where(first, np.arange(len(v)), -1))
        hub = np.where(at < 0, least, u[at])
        pairs = np.stack([hub, np.where(first, v, u)], axis=1)
        held.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        last, least, size = v[-1], hub[-1], size + len(held[-1])
        if size > 100_000:
            yield written()
            size = 0
    if size:
        yield written()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by their first column, a value at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _groups(block: int):
    """Documents to compare, from rows sorted by bucket. Groups of the same documents have the same
    name, in whichever bands they meet."""

    def cut(nodes: np.ndarray) -> Iterator[np.ndarray]:
        n = -(-2 * len(nodes) // block) if len(nodes) > block else 1
        if n == 1:
            yield nodes
            return
        own = (nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(n)
        for i in range(n):
            for j in range(i + 1, n):
                yield nodes[(own == i) | (own == j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, members, size = [], [], 0
        for _, rows in _whole(batches):
            nodes = np.unique(rows.column(1).to_numpy()) if rows.num_rows > 1 else ()
            for some in cut(nodes) if len(nodes) > 1 else ():
                name = xxhash.xxh64_intdigest(some.tobytes(), 3)
                names.append(np.full(len(some), name - ((name >> 63) << 64), np.int64))
                members.append(some)
                size += len(some)
                if size > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["name", "node"])
                    names, members, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["name", "node"])

    return run


def _connect(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all that similar pairs connect: a set looks only at those
    that none has reached yet."""
    sizes = np.array([len(s) for s in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out, rest = [], np.arange(len(sets))
    while rest.size:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            mark = np.zeros(len(known), np.uint8)
            mark[flat[starts[x] : starts[x] + sizes[x]]] = 1
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)[rest]
            near = shared >= similarity * (sizes[rest] + sizes[x] - shared) - 1e-9
            hit, rest = rest[near].tolist(), rest[~near]
            out += [(x, y) for y in hit]
            todo += hit
    return out


def _links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _whole(batches):
            nodes = rows.column(1).to_pylist()
            pairs = _connect([np.frombuffer(s, np.uint64) for s in rows.column(2).to_pylist()], similarity)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()), pa.array([nodes[y] for _, y in pairs], pa.int64())], ["u", "v"])

    return run


def _similarities(sets: list[np.ndarray], x: int) -> np.ndarray:
    """The similarity of each set to the ``x``-th."""
    shared = np.array([np.isin(s, sets[x], assume_unique=True).sum() for s in sets], float)
    sizes = np.array([len(s) for s in sets])
    return shared / np.maximum(sizes + sizes[x] - shared, 1)


def _leader(similarity: float):
    """Of a sample of a bucket the document that most others are like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _whole(batches):
            nodes, sets = rows.column(1).to_pylist(), [np.frombuffer(s, np.uint64) for s in rows.column(2).to_pylist()]
            alike = [int((_similarities(sets, x) >= similarity - 1e-9).sum()) for x in range(len(sets))]
            best = min(range(len(sets)), key=lambda x: (-alike[x], nodes[x]))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([nodes[best]], pa.int64())], ["bucket", "leader"])

    return run


_LINK, _MID, _FAR = range(3)


def _around(similarity: float):
    """Links of a chunk of a bucket with its leader, as (_LINK, u, v), and the bucket and node of those
    that are not like it: _MID if they may be like some that are, _FAR if they can't be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _whole(batches):
            nodes, sets = rows.column(1).to_pylist(), [np.frombuffer(s, np.uint64) for s in rows.column(2).to_pylist()]
            bucket, lead = rows.column(3)[0].as_py(), rows.column(4).to_pylist().index(True)
            out = [(_LINK, nodes[x], nodes[y]) for x, y in _connect(sets, similarity)]
            # The distance 1 - similarity obeys the triangle inequality.
            near = _similarities(sets, lead)
            out += [(_MID if v >= 2 * similarity - 1 - 1e-9 else _FAR, bucket, nodes[x]) for x, v in enumerate(near.tolist()) if v < similarity - 1e-9]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int8(), pa.int64(), pa.int64()), strict=True)], ["kind", "u", "v"])

    return run


#: Documents of a crowded bucket from which its leader is chosen.
SAMPLE = 32


def _crowded(rows: DataFrame, block: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of crowded buckets (``bucket``, ``node``, ``n``, ``shingles``) with their leaders, the ``node`` of those that
    are not like them and are left to compare with each other, and the groups (``name``, ``node``) in which
    these meet those that are.

    Documents like the leader are connected by it, so no two of them are compared. Of the others only those
    within twice the distance are compared with the ones that the leader has: others can't be like any. Samples and leaders are a few rows for each ``block`` documents,
    so they are broadcast and the sets are shuffled once, to their chunks."""
    keys = rows.select("bucket", "node", "n")
    w = Window.partitionBy("bucket", "part").orderBy(F.xxhash64("node", "bucket"), "node")
    # The sample's smallest hashes, by parts first, so that no bucket is sorted as a whole.
    parts = keys.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE)
    sample = parts.withColumn("part", F.lit(0)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE).select("bucket", "node")
    leaders = rows.join(F.broadcast(sample), ["bucket", "node"]).select("bucket", "node", "shingles").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_leader(similarity), "bucket long, leader long")
    leaders = staged(leaders.join(keys.groupBy("bucket").agg(F.first("n").alias("n")), "bucket"), "leaders")
    chunks = F.ceil(2 * F.col("n") / block).cast("long")
    name = lambda *c: F.xxhash64("bucket", *c)
    led = rows.join(F.broadcast(leaders.select("bucket", "leader")), "bucket")
    own = led.where("node <> leader").select(name(F.pmod(F.xxhash64("node"), chunks)).alias("name"), "node", "shingles", "bucket", F.lit(False).alias("lead"))
    first = led.where("node = leader").select("bucket", "node", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")).select(name("chunk").alias("name"), "node", "shingles", "bucket", F.lit(True).alias("lead"))
    joined = own.unionByName(first)
    found = staged(joined.repartition("name").sortWithinPartitions("name").mapInArrow(_around(similarity), "kind byte, u long, v long"), "around")
    links, rest = found.where(F.col("kind") == _LINK).select("u", "v"), found.where(F.col("kind") != _LINK).select("kind", F.col("u").alias("bucket"), F.col("v").alias("node")).distinct()
    mids = rest.where(F.col("kind") == _MID).select("bucket", "node")
    sizes = mids.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).join(leaders.select("bucket", "n"), "bucket")
    blocks = F.ceil(2 * F.col("m") / block).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    near = keys.select("bucket", "node").join(rest.select("bucket", "node"), ["bucket", "node"], "left_anti").join(sizes, "bucket")
    near = near.select("bucket", "node", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), every(blocks).alias("mid"))
    mids = mids.join(sizes, "bucket").select("bucket", "node", F.pmod(F.xxhash64("node"), blocks).alias("mid"), every(chunks).alias("chunk"))
    pairs = near.unionByName(mids).select(name(F.lit("mid"), "chunk", "mid").alias("name"), "node")
    return links, rest.select("node"), pairs


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """``id``, ``text_key`` (xxhash64 of the text) and ``component`` for every row with an id.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or
    more are linked, and ``component`` is the same for all that links reach. Multi-index hashing over
    SimHash fingerprints finds the pairs to compare: they share one of the segments, whose number
    follows from ``similarity`` (``plan``), and lie within the radius. It may miss a pair as often as ``MISS``
    says, for segments and radius each. What such pairs connect is a group, and each link in it is verified
    on the sets.
    Texts of the same words are one node. Those without words, null ones too, are alike.

    A group of more than ``block`` documents is grouped anew by its segments, within a radius of all bits
    (``whole``), which may miss as many pairs once more. If a group is as large then, those like a leader are
    connected by it; others are compared with some of the leader's, and grouped anew. What is still as large
    after ``ROUNDS`` is compared in each bucket of a segment on its own.
    """
    text_batches(docs.sparkSession)
    key = F.xxhash64(text_col)
    kept = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    total, kept = kept.count(), spread(kept)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array([n for n, _ in found], pa.int64()), pa.array([fingerprint(c, total, similarity) for _, c in found], pa.binary())], ["id", "text_key", "node", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), size)[1].tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bucket", "node", "n")), pa.array(found, pa.binary())], ["bucket", "node", "n", "shingles"])

    kind = kept.schema["id"].dataType
    marked = staged(kept.mapInArrow(sketch, T.StructType([T.StructField("id", kind), T.StructField("text_key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType())])), "sketches")
    nodes = staged(marked.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("at"), F.first("fp").alias("fp")), "nodes")

    def met_in(nodes: DataFrame, longs: int, radius: int, passes: int) -> DataFrame:
        """Edges (``bucket``, ``u``, ``v``) that connect what shares a segment and lies within the radius."""
        bits = [f"f{i}" for i in range(longs)]

        def candidates(nodes: DataFrame, dealt, crowd: int) -> DataFrame:
            def met_at(turn: int) -> DataFrame:
                rows = dealt(nodes.select("node", "fp").mapInArrow(_segments(total, similarity, turn, longs, passes), ", ".join(f"{c} long" for c in ["bucket", "node", *bits])))
                return staged(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(radius, crowd), "bucket long, u long, v long"), "candidates")

            return functools.reduce(DataFrame.unionAll, map(met_at, range(passes)))

        met = candidates(nodes, lambda rows: rows, crowd)
        passed = met.where("v IS NULL").select("bucket", F.col("u").alias("node"))
        if not passed.isEmpty():
            blocks = passed.groupBy("bucket").agg(F.ceil(2 * F.count(F.lit(1)) / crowd).cast("int").alias("k"))

            def dealt(rows: DataFrame) -> DataFrame:
                rows = rows.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
                return rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", *bits)

            met = met.unionByName(candidates(nodes.join(passed.select("node").distinct(), "node"), dealt, 1 << 60))
        return met.where("v IS NOT NULL")

    def in_groups(met: DataFrame) -> DataFrame:
        """``node`` and the ``root`` of its group, and the group's size ``n`` if that is over ``block``."""
        # A document has an edge in each segment that it shares, near copies some dozens; one to the smallest is enough.
        edges = met.select("u", "v").repartition("v").sortWithinPartitions("v", "u").mapInArrow(_stars, "u long, v long")
        # Every document is in one group, in however many segments it meets others.
        grouped = staged(components(edges), "grouped")
        # At most one crowded group in ``block`` documents; without its size a group is not crowded.
        sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        return grouped.join(F.broadcast(sizes), "root", "left")

    def met_closer(some: DataFrame) -> DataFrame:
        """The same edges among these nodes alone, by as many bits as fingerprints have."""
        few = staged(nodes.join(some.select("node").distinct(), "node").select("node", "fp"), "crowded")
        return met_in(few, *whole(total, similarity), max(1, min(PASSES, few.count() // TURN)))

    grouped = in_groups(met_in(nodes, CHECKED // 64, plan(total, similarity)[-1], PASSES))
    crowded = grouped.where("n IS NOT NULL")
    if not crowded.isEmpty():
        # By few bits, chains of texts that share a common line connect most of a large table.
        met = met_closer(crowded)
        grouped = grouped.where("n IS NULL").unionByName(in_groups(met))
    # The row whose text is read for each document that is to be compared; texts of others are not shuffled.
    members = staged(nodes.join(grouped.withColumnRenamed("root", "bucket"), "node").select("at.id", "at.text_key", "bucket", "node", "n"), "groups")
    at = ["id", "text_key"]
    texts = sifted(kept, members, at).where("_passes").drop("_passes").join(members, at).dropDuplicates(at)
    found = staged(texts.select("bucket", "node", "n", "text").mapInArrow(sets, "bucket long, node long, n long, shingles binary"), "sets")

    def linked_in(rows: DataFrame) -> DataFrame:
        return rows.select("name", "node", "shingles").repartition("name").sortWithinPartitions("name").mapInArrow(_links(similarity), "u long, v long")

    links = [staged(linked_in(found.where("n IS NULL").withColumnRenamed("bucket", "name")), "links")]
    crowded = found.where("n IS NOT NULL")
    for turn in range(ROUNDS + 1):
        if crowded.isEmpty():
            break
        led, rest, pairs = _crowded(crowded, block, similarity)
        if turn < ROUNDS:
            met = met_closer(rest)
            again = in_groups(met)
            pairs = pairs.unionByName(again.where("n IS NULL").select(F.col("root").alias("name"), "node"))
            crowded = staged(again.where("n IS NOT NULL").withColumnRenamed("root", "bucket").join(found.select("node", "shingles"), "node").select("bucket", "node", "n", "shingles"), "crowded-sets")
        else:  # by buckets, each on its own
            meet = met.select(F.xxhash64("bucket", "u").alias("bucket"), F.explode(F.array("u", "v")).alias("node")).join(rest.distinct(), "node").select("bucket", "node")
            pairs = pairs.unionByName(meet.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups(block), "name long, node long"))
        left = staged(pairs.distinct(), "left")
        few = sifted(found.where("n IS NOT NULL").select("node", "shingles"), left, ["node"]).where("_passes").drop("_passes")
        links += [led, staged(linked_in(left.join(few, "node")), "links")]
    linked = staged(components(functools.reduce(DataFrame.unionByName, links)), "components")
    return marked.join(linked, "node", "left").select("id", "text_key", F.coalesce("root", "node").alias("component"))
