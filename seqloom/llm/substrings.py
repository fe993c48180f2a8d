"""Repeated substrings by prefix-free parsing: triggers cut texts into phrases that any two
occurrences of a string share; phrases, then suffixes of the few phrases in doubt, are sorted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, staged, table, text_batches

GRAM = 8
#: Rows that a task combines before it sends them on, and that a phrase may have before they are
#: dealt with as a stream.
COMBINE_ROWS, GROUP_ROWS = 1_000_000, 1_000_000
#: Bytes of phrases whose suffixes a task sorts at once, and of a group whose strings are dealt out
#: by their digests.
SORT_BYTES, GROUP_BYTES = 2_000_000, 4_000_000
#: Phrases with one tail that are compared as they are; more are cut into pieces of so many starts,
#: each dealt out by the bytes that all its strings hold.
CROWD, PIECE = 256, 30
#: Bytes of a string that counts as part of a passage, and words that a passage has at least.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
_SINGLE, _SHARED, _DONE, _ASK, _SAMPLE, _ASK_PIECES, _SAMPLE_PIECES = range(7)
_LEVEL = 11  # bit of a tag that says which length a row is about
_MIX = np.uint64(0x9E3779B97F4A7C15)


def triggers(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first start, last start): each start of a ``length``-byte string belongs to the
    smallest hash of an 8-byte gram among the first three fifths of the string, the leftmost one if
    several are equal. So the string itself fixes where its trigger is, wherever it occurs."""
    starts, window = len(text) - length + 1, _window(length)
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    raw = np.frombuffer(text, np.uint8)
    n = starts + window - 1
    gram = np.empty(-(-n // window) * window, np.uint64)
    for k in range(GRAM):
        part = raw[k : k + (n - k + GRAM - 1) // GRAM * GRAM]
        part = part[: len(part) // GRAM * GRAM].view("<u8")
        gram[k : k + GRAM * len(part) : GRAM] = part
    gram[:n] = ((gram[:n] * _MIX) >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    gram[n:] = np.iinfo(np.uint64).max
    block = gram.reshape(-1, window)
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(block, axis=1).ravel()
    least = (np.minimum(after[:starts], before[window - 1 : window - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.r_[first[1:], starts] - 1


def _window(length: int) -> int:
    return length * 3 // 5


def phrases(text: bytes, length: int, level: int = 0) -> np.ndarray:
    """Rows (e, c, trigger, first start, last start). ``e`` digests the bytes after the trigger that
    all strings of the phrase hold, but for its last bit, the level; ``c`` all bytes of all of them."""
    at, first, last = triggers(text, length)
    tail = length - _window(length) + 1
    of = xxhash.xxh3_64_intdigest
    out = np.empty((len(at), 5), np.uint64)
    out[:, 0] = [of(text[a : a + tail]) & ~1 | level for a in at.tolist()]
    out[:, 1] = [of(text[i : j + length], a - i) for a, i, j in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
    out[:, 2], out[:, 3], out[:, 4] = at, first, last
    return out


# A place packs the tag of the text (11 bits) and the level (1), the trigger (32), and how far before
# it the first and the last start lie (10 each).
def _pack(tag: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    u = lambda x, s: x.astype(np.uint64) << np.uint64(s)
    return u(tag, 52) | u(at, 20) | u(at - first, 10) | u(at - last, 0)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    take = lambda s, n: (place.view(np.uint64) >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64)
    at = take(20, 32)
    return take(52, 12), at, at - take(10, 10), at - take(0, 10)


_ROWS = ["kind", "e", "c", "h", "place"]
_ROWS_SCHEMA = "kind byte, e long, c long, h long, place long"


def _batch(kind, e, c, h, place) -> pa.RecordBatch:
    cols = [pa.array(np.broadcast_to(np.asarray(kind, np.int8), (len(h),)).copy()), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (e, c, h, place))]
    return pa.RecordBatch.from_arrays(cols, _ROWS)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _done(h: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that say which starts are repeated: neighbouring ranges of a text become one."""
    if len(h):
        tag, _, first, last = _unpack(place)
        order = np.lexsort((first, tag, h))
        h, tag, first, last = h[order], tag[order], first[order], last[order]
        new = _heads(h, tag)
        new[1:] |= first[1:] > last[:-1] + 1  # phrases of a text follow each other; repeated rows are equal
        at = np.flatnonzero(new)
        top = np.maximum.reduceat(last, at)
        yield _batch(_DONE, h[at], tag[at].astype(np.uint64), h[at], first[at].astype(np.uint64) << np.uint64(32) | top.astype(np.uint64))


def _cut(*lengths: int):
    """Texts to phrases for each length. Equal phrases of a task become one row at once, and their places are
    settled here, so that a text that many documents copy is a few rows for each task."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = _heads(rows[:, 0], rows[:, 1])
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(rows)])
        one = rows[at]
        yield _batch(np.where(size > 1, _SHARED, _SINGLE), *one.T)
        again = rows[np.repeat(size > 1, size)]
        yield from _done(again[:, 2].copy(), again[:, 3].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for h, tag, text in zip(b.column("h").to_numpy().view(np.uint64), b.column("tag").to_numpy(), b.column("text"), strict=True):
                raw = text.as_py()
                for level, length in enumerate(lengths):
                    found = phrases(raw, length, level)
                    if len(found):
                        e, c, at, first, last = found.T
                        parts.append(np.column_stack([e, c, np.full(len(e), h), _pack(np.full(len(e), tag | level << _LEVEL), at, first, last)]))
                        n += len(e)
            if n >= COMBINE_ROWS:
                yield from flush(parts)
                parts, n = [], 0
        if parts:
            yield from flush(parts)

    return run


def _resolve(rows: list[np.ndarray], mixed_e, crowd: int) -> Iterator[pa.RecordBatch]:
    """``rows`` (kind, e, c, h, place) in order of e and c, groups of e whole. A phrase that occurs
    twice is repeated. One that occurs once, among others with its tail, may share some of its
    strings with them: it is asked for, and so is a sample of each repeated one, in pieces if there
    are many. ``mixed_e``: a group of which other phrases went before."""
    kind, e, c, h, place = rows
    if not len(e):
        return
    at = np.flatnonzero(_heads(e, c))
    size = np.diff(np.r_[at, len(e)])
    many = (size > 1) | np.logical_or.reduceat(kind == _SHARED, at)
    group = np.cumsum(_heads(e[at])) - 1
    before = np.zeros(group[-1] + 1, bool) if mixed_e is None else e[at][_heads(e[at])] == mixed_e
    mixed = (np.bincount(group) > 1) | before
    lonely = (np.bincount(group, ~many) > 0) | before
    crowded = ((np.bincount(group) > crowd) | before)[group]
    settled = np.repeat(many, size) & (kind == _SINGLE)
    yield from _done(h[settled], place[settled])
    for what, pieces, chosen in ((_ASK, _ASK_PIECES, ~many & mixed[group]), (_SAMPLE, _SAMPLE_PIECES, many & mixed[group] & lonely[group])):
        k = at[chosen]
        yield _batch(np.where(crowded[chosen], pieces, what), e[k], c[k], h[k], place[k])


def _sift(batches: Iterator[pa.RecordBatch], crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """Streams rows in order of e and c; holds a group, or GROUP_ROWS of a larger one."""
    rest, mixed_e = None, None
    for b in batches:
        rows = [b.column(n).to_numpy() for n in _ROWS]
        through = rows[0] == _DONE
        if through.any():
            yield b.filter(pa.array(through))
            rows = [x[~through] for x in rows]
        rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        if not len(rest[1]):
            continue
        cut = int(np.flatnonzero(rest[1] != rest[1][-1])[-1]) + 1 if rest[1][0] != rest[1][-1] else 0
        if cut:
            yield from _resolve([x[:cut] for x in rest], mixed_e, crowd)
            rest = [x[cut:] for x in rest]
        if len(rest[1]) > GROUP_ROWS:
            cut = int(np.flatnonzero(rest[2] != rest[2][-1])[-1]) + 1 if rest[2][0] != rest[2][-1] else 0
            if cut:
                mixed_e = rest[1][0]
                yield from _resolve([x[:cut] for x in rest], mixed_e, crowd)
                rest = [x[cut:] for x in rest]
            else:  # one phrase: all are repeated, and one row stands for them
                once = rest[0] == _SINGLE
                yield from _done(rest[3][once], rest[4][once])
                rest = [x[:1].copy() for x in rest]
                rest[0][:] = _SHARED
    if rest is not None:
        yield from _resolve(rest, mixed_e, crowd)


_PIECES = "e long, h long, place long, sample boolean, piece binary"


def _pieces(raw: bytes, at: int, first: int, last: int, length: int, level: int) -> Iterator[tuple[int, int, int]]:
    """(e, first start, last start) of each piece of a phrase. Starts are cut by how far before the
    trigger they lie, so equal strings are in equal pieces; ``e`` digests what all strings hold
    that such a piece may have."""
    for k in range((at - last) // PIECE, (at - first) // PIECE + 1):
        x = k * PIECE
        e = xxhash.xxh3_64_intdigest(raw[at - x : at - x - PIECE + 1 + length], k + 1) & ~1 | level
        yield e - (e >> 63 << 64), max(first, at - x - PIECE + 1), min(last, at - x)


def _fetch(*lengths: int):
    """Texts with the phrases asked for (a list of e, place, kind) to rows with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, tag, text, asked in zip(b.column("h").to_pylist(), b.column("tag").to_pylist(), b.column("text"), b.column("asked"), strict=True):
                raw, asked = text.as_py(), asked.values
                e, place, kind = (asked.field(k).to_numpy() for k in range(3))
                tags, at, first, last = _unpack(place)
                for x, p, k, t, a, i, j in zip(e.tolist(), place.tolist(), kind.tolist(), tags.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
                    level = t >> _LEVEL
                    length, sample = lengths[level], k in (_SAMPLE, _SAMPLE_PIECES)
                    if t & (1 << _LEVEL) - 1 != tag:
                        continue
                    if k in (_ASK, _SAMPLE):
                        out.append((x, h, p, sample, raw[i : j + length]))
                    else:
                        out += [(y, h, (t - (t >> _LEVEL << 12)) << 52 | a << 20 | (a - b) << 10 | (a - c), sample, raw[b : c + length]) for y, b, c in _pieces(raw, a, i, j, length, level)]
                if len(out) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], _PIECE_NAMES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], _PIECE_NAMES)

    return run


_PIECE_NAMES = ["e", "h", "place", "sample", "piece"]
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _ranks(pieces: list[bytes], depth: int) -> np.ndarray:
    """Order of the pieces; then for each piece and each depth d from 0 to ``depth`` the number of
    the first piece in that order that has the same first d bytes. From the common prefixes of
    neighbours, as a suffix array gives them."""
    n = len(pieces)
    order = sorted(range(n), key=pieces.__getitem__)
    table = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8).reshape(n, depth)
    same = table[1:] == table[:-1]
    common = np.where(same.all(axis=1), depth, same.argmin(axis=1))
    first = np.zeros((n, depth + 1), np.int32)
    first[1:] = np.where(common[:, None] < np.arange(depth + 1), np.arange(1, n, dtype=np.int32)[:, None], 0)
    np.maximum.accumulate(first, axis=0, out=first)
    out = np.empty_like(first)
    out[order] = first
    return out


def repeated_starts(e: np.ndarray, place: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every ``length``-byte string of the pieces that another one holds too. A
    string is a phrase's last bytes before the trigger and the bytes from the trigger on. Both sides
    are sorted, the one read backwards; strings are equal if they have equal ranks on both."""
    _, at, first, last = _unpack(place)
    ahead = (at - first).tolist()
    reach = _window(length)
    keys = [x.to_bytes(8) for x in e.view(np.uint64).tolist()]
    after = _ranks([k + p[a : a + length].ljust(length, b"\0") for k, p, a in zip(keys, pieces, ahead, strict=True)], length + 8)
    before = _ranks([p[:a][::-1].ljust(reach, b"\0") for p, a in zip(pieces, ahead, strict=True)], reach)
    size = last - first + 1
    row = np.repeat(np.arange(len(e)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    x = np.repeat(at, size) - start  # bytes before the trigger
    code = (x.astype(np.uint64) << np.uint64(48)) | (before[row, x].astype(np.uint64) << np.uint64(24)) | after[row, length + 8 - x].astype(np.uint64)
    order = np.argsort(code)
    new = _heads(code[order])
    twice = ~new | ~np.r_[new[1:], True]
    hit = np.sort(order[twice])
    return row[hit], start[hit]


_FOUND = "h long, tag int, first long, last long, digest binary, sample boolean"


def _compare(lengths: Sequence[int], sort_bytes: int, group_bytes: int):
    """Streams pieces in order of level and e; sorts whole groups of a level together. The strings of
    a group of more than ``group_bytes`` are passed on, each with a digest, instead."""

    def batch(h, tag, first, last, digest=None, sample=None) -> pa.RecordBatch:
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(tag, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.nulls(n, pa.binary()) if digest is None else pa.array(digest, pa.binary()), pa.array(np.zeros(n, bool) if sample is None else sample)], ["h", "tag", "first", "last", "digest", "sample"])

    def settle(e, h, place, sample, pieces) -> Iterator[pa.RecordBatch]:
        row, start = repeated_starts(e, place, pieces, lengths[e[0] & 1])
        own = ~sample[row]
        row, start = row[own], start[own]
        if len(row):
            new = _heads(row)
            new[1:] |= start[1:] != start[:-1] + 1
            a = np.flatnonzero(new)
            b = np.r_[a[1:], len(row)] - 1
            yield batch(h[row[a]], _unpack(place)[0][row[a]], start[a], start[b])

    def pass_on(e, h, place, sample, pieces) -> Iterator[pa.RecordBatch]:
        tag, _, first, last = _unpack(place)
        length = lengths[e[0] & 1]
        for i, p in enumerate(pieces):
            n = int(last[i] - first[i]) + 1
            starts = np.arange(first[i], last[i] + 1)
            yield batch(np.full(n, h[i]), np.full(n, tag[i]), starts, starts, [xxhash.xxh3_128_digest(p[k : k + length]) for k in range(n)], np.full(n, sample[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passed = None, None
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_pylist()]
            rest = cols if rest is None else [*(np.concatenate(x) for x in zip(rest[:4], cols[:4], strict=True)), rest[4] + cols[4]]
            cuts = [*np.flatnonzero(_heads(rest[0])).tolist(), len(rest[0])]
            at, size = 0, 0
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                open_end = j == len(rest[0])
                grown = sum(map(len, rest[4][i:j]))
                if passed == rest[0][i] or grown > group_bytes:
                    if at < i:
                        yield from settle(*[x[at:i] for x in rest])
                    yield from pass_on(*[x[i:j] for x in rest])
                    passed, at, size = rest[0][i], j, 0
                elif open_end or size + grown > sort_bytes or rest[0][at] & 1 != rest[0][i] & 1:
                    if at < i:
                        yield from settle(*[x[at:i] for x in rest])
                    at, size = i, grown
                else:
                    size += grown
            rest = [x[at:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from settle(*rest)

    return run


def _twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams strings in order of their digests; passes those on that have a twin."""
    held, held_out = None, False
    for b in batches:
        if not b.num_rows:
            continue
        digest = b.column("digest").to_pylist()
        same = [x == y for x, y in zip(digest[1:], digest[:-1], strict=True)]
        first = held is not None and held.column("digest")[0].as_py() == digest[0]
        if held is not None and (first or held_out):
            yield held
        keep = [x or y for x, y in zip([first, *same], [*same, False], strict=True)]
        last, held_out = keep[-1], keep[-1]
        yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1], pa.bool_()))
        held = b.slice(b.num_rows - 1)
        held_out = last
    if held is not None and held_out:
        yield held


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("h"), F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit((1 << _LEVEL) - 1)).cast("int").alias("tag"), text.cast("binary").alias("text"))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = (400,), sort_bytes: int = SORT_BYTES, group_bytes: int = GROUP_BYTES, crowd: int = CROWD) -> DataFrame:
    """``h``, ``tag`` (of a row's id and text), ``level``, ``first`` and ``last``: ranges of starts of
    strings of ``lengths[level]`` bytes that start anywhere else too. Ranges may overlap. One or two
    lengths share all passes."""
    if not (0 < len(lengths) <= 2 and all(40 <= n <= 1700 for n in lengths)):
        raise ValueError("one or two lengths from 40 to 1700 bytes")
    text_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    cut = spread(keyed.select("h", "tag", "text")).mapInArrow(_cut(*lengths), _ROWS_SCHEMA)
    sifted = staged(cut.repartition("e").sortWithinPartitions("e", "c").mapInArrow(partial(_sift, crowd=crowd), _ROWS_SCHEMA), "phrases")
    asked = sifted.where(F.col("kind") >= _ASK).groupBy("h").agg(F.collect_list(F.struct("e", "place", "kind")).alias("asked"))
    pieces = keyed.select("h", "tag", "text").join(asked, "h").mapInArrow(_fetch(*lengths), _PIECES)
    sorted_pieces = pieces.repartition("e").sortWithinPartitions(F.col("e").bitwiseAND(F.lit(1)), "e")
    found = staged(sorted_pieces.mapInArrow(_compare(lengths, sort_bytes, group_bytes), _FOUND), "starts")
    crowded = found.where("digest IS NOT NULL").repartition("digest").sortWithinPartitions("digest").mapInArrow(_twins, _FOUND)
    ranges = found.where("digest IS NULL").unionAll(crowded.where(~F.col("sample"))).select("h", "tag", "first", "last")
    done = sifted.where(F.col("kind") == _DONE).select("h", F.col("c").cast("int").alias("tag"), F.shiftrightunsigned("place", 32).alias("first"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last"))
    return done.unionAll(ranges).select("h", F.col("tag").bitwiseAND(F.lit((1 << _LEVEL) - 1)).alias("tag"), F.shiftright("tag", _LEVEL).alias("level"), "first", "last")


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> list[list[int]]:
    """[start, stop] of the runs of bytes that strings with these starts cover."""
    spans: list[list[int]] = []
    for i, j in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j + length)
        else:
            spans.append([i, j + length])
    return spans


def whole_words(raw: bytes, start: int, stop: int) -> int:
    """Words that lie in the span from end to end."""
    n = len(raw[start:stop].split())
    if n and start and not raw[start - 1 : start].isspace() and not raw[start : start + 1].isspace():
        n -= 1
    if n and stop < len(raw) and not raw[stop - 1 : stop].isspace() and not raw[stop : stop + 1].isspace():
        n -= 1
    return n


_OUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<array<long>>", "kept_sha256": "string", "n_repeated": "long", "passages": "array<array<long>>", "kept": "binary"}


def _erase(lengths: Sequence[int], passage_words: int, with_kept: bool):
    names = [n for n in _OUT if n != "kept" or with_kept]
    types = {"long": pa.int64(), "string": pa.string(), "array<array<long>>": pa.list_(pa.list_(pa.int64())), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tag, text, ranges in zip(b.column("tag").to_pylist(), b.column("text"), b.column("ranges"), strict=True):
                raw, found = text.as_py(), [[], []]
                if ranges.is_valid:
                    t, level, first, last = (ranges.values.field(k).to_numpy() for k in range(4))
                    for k, length in enumerate(lengths):
                        own = (t == tag) & (level == k)
                        found[k] = _spans(first[own], last[own], length)
                spans, passages = found[0], [s for s in found[-1 if len(lengths) > 1 else 0] if whole_words(raw, *s) >= passage_words]
                kept = b"".join([raw[i:j] for i, j in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True)])
                rows.append((len(raw), len(raw) - len(kept), len(spans), spans, hashlib.sha256(kept).hexdigest(), sum(z - a for a, z in passages), passages, kept))
            cols = dict(zip(_OUT, zip(*rows, strict=True) if rows else [()] * len(_OUT), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(cols[n], types[_OUT[n]]) for n in names)], ["id", *names])

    return run


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage_bytes: int | None = PASSAGE_BYTES, passage_words: int = PASSAGE_WORDS, with_kept: bool = True, **limits) -> DataFrame:
    """For every row ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` ([start, stop] in
    bytes), ``kept_sha256``, ``n_repeated`` (bytes in passages), ``passages`` ([start, stop]) and, if
    wanted, ``kept`` (binary, for a cut may split a character).

    Every byte of the UTF-8 text that a string of ``length`` bytes covers which starts anywhere else
    too, in the same text or another, is removed; all strings are judged on the input. Passages
    are found alike, with strings of ``passage_bytes``: runs of such bytes that hold
    ``passage_words`` whole words or more. They are reported, not removed. Without
    ``passage_bytes`` they are those among the removed spans.

    Triggers found by a rolling hash cut the texts into phrases so that equal strings lie in phrases
    with equal triggers. Phrases are sorted by what follows the trigger. Phrases that occur twice
    are settled by that. For those that share only a tail with others, the suffixes of the phrases
    before the trigger and the order of what follows it combine to the order of all their strings.
    A tail that more than ``crowd`` phrases share is dealt out again, by longer parts of them.

    Null texts are empty. Repeated rows are copies of each other. Rows without id take part like any
    other. Other columns are left out.
    """
    lengths = (length,) if passage_bytes in (None, length) else (length, passage_bytes)
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, lengths=lengths, **limits)
    lists = ranges.groupBy("h").agg(F.collect_list(F.struct("tag", "level", "first", "last")).alias("ranges"))
    keyed = _keyed(docs, id_col, text_col)
    schema = f"id {keyed.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in _OUT.items() if n != "kept" or with_kept)
    return keyed.join(lists, "h", "left").select("id", "tag", "text", "ranges").mapInArrow(_erase(lengths, passage_words, with_kept), schema)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), with_kept=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", (F.col("n_repeated") > 0).alias("repeated"))
