"""Benchmark decontamination: suffix arrays of training shards, searched by benchmark suffixes."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import spread, staged, table, text_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text in a shard, and words of benchmark items in a block.
SHARD_BYTES = 8_000_000
BLOCK_WORDS = 500_000
_HEAD = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())  # bytes: A-Z only


def _heads(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A code of the ``width`` words from each place on; places that differ in it differ."""
    code = np.zeros(len(at), np.uint64)
    for k in range(width):
        code = (code + ids[at + k].astype(np.uint64) + np.uint64(1)) * _MIX
    return code


class Benchmark:
    """The words of a block of items, and their suffixes cut to a window, in order.

    A suffix of an item that has a whole window left is searched for with that window. An item
    shorter than a window is one search of its own length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.items = [i for i, _ in items]
        for n, (_, words) in enumerate(items):
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for j in range(max(1, len(codes) - window + 1) if codes else 0):
                rows.setdefault(tuple(codes[j : j + window]), []).append((n, j))
        self.lengths = np.array([len(k) for k in rows], np.int64)
        keys = np.zeros((len(rows), window), ">u4")
        for i, k in enumerate(rows):
            keys[i, : len(k)] = k
        last = keys.copy()
        for i, k in enumerate(rows):
            last[i, len(k) :] = 0xFFFFFFFF
        self.first, self.last = self._text(keys), self._text(last)
        self.head = min(_HEAD, int(self.lengths.min())) if len(rows) else 1
        self.heads = np.unique(_heads(keys[:, : self.head].astype(np.int64).ravel(), np.arange(len(rows)) * self.head, self.head))
        self.source_at = np.cumsum([0, *map(len, rows.values())])
        self.source = np.array([x for v in rows.values() for x in v], np.int64).reshape(-1, 2)

    def _text(self, keys: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(keys).view(f"S{4 * self.window}").ravel()

    def search(self, docs: list[list[bytes]]) -> tuple[list[list[int]], list[list[str]], list[int]]:
        """For each document: merged [start, stop, ...] of words hit, items found, and the words of
        the longest verbatim match."""
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        ends = np.cumsum(sizes)
        get = self.ids.get
        ids = np.zeros(int(sizes.sum()) + self.window, np.int64)  # 0: not in the benchmark, or between documents
        for words, end in zip(docs, ends, strict=True):
            ids[end - 1 - len(words) : end - 1] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans, items, longest = [[] for _ in docs], [[] for _ in docs], [0] * len(docs)
        if not len(self.lengths):
            return spans, items, longest
        # The shard's suffix array, of those suffixes that begin as some benchmark suffix does.
        able = ids > 0
        for k in range(1, self.head):
            able[:-k] &= ids[k:] > 0
            able[-k:] = False
        at = np.flatnonzero(able)
        code = _heads(ids, at, self.head)
        near = np.searchsorted(self.heads, code)
        at = at[self.heads[np.minimum(near, len(self.heads) - 1)] == code]
        keys = self._text(ids[at[:, None] + np.arange(self.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        array, keys = at[order], keys[order]
        lo, hi = np.searchsorted(keys, self.first, "left"), np.searchsorted(keys, self.last, "right")
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return spans, items, longest
        n = (hi - lo)[found]
        which = np.repeat(found, n)
        place = array[np.repeat(lo[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]

        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + self.lengths[which], -1)
        edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = ends - sizes
        for d, a, b in zip(np.searchsorted(ends, starts, "right"), starts, stops, strict=True):
            spans[d] += [int(a - begin[d]), int(b - begin[d])]

        n = self.source_at[which + 1] - self.source_at[which]
        rows = np.repeat(self.source_at[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, offset = self.source[rows].T
        place, length = np.repeat(place, n), np.repeat(self.lengths[which], n)
        doc = np.searchsorted(ends, place, "right")
        for x in np.unique(doc * len(self.items) + item):
            items[x // len(self.items)].append(self.items[x % len(self.items)])
        # Windows that follow each other in both texts are one longer match.
        order = np.lexsort((place, place - offset, item))
        item, diagonal, place, length, doc = item[order], (place - offset)[order], place[order], length[order], doc[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(new)]) - 1 + length[at]
        for d, s in zip(doc[at], size, strict=True):
            longest[d] = max(longest[d], int(s))
        return spans, items, longest


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """``block`` and ``data``: the items, dealt out by their ids into blocks of about ``block_words``
    words, each made ready for the search in a task of its own and written out."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))  # six bytes a word

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or b""))
        return pa.table({"block": table.column("block")[:1], "data": pa.array([pickle.dumps(Benchmark([(i, words_of(t)) for i, t in rows], window))], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    return staged(dealt.groupBy("block").applyInArrow(build, "block int, data binary"), "benchmark")


def _shards(texts: list[bytes | None], most: int) -> Iterator[list[list[bytes]]]:
    shard, size = [], 0
    for t in texts:
        if shard and size + len(t or b"") > most:
            yield shard
            shard, size = [], 0
        shard.append(words_of(t))
        size += len(t or b"")
    yield shard


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, stop in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.IntegerType())])


def _search(docs: DataFrame, block, shard_bytes: int) -> DataFrame:
    """``row`` of ``docs`` (with ``text``) and what a block of items finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = _benchmark(block.value)
        for b in batches:
            counts, spans, items, longest = [], [], [], []
            for shard in _shards(b.column("text").to_pylist(), shard_bytes):
                counts += map(len, shard)
                for total, part in zip((spans, items, longest), benchmark.search(shard), strict=True):
                    total += part
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())], ["row", *_FOUND.names])

    return docs.mapInArrow(run, T.StructType([docs.schema["row"], *_FOUND.fields]))


@lru_cache(maxsize=1)
def _benchmark(data: bytes) -> Benchmark:
    return pickle.loads(data)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several blocks find in a text becomes one."""
    for b in batches:
        rows = []
        for found in b.column("found").to_pylist():
            spans: list[int] = []
            for f in found:
                spans = _merged(spans, f["spans"])
            rows.append((spans, sorted({i for f in found for i in f["items"]}), max(f["longest"] for f in found)))
        spans, items, longest = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())], ["key", "spans", "items", "longest"])


def find_overlap(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` ([start, stop, ...] in words), ``n_hit``, ``items`` (ids as
    sorted strings), ``n_items``, ``longest_match`` and ``contaminated`` to every row of ``docs``.

    Each shard of documents becomes a suffix array over word numbers; each suffix of each item is
    binary-searched in it, which gives all places of its first ``window`` words, and runs of
    neighbouring matches give the longest one. A shorter item is searched as a whole. The array
    keeps the suffixes that begin like some item's, so its size follows the matches, not the text.

    Items are made into blocks of about ``block_words`` words by tasks. One block at a time is held
    by driver and executors. A single block is searched for in one pass that shuffles nothing, unless
    documents come in fewer partitions than there are cores. More blocks take a pass each,
    whose finds are written out by text; they are few, and are joined to the documents at the end.

    Null texts have no words. Items without id are left out; repeated items count once. Columns of
    ``docs`` with the names added are replaced, all others kept, whatever their names. Repeated rows
    stay.
    """
    kept = [c for c in docs.columns if c == text_col or c not in ADDED]
    out = _overlap(docs.select(*[F.col(f"`{c}`") for c in kept]), benchmark, text_col, item_col, item_text_col, window, block_words, shard_bytes)
    edge = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        "n_words",
        F.col("spans").alias("hit_spans"),
        F.aggregate(edge, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.col("longest").alias("longest_match"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ADDED = ["n_words", "hit_spans", "n_hit", "items", "n_items", "longest_match", "contaminated"]


def _overlap(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_words: int, shard_bytes: int) -> DataFrame:
    """``row``, a document whole, and what was found in it."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text)
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_words)
    numbers = [r["block"] for r in blocks.select("block").orderBy("block").collect()]
    data = lambda k: spark.sparkContext.broadcast(bytes(blocks.where(F.col("block") == k).first()["data"]))
    if len(numbers) < 2:
        block = data(numbers[0]) if numbers else spark.sparkContext.broadcast(pickle.dumps(Benchmark([], window)))
        out = _search(rows, block, shard_bytes)
    else:
        finds, keyed = None, spread(docs.select(F.struct(F.xxhash64(text_col).alias("key")).alias("row"), text))
        for k in numbers:
            block = data(k)
            found = _search(keyed, block, shard_bytes).where(F.size("items") > 0)
            found = staged(found.select("row.key", F.struct("spans", "items", "longest").alias("found")).dropDuplicates(["key"]), "finds")
            finds = found if finds is None else finds.unionAll(found)
            block.destroy()
        merged = finds.groupBy("key").agg(F.collect_list("found").alias("found")).mapInArrow(_joined, "key long, spans array<int>, items array<string>, longest int")
        nothing = spark.sparkContext.broadcast(pickle.dumps(Benchmark([], window)))
        counted = _search(rows.select(F.struct("row", F.xxhash64(F.col(f"row.`{text_col}`")).alias("key")).alias("row"), "text"), nothing, shard_bytes).select("row.row", "row.key", "n_words")
        none = lambda kind: F.array().cast(kind)
        out = counted.join(merged, "key", "left").select("row", "n_words", F.coalesce("spans", none("array<int>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns as they were."""
    found = _overlap(docs, benchmark, text_col, item_col, item_text_col, window, block_words, shard_bytes)
    return found.where(F.size("spans") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlap(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.col("longest_match").cast("long").alias("longest_match"), F.array_join(F.col("hit_spans").cast("array<string>"), ",").alias("hit_spans"))


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, j, array_to_string(w[j:j + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id, bw.j FROM dw JOIN bw USING (n, g)),
cells AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)),
runs AS (SELECT doc_id, min(q) AS a, max(q) AS z FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS isle FROM cells) GROUP BY doc_id, isle),
cover AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_hit, string_agg((a - 1) || ',' || z, ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id),
chains AS (SELECT doc_id, item_id, p - j AS diagonal, n, p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - j ORDER BY p) AS isle FROM (SELECT DISTINCT doc_id, p, n, item_id, j FROM hits)),
best AS (SELECT doc_id, max(m) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS m FROM chains GROUP BY doc_id, item_id, diagonal, n, isle) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(i)), ',') AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(longest, 0)::BIGINT AS longest_match, coalesce(spans, '') AS hit_spans FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""
