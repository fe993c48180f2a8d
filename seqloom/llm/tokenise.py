"""SentencePiece BPE encoding by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import spread, table, text_batches

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Longest segment, and number of segments, that a worker remembers.
MEMO_CHARS, MEMO_SIZE = 48, 300_000


class _Fits(dict):
    """Answers for pairs of pieces, by ``a << 20 | b``, kept in a bounded memory."""

    def __init__(self, compatible, most: int = 1_000_000):
        self.compatible, self.most = compatible, most

    def __missing__(self, pair: int) -> bool:
        if len(self) >= self.most:
            self.clear()
        out = self[pair] = self.compatible(pair >> 20, pair & (1 << 20) - 1)
        return out


class Pieces:
    """A BPE model with byte fallback, and the tables for exact encoding.

    The library merges, again and again, the adjacent pair whose union is the piece with the best
    score. A sequence of pieces is its result exactly if every two neighbours are compatible: if
    merging their joined text again gives the same two. So the text is covered by longest matches,
    the last one shortened or dropped where no compatible piece follows.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only models that leave text as it is, but for a leading space, are known here")
        self.piece = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL]
        if any(p.type in (pb.ModelProto.SentencePiece.USER_DEFINED, pb.ModelProto.SentencePiece.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not known here")
        self.id = {self.piece[i]: i for i in normal}
        self.byte = {int(m[1], 16): i for i, p in enumerate(self.piece) if (m := _BYTE.fullmatch(p))}
        self.value = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.CONTROL}
        if any(SPACE in p.strip(SPACE) or (p.strip(SPACE) and p.endswith(SPACE)) for p in self.id):
            raise ValueError("pieces with an inner space would cross the segments")
        self.space = self.id[SPACE]  # its text is the space that decoding drops at the start
        self.last_byte = max(self.value)
        self._build()

    def _build(self) -> None:
        # How merging ends for the piece's own text: as the piece (then from which two), or short of it.
        self.halves: dict[int, tuple[int, int]] = {}
        words = ahocorasick.Automaton()
        for text, i in self.id.items():
            if text.strip(SPACE) == "" and len(text) > 1:
                continue  # these tie in score; merge() deals with runs of spaces
            if len(text) == 1:
                self.halves[i] = (i, i)
            elif self.merge(text) == [i]:
                self.halves[i] = self._last
            else:
                continue
            words.add_word(text, i)
        words.make_automaton()
        self.words = words
        self.sizes = [len(p) for p in self.piece]
        self._fits = _Fits(self._compatible)
        # The pairs that have a union among the pieces.
        self.union: dict[tuple[int, int], int] = {}
        for text, i in self.id.items():
            for k in range(1, len(text)):
                a, b = self.id.get(text[:k]), self.id.get(text[k:])
                if a in self.halves and b in self.halves:
                    self.union[a, b] = i

    def merge(self, text: str) -> list[int]:
        """The library's own rule, step by step; for tables and runs of spaces."""
        part: list[str] = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        self._last = (-1, -1)
        while heap:
            _, a, b, union = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != union or right[a] != b:
                continue
            self._last = (self.id.get(part[a], -1), self.id.get(part[b], -1))
            part[a], part[b] = union, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for p in part if p for i in ([self.id[p]] if p in self.id else self._bytes(p))]

    def _bytes(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces ``a`` and ``b`` gives them back. Undoes merges on both
        sides, latest first. If two parts that meet at the border have a union that would have
        come before the merges undone so far, the border would not have stayed."""
        rank, halves, union = self.score, self.halves, self.union
        undone_a = undone_b = None  # the merge on either side that was undone last
        while True:
            if (u := union.get((a, b))) is not None:
                before = [rank[x] for x in (undone_a, undone_b) if x is not None]
                # On a tie the leftmost pair comes first: a merge left of the border before it, one right of it after.
                if all(rank[u] > s for s in before) or not before:
                    return False
                if undone_b is not None and rank[u] == rank[undone_b] and (undone_a is None or rank[u] > rank[undone_a]):
                    return False
            can_a, can_b = len(self.piece[a]) > 1, len(self.piece[b]) > 1
            if not can_a and not can_b:
                return True
            # Of the two merges the later one is undone first.
            if can_a and (not can_b or rank[a] < rank[b]):
                undone_a, a = a, halves[a][1]
            else:
                undone_b, b = b, halves[b][0]

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment: any number of spaces, then other characters."""
        if text.startswith(SPACE * 2):
            return self.merge(text)
        at: list[list[int]] = [[] for _ in text]  # pieces that start here, shortest first
        sizes = self.sizes
        for end, i in self.words.iter(text):
            at[end - sizes[i] + 1].append(i)
        if all(at):
            return self._cover(at, 0, len(text))
        out: list[int] = []
        start, n = 0, len(text)
        while start < n:
            if not at[start]:  # a character that is no piece: nothing merges across it
                out += self._bytes(text[start])
                start += 1
                continue
            stop = start
            while stop < n and at[stop]:
                stop += 1
            out += self._cover(at, start, stop)
            start = stop
        return out

    def _cover(self, at: list[list[int]], start: int, stop: int) -> list[int]:
        failed = bytearray((stop - start) // 8 + 1)  # a bit for each place from which no cover was found
        ids: list[int] = []
        tries: list[int] = []
        sizes, fits, last = self.sizes, self._fits, -1
        place, k = start, len(at[start]) - 1
        while place < stop:
            found = at[place]
            while k >= 0:
                i = found[k]
                end = place + sizes[i] - start
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or fits[last << 20 | i]):
                    break
                k -= 1
            if k >= 0:
                ids.append(i)
                tries.append(k)
                place += sizes[i]
                last = i
                if place < stop:
                    k = len(at[place]) - 1
            else:
                failed[place - start >> 3] |= 1 << (place - start & 7)
                if not ids:
                    raise ValueError("no cover")
                place -= sizes[ids.pop()]
                last = ids[-1] if ids else -1
                k = tries.pop() - 1
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library gives it: bytes in a row are UTF-8, each byte that is
        not is U+FFFD; one leading space goes."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()

        first = True
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            flush()
            if i in self.control:
                continue
            text = self.piece[i]
            if i == 0:
                text = " ⁇ "
            elif first and not any(out):
                if text.startswith(SPACE):
                    text = text[1:]
                    first = False
                elif text:
                    first = False
            out.append(text.replace(SPACE, " "))
        flush()
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Valid characters as they are, U+FFFD for each byte that begins none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


#: Spaces and what follows them. A line feed is no part of any longer piece, so it ends a segment.
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}*\n|{SPACE}+")


class Encoder:
    """Encodes and decodes whole texts by segments that no merge crosses; remembers short ones."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.split_lines = not any("\n" in p for p in self.pieces.id)
        self.text = [str(i) for i in range(len(self.pieces.piece))]
        # Two generations: what is in use moves on to the new one.
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _segment(self, text: str) -> tuple[int, str, str]:
        out = self.old.get(text)
        if out is None:
            pieces = self.pieces
            ids = pieces.encode_segment(text)
            if min(ids) <= pieces.last_byte:
                decoded = pieces.decode([pieces.space, *ids])
            else:
                decoded = "".join([pieces.piece[i] for i in ids]).replace(SPACE, " ")
            out = len(ids), ",".join([self.text[i] for i in ids]), decoded
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.old, self.memo = self.memo, {}
            self.memo[text] = out
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return _SEGMENT.findall(text) if self.split_lines else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text decoded from them."""
        get, make = self.memo.get, self._segment
        parts = [get(s) or make(s) for s in self.segments(text or "")]
        if not parts:
            return 0, "", ""
        decoded = "".join([p[2] for p in parts])
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), decoded.removeprefix(" ")

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.round_trip(text)[1].split(",") if i]


@lru_cache(maxsize=1)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _map(docs: DataFrame, of: str, model: str, columns: list[tuple[str, T.DataType]], one) -> DataFrame:
    """Adds columns that ``one(encoder, value)`` gives of the column ``of``. The model, which is small,
    is broadcast. Columns with the names added are replaced, all others kept, whatever their names."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    new = [n for n, _ in columns]
    kept = [c for c in docs.columns if c not in new]
    value = F.col(f"`{of}`")
    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), value.alias("value"))
    made = T.StructType([rows.schema["row"], *(T.StructField(f"c{k}", t) for k, (_, t) in enumerate(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encoder = _encoder(shared.value)
        for b in batches:
            found = [one(encoder, t.as_py()) for t in b.column("value")]
            arrays = [pa.array([r[k] for r in found], to_arrow_type(t)) for k, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *arrays], made.names)

    out = rows.mapInArrow(run, made)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[F.col(f"c{k}").alias(n) for k, n in enumerate(new)])


def tokenised(docs: DataFrame, model: str, *, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``n_tokens`` to every row. Null texts have no ids; columns of
    these names are replaced, others and repeated rows are kept."""

    def one(encoder: Encoder, text: str | None) -> tuple:
        ids = encoder.encode(text)
        return ids, len(ids)

    return _map(docs, text_col, model, [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType())], one)


def detokenised(rows: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids; null ids give an empty text."""
    return _map(rows, ids_col, model, [("decoded", T.StringType())], lambda encoder, ids: (encoder.pieces.decode(ids or []),))


def digests(docs: DataFrame, model: str, *, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to every row: encodes and decodes each
    whole text. Nulls count as empty texts."""

    def one(encoder: Encoder, text: str | None) -> tuple:
        n, ids, decoded = encoder.round_trip(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _map(docs, text_col, model, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], one)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model()).drop("text")
