"""Spelling variants: words that differ by one edit, found in a trie of letter-group counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import crc32_sql
from .tables import ascii_lower, spread, staged, table

#: Groups of letters, those that tell words apart best first; all other letters are one more.
GROUPS = ("e", "a", "i", "o", "t", "n", "s", "r", "l", "h", "d", "u", "c", "m", "gp", "by", "fv", "wk", "jqxz")
RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a cell of the trie that one group holds, at least, and how many such groups there may be.
CELL_WORDS, CELLS = 4096, 16_384
#: State of a search: nothing spent, the surplus spent, both spent.
_FRESH, _LONGER, _MOVED = 0, 1, 2


def vector(word: str, groups: Sequence[str] = GROUPS) -> tuple[int, ...]:
    """How often each group's letters occur."""
    found = [sum(map(word.count, g)) for g in groups]
    return (*found, len(word) - sum(found))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted or replaced code point makes ``b``, as long as ``a`` or one longer, of ``a``."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] and i < len(a) if len(a) == len(b) else a[i:] == b[i + 1 :]


def _steps(state: int) -> tuple[tuple[int, int], ...]:
    """By how much a count may change next, and the state after that: the surplus comes first, so
    each pair is met from one side."""
    return ((0, state), (1, _LONGER)) if state == _FRESH else ((0, state), (-1, _MOVED)) if state == _LONGER else ((0, state),)


def prefix(counts: Sequence[int]) -> str:
    return ",".join(map(str, counts))


def cells_of(counts: tuple[int, ...], crowded: frozenset[str]) -> tuple[str, list[tuple[str, int]]]:
    """The cell that a vector lies in, and the cells and states in which its search goes on. A cell is
    the first node on the way from the root that is not crowded, or a crowded leaf."""
    depth, top = len(counts), 1
    while top < depth and prefix(counts[:top]) in crowded:
        top += 1
    found: list[tuple[str, int]] = []

    def walk(head: tuple[int, ...], state: int) -> None:
        for change, after in _steps(state):
            c = counts[len(head)] + change
            if c < 0:
                continue
            node = (*head, c)
            if len(node) < depth and prefix(node) in crowded:
                walk(node, after)
            else:
                found.append((prefix(node), after))

    walk((), _FRESH)
    return prefix(counts[:top]), found


def _halves(length: int) -> int:
    """Words that one edit makes of each other share so many letters at the front or at the end, if
    the longer one has this length."""
    return (length - 1) // 2


class Cell:
    """Near words between those that search in a cell and those that lie in it."""

    def __init__(self) -> None:
        self.found: dict[str, list] = {}

    def _meet(self, a: str, n: int, b: str, m: int) -> None:
        for word, own, other, count in ((a, n, b, m), (b, m, a, n)):
            at = self.found.setdefault(word, [own, 0, 0, ""])
            at[1] += 1
            if count > at[2] or (count == at[2] and other < at[3]):
                at[2], at[3] = count, other

    def leaf(self, queries: list[tuple[str, int]], words: list[tuple[str, int]], state: int, only: str = "") -> None:
        """Verifies the pairs of two leaves. They share their front or end half, so only those are
        compared; ``only`` takes one of both kinds, the end for pairs that do not share the front."""
        if not queries or not words:
            return
        h = _halves(len(words[0][0]))
        for side in "<>" if not only else only:
            cut = (lambda w: w[:h]) if side == "<" else (lambda w: w[-h:])
            at: dict[str, list[tuple[str, int]]] = {}
            for w in words:
                at.setdefault(cut(w[0]), []).append(w)
            for a, n in queries:
                for b, m in at.get(cut(a), ()):
                    if (state != _FRESH or a < b) and (side == "<" or a[:h] != b[:h]) and one_edit(a, b):
                        self._meet(a, n, b, m)

    def search(self, queries: dict, words: dict, depth: int, state: int) -> None:
        """Both tries at once, depth first."""
        if not depth:
            self.leaf(queries, words, state)
            return
        for c, below in queries.items():
            for change, after in _steps(state):
                other = words.get(c + change)
                if other is not None:
                    self.search(below, other, depth - 1, after)


def _trie(rows: list[tuple[str, int]], skip: int, groups: Sequence[str]) -> dict:
    root: dict = {}
    for word, n in rows:
        counts = vector(word, groups)[skip:]
        node = root
        for c in counts[:-1]:
            node = node.setdefault(c, {})
        node.setdefault(counts[-1], []).append((word, n))
    return root


def _searched(groups: Sequence[str]):
    depth = len(groups) + 1

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[str, int]] = []
        queries: dict[int, list[tuple[str, int]]] = {}
        for b in batches:
            for word, n, state in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), b.column("state").to_pylist(), strict=True):
                (words if state < 0 else queries.setdefault(state, [])).append((word, n))
        name, cell = key[0].as_py(), Cell()
        if words and queries:
            if name[-1:].isdigit():
                skip = name.count(",") + 1
                tree = _trie(words, skip, groups) if skip < depth else {}
                for state, rows in queries.items():
                    if skip < depth:
                        cell.search(_trie(rows, skip, groups), tree, depth - skip, state)
                    else:
                        cell.leaf(rows, words, state)
            else:
                side = name[name.index("|") + 1]
                for state, rows in queries.items():
                    cell.leaf(rows, words, state, side)
        found = [(w, *v) for w, v in cell.found.items()]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "near", "best_n", "best"])

    return run


def _crowded(words: DataFrame, groups: Sequence[str], most: int) -> frozenset[str]:
    """Nodes of the trie under which more than ``most`` words lie: as many as fit, so, for each level."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, int] = {}
            for w in b.column("word").to_pylist():
                v = vector(w, groups)
                for d in range(1, len(v) + 1):
                    p = prefix(v[:d])
                    counts[p] = counts.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["node", "n"])

    rows = words.select("word").mapInArrow(prefixes, "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return frozenset(r["node"] for r in rows.where(F.col("n") > most).collect())


def near_words(words: DataFrame, *, groups: Sequence[str] = GROUPS, cell_words: int = CELL_WORDS, cells: int = CELLS) -> DataFrame:
    """For each of ``words`` (distinct ``word``, not null, and ``n``) that has near words, those one
    inserted, deleted or replaced code point away: ``word``, ``near`` (how many), ``form`` and ``form_n`` (the one
    of largest ``n``, of several the smallest in code-point order).

    Words hang in a trie by their letter groups' counts. A pair's counts differ by one surplus and one
    deficit at most, so a search spends these on its way down. Nodes with more than ``cell_words``
    words, or more than a ``cells``-th of all, are known everywhere (``cells`` on a level at most); words go
    to the cells below them, searches to all cells that their budget reaches, and each cell goes on
    by itself. A leaf of more words than that, of anagrams, is dealt out by halves: near words of one
    length, or of two that follow, share one. Every cell sends one row a word, not one a pair."""
    total = words.count()
    if not total:
        return words.select("word", F.lit(0).cast("long").alias("near"), F.col("word").alias("form"), F.col("n").cast("long").alias("form_n"))
    groups, depth = tuple(groups), len(groups) + 1
    crowded = words.sparkSession.sparkContext.broadcast(_crowded(words, groups, max(cell_words, total // cells)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = crowded.value
        for b in batches:
            out: list[tuple[str, int, str, int]] = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                own, reached = cells_of(vector(word, groups), nodes)
                for name, state in ((own, -1), *reached):
                    if name.count(",") + 1 == depth and name in nodes:
                        h = _halves(len(word) + (state == _LONGER))
                        out += [(f"{name}|<{word[:h]}", state, word, n), (f"{name}|>{word[-h:]}", state, word, n)]
                    else:
                        out.append((name, state, word, n))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int8(), pa.string(), pa.int64()), strict=True)], ["cell", "state", "word", "n"])

    dealt = spread(words.select("word", F.col("n").cast("long").alias("n"))).mapInArrow(routed, "cell string, state byte, word string, n long")
    met = dealt.groupBy("cell").applyInArrow(_searched(groups), "word string, n long, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    met = met.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return met.select("word", "near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of forms, for each word that has one. Each round
    doubles the steps taken; a form is at least ``RATIO`` times as frequent, so a few rounds do."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = staged(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("_moved")


def group_variants(words: DataFrame, *, ratio: int = RATIO, groups: Sequence[str] = GROUPS) -> DataFrame:
    """For each of ``words`` (distinct ``word`` and ``n``): ``form``, its most frequent near word if that is ``ratio``
    times as frequent at least, ``root``, where following the forms ends (the word itself without one),
    ``n_near`` (0 without near words) and ``form_n`` (null without a form). Words of fewer than four
    code points and null ones should be left out before. An empty table gives an empty one."""
    near = staged(near_words(words, groups=groups), "near")
    has = F.col("form_n") >= ratio * F.col("n")
    rows = words.select("word", F.col("n").cast("long").alias("n")).join(near, "word", "left")
    rows = staged(rows.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    roots = rooted(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(text: Column, least: int) -> Column:
    """Maximal runs of letters, A-Z in lower case, of ``least`` letters or more."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))


def word_counts(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", slip: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of at least so many letters and occurrences, over whole texts. Counts
    are summed up by tasks before they travel, so a frequent word is a row a task.

    With ``slip`` a letter is lost from every ``slip``-th run: where that divides the unsigned CRC-32 ``h`` of
    ``<id>:<run>`` the one at ``h % length`` goes. Null texts have no words, a null id is written as
    nothing; repeated rows count again, other columns are left out."""
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    rows = rows.select("id", F.explode(runs(F.col("text"), least_length)).alias("word"))
    if slip:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod("h", F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


SLIP = 199


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = staged(word_counts(table(spark, sf_dir, "documents"), slip=SLIP), "words")
    return group_variants(words)


OP13_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS MATERIALIZED (SELECT id, run, count(*) AS n FROM w WHERE length(run) >= 6 GROUP BY ALL),
{crc32_sql("c", "id, run, n", "id || ':' || run")},
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM v, range(1, 200) t(i) WHERE i <= length(word)),
e AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b FROM d a JOIN d b ON a.key = b.key AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.key UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.key),
m AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, max(v.n) AS best_n FROM e JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, m.n_near, m.best_n, (SELECT min(b) FROM e JOIN v x ON x.word = b WHERE a = v.word AND x.n = m.best_n) AS best FROM v LEFT JOIN m USING (word)),
g AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
r AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT r.word, g.word, g.form FROM r JOIN g ON g.word = r.next)
SELECT g.word, g.form, r.root, g.n, g.n_near, g.form_n FROM g JOIN r ON r.word = g.word AND r.next IS NULL"""
