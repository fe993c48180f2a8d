"""Text functions: rules, URLs, fingerprints and shortening."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import Names, sum_before

DEFAULT_HAN = r"\x{4E00}-\x{9FFF}"


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule (label, pattern) that matches anywhere, whatever the case. Rules are
    regular expressions; quote plain text with ``\\Q...\\E``."""
    out = F.lit(default).cast("string")
    for label, pattern in reversed(list(rules)):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def classify_by_table(df: DataFrame, text: str, rules: DataFrame, id_cols: Names) -> DataFrame:
    """Like :func:`classify` with rules in a table (``priority``, ``label``, ``word``): whole words,
    lower case. Words meet rules by equality, so long tables of rules do."""
    words = df.select(*id_cols, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    hits = words.join(rules, "word").groupBy(*id_cols).agg(F.min_by("label", "priority").alias("label"))
    return df.select(*id_cols).join(hits, list(id_cols), "left")


#: Rules that one automaton holds.
RULES = 100_000


def classify_by_substrings(df: DataFrame, text: str, rules: DataFrame, id_cols: Names, block: int = RULES) -> DataFrame:
    """``id_cols`` and ``label`` of every row: that of the rule (``priority``, ``label``, ``text``) with the least
    priority whose text occurs anywhere in ``text``, whatever the case; null if none does. Of rules that
    share a priority the smaller text counts; empty and null texts match nothing.

    All texts are read once past an automaton of the rules, whose cost does not grow with their number.
    One automaton holds ``block`` rules; longer tables are dealt out over as many, one pass each."""
    clean = rules.select(F.col("priority").cast("long").alias("priority"), F.col("label").cast("string").alias("label"), F.lower("text").alias("text")).where("text <> '' AND priority IS NOT NULL")
    clean = clean.groupBy("text").agg(F.min(F.struct("priority", "label")).alias("r")).select("r.priority", "r.label", "text")
    blocks = max(1, -(-clean.count() // block))
    rows = df.select(*id_cols, F.lower(text).alias("_text"), F.lit(None).cast("struct<priority:long,text:string,label:string>").alias("_rule"))
    for k in range(blocks):
        some = [(r["text"], r["priority"], r["label"]) for r in clean.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        rows = _first_rules(rows, df.sparkSession.sparkContext.broadcast(some))
    return rows.select(*id_cols, F.col("_rule.label").alias("label"))


_BUILT: dict[object, object] = {}


def _automaton(shared) -> object:
    """The rules of a broadcast as an automaton, made once in each worker."""
    import ahocorasick

    if shared.value and id(shared) not in _BUILT:
        made = ahocorasick.Automaton()
        for text, priority, label in shared.value:
            made.add_word(text, (priority, text, label))
        made.make_automaton()
        _BUILT.clear()
        _BUILT[id(shared)] = (shared, made)
    return _BUILT[id(shared)][1] if shared.value else None


def _first_rules(rows: DataFrame, shared) -> DataFrame:
    """``rows`` with ``_rule`` replaced by a rule of ``shared`` where that comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shared)
        least = min((p, t) for t, p, _ in shared.value) if made else None
        for b in batches:
            best = []
            for text, old in zip(b.column("_text").to_pylist(), b.column("_rule").to_pylist(), strict=True):
                now = None if old is None else (old["priority"], old["text"], old["label"])
                for _, rule in made.iter(text) if made and text else ():
                    if now is None or rule[:2] < now[:2]:
                        now = rule
                        if now[:2] == least:
                            break
                best.append(None if now is None else dict(zip(("priority", "text", "label"), now, strict=True)))
            at = b.schema.get_field_index("_rule")
            yield pa.RecordBatch.from_arrays([pa.array(best, c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return rows.mapInArrow(run, rows.schema)


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next slash, in lower case; a name without a scheme
    as it is, trimmed. Null and blank ones are empty."""
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1)).otherwise(F.trim(url))
    return F.coalesce(F.when(F.trim(url) != "", F.lower(host)), F.lit(""))


def _path(url: Column) -> Column:
    """Path of an absolute URL without query and fragment; empty for anything else."""
    return F.coalesce(F.regexp_extract(F.trim(url), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1), F.lit(""))


def url_file(url: Column, default: str) -> Column:
    """Last part of the path, without query and fragment; a default if there is none."""
    name = F.element_at(F.split(_path(url), "/"), -1)
    return F.when(F.trim(name) == "", F.lit(default)).otherwise(name)


def url_tail(url: Column, skip: int = 3) -> Column:
    """What follows the first ``skip`` parts of the path; empty parts do not count."""
    path = F.filter(F.split(_path(url), "/"), lambda p: p != "")
    return F.array_join(F.slice(path, skip + 1, F.greatest(F.size(path) - skip, F.lit(0))), "/")


def content_fingerprint(df: DataFrame, by: Names, line: str, order: Names, pieces: int | None = None) -> DataFrame:
    """A digest of each key's lines in order, to see changes by: one line more, or two that change
    places, give another. Null lines are empty. Rows that tie in ``order`` should not differ.

    Each line with its place gives two numbers of 60 bits; their sums and the number of lines are what
    is digested. Sums can be made of parts in any order, so a key's lines never are one value;
    ``pieces`` as in ``core.sum_before`` finds places of keys larger than a task."""
    rows = sum_before(df.select(*by, *order, F.coalesce(F.col(line), F.lit("")).alias("_line")), by, order, F.lit(1).cast("long"), "_at", pieces)
    rows = rows.withColumn("_h", F.md5(F.concat(F.col("_at").cast("string"), F.lit(":"), F.col("_line"))))
    part = lambda k: F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), part(0).alias("_a"), part(1).alias("_b"))
    return sums.select(*by, F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("_n", "_a", "_b")])).alias("fingerprint"))


def char_count(text: Column, kind: str = DEFAULT_HAN) -> Column:
    """Characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]", ""))


def clamp_chars(text: Column, n: int = 60, kind: str = DEFAULT_HAN) -> Column:
    """The text up to its ``n``-th character of a class, with an ellipsis where it was cut."""
    head = F.regexp_extract(text, f"(?s)^((?:[^{kind}]*[{kind}]){{{n}}})", 1)
    return F.when(char_count(text, kind) > n, F.concat(head, F.lit("…"))).otherwise(text)


def plain_breaks(text: Column) -> Column:
    """Line breaks of any system as line feeds, without white space at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def head_lines(text: Column, lines: int = 5, chars: int = 400, mark: str = " …") -> Column:
    """The first lines that are not blank, without white space at their ends, as long as they fit into
    so many characters with their breaks; the line that does not fit is cut and marked."""
    parts = F.filter(F.transform(F.split(plain_breaks(text), "\n"), lambda x: F.regexp_replace(x, r"[\s\p{Z}]+$", "")), lambda x: x != "")
    start = F.struct(F.lit(chars).alias("room"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.length(x) <= acc["room"]
        line = F.when(fits, x).otherwise(F.concat(F.substring(x, F.lit(1), acc["room"]), F.lit(mark)))
        room = F.when(fits, acc["room"] - F.length(x) - 1).otherwise(0)
        done = acc["room"] <= 0
        return F.struct(F.when(done, acc["room"]).otherwise(room).alias("room"), F.when(done, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"))

    return F.array_join(F.aggregate(F.slice(parts, 1, max(1, lines)), start, step, lambda a: a["out"]), "\n")


def tail_chars(text: Column, chars: int = 500, least: int = 80) -> Column:
    """The last characters, from a line's start on unless that is among the last ``least`` of them."""
    whole = plain_breaks(text)
    tail = F.right(whole, F.lit(chars))
    at = F.instr(tail, "\n")
    cut = (F.length(whole) > chars) & (at > 0) & (at - 1 < chars - least)
    return F.when(cut, F.substring(tail, at + 1, F.length(tail))).otherwise(tail)
