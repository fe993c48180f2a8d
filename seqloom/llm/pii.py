"""Personal data in texts: candidates of several generators, judged by boosted trees."""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, boosted, least_threshold, platt, sigmoid
from .tables import spread, staged, table, text_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: The model is fitted on the texts of at most so many ids, and at most so many candidates of them.
FIT_IDS, FIT_ROWS = 10_000, 20_000
FOLDS, PRECISION, LEAST_ROWS = 4, 0.98, 40
#: A redaction must be as likely as this: a wrong one is taken to cost four times what a miss does.
LEAST_LIKELY = 0.8
MASKS = [f"[{k.upper()}]" for k in KINDS]

Span = tuple[int, int, int]  # start, kind, stop

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, or it would have started before. Patterns begin with a
# class, so that texts are skimmed for it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"\x20?(?:[@＠]|[(\[{<]\x20?(?:at|AT)\x20?[)\]}>])\x20?|\x20(?:at|AT)\x20")
_DOT = r"(?:\x20?(?:[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}])\x20?|\x20(?:dot|DOT)\x20|\x20?\.\x20?)"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_LOOSE_IP = re.compile(rf"[0-9](?<![0-9][0-9])[0-9]{{0,2}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
_CHAIN = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20().\-/ ‑–]{0,3}[0-9]){6,}")
_SIGNS = [re.compile(p) for p in ("@", "＠", " at ", " AT ", r"[(\[{<]\x20?(?:at|AT)\x20?[)\]}>]")]
_GROUP = re.compile(r"[+(]{0,2}[0-9]+")
#: Numbers of cards and phones have no more groups of digits than this.
MOST_GROUPS = 6
#: Hosts of written-out addresses are no longer than this.
MOST_HOST = 400


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _local_start(text: str, stop: int, low: int) -> int:
    while stop > low and text[stop - 1] in _LOCAL:
        stop -= 1
    return stop


def base_spans(text: str) -> list[Span]:
    """The plain rules: leftmost matches that do not overlap, by kind; those that fail a check go."""
    out: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start, m = _local_start(text, at, low), _DOMAIN.match(text, at + 1)
        if m and start < at:
            out.append((start, EMAIL, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """What may be personal data, overlapping: addresses with written-out signs, dotted numbers, and
    runs of groups of digits in each chain of them."""
    out: set[Span] = set()
    for m in (m for p in _SIGNS for m in p.finditer(text)):
        low, high = m.start() - (text[m.start() - 1 : m.start()] == " "), m.end() + (text[m.end() : m.end() + 1] == " ")
        start, d = _local_start(text, low, 0), _LOOSE_DOMAIN.match(text, high, high + MOST_HOST)
        if d and start < low:
            out.add((start, EMAIL, d.end()))
            # A sentence may end after the address.
            parts = [p.end() for p in re.finditer(r"[A-Za-z0-9-]+", d.group())]
            out.update((start, EMAIL, high + e) for e in parts[1:-1])
    out.update((m.start(), IP, m.end()) for m in _LOOSE_IP.finditer(text))
    for m in _CHAIN.finditer(text):
        first = m.start()
        while first > 0 and m.start() - first < 2 and text[first - 1] in "+(":
            first -= 1
        groups = [(g.start(), g.end(), sum("0" <= c <= "9" for c in g.group())) for g in _GROUP.finditer(text, first, m.end())]
        for i, (start, _, _) in enumerate(groups):
            n = 0
            for _, stop, own in groups[i : i + MOST_GROUPS]:
                n += own
                if n > 19:
                    break
                if n >= 12:
                    out.add((start, CARD, stop))
                if 7 <= n <= 15:
                    out.add((start, PHONE, stop))
    return sorted(out)


# Words near data of a kind, and near numbers that are none, in some languages.
NEAR = ["mail contact email correo courriel kontakt write", "ip host server address client adresse login", "card visa credit debit payment tarjeta carte karte amex master", "phone tel call fax mobile cell teléfono téléphone telefon whatsapp dial"]
FAR = "version order isbn invoice ref date page section no id serial part item total sum amount"
_WORDS = [re.compile(r"\b(?:" + w.replace(" ", "|") + ")", re.I) for w in [*NEAR, FAR]]
CONTEXT = 40


def features(text: str, span: Span) -> list[float]:
    """Format of a span and what stands around it, as numbers. The kind is among them."""
    start, kind, stop = span
    s, before, after = text[start:stop], text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    left, right = before[-1:], after[:1]
    parts = re.split(_DOT, s[(m.end() if (m := _AT.search(s)) else 0) :])
    tail, signs = parts[-1], m.group() if m else ""
    year = sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    near = re.sub(r"\s+", " ", before)
    side = lambda c: [float(c.isalnum()), float(c in "+-/.,:=#$€%" and c != "")]
    return [
        *[float(kind == k) for k in range(4)],
        len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        float(s.startswith("+") or digits.startswith("00")), s.count("("), s.count(")"), s.count(" "), s.count("-") + s.count("\u2011") + s.count("\u2013"), s.count("."), s.count("/"),
        float(luhn(digits)) if kind == CARD else 0.0,
        float(digits[:1] or -1), float(digits[:2] or -1),
        float(len(groups) == 4 and all(g[:4].isdigit() and int(g[:4]) <= 255 for g in groups)),
        year, float(len(set(digits))),
        float("@" in signs or "＠" in signs), float(bool(re.search(r"[(\[{<]", signs))), float(signs.strip().lower() == "at"), float(signs != signs.strip()),
        len(parts), float(len(tail)), float(tail.isalpha()) + float(tail.islower()), float(bool(re.search(r"\.\x20|\x20\.", s))), float(len(re.findall(r"\bdot\b", s, re.I))), float(len(re.findall(r"[(\[{]\x20?\.", s))),
        *side(left), *side(right),
        sum(c.isdigit() for c in before[-12:] + after[:12]),
        float(any(_WORDS[k].search(near) for k in [kind])) - float(bool(_WORDS[4].search(near[-20:]))),
    ]


Variant = tuple[str, list[tuple[int, int]]]  # a text and where in it personal data stands


def _checked(digits: str) -> str:
    """``digits`` with the last one set so that Luhn's sum comes out."""
    return next(x for x in (digits[:-1] + str(k) for k in range(10)) if luhn(x))


def _emails(value: str, rng: random.Random) -> tuple[list[str], list[str]]:
    word = lambda a=3, b=9: "".join(rng.choices("abcdefghiklmnoprstuvwyz", k=rng.randint(a, b)))
    named = rng.choice([f"{word()}.{word()}", f"{word()}{rng.randint(1, 99)}", f"{word()}_{word()}", word(), f"{word(1, 1)}.{word()}"])
    host = ".".join([*(word() for _ in range(rng.choice([1, 1, 2]))), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co", "edu", "info"])])
    good = [f"{named} @ {host}", f"{named}＠{host}"]
    for name, at_host in (value.rsplit("@", 1), (named, host)):
        for _ in range(2):
            at, dot = rng.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " AT "]), rng.choice([" dot ", "(dot)", " (dot) ", "[dot]", " DOT "])
            good.append(name + at + at_host.replace(".", dot))
        good += [f"{name} at {at_host.replace('.', ' dot ')}", f"{name}{rng.choice(['(at)', ' [at] ', '[at]', ' (at) '])}{at_host}"]
    bad = [f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word().title()}", f"{word()} at {word()}. {word()}", f"{word()} @ {rng.randint(1, 9)}.{rng.randint(0, 99)}", f"{word()} at {rng.randint(1, 23)}.{rng.randint(10, 59)}", f"{word()}@{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.randint(2, 99)} @ {rng.randint(1, 99)}.{rng.randint(10, 99)}"]
    return good, bad


def _addresses(value: str, rng: random.Random) -> tuple[list[str], list[str]]:
    r = rng.randint
    parts, wrong = value.split("."), [str(r(256, 999)), *(str(r(0, 999)) for _ in range(3))]
    good = [dot.join(parts) for dot in ("[.]", "(.)", " dot ", "[dot]", " . ", "(dot)")]
    bad = ["[.]".join(wrong), " . ".join(wrong), ".".join(wrong), f"{r(1, 31)}.{r(1, 12)}.{r(1990, 2030)}", f"{r(1, 9)}. {r(1, 9)}. {r(1, 9)}. {r(1, 9)}"]
    return good, bad


def _cards(value: str, rng: random.Random) -> tuple[list[str], list[str]]:
    r, d = rng.randint, _digits(value)
    many = lambda n: "".join(str(r(0, 9)) for _ in range(n))
    groups = lambda x, s: s.join(x[i : i + 4] for i in range(0, len(x), 4))
    other = _checked(str(r(3, 6)) + many(15))
    wrong = other[:-1] + str((int(other[-1]) + r(1, 9)) % 10)
    good = [groups(x, sep) for x in (d, other) for sep in rng.sample([".", "/", "  ", " - ", " "], 2)]
    bad = [wrong, groups(wrong, "."), groups(wrong, " "), f"978{many(10)}", f"20{r(10, 30)}{r(10, 12)}{r(10, 28)}{many(6)}", f"978-{r(0, 9)}-{many(3)}-{many(5)}-{r(0, 9)}"]
    return good, bad


def _phones(value: str, rng: random.Random) -> tuple[list[str], list[str]]:
    r, area = rng.randint, str(rng.randint(200, 989))
    many = lambda n: "".join(str(r(0, 9)) for _ in range(n))
    good = [f"({area}) {r(200, 999)}-{many(4)}", f"({area}){r(200, 999)} {many(4)}", f"{area}-{r(200, 999)}-{many(4)}", f"{area}.{r(200, 999)}.{many(4)}", f"00{r(1, 99)} {area} {many(7)}", f"00{r(1, 99)}-{area}-{many(6)}", f"+{r(1, 99)}/{area}/{many(7)}", f"0{r(20, 99)} {many(4)} {many(4)}"]
    bad = [f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d} {r(0, 23):02d}", f"{r(1900, 1990)} - {r(1991, 2030)}", f"{r(1900, 1990)} {r(1991, 2030)} {r(1991, 2030)}", f"{r(0, 9)}.{many(r(6, 14))}", f"{r(10, 9999)}.{many(r(5, 9))}", many(r(7, 15)), f"{r(1, 28)}/{r(1, 12)}/{r(1990, 2030)}", f"{r(1990, 2030)}{r(10, 12)}{r(10, 28)}", " ".join(str(r(1, 99)) for _ in range(6)), f"{r(1, 999)} {many(3)} {many(3)}", f"{r(1, 99)}.{many(3)}.{many(3)}", f"978-{r(0, 9)}-{many(3)}-{many(5)}-{r(0, 9)}"]
    return good, bad


def _variants(kind: int, value: str, rng: random.Random) -> list[Variant]:
    """Other forms of a found value and values like it, and look-alikes that are no personal data."""
    good, bad = (_emails, _addresses, _cards, _phones)[kind](value, rng)
    made: list[Variant] = [(g, [(0, len(g))]) for g in good] + [(b, []) for b in bad]
    if kind == CARD:  # two in a row, which the plain rule takes for one number that is too long
        other = _checked(value[:1] + "".join(str(rng.randint(0, 9)) for _ in range(15)))
        made += [(f"{value}{sep}{other}", [(0, len(value)), (len(value) + len(sep), len(value) + len(sep) + 16)]) for sep in (" ", "-")]
    return made


def _overlap(a: Span, b: Span) -> bool:
    return a[0] < b[2] and b[0] < a[2]


def examples(text: str, seed: int) -> Iterator[tuple[int, int, list[float]]]:
    """Kind, label and features of candidates: spans of the plain rules are personal data, candidates
    that cut into them, or words around an "at" without any sign, are none. Variants of each span are
    set in its place."""
    base = base_spans(text)
    for c in candidates(text):
        if c in base:
            yield c[1], 1, features(text, c)
        elif any(_overlap(c, b) for b in base) or (c[1] == EMAIL and not re.search(r"[@＠(\[{]| dot ", text[c[0] : c[2]], re.I)):
            yield c[1], 0, features(text, c)
    for start, kind, stop in base:
        head, tail = text[max(0, start - 80) : start], text[stop : stop + 80]
        for value, good in _variants(kind, text[start:stop], random.Random(seed * 1_000_003 + start)):
            made, at = head + value + tail, len(head)
            for c in candidates(made):
                if _overlap(c, (at, kind, at + len(value))):
                    yield c[1], int(c[1] == kind and (c[0] - at, c[2] - at) in good), features(made, c)


@dataclass(frozen=True)
class Judge:
    """Trees, slope and intercept of their calibration, and a threshold for each kind."""

    trees: Boosted
    slope: float
    intercept: float
    thresholds: tuple[float, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.odds(x) + self.intercept)


def fit_judge(kinds: np.ndarray, labels: np.ndarray, x: np.ndarray, folds: np.ndarray, precision: float = PRECISION) -> Judge | None:
    """Trees over all rows, calibrated on predictions for folds that were left out; thresholds are the
    lowest at which so large a share of a kind's predictions is right."""
    if len(labels) < LEAST_ROWS or labels.min() == labels.max():
        return None
    odds = np.zeros(len(labels))
    for f in np.unique(folds):
        out = folds == f
        if out.all():
            odds = boosted(x, labels).odds(x)
        else:
            odds[out] = boosted(x[~out], labels[~out]).odds(x[out])
    slope, intercept = platt(odds, labels)
    p = sigmoid(slope * odds + intercept)
    at = tuple(max(LEAST_LIKELY, least_threshold(p[kinds == k], labels[kinds == k], precision)) for k in range(len(KINDS)))
    return Judge(boosted(x, labels), slope, intercept, at)


def train(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", ids: int = FIT_IDS, rows: int = FIT_ROWS, precision: float = PRECISION) -> Judge | None:
    """Fits a judge on the texts of at most ``ids`` ids, those with the smallest hashes, and on at most
    ``rows`` examples from them. Of texts that share an id one is used. None if the plain rules find
    too little there."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chosen = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(ids)
    sample = spread(texts).join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(name.encode())
                out += [(seed, k, kind, label, x) for k, (kind, label, x) in enumerate(examples(text, seed))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["seed", "k", "kind", "label", "x"])

    made = staged(sample.mapInArrow(run, "seed long, k long, kind long, label long, x array<double>"), "examples")
    found = made.orderBy(F.xxhash64("seed", "k"), "seed", "k").limit(rows).toPandas().sort_values(["seed", "k"])
    if not len(found):
        return None
    return fit_judge(found["kind"].to_numpy(), found["label"].to_numpy(), np.array(found["x"].tolist()), found["seed"].to_numpy() % FOLDS, precision)


def judged(text: str, judge: Judge | None) -> tuple[list[Span], list[Span]]:
    """The spans of the plain rules, and those that the judge adds. Of added ones that overlap the
    likeliest stays, of equal ones the longer, then the first; what touches a plain span is none."""
    base = base_spans(text)
    if judge is None:
        return base, []
    starts, stops = [], []
    for start, _, stop in base:
        if stops and start < stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)
    free = [c for c in candidates(text) if not (k := bisect.bisect_left(starts, c[2])) or stops[k - 1] <= c[0]]
    if not free:
        return base, []
    p = judge.probabilities(np.array([features(text, c) for c in free]))
    likely = sorted((-v, c[0] - c[2], *c) for v, c in zip(p.tolist(), free, strict=True) if v >= judge.thresholds[c[1]])
    added: list[Span] = []
    marks: set[int] = set()
    for _, _, start, kind, stop in likely:
        if not marks.intersection(range(start, stop)):
            marks.update(range(start, stop))
            added.append((start, kind, stop))
    return base, sorted(added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, judge: Judge | None, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``id``, the numbers of plain spans ``n_email``, ``n_ip``, ``n_card`` and
    ``n_phone``, the plain spans as ``base``, all spans as ``spans`` and the number of those that the judge
    added, ``n_added``. Spans are ``kind:start:stop`` in code points, joined by commas, by start and
    then by kind. Null and empty texts have none; repeated rows and rows without an id each have a
    row; other columns are left out. Without a judge there are only plain spans."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text"):
                base, added = judged(text.as_py() or "", shared.value)
                out.append((*(sum(k == j for _, k, _ in base) for j in range(len(KINDS))), written(base), written(sorted(base + added)), len(added)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"])

    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *counts, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]))


def redact(docs: DataFrame, judge: Judge | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; spans that overlap become
    one, named after the first. All rows and columns stay, whatever their names."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        base, added = judged(text or "", shared.value)
        out, done, last = [], 0, 0
        for start, kind, stop in sorted(base + added):
            if start >= last:
                out += [text[done:start], MASKS[kind]]
            last = done = max(last, stop)
        return "".join(out) + text[done:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([masked(t.as_py()) for t in columns[at]], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return spread(docs).mapInArrow(run, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
