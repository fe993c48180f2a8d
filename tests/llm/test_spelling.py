import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.llm.spelling import cells_of, group_variants, near_words, one_edit, prefix, vector, word_counts


def edits(a, b):
    """Edit distance by the book."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(words, ratio=5):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def sample(rng, letters, many):
    words = {"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(many)}
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :] + "ee"]))
    return {w: rng.choice([5, 6, 30, 31, 200, 1500]) for w in words if len(w) >= 6}


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = {**sample(rng, "etaoinsh", 120), **sample(rng, "abcÀéÿ×zq", 80)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = group_variants(df)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(words)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_cells(spark, most):
    """Few words a cell, down to leaves that are dealt out by halves; one group for all letters
    makes every word of a length an anagram of the others."""
    rng = random.Random(most)
    words = sample(rng, "abcde", 60)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = {(w, near, form) for w, _, _, _, near, _ in brute(words) for form in [min((x for x in words if edits(w, x) == 1), key=lambda x: (-words[x], x), default=None)] if near}
    for groups in (("e", "a"), ("abcde",)):
        got = near_words(df, groups=groups, cell_words=most, cells=10**9)
        assert {(r.word, r.near, r.form) for r in got.collect()} == want


def test_search_spends_surplus_before_deficit():
    assert vector("cheese", ("e", "s")) == (3, 1, 2)
    own, reached = cells_of((3, 1, 2), frozenset({prefix((3,)), prefix((4,))}))
    assert own == "3,1"
    assert set(reached) == {("3,1", 0), ("3,2", 1), ("4,1", 1), ("4,0", 2)}
    assert one_edit("abc", "abd") and one_edit("abc", "abbc") and one_edit("abc", "abcc") and one_edit("abc", "xabc")
    assert not one_edit("abc", "abc") and not one_edit("abc", "bca") and not one_edit("abc", "axbx")


def test_words_and_edges(spark):
    rows = [(1, "Colour COLOUR colour; colour-colour"), (2, "colours\x00colours écoles Écoles"), (None, "colour" * 3), (3, None), (4, ""), (4, ""), (5, "color " * 9 + "x" * 100_000), (6, "éé" * 3 + " naïveté×÷ÀÁ")] * 5
    docs = spark.createDataFrame([(i, t, 0, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    for slip in (None, 2, 199):
        want = Counter()
        for i, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if slip and h % slip == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += len(run) >= 6
        got = word_counts(docs, slip=slip)
        assert {(r.word, r.n) for r in got.collect()} == {(w, n) for w, n in want.items() if n >= 5}
    assert group_variants(got.limit(0)).count() == 0
    lone = group_variants(spark.createDataFrame([("lonely", 5)], "word string, n long")).collect()
    assert [tuple(r) for r in lone] == [("lonely", None, "lonely", 5, 0, None)]
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125)]
    got = group_variants(spark.createDataFrame(chain, "word string, n long")).where(F.col("root") == "aabbbb")
    assert got.count() == 5
