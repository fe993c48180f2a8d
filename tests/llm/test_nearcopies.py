import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_neardup import roots

import corpus_pipeline
from seqloom.llm import nearcopies, urls
from seqloom.llm.nearcopies import _connect, near_copies

SF = "/root/testdata/sf0.01"


def slow(text, size=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def pairs(texts):
    """All pairs of 0.8 or more."""
    sets, holders = {i: slow(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    near = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    return [(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_stage_keeps_one_of_all_that_are_similar(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, rng = {r.doc_id: r.text for r in docs.collect()}, np.random.default_rng(5)
    long = [t for t in texts.values() if len((t or "").split()) > 60][:300]
    for k, t in enumerate(long):  # copies with some words edited
        words = t.split()
        for at in rng.choice(len(words), max(1, len(words) * (k % 5 + 1) // 200), replace=False):
            words[at] = f"edit{k}x{at}"
        texts[100_000 + k] = " ".join(words)
    edges = pairs(texts)
    new = [(a, b) for a, b in edges if slow(texts[a]) != slow(texts[b])]
    assert len(new) > 150
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()}
    assert got == {i for i, r in roots(texts, edges).items() if i == r}


@pytest.mark.parametrize("block", [2000, 20])
def test_large_groups_are_cut_without_loss(spark, block):
    base = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(base[: 80 + i]) for i in range(100)}  # each is like its neighbours
    texts |= {200 + i: " ".join([*base[:80], *(f"o{i}x{k}" for k in range(60))]) for i in range(50)}  # a common passage
    want = roots(texts, pairs(texts))
    found = near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect()
    least = {}
    for r in found:
        least[r.component] = min(r.id, least.get(r.component, r.id))
    assert {r.id: least[r.component] for r in found} == want
    assert len(set(want.values())) > 50


def test_connect():
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 2, 4, 100, 6)]
    assert roots(range(5), _connect(sets, 0.8)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}
    assert _connect([np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64)], 0.8) == [(0, 1)]
    assert _connect([np.arange(10, dtype=np.uint64), np.arange(7, dtype=np.uint64)], 0.8) == []


def test_rows_that_share_an_id_only_are_not_merged(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black pink grey")
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, two, "en", "s", 1), (2, one, "en", "s", 1), (2, three, "en", "s", 1), (3, three, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted([(1, one), (1, two), (2, three)])


@pytest.mark.parametrize("block", [8, 30])
def test_crowded_buckets(spark, block):
    """Families of edited copies in buckets of more than ``block``: the components of all similar pairs,
    chains that leave a leader's neighbourhood among them."""
    rng = random.Random(block)
    texts, word = [], lambda: "".join(rng.choices("abcdefg", k=6))
    for family in range(4):
        base = [word() for _ in range(60)]
        for i in range([90, 40, 25, 3][family]):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            if family == 1:  # drifts away, step by step
                base[rng.randrange(len(base))] = word()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), edges)
    got = {r.id: r.component for r in near_copies(docs, block=block).collect()}
    same = lambda of: {frozenset(k for k in of if of[k] == c) for c in set(of.values())}
    assert same(got) == same(want)


def test_near_copies_of_one_text_grow_in_proportion(spark, monkeypatch):
    """Work in a crowded bucket follows its documents, not their pairs."""
    rng, base, made = random.Random(2), [f"w{i}" for i in range(40)], {}
    plain = nearcopies.staged

    def spied(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(nearcopies, "staged", spied)
    for n in (300, 1200):
        texts = [" ".join(base[:i] + [f"x{k}"] + base[i + 1 :]) for k in range(n) for i in [rng.randrange(2)]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert len({r.component for r in near_copies(docs, block=100).collect()}) == 1
        made[n] = made["around"] + made["left"] + made["groups"]
    assert made[1200] < 6 * made[300]


def differ(shared, a, b):
    """How often a SimHash bit of two sets differs that share some shingles and have ``a`` and ``b`` more."""
    walk = lambda k: {2 * i - k: math.comb(k, i) / 2**k for i in range(k + 1)}
    one = lambda s, k: sum(p for x, p in walk(k).items() if s + x > 0)
    return sum(p * (one(s, a) * (1 - one(s, b)) + one(s, b) * (1 - one(s, a))) for s, p in walk(shared).items())


def test_segments_and_radius_find_similar_sets():
    """Candidates come from SimHash by multi-index hashing; by the exact odds of a bit, sets of any size that
    are similar share a segment and lie within the radius."""
    for n in (1000, 10**8):
        width, segments, small, radius = nearcopies.plan(n, 0.8)
        assert n / 2**width <= nearcopies.CHANCE
        for shared in range(4, 50):
            for a in range(13):
                for b in range(a + 1):
                    if a and shared >= 0.8 * (shared + a + b) - 1e-9:
                        p = differ(shared, a, b)
                        assert (1 - (1 - p) ** width) ** (small if shared + a <= 5 else segments) <= nearcopies.MISS
                        assert sum(math.comb(192, d) * p**d * (1 - p) ** (192 - d) for d in range(radius + 1)) >= 1 - nearcopies.MISS


def test_fingerprint_bits_are_majorities():
    codes = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    mixed = []
    for c in codes.tolist():
        whole = 0
        for k in range(3):
            x = (c + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            whole |= (x ^ x >> 31) << 64 * k
        mixed.append(whole)
    want = sum(1 << b for b in range(192) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))
    assert int.from_bytes(nearcopies.simhash(codes, 192), "little") == want
    assert nearcopies.fingerprint(codes[:0], 10, 0.8) is None
    assert len(nearcopies.fingerprint(codes[:4], 10, 0.8)) > len(nearcopies.fingerprint(codes, 10, 0.8)) == len(nearcopies.fingerprint(codes[:3], 10, 0.8))


def test_crowded_segments_are_dealt_out(spark):
    """Values of a segment that more rows hold than ``crowd`` lose no link."""
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join([*base[i:], *(f"o{i}x{k}" for k in range(i))]) for i in range(40)}
    want = roots(texts, pairs(texts))
    found = near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), crowd=6).collect()
    least = {}
    for r in found:
        least[r.component] = min(r.id, least.get(r.component, r.id))
    assert {r.id: least[r.component] for r in found} == want


def test_stars_connect_what_their_edges_do():
    rng = np.random.default_rng(3)
    for n, m in ((40, 25), (60, 60), (9, 200)):
        edges = sorted({(int(max(p)), int(min(p))) for p in rng.integers(0, n, (m, 2)) if p[0] != p[1]})
        edges += edges[: m // 4]  # of two stagings, so some are repeated
        v, u = np.array(sorted(edges)).T
        batches = [pa.RecordBatch.from_arrays([pa.array(u[a : a + 7]), pa.array(v[a : a + 7])], ["u", "v"]) for a in range(0, len(v), 7)]
        got = [(r["u"], r["v"]) for b in nearcopies._stars(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert roots(range(n), got) == roots(range(n), edges)
        assert all(a < b for a, b in got)
    hubs = pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(30), 500)), pa.array(np.repeat(np.arange(30, 530), 30))], ["u", "v"])
    assert sum(b.num_rows for b in nearcopies._stars(iter([hubs]))) == 529  # of 15,000
    assert not list(nearcopies._stars(iter([hubs.slice(0, 0)])))


def test_candidates_of_near_copies_come_to_few_edges(spark, monkeypatch):
    """Near copies share dozens of segments, each of which gives an edge; components get a few a document."""
    rng, made = random.Random(4), {}
    plain = nearcopies.components

    def spied(edges):
        made.setdefault(n, edges.count())  # of the candidates, then of the links
        return plain(edges)

    monkeypatch.setattr(nearcopies, "components", spied)
    for n in (500, 2000):
        base = [f"w{i}" for i in range(100)]
        texts = [" ".join(base[:i] + [f"x{k}"] + base[i + 1 :]) for k in range(n) for i in [rng.randrange(100)]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert len({r.component for r in near_copies(docs).collect()}) == 1
    assert made[500] < 8 * 500 and made[2000] < 8 * 2000


def test_passes_give_each_segment_once():
    rng, n = np.random.default_rng(6), 1000
    fps = [nearcopies.fingerprint(rng.integers(0, 2**63, k, dtype=np.uint64), n, 0.8) for k in (4, 40, 0, 5, 90)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(fps, pa.binary())], ["node", "fp"])
    width, segments, small, _ = nearcopies.plan(n, 0.8)
    parts = [[r for b in nearcopies._segments(n, 0.8, turn)(iter([rows])) for r in b.to_pylist()] for turn in range(nearcopies.PASSES)]
    assert max(map(len, parts)) < 1.2 * min(map(len, parts))
    got = sorted((r["node"], r["bucket"] >> 32, r["bucket"] % 2**32) for p in parts for r in p)
    bits = [f and int.from_bytes(f, "little") for f in fps]
    assert got == [(i, k, bits[i] >> k * width & 2**width - 1) for i, f in enumerate(fps) if f for k in range((segments, small)[i in (0, 3)])]


@pytest.mark.parametrize("room", [8_000_000, 64])
def test_sifted_loses_no_match(spark, monkeypatch, room):
    """A filter that is too small for its keys lets more rows pass and stops none that is listed."""
    monkeypatch.setattr(urls, "SIFT_BYTES", room)
    rows = spark.range(20_000).selectExpr("id", "id % 7 AS k", "'y' AS other")
    out = urls.sifted(rows, rows.where("id % 40 = 3").select("id", "k"), ["id", "k"])
    assert out.columns == [*rows.columns, "_passes"] and out.count() == 20_000
    passed = {r.id for r in out.where("_passes").collect()}
    assert passed >= set(range(3, 20_000, 40)) and len(passed) < 600 or room == 64
    assert not urls.sifted(rows, rows.limit(0), ["id", "k"]).where("_passes").count()


def test_disk_at_once(spark, tmp_path):
    """Shuffle files go with the step that wrote them, and texts without near copies are in none."""
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    used = lambda: sum(p.stat().st_size for p in local.rglob("shuffle_*.data") if p.exists())
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(300)) for _ in range(1500)]
    texts += [t + " end" for t in texts[:30]] + texts[30:60]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows.write.parquet(str(tmp_path / "docs"))
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before = used()
    out = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    for _ in range(20):
        if used() - before < 100_000:
            break
        time.sleep(0.5)
    assert used() - before < 100_000
    assert {r.doc_id for r in out.select("doc_id", "text").collect()} == set(range(1500))
    assert used() - before < 1_000_000  # of 3.7 MB of texts
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_radius_of_whole_fingerprints_keeps_similar_sets():
    for n in (1000, 10**8):
        longs, radius = nearcopies.whole(n, 0.8)
        bits = 64 * longs
        assert 1000 < bits <= min(len(nearcopies.fingerprint(np.arange(k, dtype=np.uint64), n, 0.8)) for k in (2, 4, 50)) * 8
        ways = [math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in range(radius + 1)]
        for shared in range(4, 50):
            for a in range(13):
                for b in range(a + 1):
                    if a and shared >= 0.8 * (shared + a + b) - 1e-9:
                        p = differ(shared, a, b)
                        assert sum(math.exp(w + d * math.log(p) + (bits - d) * math.log1p(-p)) for d, w in enumerate(ways)) >= 1 - nearcopies.MISS


def test_common_lines_do_not_make_pairs_of_blocks(spark, monkeypatch):
    """Short texts that share a line are candidates by few bits, so that they make one large group; hardly any
    are similar, and what is compared follows their number, not their pairs."""
    rng, made, plain = random.Random(7), {}, nearcopies.staged

    def spied(df, name):
        out = plain(df, name)
        made[name] = max(out.count(), made.get(name, 0))
        return out

    monkeypatch.setattr(nearcopies, "staged", spied)
    line = " ".join(f"line{i}" for i in range(24))
    texts = {i: f"{line}\n" + " ".join(f"{rng.randrange(10**9):x}" for _ in range(14)) for i in range(900)}
    texts |= {1000 + i: texts[i].rsplit(" ", 1)[0] for i in range(0, 900, 9)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least, found = {}, near_copies(docs, block=60).collect()
    for r in found:
        least[r.component] = min(r.id, least.get(r.component, r.id))
    assert {r.id: least[r.component] for r in found} == {i: i - 1000 if i >= 1000 else i for i in texts}
    assert made["groups"] + made.get("left", 0) < 1000  # over 20,000 as pairs of blocks
    assert made["crowded"] > 900  # one group, by few bits


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_groups_that_stay_large_lose_no_link(spark, monkeypatch, rounds):
    """A chain that no leader settles is compared by buckets after the last round."""
    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    base = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(base[i : 80 + i]) for i in range(120)}  # each is like its neighbours
    texts |= {200 + i: " ".join([*base[:70], *(f"o{i}x{k}" for k in range(20))]) for i in range(60)}  # near, and not similar
    want = roots(texts, pairs(texts))
    found = near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=12).collect()
    least = {}
    for r in found:
        least[r.component] = min(r.id, least.get(r.component, r.id))
    assert {r.id: least[r.component] for r in found} == want
