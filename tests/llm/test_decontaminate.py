import hashlib
import re

from seqloom.llm.decontaminate import decontaminated, find_overlap, op9_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[k]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_decontaminate(spark, sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(slow(docs, items))
    assert sum(w[-1] for w in want) > 5
    assert sorted(tuple(r)[:6] for r in got.collect()) == want


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short Item"), (3, None), (None, "red fish"), (10, "über"), (4, "!!"), (1, "one two three four five six seven eight nine ten eleven"), (5, "a a a a a a a a a a a a")]
DOCS = [
    (1, "x ONE two three four five six seven eight nine ten eleven twelve short", "k"),
    (2, "item short item, short. item", "k"),
    (3, None, "k"),
    (4, "", "k"),
    (5, "two three four five six seven eight nine ten", "k"),
    (5, "two three four five six seven eight nine ten", "k"),
    (None, "red fish Über über Straße", "k"),
    (6, "b " * 30_000 + "a " * 25, "k"),
    (7, "one two three four five", "k"),
    (8, "six seven eight nine ten eleven", "k"),
]


def test_edges(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted((str(x[0]), *x[1:4], x[5]) for x in slow([d[:2] for d in DOCS], {b for b in BENCH if b[0] is not None}))
    for block, shard in ((10**6, 10**7), (12, 50)):
        rows = find_overlap(docs.coalesce(1), bench, block_words=block, shard_bytes=shard).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == want
        by = {r.doc_id: r for r in rows}
        assert by[1].longest_match == 11 and by[1].hit_spans == [1, 12] and by[6].longest_match == 12
    assert sorted(str(r.doc_id) for r in decontaminated(docs, bench).collect()) == ["3", "4", "5", "5", "7", "8"]
    assert find_overlap(docs.limit(0), bench).count() == 0
    assert find_overlap(docs, bench.limit(0)).where("contaminated").count() == 0


def test_many_blocks_of_items(spark):
    """A block holds the items dealt to it alone; many blocks find what one finds."""
    import pickle

    from seqloom.llm.decontaminate import _blocks

    items = [(i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(14))) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 13 + k) % 400}" for k in range(60)), "k") for i in range(40)] + [(99, None, "k"), (100, "", "k")], "doc_id long, text string, key string")
    blocks = [pickle.loads(r["data"]) for r in _blocks(bench, "item_id", "text", 10, 200).collect()]
    assert len(blocks) > 5 and sum(len(b.items) for b in blocks) == 200 and max(len(b.items) for b in blocks) < 80
    one, many = (sorted(map(repr, find_overlap(docs, bench, block_words=n).collect())) for n in (10**6, 200))
    assert one == many and sum(r.contaminated for r in find_overlap(docs, bench, block_words=200).collect()) > 5
