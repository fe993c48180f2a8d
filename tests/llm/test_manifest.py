import hashlib
import random

from pyspark.sql import functions as F

from seqloom.llm.manifest import BLOCK, folded, manifest, proof_digest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(all_levels, i):
    """What is left and right of node ``i`` on each level."""
    out = []
    for nodes in all_levels[:-1]:
        run, at = nodes[i - i % 16 : i - i % 16 + 16], i % 16
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 16
    return out


def brute(rows, fields):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r["doc_id"], r["source"], digest(*[field(r[f]) for f in fields])) for r in rows]
    groups = {}
    for i, s, h in sorted(leaves, key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        groups.setdefault(s, []).append((i, h))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([h for _, h in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for j, (i, h) in enumerate(groups[s]):
            path = siblings(trees[s], j) + siblings(top, k)
            yield (i, h, trees[s][-1][0], top[-1][0], digest(*[x + y for x, y in path]), tuple(path))


def check(spark, rows, fields=("doc_id", "text", "lang")):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, root string, rank int, digest string")
    got = manifest(docs, fields=list(fields))
    got = got.select("id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), "path", folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    key = lambda t: tuple((v is not None, v) for v in t)
    have = sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, tuple(map(tuple, r.path))) for r in got), key=key)
    dicts = [dict(zip(docs.columns, r, strict=True)) for r in rows]
    assert have == sorted(brute(dicts, fields), key=key)
    assert all(r.folded == r.root for r in got)


def test_against_brute_force(spark):
    rng = random.Random(3)
    # Groups of one, of a run, of a block and one more, and one that holds most rows.
    rows = [(i, f"s{i % 40}", "en", "x" * (i % 7), "clash", 1, None) for i in range(80)]
    rows += [(1000 + i, "run", None, "r", None, None, None) for i in range(16)]
    rows += [(2000 + i, "block", "", None, None, None, None) for i in range(BLOCK)]
    rows += [(3000 + i, "more", "é", "", None, None, None) for i in range(BLOCK + 1)]
    rows += [(5000 + i, None, "en", f"ÄB {i % 5}", None, None, None) for i in range(900)]
    rows += [(7, "s7", "en", "again", None, None, None)] * 3 + [(None, "none", None, None, None, None, None)] * 20 + [(9, "", "en", "😀\x00", None, None, None), (10, "Z", "en", "w " * 60_000, None, None, None)]
    rng.shuffle(rows)
    check(spark, rows)


def test_small(spark):
    check(spark, [(1, "a", "en", "lone", None, None, None)])
    check(spark, [(1, "a", "en", "x", None, None, None)] * 40)
    check(spark, [(2, None, None, None, None, None, None), (1, "", None, None, None, None, None)])
    docs = spark.createDataFrame([], "doc_id string, source int, text string")
    assert manifest(docs, fields=["text"]).count() == 0
    docs = spark.createDataFrame([("b", 1, "x"), ("a", 1, "y")], "`my id` string, kind int, text string")
    got = manifest(docs, fields=["my id", "text"], id_col="my id", group_col="kind").collect()
    assert {r.id for r in got} == {"a", "b"} and len({r.root for r in got}) == 1


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"Text {i}") for i in range(300)], "doc_id long, source string, text string")
    given = F.when(F.col("doc_id") == 17, F.sha2(F.lit("other"), 256))
    got = manifest(docs, fields=["text"], given=given)
    wrong = got.where(folded(F.col("given"), F.col("path")) != F.col("root")).collect()
    assert [r.id for r in wrong] == [17]
