"""Columns of the caller keep their names and values in every operator that carries them."""

from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import chunks, decontaminate, nearcopies, neardup, neighbours, quality, secrets, substrings, tokenise, toxicity, urls

#: Names that the operators use within, in a table of an id, a text and an owner.
NAMES = ["row", "key", "salt", "spans", "_text", "_live", "_items", "_spans", "_row_key", "_key", "_verdict", "_h", "_block", "_w0", "listed2", "id", "h", "tag", "value", "p", "c0", "label", "fp", "cell", "component", "digest", "live", "text_more", "found", "node"]


def docs(spark, texts=("password: q9Zk2LmN8vTr4XyB one two three", "one two three four five", None, "")):
    rows = spark.createDataFrame([(i, t, f"s{i}", "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")
    return rows.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in NAMES})


def kept(out, columns):
    """All columns asked for are there, in order and with their values."""
    assert [c for c in out.columns if c in columns] == columns
    for r in out.collect():
        for n in columns:
            if n in NAMES and r["doc_id"] is not None:
                assert r[n] == f"{n}-{r['doc_id']}"


def test_documents_with_any_names(spark):
    d = docs(spark)
    names = d.columns
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("i", "four five")], "item_id string, text string")
    kept(quality.good_documents(d, labels.limit(0), threshold=0.5), names)
    kept(secrets.mask_secrets(d, repo_cols=["lang"]), names)
    assert "[SECRET]" in {r.doc_id: r.text for r in secrets.mask_secrets(d).collect()}[0]
    found = decontaminate.find_overlap(d, bench)
    kept(found, names)
    assert {r.doc_id: r.n_hit for r in found.collect()}[1] == 2
    clean = decontaminate.decontaminated(d.withColumn("items", F.lit("mine")), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 2, 3] and {r["items"] for r in clean.collect()} == {"mine"}
    kept(tokenise.tokenised(d, tokenise.default_model()), names)
    kept(tokenise.digests(d, tokenise.default_model()), names)
    kept(tokenise.detokenised(tokenise.tokenised(d, tokenise.default_model()), tokenise.default_model()), names)
    kept(toxicity.score_toxicity(d, toxicity.train(d, labels, ["toxic"])), names)
    for out in (neardup.near_duplicates(d), chunks.chunk_dedup(d), substrings.without_repeats(d), secrets.find_secrets(d), quality.score_documents(d, labels), nearcopies.near_copies(d)):
        assert out.count() == 4
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, "/root/testdata/sf0.001")
        if k < 4:
            kept(out, names)
            assert out.columns == names
        else:
            assert out.count() == 4


def test_pages_and_vectors_with_any_names(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/x") for i in range(5)], "doc_id long, url string").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in NAMES})
    listed = spark.createDataFrame([("h3.net/x",)], "url string")
    for mb in (8, 0):
        out = urls.url_filter(pages, listed, broadcast_mb=mb)
        kept(out, pages.columns)
        assert [r.doc_id for r in out.where("listed").collect()] == [3]
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>").withColumns({n: F.lit(n) for n in ("id", "v", "cell", "score", "rank", "block")})
    assert neighbours.nearest(vectors, k=3).count() == 6


def test_ids_that_are_text(spark):
    d = docs(spark, ("a b c d e f " * 40, "a b c d e f " * 40, "x")).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    got = chunks.chunk_dedup(d).collect()
    assert len(got) == 3 and sum(r.n_removed > 0 for r in got) >= 1
    assert neardup.near_duplicates(d).count() == substrings.without_repeats(d).count() == 3
