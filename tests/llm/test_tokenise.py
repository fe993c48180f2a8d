import hashlib
import random

import pytest
import sentencepiece

from seqloom.llm.tokenise import Encoder, default_model, detokenised, op6_sentencepiece, tokenised


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def encoder():
    with open(default_model(), "rb") as f:
        return Encoder(f.read())


def same(encoder, library, text):
    ids = library.encode(text)
    n, got, decoded = encoder.round_trip(text)
    return (n, got, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_random_texts(encoder, library):
    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz    eettaaooiinn.,'\n\t\rABCDé中文日本😀▁\x00́ 1234567890--=="
    pieces = list(encoder.pieces.id)
    for _ in range(4000):
        kind = rnd.random()
        if kind < 0.4:
            text = "".join(rnd.choices(letters, k=rnd.randrange(60)))
        elif kind < 0.8:
            text = "".join(rnd.choices(pieces, k=rnd.randrange(1, 6))).replace("▁", rnd.choice(" ▁"))
        else:
            text = " " * rnd.randrange(40) + "".join(rnd.choices("the inaton s", k=30)) + " " * rnd.randrange(20)
        assert same(encoder, library, text), text


def test_long_segments(encoder, library):
    rnd = random.Random(8)
    for text in ("a" * 3000, "".join(rnd.choices("abcdefgh0123", k=20_000)), "中文" * 2000, "\U0001f600" * 500, " " * 700, "x" + " " * 300 + "y"):
        assert same(encoder, library, text)


def test_decoding_any_ids(encoder, library):
    rnd = random.Random(9)
    for _ in range(2000):
        ids = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), rnd.randrange(259, 32000), encoder.pieces.space]) for _ in range(rnd.randrange(8))]
        assert encoder.pieces.decode(ids) == library.decode(ids), ids


def test_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "Hello  world\n▁", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = detokenised(tokenised(docs, default_model()), default_model()).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == sorted((str(i), x, d) for i, x, d in want)
    assert tokenised(docs.limit(0), default_model()).count() == 0
