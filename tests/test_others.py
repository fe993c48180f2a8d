import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import texts as tx
from seqloom.operators import grids, ledgers, signals
from seqloom.sources import files
from seqloom.streaming import stateful as st


def test_catalog(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt", "d/e.webp", "d-2/f.avif", "z.jfif", "1/2/3/4/5/6/7/deep.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[1] for r in files.media_catalog(spark, [str(tmp_path)], folders=True).collect()]
    assert got == ["a.jpg", "b.PNG", "z.jfif", "e.webp", "f.avif"]
    roots = [str(tmp_path / "d"), str(tmp_path / "c.txt"), str(tmp_path)]  # roots in their order, a named file as it is
    got = [r.path.rsplit("/", 1)[1] for r in files.media_catalog(spark, roots, folders=True).collect()]
    assert got == ["e.webp", "c.txt", "a.jpg", "b.PNG", "z.jfif", "f.avif"]
    assert len(files.media_catalog(spark, [str(tmp_path)], max_files=1, folders=True).collect()) == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.media_catalog(spark, roots).collect()] == ["c.txt"]  # folders only if asked for


def test_verdict_file(spark, tmp_path):
    rows = spark.createDataFrame([("b|x", False, 2, 100, "n"), ("a", True, 0, 50, "")], "key string, ok boolean, failures int, at long, note string")
    files.write_verdict_tsv(rows, str(tmp_path / "v"), "s1")
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    assert text.splitlines()[1] == "# sig=s1" and text.splitlines()[2].startswith("a\t")
    assert sorted(map(tuple, files.read_verdict_tsv(spark, str(tmp_path / "v")).collect())) == [("a", True, 0, 50, ""), ("b|x", False, 2, 100, "n")]
    bad = spark.createDataFrame([("k\tmaybe\t1\t2",), ("k\ttrue\t-1\t2",), ("k\ttrue\t1",), ("\ttrue\t1\t5",), ("k\ttrue\t4\t5",)], "value string")
    assert [tuple(r) for r in files.parse_verdicts(bad).collect()] == [("k", True, 0, 5, "")]
    odd = spark.createDataFrame([("k\t1\t1\t2",), ("  # c\ttrue\t1\t2",), (" K\tTRUE\t1\t2\t a ",)], "value string")
    assert [tuple(r) for r in files.parse_verdicts(odd).collect()] == [("K", True, 0, 2, "a")]
    rows = spark.createDataFrame([("a", True, 3, 9, "two\nlines\tand more"), (" ", False, 1, 1, ""), ("b", False, 2, 8, None)], rows.schema)
    files.write_verdict_tsv(rows, str(tmp_path / "w"), "card 1")
    text = "".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*")))
    assert text.splitlines()[2:] == ["a\tTrue\t0\t9\ttwo lines and more", "b\tFalse\t2\t8\t"]
    assert files.read_verdict_tsv(spark, str(tmp_path / "w"), "CARD 1").count() == 2 and files.read_verdict_tsv(spark, str(tmp_path / "w"), "card 2").count() == 0
    (tmp_path / "x.tsv").write_text("a\ttrue\t0\t5\nA\tfalse\t2\t7\n")
    assert [tuple(r) for r in files.read_verdict_tsv(spark, str(tmp_path / "x.tsv"), "any").collect()] == [("A", False, 2, 7, "")]


def test_price_books(spark):
    good = '{"modelKey": "m", "engineScale": 2, "secondsPerFrame": 0.5, "samplePixels": 10, "sampleFrames": 6, "machineKey": " K ", "backend": "ONNX-DML"}'
    broken = good.replace("0.5", '"fast"')
    texts = ['{"prices": [%s]}' % good, '{"schema": 1, "prices": [%s, %s]}' % (good, good.replace('"m"', '" "')), '{"schema": 1, "prices": [%s, %s]}' % (good, broken), '{"schema": 2, "prices": [%s]}' % good, '{"entries": [%s]}' % good, "[", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    for i, n in enumerate([1, 1, 0, 0, 0, 0, 0]):
        rows = files.read_price_json(df.where(f"i = {i}"), "json", ledgers.BACKENDS).collect()
        assert len(rows) == n and all((r.model, r.scale, r.machineKey, r.backend) == ("m", 2, "K", "onnx-dml") for r in rows)
    back = files.to_price_json(files.read_price_json(df.where("i = 0"), "json", ledgers.BACKENDS).withColumn("part", F.lit(1)), ["part"])
    assert '"modelKey":"m"' in back.first().json and files.read_price_json(back, "json", ledgers.BACKENDS).count() == 1


def test_measures_are_resolved(spark):
    """Newest of the machine and backend asked for, else what else there is."""
    book = [("m", 2, "A", "onnx-dml", "2026-01-01", 1, 1.0), ("m", 2, "A", "onnx-dml", "2026-03-01", 2, 2.0), ("m", 2, "A", "ncnn-vulkan", "2026-02-01", 3, 3.0), ("m", 2, "B", "onnx-cpu", "2026-04-01", 4, 4.0), ("m", 2, "C", "odd", "2026-01-05", 5, 5.0), ("x", 1, "D", "odd", "2026-01-05", 6, 6.0)]
    asks = [("m", 2, "A", "onnx-dml"), ("m", 2, "A", None), ("m", 2, None, "ncnn-vulkan"), ("m", 2, " ", None), ("m", 2, "Z", "onnx-dml"), ("m", 2, "B", "onnx-dml"), ("m", 2, "A", "other"), ("m", 2, "A", ""), ("n", 2, "A", None), ("m", 2, "A ", " ONNX-CPU"), ("x", 1, "D", "onnx-cpu"), ("m", 2, None, "odd")]
    want = [(2.0, "B", None), (2.0, "B", None), (3.0, None, None), (4.0, None, None), (None, "B", None), (None, "A", "onnx-cpu"), (None, None, None), (None, None, None), (None, None, None), (None, "B", "onnx-dml"), (None, None, None), (None, None, None)]
    b = spark.createDataFrame(book, "model string, scale int, machine string, backend string, measured_at string, seq int, cost double")
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(asks)], "ask_id int, model string, scale int, machine string, backend string")
    out = ledgers.resolve_measure(a, b, "cost")
    assert [tuple(r)[1:] for r in out.orderBy("ask_id").collect()] == want


def test_unique_names_with_taken(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(["a.txt", "a.txt", "b", "a (2).txt"])], "dir string, i int, name string")
    taken = spark.createDataFrame([("d", "b"), ("d", "b (2)")], "dir string, name string")
    got = {r.i: r.unique_name for r in files.unique_names(df, "dir", "name", "i", taken).collect()}
    assert len(set(got.values())) == 4 and got[0] == "a.txt" and got[2] == "b (3)" and not set(got.values()) & {"b", "b (2)"}


def test_many_names_meet_many_numbers(spark):
    """The free numbers in order, by a loop."""
    rng = np.random.default_rng(7)
    blocked = sorted({int(x) for x in rng.integers(1, 90, 40)})
    df = spark.createDataFrame([("d", i, "x.png") for i in range(60)] + [("e", 99, "x.png"), (None, 1, "x.png")], "dir string, i int, name string").repartition(4)
    taken = spark.createDataFrame([("d", "x.png" if n == 1 else f"x ({n}).png") for n in blocked] * 2, "dir string, name string")
    free = [n for n in range(1, 200) if n not in blocked][:60]
    got = {(r.dir, r.i): r.unique_name for r in files.unique_names(df, "dir", "name", "i", taken).collect()}
    assert [got["d", i] for i in range(60)] == ["x.png" if n == 1 else f"x ({n}).png" for n in free]
    assert got["e", 99] == "x.png" and got[None, 1] == "x.png"


def test_missing_outputs(spark):
    inputs = spark.createDataFrame([("x/A.png",), ("b.jpg",), ("c.png",), (".png",), ("g.png",)], "path string")
    outputs = spark.createDataFrame([("out/a.webp",), ("OUT/B.JPG",), ("c.txt",), ("g.gif",)], "path string")
    assert sorted(r.path for r in ledgers.missing_outputs(inputs, outputs).collect()) == ["c.png", "g.png"]


def test_eta_blends_rates(spark):
    # 40 of 100 done in 40 s, 10 of them in the last 5: rates of 2 and 1, weighed 0.8 * 40 / 60
    rows = [("j", 20, 100, 25.0), ("j", 30, 100, 35.0), ("j", 40, 100, 40.0), ("j", 100, 100, 70.0)]
    df = spark.createDataFrame(rows, "job string, done long, total long, elapsed double")
    got = [r.eta for r in ledgers.eta_blended(df, ["job"], "done", "total", "elapsed", 1, 3.0).orderBy("done").collect()]
    weight = 0.8 * 40 / 60
    assert abs(got[2] - (60 / (weight * 2 + (1 - weight)) + 3)) < 1e-9 and got[3] == -1
    early = spark.createDataFrame([("j", 4, 10, 0.2), ("j", 5, 10, 2.0), ("k", 3, 10, 9.0)], df.schema)
    got = {(r.job, r.done): r.eta for r in ledgers.eta_blended(early, ["job"], "done", "total", "elapsed", 1).collect()}
    assert got == {("j", 4): -1, ("j", 5): 2.0, ("k", 3): -1}  # a sample of a fifth of a second does not count


def test_eta_shown(spark):
    rows = [("j", 1, -1.0, 5.0), ("j", 2, 50.0, 5.0), ("j", 3, 80.0, 5.0), ("j", 4, -1.0, 5.0), ("j", 5, 20.0, 30.0), ("j", 6, 25.0, 0.0)]
    df = spark.createDataFrame(rows, "job string, done long, eta double, floor double")
    assert [r.shown for r in ledgers.eta_shown(df, ["job"], "done", "eta", "floor").orderBy("done").collect()] == [None, 50.0, 50.0, 50.0, 30.0, 25.0]
    df = spark.createDataFrame([("j", 1, 0.0, 0.0), ("j", 2, 4.0, 0.0), ("j", 3, 9.0, 0.0), ("j", 4, 1.0, -2.0)], df.schema)
    assert [r.shown for r in ledgers.eta_shown(df, ["job"], "done", "eta", "floor").orderBy("done").collect()] == [0.0, 4.0, 4.0, 1.0]  # 0 binds nothing


def fuzzy(spark, names, others=()):
    df = lambda xs: spark.createDataFrame(list(enumerate(xs)), "id int, name string")
    return [r.name for r in ledgers.missing_fuzzy(df(names), [df(others)], "name", "id").orderBy("id").collect()]


def test_fuzzy_names(spark):
    chain = ["Alpha model", "alpha MODEL and Gamma model", "Gamma model"]
    assert fuzzy(spark, chain) == ["Alpha model", "Gamma model"]  # the middle one is dropped and drops none
    assert fuzzy(spark, chain[1:] + chain[:1]) == chain[1:2]
    assert fuzzy(spark, ["NV", "NV", " ", None, "nv"], ["NV"]) == ["NV", "NV", "nv"]  # short names say nothing
    assert fuzzy(spark, [" Radeon 610M ", "AMD Radeon 610M", "GeForce 4060", "GeForce 4060"], ["GEFORCE 4060 Laptop"]) == ["Radeon 610M"]
    words = ["".join(x) for x in zip("abcdefgh" * 3, "hgfedcba" * 3)] * 8
    names = [" ".join(words[i : i + 1 + (i * 7) % 5]) for i in range(60)]
    kept = []
    for n in names:
        if len(n) < 8 or not any(n in k or k in n for k in kept if len(k) >= 8):
            kept.append(n)
    assert fuzzy(spark, names) == kept


def test_measure_without_pixels(spark):
    row = spark.range(1).select(*ledgers.two_point_cost(F.lit(2.0), F.lit(8.0), F.lit(4), F.lit(0))).first()
    assert tuple(row) == (2.0, 0.0, 2.0)


def test_verdicts_live_apart(spark):
    rows = [("ok", 0, True, 0), ("bad", 0, False, 0), ("cpu", 0, False, -1), ("deny", 0, True, 0)]
    df = spark.createDataFrame(rows, "key string, at long, ok boolean, device int")
    at = lambda now: {r.key: (r.ok, r.failures, r.denied) for r in ledgers.verdict_state(df, ["key"], ["at"], F.lit(now), 100, 3, F.col("key") == "deny", 10, "device").collect()}
    assert at(10) == {"ok": (True, 0, False), "bad": (False, 1, False), "deny": (False, 3, True)}
    assert at(11).keys() == {"bad", "deny"} and at(101) == {} and at(-1) == {}


def test_feather_of_one_blurs(spark):
    cells = spark.createDataFrame([(0, 0, x, float(x == 2)) for x in range(5)], "grid_id int, y int, x int, v double")
    out = lambda **k: [round(r.v, 6) for r in grids.alpha_stretch(cells, ["grid_id"], 0.0, 0.0, **k).orderBy("x").collect()]
    assert out() == [0, 0, 1, 0, 0] and out(feather=1) == [0, 0.333333, 0.333333, 0.333333, 0] == out(feather=3) and out(morph=1) == [0] * 5


def test_urls_and_fingerprints(spark):
    urls = ["https://A.example.com/o/r/b/ad/img.jpg?x=1#y", "https://a.example.com", "  Example.com/a ", None, " ", "http://h/a//b/c/d.txt?x=1", "http://h/a/b/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    u = F.col("u")
    got = [tuple(r) for r in df.orderBy("i").select(tx.url_host(u), tx.url_tail(u), tx.url_file(u, "ad.jpg")).collect()]
    assert got == [("a.example.com", "ad/img.jpg", "img.jpg"), ("a.example.com", "", "ad.jpg"), ("example.com/a", "", "ad.jpg"), ("", "", "ad.jpg"), ("", "", "ad.jpg"), ("h", "d.txt", "d.txt"), ("h", "", "ad.jpg")]
    lines = lambda *xs: tx.content_fingerprint(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i int, t string"), ["k"], "t", ["i"]).first().fingerprint
    assert len({lines("a", "b"), lines("b", "a"), lines("a", "b", ""), lines("ab"), lines("a")}) == 5 and lines("a", None) == lines("a", "")


def coalesced(spark, rows):
    df = spark.createDataFrame([(0, at, i, target, pos) for i, (at, target, pos) in enumerate(rows)], "key int, at_ms long, seq long, target double, pos double")
    start, _, out = st.COALESCE
    return [(r.at_ms, r.ran) for r in st.batch_fold(df, ["key"], ["at_ms", "seq"], start, st.coalesce_step(), out).orderBy("at_ms").collect()]


def test_requests_at_the_limits(spark):
    assert coalesced(spark, [(0, 1.0, None), (900, 2.0, None), (901, None, None)]) == [(0, 1.0), (901, 2.0)]  # still under way at 900
    assert coalesced(spark, [(0, 1.0, None), (200, 2.0, 9.0)]) == [(0, 1.0)]  # where it began is not known
    assert coalesced(spark, [(0, 1.0, 9.0), (200, 2.0, 9.5)]) == [(0, 1.0), (200, 2.0)]
    assert coalesced(spark, [(0, 1.0, None), (200, 2.0, 1.375), (300, None, 1.25)]) == [(0, 1.0), (300, 2.0)]
    assert coalesced(spark, [(0, -3.0, None), (50, 2.0, 0.0), (109, None, 0.0), (110, None, 0.0)]) == [(0, 0.0), (110, 2.0)]


def test_a_timer_fires(spark, tmp_path):
    """A key that is silent for longer than its time to live starts anew, across micro-batches."""
    day = 86_400
    rows = [("a", 100 * day, 1), ("a", 101 * day, 2), ("b", 130 * day, 3), ("b", 160 * day, 4), ("a", 161 * day, 5)]
    df = spark.createDataFrame(rows, "key string, at long, seq long").withColumns({"ok": F.lit(False), "time": F.col("at").cast("timestamp")})
    for _, _, k in rows:
        df.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start, state, out = st.VERDICT
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("time", "1 day")
    folded = st.keyed_fold(stream, ["key"], ["at", "seq"], start, st.verdict_step(7 * day, 2), state, out, keep_ms=7 * day * 1000, time="time")
    query = folded.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    removed = sum(s["numRowsRemoved"] for p in query.recentProgress for s in p["stateOperators"])
    got = {r.seq: r.failures for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1} and removed >= 1


def test_verdict_ages(spark):
    rows = [("a", 0, False), ("a", 10, False), ("b", 0, False), ("b", 500, False), ("c", 0, True), ("d", 2000, False)]
    df = spark.createDataFrame(rows, "key string, at long, ok boolean")
    got = {r.key: r.failures for r in ledgers.verdict_state(df, ["key"], ["at"], F.lit(550), 100, 2).collect()}
    assert got == {"b": 1}
    got = {r.key: (r.failures, r.denied) for r in ledgers.verdict_state(df, ["key"], ["at"], F.lit(60), 100, 2).collect()}
    assert got["a"] == (2, True) and got["c"] == (0, False) and "d" not in got


def test_the_last_chunk_covers_the_end(spark):
    """A hundred samples in chunks of a hundred: a second chunk, or the end would weigh nothing."""
    df = spark.createDataFrame([("t", i, 1.0) for i in range(100)], "track string, i long, v double")
    chunks = signals.chunk_overlap(df, ["track"], 100, 25)
    assert {r.c for r in chunks.select("c").distinct().collect()} == {0, 1}
    back = {r.i: r.v for r in signals.overlap_add(chunks, ["track"]).collect()}
    assert back[99] == 1.0 and len(back) == 100


def test_resample_tone(spark):
    n, rate = 4000, 16000
    tone = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(tone)], "track_id string, i long, v double")
    got = np.array([r.v for r in signals.resample(df, ["track_id"], 3, 1, half=64, chunk=1000).orderBy("i").collect()])
    want = np.sin(2 * np.pi * 1000 * np.arange(len(got)) / 48000)
    mid = slice(600, -600)
    assert len(got) == 12000 and 10 * np.log10((want[mid] ** 2).mean() / ((got - want)[mid] ** 2).mean()) > 55
    assert signals.resample(df, ["track_id"], 2, 2) is df


def test_identities(spark):
    df = spark.createDataFrame([("t", i, float(np.sin(i))) for i in range(500)], "track_id string, i long, v double")
    chunks = signals.chunk_overlap(df, ["track_id"], 100, 25)
    back = {r.i: r.v for r in signals.overlap_add(chunks, ["track_id"]).collect()}
    assert all(abs(back[i] - np.sin(i)) < 1e-9 for i in range(1, 499))
    taps = signals.lowpass_taps(0.3, 0.1, 500)
    assert abs(taps.sum() - 1) < 1e-12 and len(taps) % 2
    merged = {r.i: r.v for r in signals.spectral_merge(df, df, ["track_id"], taps, chunk=64).collect()}
    assert all(abs(merged[i] - np.sin(i)) < 1e-9 for i in range(500))
    lengths = spark.createDataFrame([("t", 500)], "track_id string, n long")
    whole = {r.i: r.v for r in signals.istft(signals.stft(df, ["track_id"], 16, 4), ["track_id"], 16, 4, lengths).collect()}
    assert all(abs(whole[i] - np.sin(i)) < 1e-6 for i in range(16, 480))


def test_orient_and_tiles(spark):
    cells = spark.createDataFrame([(c, y, x, float(y * 3 + x), c, 3, 2) for c in range(1, 9) for y in range(2) for x in range(3)], "grid_id int, y int, x int, v double, code int, w int, h int")
    out = {}
    for r in grids.orient(cells, "code", "w", "h").collect():
        out.setdefault(r.code, np.full((r.h, r.w), -1.0))[r.y, r.x] = r.v
    a = np.arange(6.0).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}
    assert all((out[c] == want[c]).all() for c in want)
    flat = cells.where("code = 1").select("grid_id", "y", "x", "v")
    back = {(r.y, r.x): r.v for r in grids.tile_stitch(grids.tile_split(flat, 3, 2, 2, 0, least_stride=1), ["grid_id"], 0).collect()}
    assert back == {(y, x): float(y * 3 + x) for y in range(2) for x in range(3)}


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, at = [], 0
    for i in range(300):
        at += int(rng.integers(1, 120))
        rows.append((i % 3, at, i, float(rng.random()) if rng.random() < 0.7 else None, float(rng.random())))
    df = spark.createDataFrame(rows, "key long, at_ms long, seq long, target double, pos double")
    for k in range(3):  # micro-batches in order
        df.where(f"seq >= {k * 100} AND seq < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start, state, out = st.COALESCE
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.drained(st.keyed_fold(stream, ["key"], ["at_ms", "seq"], start, st.coalesce_step(), state, out))
    want = st.batch_fold(df, ["key"], ["at_ms", "seq"], start, st.coalesce_step(), out)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and rows
    gaps = {}
    for key, ms, _ in rows:
        assert ms - gaps.get(key, -1000) >= 110
        gaps[key] = ms


def test_texts(spark):
    df = spark.createDataFrame([("漢字abc漢字" * 3,), ("x",), ("",)], "t string")
    got = [tuple(r) for r in df.select(tx.char_count(F.col("t")), tx.clamp_chars(F.col("t"), 2)).collect()]
    assert got == [(12, "漢字…"), (0, "x"), (0, "")]
    head = df.select(tx.head_lines(F.lit("a\n" + "b" * 500), 5, 400).alias("h"), tx.tail_chars(F.lit("q" * 300 + "\n" + "z" * 450)).alias("t")).first()
    assert head.h == "a\n" + "b" * 398 + " …" and head.t == "z" * 450
    cases = {"aaaa\n\n \nbbbb\ncccccccccccc": "aaaa\nbbbb\ncc …", "  a \r\nb\rc\nd  ": "a\nb\nc", "aaaaaaaaaaaa\nb": "aaaaaaaaaaaa", " \n ": "", None: ""}
    one = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.head_lines(F.col("t"), 3, 12).alias("h"))
    assert {r.t: r.h for r in one.collect()} == cases


def test_measures_are_rejected_by_the_first_rule(spark):
    good = ("m", 2, 6, 0.9, 2.5, 2_073_600, "K", "ncnn-vulkan")
    bad = {"model": (0, " "), "scale": (1, 0), "frames": (2, 3), "time": (3, float("nan")), "sample_time": (4, float("inf")), "pixels": (5, 0), "machine": (6, None), "backend": (7, "")}
    rows = [("", *good), *((k, *[v if j == i else x for j, x in enumerate(good)]) for k, (i, v) in bad.items())]
    rows += [("time", *good[:3], 0.0, *good[4:]), ("sample_time", *good[:4], -1.0, *good[5:]), ("order", *good[:3], 4.0, 4.0, *good[5:]), ("order", *good[:3], 4.0, 3.7, *good[5:]), ("noise", *good[:3], 4.0, 4.5, *good[5:]), ("slope", *good[:3], 0.9, 900.0, *good[5:])]
    df = spark.createDataFrame(rows, "want string, model string, scale int, n int, t1 double, tn double, pixels long, machine string, backend string")
    assert [(r.want, r.reject or "") for r in ledgers.validate_measures(df).collect() if r.want != (r.reject or "")] == []


def test_resample_by_join_shuffles_samples_not_products(spark):
    """As the plain sum over taps in Python, with missing samples and a track of one."""
    tracks = {"a": range(1000), "b": [i for i in range(400) if i % 97 and not 150 <= i < 330], "c": [0]}
    values = {(t, i): math.sin(i * 0.7) * 0.9 for t, own in tracks.items() for i in own}
    df = spark.createDataFrame([(t, i, v) for (t, i), v in values.items()], "track string, i long, v double").repartition(3)
    for up, down, half in ((3, 2, 8), (2, 3, 4), (6, 4, 3)):
        taps, g = signals.resample_taps(up, down, half), math.gcd(up, down)
        want = {}
        for t, own in tracks.items():
            n = max(own) + 1
            for o in range(round(n * up / down)):
                used = [(values[t, i], taps[o * down % up // g, k + half]) for k in range(-half, half + 1) for i in [min(max(o * down // up + k, 0), n - 1)] if (t, i) in values]
                if used:
                    weight = sum(c for _, c in used)
                    want[t, o] = max(-1.0, min(1.0, sum(v * c for v, c in used) / (weight if abs(weight) > 1e-6 else 1.0)))
        got = {(r.track, r.i): r.v for r in signals.resample_by_join(df, ["track"], up, down, half).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = signals.resample_by_join(df, ["track"], 3, 2, 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # What joins the taps is not shuffled after it: no exchange lies above their join.
    assert "hashpartitioning" in plan and "hashpartitioning" not in plan.split("BroadcastHashJoin")[0]
