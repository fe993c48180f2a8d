"""Queries of the sources and the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as tx
from ..functions.core import over, r6
from ..operators import ledgers as lg
from ..sources import files as op
from ..sources import fixtures as fx
from .registry import query


@query("a01_media_catalog", """p AS (SELECT CASE WHEN doc_id = 2 THEN 'root/named.txt' ELSE 'root/' || lang || CASE WHEN doc_id % 5 = 0 THEN '-b/' ELSE '/' END || source || CASE WHEN doc_id % 11 = 0 THEN '/a/b/c/d/e/f/' ELSE '/' END || (doc_id // 2)::VARCHAR || ['.PNG', '.png', '.txt', '.jfif', '.avif'][1 + doc_id % 5] END AS path FROM documents),
r AS (SELECT path, CASE WHEN starts_with(path, 'root/fr/') THEN 0 WHEN path = 'root/named.txt' THEN 1 WHEN starts_with(path, 'root/') THEN 2 END AS root FROM p),
d AS (SELECT path, root, (CASE root WHEN 0 THEN len(string_split(path, '/')) - 3 WHEN 1 THEN 0 ELSE len(string_split(path, '/')) - 2 END)::INT AS depth, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM r),
e AS (SELECT * FROM d WHERE root = 1 OR depth <= 6 AND regexp_matches(lower(path), '\\.(png|jfif|avif)$') QUALIFY row_number() OVER (PARTITION BY upper(path) ORDER BY path) = 1)
SELECT path, depth, dir, name FROM e ORDER BY root, depth, string_split(upper(dir), '/'), upper(name), path LIMIT 200""")
def a01(spark, sf):
    """Three roots, of which one is a file, in an order of their own."""
    e = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".png", ".txt", ".jfif", ".avif")]), (e % 5 + 1).cast("int"))
    deep = F.when(e % 11 == 0, "/a/b/c/d/e/f/").otherwise("/")
    path = F.concat(F.lit("root/"), "lang", F.when(e % 5 == 0, "-b/").otherwise("/"), "source", deep, F.expr("doc_id div 2").cast("string"), ending)
    files = fx.table(spark, sf, "documents").select(F.when(e == 2, "root/named.txt").otherwise(path).alias("path"), F.col("n_chars").alias("length"))
    return op.catalog_of(files, ["root/fr", "root/named.txt", "root/"], "image", 200, 6, folders=True).select("path", "depth", "dir", "name")


KV_SQL = "kv AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'avg_frame_rate=N/A' WHEN event_id % 4 = 1 THEN 'avg_frame_rate=' ELSE 'avg_frame_rate=' || (event_id % 90) || '/' || (event_id % 3) END AS l1, '  r_frame_rate=' || (event_id % 61) || '/2' AS l2, 'avg_frame_rate=25' AS l3, 'nb_read_frames=' || (event_id % 200) AS l4 FROM events)"


def kv(spark, sf):
    e = F.col("event_id")
    rate = F.when(e % 4 == 0, "N/A").when(e % 4 == 1, "").otherwise(F.concat((e % 90).cast("string"), F.lit("/"), (e % 3).cast("string")))
    text = F.concat(F.lit("avg_frame_rate="), rate, F.lit("\n  r_frame_rate="), (e % 61).cast("string"), F.lit("/2\navg_frame_rate=25\nnb_read_frames="), (e % 200).cast("string"))
    return fx.table(spark, sf, "events").select("event_id", text.alias("text"))


@query("a02_kv_fields", f"""{KV_SQL}, u AS (SELECT event_id, unnest([1, 2, 3, 4]) AS pos, trim(unnest([l1, l2, l3, l4])) AS line FROM kv), f AS (SELECT event_id, pos, split_part(line, '=', 1) AS key, split_part(line, '=', 2) AS value FROM u)
SELECT event_id, key, arg_min(value, pos) AS value FROM f WHERE value <> '' AND value <> 'N/A' GROUP BY event_id, key""")
def a02(spark, sf):
    return op.kv_fields(kv(spark, sf), ["event_id"], "text", ["avg_frame_rate", "r_frame_rate", "nb_read_frames"])


@query("a03_rate_field", """r AS (SELECT event_id, event_id % 200 AS n, CASE WHEN event_id % 3 > 0 THEN (event_id % 90) / (event_id % 3)::DOUBLE END AS a, CASE WHEN event_id % 61 > 0 THEN (event_id % 61)::DOUBLE END AS b FROM events),
f AS (SELECT *, coalesce(a, b) AS fps FROM r), d AS (SELECT *, CASE WHEN fps > 0 THEN CASE WHEN n >= 2 THEN (n - 1) / fps ELSE 1 / fps END END AS d FROM f)
SELECT event_id, round(fps, 6) AS fps, round(CASE WHEN d > 0.01 THEN d END, 6) AS duration FROM d""")
def a03(spark, sf):
    e = F.col("event_id")
    rows = fx.table(spark, sf, "events").select("event_id", (e % 200).alias("n"), F.concat((e % 90).cast("string"), F.lit("/"), (e % 3).cast("string")).alias("avg"), (e % 61).cast("string").alias("raw"))
    rows = rows.withColumn("fps", F.coalesce(op.rate_field(F.col("avg")), op.rate_field(F.col("raw"))))
    return rows.select("event_id", r6("fps").alias("fps"), r6(op.content_duration(F.col("n"), F.col("fps"))).alias("duration"))


@query("a04_read_verdict_tsv", """SELECT 'k' || o_orderkey AS key, o_orderstatus = 'O' AS ok, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE (o_custkey % 5)::INT END AS failures, o_custkey AS at, o_orderpriority AS note
FROM orders WHERE (o_orderstatus = 'O' AND o_orderkey % 13 <> 0 OR o_orderstatus = 'F') AND o_custkey > 0 AND o_orderkey % 17 <> 0""")
def a04(spark, sf):
    """Comments behind blanks, and verdicts written as numbers, which are none."""
    o = fx.table(spark, sf, "orders")
    ok = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 13 == 0), "1").when(F.col("o_orderstatus") == "O", "True").when(F.col("o_orderstatus") == "F", " false").otherwise("maybe")
    line = F.concat_ws("\t", F.concat(F.lit(" k"), "o_orderkey"), ok, (F.col("o_custkey") % 5).cast("string"), F.col("o_custkey").cast("string"), F.concat("o_orderpriority", F.lit(" ")))
    return op.parse_verdicts(o.select(F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("  # "), line)).otherwise(line).alias("value")))


@query("a04_verdict_lines", """a AS (SELECT user_id::VARCHAR AS key, bool_and(event_type <> 'error') AS ok, count(*)::INT AS failures, max(event_id) AS at FROM events GROUP BY user_id)
SELECT 0 AS part, '' AS key, '# key' || chr(9) || 'ok' || chr(9) || 'failures' || chr(9) || concat('a', 't') || chr(9) || 'note' AS line UNION ALL SELECT 1, '', '# sig=v1'
UNION ALL SELECT 2, key, concat_ws(chr(9), key, CASE WHEN ok THEN 'True' ELSE 'False' END, CASE WHEN ok THEN '0' ELSE failures::VARCHAR END, at::VARCHAR, 'n n') FROM a""")
def a04b(spark, sf):
    """Successes with failures before them, and notes of two lines."""
    e = fx.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.bool_and(F.col("event_type") != "error").alias("ok"), F.count(F.lit(1)).cast("int").alias("failures"), F.max("event_id").alias("at"))
    return op.verdict_lines(e.withColumn("note", F.lit("n\nn")), "v1")


# A value of a wrong kind spoils a text.
BAD_KIND = '{"schema": 1, "prices": [{"modelKey": "m", "engineScale": "two", "secondsPerFrame": 1.5, "samplePixels": 9, "sampleFrames": 9, "machineKey": "k", "backend": "O"}]}'


@query("a05_price_json", f"""SELECT machine, model, scale, round((tn - t1) / (n - 1), 6) AS seconds_per_frame, n AS sample_frames FROM v_prices WHERE backend IN ('O', 'F') AND seq % 20 <> 0 AND seq % 20 <> 7 AND tn > t1""")
def a05(spark, sf):
    p = fx.prices(spark, sf)
    slope, _, _ = lg.two_point_cost(F.col("t1"), F.col("tn"), F.col("n"), F.col("pixels"))
    entries = p.select("machine", "seq", F.when(F.col("seq") % 20 == 7, " ").otherwise(F.col("model")).alias("model"), "scale", slope.alias("secondsPerFrame"), F.col("pixels").alias("samplePixels"), F.when(F.col("seq") % 20 == 0, 0).otherwise(F.col("n")).alias("sampleFrames"), F.col("machine").alias("machineKey"), "backend")
    # One text for each thousandth of the records, so that no key gathers a share of the table.
    texts = op.to_price_json(entries.withColumn("part", F.expr("seq div 1000")).drop("machine"), ["part"]).unionByName(spark.createDataFrame([(-1, "{broken"), (-2, '{"schema": 2, "prices": []}'), (-3, BAD_KIND)], "part long, json string"))
    out = op.read_price_json(texts, "json", ["O", "F"])
    return out.select(F.col("machineKey").alias("machine"), "model", "scale", r6("secondsPerFrame").alias("seconds_per_frame"), F.col("sampleFrames").alias("sample_frames"))


LOG_SQL = "lg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line_no, CASE WHEN event_id % 50 = 0 THEN 'no time here' ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || upper(event_type) || '] value ' || event_id END AS line, CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS tm, CASE WHEN event_id % 50 <> 0 THEN upper(event_type) END AS level FROM events)"


def log(spark, sf):
    e = fx.table(spark, sf, "events")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.upper("event_type"), F.lit("] value "), F.col("event_id").cast("string"))
    return e.select("user_id", F.row_number().over(over(["user_id"], ["ts"])).alias("line_no"), F.when(F.col("event_id") % 50 == 0, "no time here").otherwise(line).alias("line"))


@query("a06_log_lines", f"{LOG_SQL} SELECT user_id, line_no, tm::VARCHAR AS time, level FROM lg")
def a06(spark, sf):
    return op.log_lines(log(spark, sf), "line").select("user_id", "line_no", F.col("time").cast("string").alias("time"), "level")


@query("a06_retain_log", f"""{LOG_SQL}, k AS (SELECT user_id, line_no, coalesce(sum(length(line) + 2) OVER (PARTITION BY user_id ORDER BY line_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM lg WHERE tm IS NULL OR tm >= TIMESTAMP '2024-01-10')
SELECT user_id, line_no FROM k WHERE newer < 1000""")
def a06b(spark, sf):
    return op.retain_log(log(spark, sf), ["user_id"], "line_no", "line", F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'"), 1000).select("user_id", "line_no")


@query("a07_dir_usage", "u AS (SELECT lang AS root, sum(n_chars)::BIGINT AS bytes, max(CASE WHEN lang <> 'es' THEN doc_id END) AS newest FROM documents GROUP BY lang) SELECT root, bytes, newest, CASE WHEN newest IS NULL THEN true ELSE 1000 - newest < 5 END AS keep FROM u")
def a07(spark, sf):
    files = fx.table(spark, sf, "documents").select(F.col("lang").alias("root"), "n_chars", F.when(F.col("lang") != "es", F.col("doc_id")).alias("mtime"))
    return op.keep_live(op.dir_usage(files, "root", "n_chars", "mtime"), F.lit(1000), 5)


@query("a08_image_summary", "m AS (SELECT grid_id, floor(avg(r)) AS r, floor(avg(g)) AS g, floor(avg(b)) AS b FROM v_rgb GROUP BY grid_id) SELECT grid_id, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luma FROM m")
def a08(spark, sf):
    return op.image_summary(fx.rgb(spark, sf), ["grid_id"]).withColumn("luma", r6("luma"))


@query("a09_unique_names", """d AS (SELECT lang AS dir, doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.txt' END AS name FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY doc_id) AS k FROM d)
SELECT dir, doc_id, CASE WHEN k = 1 THEN name WHEN ends_with(name, '.txt') THEN source || ' (' || k || ').txt' ELSE name || ' (' || k || ')' END AS unique_name FROM (SELECT *, regexp_replace(name, '\\.txt$', '') AS source FROM k)""")
def a09(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("lang").alias("dir"), "doc_id", F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(".txt")).alias("name"))
    return op.unique_names(rows, "dir", "name", "doc_id").select("dir", "doc_id", "unique_name")


@query("a09_unique_names_taken", """d AS (SELECT lang AS dir, doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 7 = 0 THEN ' (2).txt' ELSE '.txt' END AS name FROM documents),
t AS (SELECT DISTINCT lang AS dir, source || '.txt' AS name FROM documents WHERE n_chars > 500 UNION SELECT DISTINCT lang, source || ' (4).txt' FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY doc_id) AS k FROM d), w AS (SELECT dir, name, max(k) AS most FROM k GROUP BY dir, name),
u AS (SELECT dir, name FROM t UNION SELECT dir, name FROM d),
n AS (SELECT w.dir, w.name, i, CASE WHEN i = 1 THEN w.name WHEN ends_with(w.name, '.txt') THEN left(w.name, length(w.name) - 4) || ' (' || i || ').txt' ELSE w.name || ' (' || i || ')' END AS made FROM (SELECT *, unnest(range(1, most + 10)) AS i FROM w) w),
f AS (SELECT dir, name, made, row_number() OVER (PARTITION BY dir, name ORDER BY i) AS k FROM n WHERE CASE WHEN i = 1 THEN (dir, made) NOT IN (SELECT (dir, name) FROM t) ELSE (dir, made) NOT IN (SELECT (dir, name) FROM u) END)
SELECT dir, doc_id, made AS unique_name FROM k JOIN f USING (dir, name, k)""")
def a09b(spark, sf):
    e = F.col("doc_id")
    docs = fx.table(spark, sf, "documents")
    rows = docs.select(F.col("lang").alias("dir"), "doc_id", F.concat("source", F.when(e % 3 == 0, "").when(e % 7 == 0, " (2).txt").otherwise(".txt")).alias("name"))
    taken = docs.where("n_chars > 500").select(F.col("lang").alias("dir"), F.concat("source", F.lit(".txt")).alias("name")).unionAll(docs.select("lang", F.concat("source", F.lit(" (4).txt"))))
    return op.unique_names(rows, "dir", "name", "doc_id", taken).select("dir", "doc_id", "unique_name")


RULES = [("urgent", "urgent|high"), ("normal", r"\Qmedium\E"), ("unknown", r"not.specified")]


@query("f01_classify", "SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent|high') THEN 'urgent' WHEN contains(lower(o_orderpriority), 'medium') THEN 'normal' WHEN regexp_matches(lower(o_orderpriority), 'not.specified') THEN 'unknown' ELSE 'other' END AS label FROM orders")
def f01(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", tx.classify(F.col("o_orderpriority"), RULES, "other").alias("label"))


@query("f01_classify_by_table", "w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), r AS (SELECT word, row_number() OVER (ORDER BY word) AS priority FROM (SELECT DISTINCT word FROM w WHERE word < 'm')) SELECT p.p_partkey, (SELECT arg_min(upper(r.word), priority) FROM w JOIN r USING (word) WHERE w.p_partkey = p.p_partkey) AS label FROM part p")
def f01b(spark, sf):
    part = fx.table(spark, sf, "part")
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word < 'm'").distinct()
    rules = words.select("word", F.upper("word").alias("label"), F.col("word").alias("priority"))
    return tx.classify_by_table(part, "p_name", rules, ["p_partkey"])


@query("f01_classify_substrings", """r AS (SELECT lower(substr(text, 1, 7)) AS t, min(doc_id) AS priority FROM documents WHERE text <> '' GROUP BY ALL)
SELECT d.doc_id, arg_min('rule ' || r.priority, r.priority) AS label FROM documents d LEFT JOIN r ON contains(lower(d.text), r.t) GROUP BY d.doc_id""")
def f01c(spark, sf):
    """How each text begins is a rule; texts are looked through for all of them."""
    docs = fx.table(spark, sf, "documents")
    rules = docs.where("text <> ''").groupBy(F.lower(F.substring("text", 1, 7)).alias("text")).agg(F.min("doc_id").alias("priority"))
    rules = rules.withColumn("label", F.concat(F.lit("rule "), F.col("priority").cast("string")))
    return tx.classify_by_substrings(docs, "text", rules, ["doc_id"])


@query("f02_url_parts", """u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' ' || split_part(url, '://', 2) || ' ' WHEN 1 THEN replace(url, '.com/', '.com//a/') ELSE url END AS url FROM pages),
c AS (SELECT *, strpos(url, '://') AS at FROM u), r AS (SELECT *, CASE WHEN at > 0 THEN substr(url, at + 3) END AS rest FROM c), s AS (SELECT *, strpos(rest, '/') AS slash FROM r),
p AS (SELECT *, CASE WHEN slash > 0 THEN split_part(split_part(substr(rest, slash), '?', 1), '#', 1) ELSE '' END AS path FROM s), l AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, lower(CASE WHEN at = 0 THEN trim(url) WHEN slash > 0 THEN left(rest, slash - 1) ELSE rest END) AS host,
CASE WHEN path IS NULL OR path = '' OR ends_with(path, '/') THEN 'index' ELSE parts[-1] END AS file, coalesce(array_to_string(parts[2:], '/'), '') AS tail FROM l""")
def f02(spark, sf):
    """URLs as they are, without a scheme, and with empty parts."""
    given = F.col("url")
    bare = F.concat(F.lit(" "), F.split(given, "://")[1], F.lit(" "))
    url = F.when(F.col("page_id") % 4 == 0, bare).when(F.col("page_id") % 4 == 1, F.replace(given, F.lit(".com/"), F.lit(".com//a/"))).otherwise(given)
    return fx.table(spark, sf, "pages").select("page_id", tx.url_host(url).alias("host"), tx.url_file(url, "index").alias("file"), tx.url_tail(url, 1).alias("tail"))


@query("f03_content_fingerprint", """h AS (SELECT conv_id, md5((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ':' || coalesce(text, '')) AS h FROM conversations)
SELECT conv_id, md5(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT) || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT)) AS fingerprint FROM h GROUP BY conv_id""")
def f03(spark, sf):
    return tx.content_fingerprint(fx.table(spark, sf, "conversations"), ["conv_id"], "text", ["turn"])


@query("f04_char_count", "SELECT doc_id, length(text) - length(regexp_replace(text, '[éèäö]', '', 'g')) AS n, CASE WHEN length(text) - length(regexp_replace(text, '[éèäö]', '', 'g')) > 20 THEN sha256(regexp_extract(text, '(?s)^((?:[^éèäö]*[éèäö]){20})', 1) || '…') ELSE sha256(text) END AS cut FROM documents")
def f04(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select("doc_id", tx.char_count(text, "éèäö").cast("long").alias("n"), F.sha2(tx.clamp_chars(text, 20, "éèäö"), 256).alias("cut"))


# Texts with blank lines, breaks of other systems and blanks at the ends.
F05 = "f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' || replace(text, '. ', '.' || chr(13) || chr(10)) || chr(10) WHEN 2 THEN replace(text, '. ', '. ' || chr(10) || ' ' || chr(10)) ELSE replace(text, '. ', '.' || chr(13)) END AS raw FROM documents), t AS (SELECT doc_id, regexp_replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM f)"


def outputs(spark, sf):
    k, text = F.col("doc_id") % 4, F.col("text")
    raw = F.when(k == 0, text).when(k == 1, F.concat(F.lit("  "), F.replace(text, F.lit(". "), F.lit(".\r\n")), F.lit("\n"))).when(k == 2, F.replace(text, F.lit(". "), F.lit(". \n \n"))).otherwise(F.replace(text, F.lit(". "), F.lit(".\r")))
    return fx.table(spark, sf, "documents").select("doc_id", raw.alias("text"))


@query("f05_tail_chars", f"{F05}, c AS (SELECT doc_id, text, right(text, 500) AS t FROM t), p AS (SELECT *, strpos(t, chr(10)) AS p FROM c) SELECT doc_id, sha256(CASE WHEN length(text) > 500 AND p > 0 AND p - 1 < 500 - 80 THEN substr(t, p + 1) ELSE t END) AS tail FROM p")
def f05a(spark, sf):
    return outputs(spark, sf).select("doc_id", F.sha2(tx.tail_chars(F.col("text")), 256).alias("tail"))


@query("f05_head_lines", f"""{F05}, l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: trim(x) <> '')[1:5] AS ls FROM t),
c AS (SELECT doc_id, k, ls[k] AS x, 400 - coalesce(sum(length(ls[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l, range(1, 6) r(k) WHERE k <= len(ls)),
b AS (SELECT *, coalesce(bool_or(length(x) > room) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM c)
SELECT doc_id, sha256(coalesce(h, '')) AS head FROM l LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN length(x) <= room THEN x ELSE left(x, room::INT) || ' …' END, chr(10) ORDER BY k) AS h FROM b WHERE room > 0 AND NOT done GROUP BY doc_id) USING (doc_id)""")
def f05b(spark, sf):
    return outputs(spark, sf).select("doc_id", F.sha2(tx.head_lines(F.col("text")), 256).alias("head"))
