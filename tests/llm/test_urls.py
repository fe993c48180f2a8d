import duckdb
from pyspark.sql import functions as F

from seqloom.llm import urls
from seqloom.llm.urls import OP10_SQL, RULES, listed_urls, op10_url_filter, url_filter


def test_same_as_sql(spark, sf):
    got = op10_url_filter(spark, sf)
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = duck.sql(OP10_SQL)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_edges(spark):
    rows = [(1, "HTTP://WWW.Bad.example.net/x/?q=1", "a"), (2, "http://bad.example.net/x.html", "b"), (3, None, "c"), (4, "no scheme", "d"), (5, "http://a.org", "e"), (6, "http://a.org/", "f"), (7, "http://a://b.com/de/x", "g"), (8, "http://notcom/de/", "h"), (9, "http://Éa.example.org/es/1#x", "i"), (None, "http://x.com/fr/1", "j"), (1, "HTTP://WWW.Bad.example.net/x/?q=1", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame([("bad.example.net/x",), ("bad.example.net/x",), (None,)], "url string")
    for mb in (8, 0):
        got = sorted((str(r.page_id), r.host, r.path, r.rule, r.listed, r.verdict) for r in url_filter(pages, listed, broadcast_mb=mb).collect())
        assert got == sorted(
            [
                ("1", "www.bad.example.net", "/x/", None, True, "block"),
                ("1", "www.bad.example.net", "/x/", None, True, "block"),
                ("2", "bad.example.net", "/x.html", None, True, "block"),
                ("3", "", "", None, False, "allow"),
                ("4", "", "", None, False, "allow"),
                ("5", "a.org", "", None, False, "allow"),
                ("6", "a.org", "/", "org/", False, "allow"),
                ("7", "a:", "//b.com/de/x", None, False, "allow"),
                ("8", "notcom", "/de/", None, False, "allow"),
                ("9", "Éa.example.org", "/es/1", "example.org/es/", False, "block"),
                ("None", "x.com", "/fr/1", "com/fr/", False, "allow"),
            ]
        )
    assert url_filter(pages.limit(0), listed.limit(0)).count() == 0


def test_no_false_negatives(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.net/p', id) AS url")
    listed = pages.where("page_id % 3 = 0").selectExpr("concat('h', page_id % 700, '.net/p', page_id) AS url")
    got = url_filter(pages, listed).where("listed").count()
    assert got == 1000


def test_tables_of_rules(spark):
    rows = ["http://a.example.org/es/1", "http://example.org/en/12", "http://x.org/", "http://b.com/fr/", "http://b.com/de/", "http://com/de/", None, "http://notexample.org.net/es/", "http://EXAMPLE.org/es/"]
    pages = spark.createDataFrame([(i % 9, u) for i, u in enumerate(rows * 3)], "page_id long, url string")
    listed = spark.createDataFrame([("notexample.org.net/es",)], "url string")
    more = [*RULES, ("block", "org", "/"), *[("block", f"h{i}.net", "/") for i in range(50)]]
    plain = sorted(map(repr, url_filter(pages, listed, rules=more).collect()))
    assert sorted(map(repr, url_filter(pages, listed, rules=more, max_rules=3).collect())) == plain and len(plain) == 27
    assert sorted(map(repr, url_filter(pages, listed, rules=more, max_rules=3, broadcast_mb=0).collect())) == plain


def test_mirrors_of_a_listed_page(spark):
    rows = [(1, "http://www.a.net/x.html", "write to me@b"), (2, "https://a.net/x/", "plain"), (3, "http://c.net/x", "1234567812345678"), (4, "http://d.net/", None), (5, None, "me@b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter(pages, listed_urls(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    """A hot URL, pages without one, and a list that is not small: only keys meet the filter, and only
    those that it passes the list."""
    url = F.when(F.col("id") % 3 == 0, "http://hot.net/p").when(F.col("id") % 3 == 1, F.concat(F.lit("http://h"), "id", F.lit(".net/"))).when(F.col("id") % 2 == 0, None)
    pages = spark.range(9000).select(F.col("id").alias("page_id"), url.alias("url"), F.repeat(F.lit("html"), 50).alias("html"))
    pages.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    listed = spark.range(0, 9000, 5).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("url")).unionAll(spark.createDataFrame([("hot.net/p",)], "url string"))
    want = sorted(map(repr, url_filter(pages, listed).collect()))
    seen = {}
    plain = urls.listed_keys

    def spied(given, names, bloom, blocks, small):
        found = plain(given, names, bloom, blocks, small)
        seen.update(plan=given._jdf.queryExecution().executedPlan().toString(), found=found.count(), keys=given.distinct().count())
        return found

    monkeypatch.setattr(urls, "listed_keys", spied)
    monkeypatch.setattr(urls, "HOT_KEYS", 1)
    for mb in (0, 0.02):
        assert sorted(map(repr, url_filter(pages, listed, broadcast_mb=mb).collect())) == want
    assert "html" not in seen["plan"] and seen["found"] == 601 and seen["keys"] > 3000
    assert sum("block" in r for r in want) == 3600
