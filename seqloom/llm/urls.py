"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked
Bloom filter. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ascii_lower, staged, table

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
WORDS = 8  # 64-bit words in a block of the filter; a key sets one bit in each
#: Longer lists of rules are a table that hosts are joined to.
MAX_RULES = 1000
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What pages show that make up the list which ``op10`` filters by: numbers of cards, addresses of mail.
LISTED_PAGES = "[0-9]{16}|[a-z0-9]@[a-z0-9]"


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def canonical(host, path):
    """Host without a leading ``www.`` or ``m.``, path without a closing slash or ``.html``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def _bits(key):
    """Block hash, and for each word of the block the long with the key's bit."""
    h = F.xxhash64(key, F.lit(1))
    return F.xxhash64(key), [F.expr("shiftleft(1L, cast(_b AS int))".replace("_b", f"(shiftrightunsigned(_h, {6 * i}) & 63)")) for i in range(WORDS)], h


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block that has a key: ``_block`` and the words ``_w0``... Sixteen bits for
    each key give a rate of false positives of about 0.1 %."""
    at, bits, h = _bits(F.col(key))
    return (
        listed.select(F.pmod(at, F.lit(blocks)).alias("_block"), h.alias("_h"))
        .select("_block", *[b.alias(f"_w{i}") for i, b in enumerate(bits)])
        .groupBy("_block")
        .agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    )


def rule_of(host, path, rules: Sequence[tuple[str, str, str]]):
    """The rule as ``host/path`` text and its verdict; nulls where none fits. The longest wins,
    and of rules of one length the first in the sequence."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(reversed(list(rules)), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def rules_by_table(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for ``places`` (``host`` and ``path``, distinct) and a table of rules (``rank``, ``what``,
    ``host``, ``path``): ``host``, ``path``, ``rule`` and ``ruled`` of the places that a rule fits. A
    host meets the rules of its own name and of each domain that it lies in."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    spread_out = places.select("host", "path", F.explode(domains).alias("domain"))
    found = spread_out.join(rules.select("rank", "what", F.col("host").alias("domain"), F.col("path").alias("start")), "domain").where(F.col("path").startswith(F.col("start")))
    best = F.struct((F.length("domain") + F.length("start")).alias("n"), (-F.col("rank")).alias("first"))
    return found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("domain", "start").alias("rule"), F.col("what").alias("ruled")), best).alias("_r")).select("host", "path", "_r.*")


def url_filter(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", listed_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bits_per_key: int = 16, broadcast_mb: float = 8, max_rules: int = MAX_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` to every row of ``pages``.

    ``listed`` holds URLs in the form of :func:`canonical`. A page without a rule is blocked if
    its canonical URL is listed, and else allowed. The list goes into a blocked Bloom filter of
    ``bits_per_key`` bits a URL. Pages that it passes are joined to the list itself, so its false
    positives don't show. Filter and list are broadcast up to ``broadcast_mb`` each, by their measured
    sizes. Beyond that the distinct URLs alone meet the filter, those that it passes the list, and
    what is found comes back to the pages: by broadcast if it is small, else by a join in which URLs
    of many pages, and pages without one, are dealt out under salts. Rules beyond ``max_rules`` are joined by domain.

    Null URLs and URLs without ``://`` have an empty host and path, meet no rule and are never
    listed. Nulls and repeated rows in the list count once or not at all; repeated pages each get a
    row. Other columns are kept, whatever their names; those that have the names added are replaced.
    """
    added = ("host", "path", "rule", "listed", "verdict")
    keep = [c for c in pages.columns if c not in added]
    names = staged(listed.select(F.col(listed_col).alias("key")).where(F.col("key").isNotNull() & (F.col("key") != "")).distinct(), "listed")
    n, length = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    blocks = max(1, math.ceil(n * bits_per_key / (64 * WORDS)))
    bloom = bloom_filter(names, "key", blocks)
    small_filter, small_list = blocks * 8 * (WORDS + 1) <= broadcast_mb * 1e6, length + 32 * n <= broadcast_mb * 1e6
    salts = max(16, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    salted = lambda table: table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    url = F.col(f"`{url_col}`")
    plain = [c for c, kind in pages.dtypes if not kind.startswith("map")]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _once(host=host_of(url), path=path_of(url), salt=salt))
    if len(rules) > max_rules:
        table_of_rules = pages.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rank int, what string, host string, path string")
        ruled = salted(rules_by_table(row.where("host <> ''").select("host", "path").distinct(), table_of_rules))
        row = row.join(ruled, ["host", "path", "salt"], "left")
    else:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        row = row.select("*", _once(rule=rule, ruled=verdict))
    row = row.select("*", _once(key=canonical(F.col("host"), F.col("path"))))
    if small_filter and small_list:
        row = _passed(row, bloom, blocks, True)
        # What the filter stops looks up keys that no URL has.
        row = row.select("row", "host", "path", "rule", "ruled", _once(key=F.when(F.col("_passes"), F.col("key")).otherwise(F.concat(F.lit(" "), F.xxhash64("key").cast("string")))))
        row = row.join(F.broadcast(names.withColumn("listed", F.lit(True))), "key", "left")
    else:
        found = listed_keys(pages.select(url.alias("url")), names, bloom, blocks, small_filter)
        hits, size, pages_hit, most = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        found = found.withColumn("listed", F.lit(True))
        if size <= broadcast_mb * 1e6:
            row = row.join(F.broadcast(found.drop("n")), "key", "left")
        else:
            # Keys of many pages are dealt out under salts: HOT_KEYS of them at most.
            many = max(1000, pages_hit // HOT_KEYS)
            hot = found.where(F.col("n") > many).select("key", F.lit(True).alias("_hot"))
            found = found.withColumn("salt", F.explode(F.when(F.col("n") > many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))).drop("n")
            # Pages without a URL meet nothing; their keys are dealt out too.
            key = F.when(F.col("key") == "", F.concat(F.lit(" "), F.col("salt").cast("string"))).otherwise(F.col("key"))
            row = row.withColumn("key", key).join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("_hot"), F.col("salt")).otherwise(-1))
            row = row.join(found, ["key", "salt"], "left")
    return row.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep],
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


#: Keys that have more than such a share of the pages whose URL is listed are dealt out under salts.
HOT_KEYS = 10_000


def _once(**cols: Column) -> Column:
    """Columns that the optimizer does not write out again wherever they are used."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))


def _passed(rows: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """``rows`` with ``_passes``: whether the filter knows their ``key``."""
    at, bits, h = _bits(F.col("key"))
    rows = rows.select("*", _once(_block=F.when(F.col("key") != "", F.pmod(at, F.lit(blocks))), _h=h))
    rows = rows.join(F.broadcast(bloom) if small else bloom, "_block", "left")
    passes = F.col("key") != ""
    for i, b in enumerate(bits):
        passes = passes & ((F.coalesce(F.col(f"_w{i}"), F.lit(0).cast("long")).bitwiseAND(b)) != 0)
    return rows.withColumn("_passes", passes)


#: Bytes of a filter of ``sifted`` at most.
SIFT_BYTES = 8_000_000


def sifted(rows: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_passes``, false only where no row of ``listed`` has their ``keys`` (never null): only the others
    need be joined to it, so wide rows without a match are not shuffled. ``listed`` is read twice. If ``SIFT_BYTES`` are
    too few for its keys, more rows pass. Names of ``rows`` are the caller's own: none is ``key`` or begins with ``_``."""
    key = F.concat_ws(":", *keys)
    blocks = max(1, min(math.ceil(16 * listed.count() / (64 * WORDS)), SIFT_BYTES // (8 * WORDS)))
    bloom = bloom_filter(listed.select(key.alias("key")), "key", blocks)
    return _passed(rows.withColumn("key", key), bloom, blocks, True).select(*rows.columns, "_passes")


def listed_keys(urls: DataFrame, names: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """``key`` and ``n``, the number of pages, of the canonical URLs of pages (``url`` alone) that are listed.
    Keys are counted before they travel, meet the filter as keys alone, and only those that it
    passes are joined to the list."""
    keys = urls.select(_once(host=host_of(F.col("url")), path=path_of(F.col("url")))).select(canonical(F.col("host"), F.col("path")).alias("key"))
    keys = keys.where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hits = staged(_passed(keys, bloom, blocks, small).where("_passes").select("key", "n"), "hits")
    return staged(hits.join(names, "key", "left_semi"), "listed-pages")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list for ``op10``: canonical URLs of pages that show numbers of cards or addresses of mail.
    All mirrors and spellings of such a page are blocked with it."""
    return pages.where(F.col("html").rlike(LISTED_PAGES)).select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("url"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url"), listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


_PARTS = f"""SELECT page_id,
    translate(coalesce(regexp_extract(url, '{URL_PARTS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '{URL_PARTS}', 2), '') AS path, coalesce(regexp_matches(html, '{LISTED_PAGES}'), false) AS bad FROM pages"""
OP10_SQL = f"""WITH p AS ({_PARTS}),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS k FROM p),
l AS (SELECT DISTINCT k FROM c WHERE bad AND k <> ''),
r AS (SELECT *, k IN (SELECT k FROM l) AS listed,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r"""
