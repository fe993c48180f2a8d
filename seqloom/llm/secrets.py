"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import row_key, spread, staged, table

#: Digests of more rows than this, and of more than this share of all, are dealt out under salts.
MANY_ROWS, MANY_DIGESTS = 1000, 10_000
#: Matches whose places a fold sums up at once; more are cut into runs of so many.
RUN = 256
#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "opaque"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of a class that is too short can't hide a longer one, so these two need no later filter.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
MIN_ASSIGN = 12
#: What more owners or repositories have is an example.
MAX_OWNERS, MAX_REPOS = 2, 3
EXAMPLE = "(?i)example|sample|dummy|changeme|placeholder|your_|xxxx"
MASK = "[SECRET]"


def _matches(text: Column, pattern: str, value_group: int) -> Column:
    """All matches as an array of (start, stop, value), in code points. The gaps between them come
    from ``split``; a running sum of gap and match lengths gives the places, run by run, so that the
    cost follows the number of matches."""
    one = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("value"))
    none = F.filter(F.array(one), lambda _: F.lit(False))
    full, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = full if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(full.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(full)).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["v"].alias("value")))).alias("out"))

    def walk(acc: Column, run: Column) -> Column:
        part = F.aggregate(run, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int"))), lambda k: F.slice(rows, k * RUN + 1, F.lit(RUN)))
    walked = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out")), walk, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _tagged(kind: int):
    def span(x: Column) -> Column:
        # enough different characters, and no word that examples use
        lively = (F.size(F.array_distinct(F.split(x["value"], ""))) >= 6) & ~x["value"].rlike(EXAMPLE)
        return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"), F.sha2(x["value"], 256).alias("digest"), lively.alias("lively"))

    return span


def _spans(text: Column) -> Column:
    """Base spans and opaque candidates as (start, kind number, stop, digest, looks live)."""
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    parts = []
    for k, (pattern, group) in enumerate([(ASSIGN, 1), (ACCESS, 0), (HEX, 0), (OPAQUE, 0)]):
        found = _matches(text, pattern, group)
        if k == 0:
            found = F.filter(found, lambda x: F.length(x["value"]) >= MIN_ASSIGN)
        if k == 3:
            found = F.filter(found, lambda x: mixed(x["value"]))
        parts.append(F.transform(found, _tagged(k)))
    return F.array_sort(F.concat(*parts))


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat(name(x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, *, text_col: str, id_col: str, owner_col: str, repo_cols: list[str], whole: bool = False) -> DataFrame:
    """One narrow row for each document: its key, owner, repository and candidate spans, and if
    wanted the document itself as ``row``. The values of candidates are kept only as SHA-256
    digests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    needed = docs if whole else docs.select(*dict.fromkeys([id_col, text_col, owner_col, *repo_cols]))
    return spread(needed).select(
        row_key(F.col(id_col), F.col(text_col), owner, *[F.col(c) for c in repo_cols]).alias("row_key"),
        F.col(id_col).alias("id"),
        owner.alias("owner"),
        row_key(owner, *[F.col(c) for c in repo_cols]).alias("repo"),
        _spans(text).alias("spans"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """How many repositories and owners have each digest. Each step aggregates before it
    shuffles, so a value that a third of all documents hold is a few rows for each task."""
    per_repo = candidates.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repo.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_copies"))


def judged_spans(scanned: DataFrame, *, max_owners: int, max_repos: int) -> DataFrame:
    """For each row key with spans: all its spans with the numbers of owners and repositories and the
    verdict. ``live``: it looks live, and at most ``max_owners`` owners and ``max_repos`` repositories
    have it. Rows meet the numbers under as many salts as the session shuffles into."""
    salts = max(16, int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    total = scanned.agg(F.sum(F.size("spans"))).first()[0] or 0
    many = max(MANY_ROWS, total // MANY_DIGESTS)  # so there are MANY_DIGESTS at most that have more
    found = scanned.select("row_key", "owner", "repo", F.explode("spans").alias("x")).select("row_key", "owner", "repo", "x.*")
    counts = ownership(found)
    # A digest of few rows needs no salts.
    counts = counts.withColumn("salt", F.explode(F.when(F.col("n_copies") > many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    crowded = counts.where("salt = 0").select("digest").withColumn("crowded", F.lit(True))
    rows = found.dropDuplicates(["row_key", "start", "kind", "stop"]).join(F.broadcast(crowded), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int")).otherwise(-1)).drop("crowded")
    joined = rows.join(counts, ["digest", "salt"])
    live = F.col("lively") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    span = F.struct("start", "kind", "stop", live.alias("live"), "n_owners", "n_repos")
    return joined.groupBy("row_key").agg(F.array_sort(F.collect_list(span)).alias("judged"))


def find_secrets(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_cols: list[str] | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row for each document: ``id``, base counts, ``base``, ``spans`` and ``live`` (texts of
    spans), ``n_live`` and ``n_copied``, and for the spans listed, in order, by how many owners and
    repositories each is held: ``owners`` and ``repos``.

    Four kinds of candidates: values assigned to names of secrets, access keys, long hex runs and,
    beyond these, opaque tokens of mixed characters. Candidates are counted across the corpus by
    distinct repositories and owners. One that looks live, and that at most ``max_owners`` owners and
    ``max_repos`` repositories have, is ``live``; more widely copied ones are examples, be it by many
    owners or through all repositories of one. Base spans are always listed; an opaque token is
    listed only if it is live. A repository is an owner with the columns ``repo_cols``.

    Null texts are empty. A null owner is one owner of its own. Repeated rows each get a row, and
    the same result. Other columns are left out; join by ``id`` to have them.
    """
    scanned = staged(scan(docs, text_col=text_col, id_col=id_col, owner_col=owner_col, repo_cols=repo_cols or []), "secrets")
    return _report(scanned, judged_spans(scanned, max_owners=max_owners, max_repos=max_repos))


def _report(scanned: DataFrame, judged: DataFrame) -> DataFrame:
    all_spans = F.coalesce("judged", F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("stop"), F.lit(False).alias("live"), F.lit(0).cast("long").alias("n_owners"), F.lit(0).cast("long").alias("n_repos"))), lambda _: F.lit(False)))
    listed = F.filter("judged", lambda x: (x["kind"] < 3) | x["live"])
    numbers = lambda name: F.array_join(F.transform(listed, lambda x: x[name].cast("string")), ",")
    count = lambda k: F.size(F.filter("judged", lambda x: x["kind"] == k)).cast("long")
    return (
        scanned.select("row_key", "id")
        .join(judged, "row_key", "left")
        .withColumn("judged", all_spans)
        .select(
            "id",
            *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
            _written(F.filter("judged", lambda x: x["kind"] < 3)).alias("base"),
            _written(listed).alias("spans"),
            _written(F.filter("judged", lambda x: x["live"])).alias("live"),
            F.size(F.filter("judged", lambda x: x["live"])).cast("long").alias("n_live"),
            F.size(F.filter("judged", lambda x: ~x["live"] & (x["kind"] < 3))).cast("long").alias("n_copied"),
            numbers("n_owners").alias("owners"),
            numbers("n_repos").alias("repos"),
        )
    )


def mask_secrets(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_cols: list[str] | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mask: str = MASK) -> DataFrame:
    """``docs`` with every live span of the text replaced by ``mask``; overlapping spans become
    one. All rows and columns stay, whatever their names; texts without live spans, null ones too,
    are as they were. Only documents with candidates are shuffled."""
    scanned = staged(scan(docs, text_col=text_col, id_col=id_col, owner_col=owner_col, repo_cols=repo_cols or [], whole=True), "secrets")
    live = judged_spans(scanned, max_owners=max_owners, max_repos=max_repos).select("row_key", F.filter("judged", lambda x: x["live"]).alias("live")).where(F.size("live") > 0)
    text = F.col(f"row.`{text_col}`")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["stop"] <= acc["at"], acc["out"]).when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("live", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    suspect = scanned.where(F.size("spans") > 0).select("row_key", "row").join(live, "row_key", "left")
    new = F.when(F.col("live").isNull(), text).otherwise(masked)
    out = suspect.select(F.struct(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row"))
    return scanned.where(F.size("spans") == 0).select("row").unionAll(out).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), repo_cols=["lang"])
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "live", "n_live", "n_copied", "owners", "repos")


_ANY_CASE = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN_SQL = (_ANY_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").replace("'", "''")


def _kind_sql(kind: int, pattern: str, group: int, keep: str) -> str:
    """Matches of one kind with their places: gaps and matches, and a running sum of their lengths."""
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, (g - length(m))::BIGINT AS start, g::BIGINT AS stop, v FROM (
    SELECT doc_id, owner, repo, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (
    SELECT doc_id, source AS owner, source || '/' || lang AS repo, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v,
    unnest((string_split_regex(text, '{pattern}'))[1:len(regexp_extract_all(text, '{pattern}', 0))]) AS gap, unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS k FROM documents)) WHERE {keep}"""


_NAME_SQL = "['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || stop"
OP1_SQL = f"""WITH s AS ({_kind_sql(0, _ASSIGN_SQL, 1, "length(v) >= 12")} UNION ALL {_kind_sql(1, "AKIA[A-Z0-9]+", 0, "length(v) >= 18")}
UNION ALL {_kind_sql(2, "[0-9a-f]+", 0, "length(v) >= 16")} UNION ALL {_kind_sql(3, "[A-Za-z0-9+/_-]+", 0, "length(v) >= 24 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')")}),
o AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM s GROUP BY v),
j AS (SELECT s.*, n_owners, n_repos, n_owners <= 2 AND n_repos <= 3 AND len(list_distinct(string_split(v, ''))) >= 6 AND NOT regexp_matches(v, '{EXAMPLE}') AS live FROM s JOIN o USING (v)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAME_SQL}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({_NAME_SQL}, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    string_agg({_NAME_SQL}, ',' ORDER BY start, kind) FILTER (live) AS live, count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_copied,
    string_agg(n_owners::VARCHAR, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS owners, string_agg(n_repos::VARCHAR, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS repos FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(live, '') AS live, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(owners, '') AS owners, coalesce(repos, '') AS repos FROM documents LEFT JOIN a USING (doc_id)"""
