"""Sources, sinks and the parsing of attribute text, ledgers and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import Names, over

# Endings of the files that count.
KINDS = {
    "image": ["png", "jpg", "jpeg", "jfif", "webp", "bmp", "tif", "tiff", "gif", "avif"],
    "video": ["mp4", "mkv", "mov", "webm", "avi", "m4v", "ts", "m2ts", "flv", "wmv", "mpg", "mpeg", "rmvb", "3gp"],
}
PRICE_SCHEMA = "struct<schema:int,prices:array<struct<modelKey:string,engineScale:int,secondsPerFrame:double,samplePixels:bigint,sampleFrames:int,floorSeconds:double,sampleSeconds:double,measuredAtUtc:string,machineKey:string,backend:string,note:string>>,_bad:string>"


def media_catalog(spark: SparkSession, roots: Sequence[str], kind: str = "image", max_files: int = 2000, max_depth: int = 6, folders: bool = False) -> DataFrame:
    """Files of a kind among the roots: ``path``, ``depth``, ``length`` and time. See :func:`catalog_of` for
    their order. Roots that are files are kept whatever their ending; those that are folders have
    their files listed only with ``folders``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).select("path", "length", "modificationTime")
    return catalog_of(files, roots, kind, max_files, max_depth, folders)


def catalog_of(files: DataFrame, roots: Sequence[str], kind: str, max_files: int, max_depth: int, folders: bool = False) -> DataFrame:
    """The first ``max_files`` of the files that lie under the roots at most ``max_depth`` folders deep
    and have an ending of the kind, or are roots themselves. Roots come in the order given; within
    one, nearer folders first, then by folder and name. Case matters neither for endings nor for
    order, nor for paths that repeat, of which the first stays. Without ``folders`` only roots that
    are files count."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    tops = [r.rstrip("/") for r in roots]
    under = F.coalesce(*[F.when((plain == r) | plain.startswith(r + "/"), F.struct(F.lit(i).alias("root"), F.lit(len(r)).alias("at"))) for i, r in enumerate(tops)])
    rows = files.withColumn("_in", under).where("_in IS NOT NULL").withColumn("_rest", F.substring(plain, F.col("_in.at") + 1, F.length("path")))
    rows = rows.withColumn("depth", F.greatest(F.size(F.split("_rest", "/")) - 2, F.lit(0)))
    rows = rows.where((F.col("_rest") == "") | (F.lit(folders) & (F.col("depth") <= max_depth) & F.lower("path").rlike(rf"\.({'|'.join(KINDS[kind])})$")))
    rows = rows.withColumns({"dir": F.lower(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    order = [F.col("_in.root"), F.col("depth"), F.split(F.upper("dir"), "/"), F.upper("name"), F.col("path")]
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy(F.upper("path")).orderBy(*order))).where("_k = 1")
    return once.orderBy(*order).limit(max_files).drop("_k", "_in", "_rest")


def kv_fields(df: DataFrame, id_cols: Names, text: str, keys: Sequence[str]) -> DataFrame:
    """Value of the first line of each key that has one other than ``N/A`` or ``unknown``."""
    lines = df.select(*id_cols, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.withColumns({"key": F.regexp_extract("line", "^([^=]*)=", 1), "value": F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1))})
    good = lines.where(F.col("key").isin(list(keys)) & (F.col("value") != "") & ~F.lower("value").isin("n/a", "unknown"))
    return good.groupBy(*id_cols, "key").agg(F.min_by("value", "pos").alias("value"))


def rate_field(col: Column) -> Column:
    """Rate of ``a/b`` or of a plain positive number; null for anything else."""
    a, b = F.split(col, "/")[0].try_cast("double"), F.get(F.split(col, "/"), 1).try_cast("double")
    plain = col.try_cast("double")
    return F.when(col.contains("/"), F.when(b > 0, a / F.when(b > 0, b))).when(plain > 0, plain)


def content_duration(n: Column, fps: Column) -> Column:
    """Time from the first to the last frame, of one frame if there is no more; null if tiny."""
    d = F.when(n >= 2, (n - 1) / F.when(fps > 0, fps)).otherwise(1 / F.when(fps > 0, fps))
    return F.when(d > 0.01, d)


#: White space at either end.
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _one_line(text: Column) -> Column:
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\r\n", "   "))


def parse_verdicts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a verdict ledger's lines, without blanks around them; comments and bad lines go. A
    verdict is ``true`` or ``false`` in any case."""
    trimmed = F.regexp_replace(line, _ENDS, "")
    f = F.split("_line", "\t")
    part = lambda i: F.trim(F.get(f, i))
    ok = F.lower(part(1))
    rows = lines.withColumn("_line", trimmed).where((F.col("_line") != "") & ~F.col("_line").startswith("#")).select(
        part(0).alias("key"),
        F.when(ok == "true", True).when(ok == "false", False).alias("ok"),
        part(2).try_cast("int").alias("failures"),
        part(3).try_cast("bigint").alias("at"),
        _one_line(F.get(f, 4)).alias("note"),
        *[c for c in lines.columns if c not in (line, "key", "ok", "failures", "at", "note")],
    )
    good = rows.where("key <> '' AND ok IS NOT NULL AND failures >= 0 AND at > 0")
    return good.withColumn("failures", F.when(F.col("ok"), 0).otherwise(F.col("failures")))


SIGNATURE = "# sig="


def read_verdict_tsv(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """A ledger's rows, the last of each key, whose case does not matter. With a ``signature`` other than
    the one that the ledger has, if it has one, all of them count as never made."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_n"))
    if signature and signature.strip():
        signed = F.regexp_replace("value", _ENDS, "").startswith(SIGNATURE)
        first = lines.where(signed).agg(F.min_by(F.regexp_replace("value", _ENDS, ""), "_n")).first()[0]
        stored = (first or "")[len(SIGNATURE) :].strip()
        if stored and stored.lower() != " ".join(signature.translate(str.maketrans("\t\r\n", "   ")).split(" ")).strip().lower():
            lines = lines.limit(0)
    rows = parse_verdicts(lines)
    return rows.groupBy(F.lower("key").alias("_key")).agg(F.max_by(F.struct("key", "ok", "failures", "at", "note"), "_n").alias("_last")).select("_last.*")


def verdict_lines(verdicts: DataFrame, signature: str | None = None) -> DataFrame:
    """``part``, ``key`` and ``line``: a header, a signature if there is one, then a line for each row with a
    key, by key. A success has no failures; breaks and tabs in texts become blanks."""
    head = ["# key\tok\tfailures\tat\tnote", *([SIGNATURE + signature] if signature else [])]
    top = verdicts.sparkSession.createDataFrame([(i, "", t) for i, t in enumerate(head)], "part int, key string, line string")
    failures = F.when(F.col("ok"), 0).otherwise(F.greatest(F.lit(0), F.col("failures")))
    line = F.concat_ws("\t", _one_line(F.col("key")), F.when(F.col("ok"), "True").otherwise("False"), failures.cast("string"), F.col("at").cast("string"), _one_line(F.col("note")))
    return top.unionByName(verdicts.where(F.trim("key") != "").select(F.lit(len(head)).alias("part"), "key", line.alias("line")))


def write_verdict_tsv(verdicts: DataFrame, path: str, signature: str | None = None) -> None:
    """Writes a ledger; its files, in order of their names, are the ordered lines."""
    lines = verdict_lines(verdicts, signature)
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def read_price_json(df: DataFrame, text: str, backends: Sequence[str]) -> DataFrame:
    """Measurements in JSON texts of schema 1, which is that of texts that name none; bad entries go one
    by one, texts that are broken or hold a value of a wrong kind whole. Backends are compared in
    lower case without blanks around them."""
    book = F.from_json(text, PRICE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    rows = df.select(book.alias("b")).where("b._bad IS NULL AND coalesce(b.schema, 1) = 1").select(F.inline("b.prices"))
    rows = rows.select(F.col("modelKey").alias("model"), F.col("engineScale").alias("scale"), *rows.columns[2:])
    rows = rows.withColumns({"machineKey": F.trim("machineKey"), "backend": F.lower(F.trim("backend"))})
    finite = F.coalesce(~F.isnan("secondsPerFrame") & (F.abs("secondsPerFrame") < float("inf")), F.lit(False))
    return rows.where((F.trim("model") != "") & (F.col("scale") >= 1) & (F.col("samplePixels") > 0) & (F.col("sampleFrames") > 0) & finite & (F.col("secondsPerFrame") > 0) & (F.col("machineKey") != "") & F.col("backend").isin([b.lower() for b in backends]))


def to_price_json(prices: DataFrame, by: Names) -> DataFrame:
    """A JSON text of schema 1 for each key, entries in order."""
    names = {"model": "modelKey", "scale": "engineScale"}
    entry = F.struct(*[F.col(c).alias(names.get(c, c)) for c in prices.columns if c not in by])
    return prices.groupBy(*by).agg(F.to_json(F.struct(F.lit(1).alias("schema"), F.array_sort(F.collect_list(entry)).alias("prices"))).alias("json"))


def log_lines(df: DataFrame, line: str) -> DataFrame:
    """``time``, ``level`` and ``message`` of log lines; lines of another form have nulls."""
    form = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] \[([A-Z]+)\] (.*)$"
    part = lambda i: F.when(F.col(line).rlike(form), F.regexp_extract(line, form, i))
    return df.withColumns({"time": F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd HH:mm:ss")), "level": part(2), "message": part(3)})


def retain_log(df: DataFrame, by: Names, order: str, line: str, cutoff: Column, max_bytes: int) -> DataFrame:
    """Lines at or after the cutoff, or without a time, and of them the newest up to a size; the line
    that crosses it stays."""
    rows = log_lines(df, line).where(F.col("time").isNull() | (F.col("time") >= cutoff))
    newer = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_newer", F.coalesce(F.sum(F.length(line) + 2).over(newer), F.lit(0))).where(F.col("_newer") < max_bytes).drop("_newer")


def dir_usage(df: DataFrame, root: str, size: str, mtime: str) -> DataFrame:
    return df.groupBy(root).agg(F.sum(size).alias("bytes"), F.max(mtime).alias("newest"))


def keep_live(usage: DataFrame, now: Column, window: float) -> DataFrame:
    """``keep``: the newest change is within the window, or is not known; none if there is no window."""
    live = F.when(F.lit(window <= 0), False).when(F.col("newest").isNull(), True).otherwise(now - F.col("newest") < window)
    return usage.withColumn("keep", live)


def image_summary(cells: DataFrame, grid: Names) -> DataFrame:
    """Integer means of the channels and the luma of those."""
    rows = cells.groupBy(*grid).agg(*[F.floor(F.avg(c)).alias(c) for c in "rgb"])
    return rows.withColumn("luma", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))


def unique_names(df: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``unique_name``: later names that repeat in a folder get `` (2)``, `` (3)`` before the ending.
    With ``taken``, names there count as earlier ones, and no new name meets another.

    Without it a name's number is its place among those that are equal. With it, the numbers that
    are free for a name are ranked, and its k-th occurrence gets the k-th of them; own names keep
    themselves before any that are made. One pass, however many names meet."""
    ending = r"(\.[^.]*)?$"
    k = F.row_number().over(over([folder, name], [order]))
    numbered = lambda n: F.when(n == 1, F.col(name)).otherwise(F.concat(F.regexp_extract(name, "^(.*?)" + ending, 1), F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract(name, "^(.*?)" + ending, 2)))
    if taken is None:
        return df.withColumn("_k", k).withColumn("unique_name", numbered(F.col("_k"))).drop("_k")
    # Names that are not free to be made: those taken, and those that rows of their own have.
    made = r"^(.*?) \((\d{1,9})\)(\.[^.]*)?$"
    used = taken.select(F.col(folder), F.col(name)).unionAll(df.select(folder, name)).distinct()
    blocked = used.where(F.col(name).rlike(made)).select(folder, F.concat(F.regexp_extract(name, made, 1), F.regexp_extract(name, made, 3)).alias(name), F.regexp_extract(name, made, 2).alias("_text"))
    blocked = blocked.withColumn("_n", F.col("_text").cast("long")).where((F.col("_n") >= 2) & (F.col("_n").cast("string") == F.col("_text"))).select(folder, name, "_n")
    whole = taken.select(F.col(folder), F.col(name), F.lit(1).cast("long").alias("_n")).distinct()
    # The k-th number that is free is k and one for each blocked one with fewer than k free ones below
    # it: blocked ones and rows in one order by how many free ones are below, blocked ones counted.
    blocked = blocked.unionAll(whole).distinct().withColumn("_j", F.row_number().over(over([folder, name], ["_n"])))
    kinds = dict(df.dtypes)
    marks = blocked.select(folder, name, (F.col("_n") - F.col("_j")).alias("_below"), F.lit(0).alias("_row"), *[F.lit(None).cast(kinds[c]).alias(c) for c in df.columns if c not in (folder, name)])
    rows = df.withColumn("_below", (k - 1).cast("long")).withColumn("_row", F.lit(1)).select(*marks.columns)
    passed = F.count_if(F.col("_row") == 0).over(over([folder, name], ["_below", "_row"]).rowsBetween(Window.unboundedPreceding, 0))
    found = marks.unionByName(rows).withColumn("_k", F.col("_below") + 1 + passed).where(F.col("_row") == 1)
    return found.withColumn("unique_name", numbered(F.col("_k"))).select(*df.columns, "unique_name")
