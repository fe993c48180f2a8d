"""Merkle manifest of a dataset: digests of rows, of groups and of the whole, with proofs.

A tree of sixteen-way nodes stands over the rows of each group, another over the groups. The trees
are made and taken apart as nested structs of bounded blocks. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import ascii_lower, spread, staged, table

#: Children of a node, and levels that one block nests: a block holds ``FAN ** LEVELS`` nodes.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over fields, each ``-`` if null, else its bytes in UTF-8 after their number and a colon."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` (written out before) with ``rank``, their place in their group from 0, and ``size``, the
    group's number of rows; and the largest size. Nulls come first; rows that agree in all of
    ``order`` are the same.

    A scan in two levels: rows are dealt out by ranges, ranks within a range come from a window over
    it, and what earlier ranges hold from their counts. So a group may be larger than a task."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_salt", F.rand(7)).repartitionByRange(n, *by, *order, "_salt").drop("_salt")
    dealt = staged(dealt.withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(group)})
    counts = staged(counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), "_before", "size"), f"{name}-sizes")
    # A null group is a group too.
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    found = dealt.withColumn("_place", place).join(counts, condition)
    found = found.withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before", "_at", *[f"_{c}" for c in by])
    return found, counts.agg(F.max("size")).first()[0] or 0


def _rolled(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of nodes (``by``, ``rank``, ``size``, ``digest`` and any ``payload``): a row for each
    ``BLOCK`` in a row of a group, with its own ``rank``, ``size``, ``digest`` and, as ``tree``, the nodes
    nested in structs. The digits of the rank are grouped away one after the other, all in the one
    shuffle by block. A level whose group has a single node is passed on as it is."""
    digits = [F.pmod(F.shiftright("rank", 4 * k), F.lit(FAN)).cast("int").alias(f"_d{k}") for k in range(LEVELS)]
    rows = nodes.select(*by, "size", F.shiftright("rank", 4 * LEVELS).alias("_block"), *digits, F.struct("digest", "payload").alias("_node"))
    rows = rows.repartition(*by, "_block")
    for k in range(LEVELS):
        left = [f"_d{j}" for j in range(LEVELS - 1, k, -1)]
        rows = rows.groupBy(*by, "size", "_block", *left).agg(F.array_sort(F.collect_list(F.struct(F.col(f"_d{k}").alias("digit"), "_node"))).alias("_run"))
        kids = F.transform("_run", lambda x: x["_node"])
        own = F.transform(kids, lambda x: x["digest"])
        several = F.col("size") > FAN**k
        rows = rows.withColumn("_node", F.struct(F.when(several, joined_digest(own)).otherwise(own[0]).alias("digest"), kids.alias("kids"))).drop("_run")
    up = F.ceil(F.col("size") / BLOCK).cast("long")
    return rows.select(*by, F.col("_block").alias("rank"), up.alias("size"), F.col("size").alias("of"), F.col("_node.digest").alias("digest"), F.col("_node.kids").alias("tree"))


def _steps(several: Column, kids: Column, at: Column) -> Column:
    """The siblings before and after a node, where its level has several nodes."""
    own = F.transform(kids, lambda x: x["digest"])
    before, after = F.slice(own, F.lit(1), at), F.slice(own, at + 2, F.lit(FAN))
    step = F.array(F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right")))
    return F.when(several, step).otherwise(F.slice(step, F.lit(1), F.lit(0)))


def _unrolled(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The nodes of blocks again, each with its ``path``: its siblings level by level, then those of its
    block (the column ``above``). No join: a transform over the nested structs and an explode."""

    def nodes(run: Column, j: Column) -> Column:
        upper = _steps(F.col("of") > FAN, F.col("tree"), j)
        return F.transform(
            run["kids"],
            lambda x, i: F.struct((F.col("rank") * BLOCK + j * FAN + i).alias("rank"), x["digest"].alias("digest"), x["payload"].alias("payload"), F.concat(_steps(F.col("of") > 1, run["kids"], i), upper).alias("path")),
        )

    found = F.flatten(F.transform("tree", nodes))
    out = blocks.select(*by, "above", F.explode(found).alias("_x"))
    return out.select(*by, "_x.rank", "_x.digest", "_x.payload", F.concat("_x.path", "above").alias("path"))


def tree(nodes: DataFrame, largest: int, by: Sequence[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The tops (``by``, ``digest``) of the trees over the ranked nodes of each group, ``largest`` at most,
    and the blocks of every level, lowest first. Each level is written out; it has a ``BLOCK``-th of the rows below."""
    levels = [staged(_rolled(nodes, by), name)]
    while (largest := -(-largest // BLOCK)) > 1:
        levels.append(staged(_rolled(levels[-1].select(*by, "rank", "size", "digest", F.lit(None).cast("int").alias("payload")), by), name))
    return levels[-1].select(*by, "digest"), levels


def paths(levels: list[DataFrame], by: Sequence[str], above: DataFrame | None = None) -> DataFrame:
    """The nodes under ``levels`` with their whole paths up to the tops, followed by ``above.above`` of
    their group. Only rows of blocks are joined, with the paths of those over them; the one block at
    the top of an ungrouped tree needs no join."""

    def under(blocks: DataFrame, keys: Sequence[str], upper: DataFrame) -> DataFrame:
        upper = upper.select(*[F.col(k).alias(f"_{k}") for k in keys], "above")
        condition = F.lit(True)
        for k in keys:
            condition = F.col(k).eqNullSafe(F.col(f"_{k}")) & condition
        return _unrolled(blocks.join(upper, condition).drop(*[f"_{k}" for k in keys]), by)

    found = _unrolled(levels[-1].withColumn("above", F.array().cast(PATH)), by) if above is None else under(levels[-1], by, above)
    for level in reversed(levels[:-1]):
        found = under(level, [*by, "rank"], found.withColumnRenamed("path", "above"))
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, from the leaf up, left to right."""
    return joined_digest(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def manifest(docs: DataFrame, *, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", given: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``leaf`` (digest of the columns ``fields``), ``subroot`` (of its
    group), ``root`` (of the dataset), ``path`` (what was left and right of it on each level, digests as
    text) and ``given``, a leaf to be judged against them, if there is one, else the leaf itself.

    In a group leaves ascend by id; groups ascend bytewise, the null one first. While there are several
    nodes, each sixteen in a row become the digest of their digests; a lone node is the top as it
    is. Rows that share an id come in the order of their digests, rows without one first; repeated
    rows each have a leaf of their own. A null and an empty text differ. An empty table has no rows
    and no root. Other columns are left out.

    Texts are read once; only digests are shuffled. Ranks come from ranges, so that one group may
    hold any share of the rows, and what is gathered is never more than ``BLOCK`` rows."""
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in fields])
    rows = spread(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), leaf.alias("leaf"), *([] if given is None else [given.alias("given")]))
    rows = rows if given is not None else rows.withColumn("given", F.col("leaf"))
    # What is given is kept only where it differs.
    rows = staged(rows.withColumn("given", F.when(F.col("given") != F.col("leaf"), F.col("given"))), "leaves")
    nodes, largest = ranked(rows, ["group"], ["id", "leaf"], "ranked")
    nodes = nodes.select("group", "rank", "size", F.col("leaf").alias("digest"), F.struct("id", "given").alias("payload"))
    subroots, levels = tree(nodes, largest, ["group"], "groups")
    tops, largest = ranked(staged(subroots, "subroots"), [], ["group"], "tops")
    roots, upper = tree(tops.select("rank", "size", "digest", F.struct("group").alias("payload")), largest, [], "top")
    top = roots.first()  # one row, if there is any
    root = F.lit(top["digest"] if top else None).cast("string")
    groups = staged(paths(upper, []).select(F.col("payload.group").alias("group"), F.col("digest").alias("subroot"), root.alias("root"), F.col("path").alias("above")), "above")
    found = paths(levels, ["group"], groups.select("group", "above"))
    found = found.join(groups.select(F.col("group").alias("_group"), "subroot", "root"), F.col("group").eqNullSafe(F.col("_group")))
    return found.select(F.col("payload.id").alias("id"), F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("payload.given", "digest").alias("given"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth id or so has its text tampered with: A-Z become lower case."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    given = F.when(hit, leaf_digest(*fields[:-1], ascii_lower(F.col("text"))))
    found = manifest(docs, fields=FIELDS, given=given)
    root = folded(F.col("given"), F.col("path"))
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(rows: str, columns: str, text: str, name: str = "crc") -> str:
    """Common table expressions that give ``h``, the unsigned CRC-32 of a text in UTF-8, for ``columns`` of
    ``rows``: byte by byte, by a table of 256 remainders."""
    step = lambda x: f"CASE WHEN ({x}) & 1 = 1 THEN xor(({x}) >> 1, 3988292384::BIGINT) ELSE ({x}) >> 1 END"
    return f"""{name}_bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, {step("v")}, k + 1 FROM {name}_bits WHERE k < 8),
{name}_tab AS MATERIALIZED (SELECT i, v FROM {name}_bits WHERE k = 8),
{name}_text AS MATERIALIZED (SELECT {columns}, hex(encode({text})) AS x FROM {rows}),
{name}_walk AS (SELECT {columns}, x, 0 AS p, 4294967295::BIGINT AS c FROM {name}_text
  UNION ALL SELECT {columns}, x, p + 1, xor(c >> 8, v) FROM {name}_walk JOIN {name}_tab ON i = (xor(c, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) & 255) WHERE 2 * p < length(x)),
{name} AS MATERIALIZED (SELECT {columns}, xor(c, 4294967295::BIGINT) AS h FROM {name}_walk WHERE 2 * p = length(x))"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _levels_sql(name: str, key: str, n: int) -> str:
    """Nodes of ``n`` levels over ``{name}0`` (key, i, h), and runs ``{name}r{k}`` with their digests in order."""
    out, by = [], f"{key}, " if key else ""
    for k in range(n):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT {by}i // 16 AS run, list(h ORDER BY i) AS hs, max(m) AS m FROM (SELECT *, count(*) OVER ({f'PARTITION BY {key}' if key else ''}) AS m FROM {name}{k}) GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {by}run AS i, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k})")
    return ",\n".join(out)


_GROUP_LEVELS, _TOP_LEVELS = 5, 3


def _fold_sql() -> str:
    """One row a document with the siblings of each level taken in, from the leaf up."""
    out, rows = [], "f0"
    for k, (name, at) in enumerate([*[("a", k) for k in range(_GROUP_LEVELS)], *[("b", k) for k in range(_TOP_LEVELS)]]):
        place = "i" if name == "a" else "gi"
        join = f"{name}r{at} r ON r.run = f.{place} // 16" + (" AND r.source IS NOT DISTINCT FROM f.source" if name == "a" else "")
        left, right = (f"array_to_string(r.hs[{x}], '')" for x in (f"1:f.{place} % 16", f"f.{place} % 16 + 2:16"))
        moved = f"f.i // 16 AS i, f.gi" if name == "a" else "f.i, f.gi // 16 AS gi"  # noqa: F541
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT f.doc_id, f.source, f.leaf, {moved}, CASE WHEN r.m > 1 THEN f.proof || {left} || {right} ELSE f.proof END AS proof, CASE WHEN r.m > 1 THEN sha256({left} || f.acc || {right}) ELSE f.acc END AS acc FROM {rows} f JOIN {join})")
        rows = f"f{k + 1}"
    return ",\n".join(out)


_LAST = _GROUP_LEVELS + _TOP_LEVELS
#: For a million rows a source and 4,096 sources.
OP11_SQL = f"""WITH RECURSIVE {crc32_sql("(SELECT DISTINCT doc_id FROM documents)", "doc_id", "doc_id::VARCHAR")},
l AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN h % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS given FROM documents LEFT JOIN crc USING (doc_id)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
a0 AS (SELECT source, i, leaf AS h FROM o), {_levels_sql("a", "source", _GROUP_LEVELS)},
g AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gi FROM a{_GROUP_LEVELS}),
b0 AS (SELECT gi AS i, subroot AS h FROM g), {_levels_sql("b", "", _TOP_LEVELS)},
f0 AS (SELECT o.doc_id, o.source, o.leaf, o.i, g.gi, '' AS proof, coalesce(given, leaf) AS acc FROM o JOIN g ON g.source IS NOT DISTINCT FROM o.source),
{_fold_sql()}
SELECT f.doc_id, f.leaf, g.subroot, b{_TOP_LEVELS}.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = b{_TOP_LEVELS}.h AS verified
FROM f{_LAST} f JOIN g ON g.source IS NOT DISTINCT FROM f.source, b{_TOP_LEVELS}"""
