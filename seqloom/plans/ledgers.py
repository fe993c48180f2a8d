"""Queries of the ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import ledgers as op
from ..sources import fixtures as fx
from .registry import query

EXT = "png|jpg|jpeg|webp|bmp|tif|tiff"
STEM = f"regexp_replace(lower(regexp_extract(path, '([^/\\\\]*)$', 1)), '(\\.({EXT}))+$', '')"


@query("l01_missing_outputs", f"SELECT {STEM} AS stem, path FROM v_inputs WHERE {STEM} NOT IN (SELECT {STEM} FROM v_outputs WHERE regexp_matches(lower(path), '\\.({EXT})$'))")
def l01(spark, sf):
    return op.missing_outputs(fx.inputs(spark, sf), fx.outputs(spark, sf)).select("stem", "path")


@query("l02_output_defects", """b AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'absent' WHEN l_quantity < 3 THEN 'empty' END AS bad FROM lineitem),
g AS (SELECT l_orderkey, (l_orderkey % 6)::BIGINT AS want, count(*) AS n, min(l_partkey) FILTER (bad IS NOT NULL) AS at, arg_min(bad, l_partkey) FILTER (bad IS NOT NULL) AS first FROM b GROUP BY l_orderkey),
p AS (SELECT *, CASE WHEN want <= 0 THEN 'expected' WHEN n <> want THEN 'count' WHEN first IS NOT NULL THEN 'bad' END AS problem FROM g)
SELECT l_orderkey, problem, CASE WHEN problem = 'bad' THEN at END AS at FROM p""")
def l02(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_orderkey") % 6).alias("want"), (F.col("l_returnflag") != "R").alias("present"), F.when(F.col("l_quantity") < 3, 0).otherwise(1).alias("size"))
    # Line items of an order may name a part twice, so the kind of the first defect is not compared.
    out = op.output_defects(rows, ["l_orderkey"], "want", "present", "size", "l_partkey")
    return out.withColumn("problem", F.when(F.col("problem").isin("absent", "empty"), "bad").otherwise(F.col("problem")))


@query("l03_two_point_cost", "s AS (SELECT *, (tn - t1) / (n - 1) AS slope FROM v_prices) SELECT seq, round(slope, 6) AS slope, round(t1 - slope, 6) AS floor, round(CASE WHEN backend = 'unknown' THEN slope ELSE slope * 2073600 / pixels END, 6) AS at_reference FROM s")
def l03(spark, sf):
    pixels = F.when(F.col("backend") == "unknown", 0).otherwise(F.col("pixels"))
    slope, floor, ref = op.two_point_cost(F.col("t1"), F.col("tn"), F.col("n"), pixels)
    return fx.prices(spark, sf).select("seq", r6(slope).alias("slope"), r6(floor).alias("floor"), r6(ref).alias("at_reference"))


FIXTURE_BACKENDS = ["O", "F"]
FAULTS = """SELECT seq, n, backend, CASE WHEN seq % 37 = 0 THEN ' ' ELSE model END AS model, CASE WHEN seq % 23 = 0 THEN 0 ELSE scale END AS scale, CASE WHEN seq % 13 = 0 THEN 'nan'::DOUBLE WHEN seq % 19 = 0 THEN 0 ELSE t1 END AS t1,
CASE WHEN seq % 17 = 0 THEN 'inf'::DOUBLE ELSE tn END AS tn, CASE WHEN seq % 31 = 0 THEN 0 ELSE pixels END AS pixels, CASE WHEN seq % 29 = 0 THEN NULL ELSE machine END AS machine FROM v_prices"""
REJECT = "CASE WHEN trim(model) = '' THEN 'model' WHEN scale < 1 THEN 'scale' WHEN n < 4 THEN 'frames' WHEN isnan(t1) OR t1 <= 0 THEN 'time' WHEN isinf(tn) THEN 'sample_time' WHEN pixels <= 0 THEN 'pixels' WHEN machine IS NULL THEN 'machine' WHEN backend NOT IN ('O', 'F') THEN 'backend' WHEN NOT tn > t1 THEN 'order' WHEN tn - t1 < 0.15::DOUBLE * t1 THEN 'noise' WHEN (tn - t1) / (n - 1) <= 0.0005 OR (tn - t1) / (n - 1) > 120 THEN 'slope' END"


@query("l04_validate_measure", f"SELECT seq, {REJECT} AS reject FROM ({FAULTS})")
def l04(spark, sf):
    """Measurements with faults of every kind."""
    faulty = {"model": (37, F.lit(" ")), "scale": (23, F.lit(0)), "tn": (17, F.lit(float("inf"))), "pixels": (31, F.lit(0)), "machine": (29, F.lit(None))}
    p = fx.prices(spark, sf).withColumns({c: F.when(F.col("seq") % k == 0, v).otherwise(F.col(c)) for c, (k, v) in faulty.items()})
    p = p.withColumn("t1", F.when(F.col("seq") % 13 == 0, float("nan")).when(F.col("seq") % 19 == 0, 0.0).otherwise(F.col("t1")))
    return op.validate_measures(p, FIXTURE_BACKENDS).select("seq", "reject")


KEYS = ["model", "scale", "machine", "backend"]


@query("l05_upsert_latest", "SELECT model, scale, machine, backend, seq FROM v_prices QUALIFY row_number() OVER (PARTITION BY model, scale, machine, backend ORDER BY (seq % 3 = 0)::INT DESC, seq DESC) = 1")
def l05(spark, sf):
    p = fx.prices(spark, sf)
    return op.upsert_latest(p.where("seq % 3 <> 0"), p.where("seq % 3 = 0"), KEYS, "seq").select(*KEYS, "seq")


@query("l06_resolve_measure", """a AS (SELECT seq AS ask_id, model, CASE WHEN seq % 11 = 0 THEN 9 ELSE scale END AS scale, CASE WHEN seq % 4 = 0 THEN '99' WHEN seq % 9 = 2 THEN ' ' ELSE machine END AS machine, CASE WHEN seq % 10 = 1 THEN NULL ELSE backend END AS backend FROM v_prices),
b AS (SELECT model, scale, machine, CASE WHEN backend IN ('O', 'F') THEN lower(backend) END AS b, (measured_at, seq) AS at, round(t1, 6) AS v FROM v_prices WHERE NOT (machine = '3' AND backend = 'O') AND NOT (machine = '4' AND backend <> 'unknown') QUALIFY row_number() OVER (PARTITION BY model, scale, machine, backend ORDER BY measured_at DESC, seq DESC) = 1),
j AS (SELECT a.ask_id, a.backend, b.*, trim(a.machine) = '' OR a.machine = b.machine AS m, a.backend IS NULL OR b.b = lower(a.backend) AS k FROM a JOIN b ON a.model = b.model AND a.scale = b.scale WHERE a.backend IS NULL OR a.backend IN ('O', 'F')),
g AS (SELECT ask_id, any_value(backend) AS asked, arg_max(v, at) FILTER (m AND k) AS found, arg_max(machine, at) FILTER (NOT m) AS om, arg_max_null(b, at) FILTER (m AND k IS NOT TRUE) AS ob FROM j GROUP BY ask_id)
SELECT ask_id, found, om AS other_machine, CASE WHEN found IS NULL AND asked IS NOT NULL THEN ob END AS other_backend FROM a LEFT JOIN g USING (ask_id)""")
def l06(spark, sf):
    """One machine lacks a backend and one all that are known; asks have machines and scales that no
    record has, blank machines, and backends that are not known or not given."""
    p = fx.prices(spark, sf)
    machine = F.when(F.col("seq") % 4 == 0, "99").when(F.col("seq") % 9 == 2, " ").otherwise(F.col("machine"))
    asks = p.select(F.col("seq").alias("ask_id"), "model", F.when(F.col("seq") % 11 == 0, 9).otherwise(F.col("scale")).alias("scale"), machine.alias("machine"), F.when(F.col("seq") % 10 != 1, F.col("backend")).alias("backend"))
    book = p.where("NOT (machine = '3' AND backend = 'O') AND NOT (machine = '4' AND backend <> 'unknown')")
    return op.resolve_measure(asks, book.withColumn("t1", r6("t1")), "t1", backends=FIXTURE_BACKENDS)


@query("l07_perf_history", """r AS (SELECT model AS engine, scale, backend AS flag, seq, measured_at AS at, pixels / 1e6::DOUBLE AS area, seq % 5 AS version, tn AS seconds, n AS frames FROM v_prices)
SELECT engine, scale, greatest(1, least(40, round_even(area * 10, 0)::INT)) AS tier, flag, round(arg_max(seconds / frames / greatest(0.25::DOUBLE, area), (at, seq)), 6) AS cost FROM r WHERE version = 2 AND seconds > 0 GROUP BY ALL""")
def l07(spark, sf):
    runs = fx.prices(spark, sf).select(F.col("model").alias("engine"), "scale", F.col("backend").alias("flag"), "seq", F.col("measured_at").alias("at"), (F.col("pixels") / 1e6).alias("area"), (F.col("seq") % 5).alias("version"), F.col("tn").alias("seconds"), F.col("n").alias("frames"))
    return op.perf_history(runs, ["flag"], 2).withColumn("cost", r6("cost"))


@query("l08_strike_streak", """o AS (SELECT key, max((at, seq)) FILTER (ok) AS last FROM v_attempts GROUP BY key), s AS (SELECT key, count(*) FILTER (NOT a.ok AND (last IS NULL OR (a.at, a.seq) > last)) AS strikes FROM v_attempts a JOIN o USING (key) GROUP BY key)
SELECT key, strikes, strikes >= 2 AS broken FROM s""")
def l08(spark, sf):
    return op.strike_streak(fx.attempts(spark, sf), ["key"], ["at", "seq"], limit=2)


@query("l09_verdict_state", """n AS (SELECT key, at, note <> 'error' AND note <> 'purchase' AS ok, note = 'purchase' AS deny, row_number() OVER (PARTITION BY key ORDER BY at, seq) AS i FROM v_attempts WHERE note <> 'signup'),
f AS (SELECT key, i, at, ok, CASE WHEN ok THEN 0 WHEN deny THEN 3 ELSE 1 END AS failures FROM n WHERE i = 1
 UNION ALL SELECT n.key, n.i, n.at, n.ok, CASE WHEN n.ok THEN 0 WHEN n.deny THEN 3 WHEN NOT f.ok AND n.at - f.at BETWEEN 0 AND 604800 THEN f.failures + 1 ELSE 1 END FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
SELECT key, failures, at, ok, NOT ok AND failures >= 3 AS denied FROM f WHERE i = (SELECT max(i) FROM n WHERE n.key = f.key) AND 1706660000 - at BETWEEN 0 AND CASE WHEN ok THEN 86400 ELSE 604800 END""")
def l09(spark, sf):
    """Failures live for a week, successes for a day; attempts without a device are not booked."""
    rows = fx.attempts(spark, sf).withColumn("device", F.when(F.col("note") == "signup", -1).otherwise(0))
    return op.verdict_state(rows, ["key"], ["at", "seq"], F.lit(1_706_660_000), 604_800, 3, F.col("note") == "purchase", 86_400, "device").select("key", "failures", "at", "ok", "denied")


@query("l10_all_or_unknown", "SELECT c_custkey, bool_and(o_orderstatus <> 'P') AS \"all\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def l10(spark, sf):
    flags = fx.table(spark, sf, "customer").select("c_custkey").join(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "P").alias("f")), "c_custkey", "left")
    return op.all_or_unknown(flags, ["c_custkey"], "f")


@query("l11_verdict_lookup", """v AS (SELECT model AS engine, machine AS device, CASE WHEN scale = 1 THEN '' ELSE scale::VARCHAR END AS model, max(seq) % 3 <> 0 AS ok FROM v_prices WHERE machine <> '5' AND scale <> 3 GROUP BY ALL),
a AS (SELECT seq, model AS engine, machine AS device, scale::VARCHAR AS model FROM v_prices)
SELECT a.seq, coalesce(e.ok, w.ok) AS verdict FROM a LEFT JOIN v e ON e.engine = a.engine AND e.device = a.device AND e.model = a.model AND e.model <> '' LEFT JOIN v w ON w.engine = a.engine AND w.device = a.device AND w.model = ''""")
def l11(spark, sf):
    p = fx.prices(spark, sf)
    named = lambda model: [F.col("model").alias("engine"), F.col("machine").alias("device"), model.alias("model")]
    # One machine and one scale have no verdicts; those of scale 1 are the engine's.
    verdicts = p.where("machine <> '5' AND scale <> 3").select(*named(F.when(F.col("scale") == 1, "").otherwise(F.col("scale").cast("string"))), "seq")
    verdicts = verdicts.groupBy("engine", "device", "model").agg((F.max("seq") % 3 != 0).alias("ok"))
    asks = p.select("seq", *named(F.col("scale").cast("string")))
    return op.verdict_lookup(asks, verdicts).select("seq", "verdict")


AVG = "CASE WHEN done >= 4 AND elapsed >= 1 AND done < total THEN (total - done) * elapsed / done ELSE -1.0::DOUBLE END"
ETA = f"""q AS (SELECT *, lag(done, 5) OVER w AS d0, lag(elapsed, 5) OVER w AS t0, {AVG} AS av FROM v_progress WINDOW w AS (PARTITION BY job ORDER BY done)),
x AS (SELECT *, done / elapsed AS overall, CASE WHEN d0 > 0 AND d0 < done AND t0 > 0.2 AND elapsed > t0 THEN (done - d0) / (elapsed - t0) END AS recent, 0.8::DOUBLE * least(1, done / 60) AS w FROM q),
e AS (SELECT *, CASE WHEN av < 0 THEN -1.0::DOUBLE ELSE (total - done) / coalesce(w * recent + (1 - w) * overall, overall) + 30 END AS eta FROM x)"""


@query("l12_eta_average", f"SELECT job, done, round({AVG}, 3) AS eta FROM v_progress")
def l12a(spark, sf):
    return fx.progress(spark, sf).select("job", "done", F.round(op.eta_average(F.col("done"), F.col("total"), F.col("elapsed")), 3).alias("eta"))


@query("l12_eta_blended", f"{ETA} SELECT job, done, round(eta, 3) AS eta FROM e")
def l12b(spark, sf):
    return op.eta_blended(fx.progress(spark, sf), ["job"], "done", "total", "elapsed", 5, 30.0).select("job", "done", F.round("eta", 3).alias("eta"))


def eta_floor():
    return F.when(F.col("done") % 9 < 4, 0.0).otherwise((F.col("total") - F.col("done")) * 9000.0)


@query("l13_eta_shown", f"""{ETA}, fl AS (SELECT job, done, CASE WHEN done % 7 = 0 AND eta >= 0 THEN 0 ELSE eta END AS eta, CASE WHEN done % 9 < 4 THEN 0 ELSE (total - done) * 9000.0::DOUBLE END AS floor FROM e),
s AS (SELECT job, done, CASE WHEN eta >= 0 THEN greatest(eta, floor) END AS shown FROM fl WHERE done = 1 UNION ALL
 SELECT fl.job, fl.done, CASE WHEN eta < 0 THEN s.shown WHEN s.shown IS NULL OR s.shown <= 0 THEN greatest(eta, floor) ELSE greatest(least(s.shown, eta), floor) END FROM s JOIN fl ON fl.job = s.job AND fl.done = s.done + 1)
SELECT job, done, round(shown, 3) AS shown FROM s""")
def l13(spark, sf):
    """Estimates of 0 occur, after which a job's time may grow again."""
    rows = op.eta_blended(fx.progress(spark, sf), ["job"], "done", "total", "elapsed", 5, 30.0).withColumns({"floor": eta_floor(), "eta": F.when((F.col("done") % 7 == 0) & (F.col("eta") >= 0), 0.0).otherwise(F.col("eta"))})
    return op.eta_shown(rows, ["job"], "done", "eta", "floor").select("job", "done", F.round("shown", 3).alias("shown"))


@query("l14_top_reasons", """c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY source)
SELECT source, n, false AS rest FROM c WHERE k <= 5 UNION ALL SELECT NULL, sum(n)::BIGINT, true FROM c WHERE k > 5""")
def l14(spark, sf):
    return op.top_reasons(fx.table(spark, sf, "documents"), "source", 5)


@query("l15_sum_by_owner", "SELECT regexp_extract(s_name, '0*([0-9]?[0-9])[0-9]$', 1) AS owner, round(sum(s_acctbal), 6) AS used, round(greatest(0.0::DOUBLE, 50000 - sum(s_acctbal)), 6) AS free FROM supplier WHERE s_acctbal > 0 AND owner <> '' GROUP BY ALL")
def l15(spark, sf):
    return op.sum_by_owner(fx.table(spark, sf, "supplier"), "s_name", "s_acctbal", "0*([0-9]?[0-9])[0-9]$", 50_000).withColumns({"used": r6("used"), "free": r6("free")})


# Names of every kind: equal short ones, chains of which the middle one holds both ends, holders of
# known names, blank ones.
CARDS = """CASE c_custkey % 6 WHEN 0 THEN c_name || ' Ltd' WHEN 1 THEN upper(c_name) WHEN 2 THEN 'Card ' || (c_custkey % 7) WHEN 3 THEN 'Alpha-' || (c_custkey // 6) || '-Beta ' WHEN 4 THEN 'alpha-' || (c_custkey // 6) || '-beta gamma-' || (c_custkey // 6) || '-delta'
    ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE 'Gamma-' || (c_custkey // 6) || '-Delta' END END"""


@query("l16_missing_fuzzy", f"""a AS (SELECT id, trim(name) AS name, lower(trim(name)) AS k FROM (SELECT c_custkey AS id, {CARDS} AS name FROM customer) WHERE trim(name) <> ''),
b AS (SELECT DISTINCT lower(name) AS k FROM (SELECT c_name AS name FROM customer WHERE c_acctbal > 3000 UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) WHERE length(name) >= 8),
o AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE length(a.k) >= 8 AND (contains(a.k, b.k) OR contains(b.k, a.k)))),
g AS (SELECT i, id, name, k, true AS kept, [k] AS seen FROM o WHERE i = 1
 UNION ALL SELECT o.i, o.id, o.name, o.k, length(o.k) < 8 OR NOT list_bool_or(list_transform(g.seen, lambda s: contains(s, o.k) OR contains(o.k, s))),
 CASE WHEN length(o.k) < 8 OR list_bool_or(list_transform(g.seen, lambda s: contains(s, o.k) OR contains(o.k, s))) THEN g.seen ELSE list_append(g.seen, o.k) END FROM g JOIN o ON o.i = g.i + 1)
SELECT id, name FROM g WHERE kept""")
def l16(spark, sf):
    c = fx.table(spark, sf, "customer")
    key, group = F.col("c_custkey"), F.expr("cast(c_custkey div 6 AS string)")
    kinds = [
        F.concat("c_name", F.lit(" Ltd")),
        F.upper("c_name"),
        F.concat(F.lit("Card "), (key % 7).cast("string")),
        F.concat(F.lit("Alpha-"), group, F.lit("-Beta ")),
        F.concat(F.lit("alpha-"), group, F.lit("-beta gamma-"), group, F.lit("-delta")),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.concat(F.lit("Gamma-"), group, F.lit("-Delta"))),
    ]
    a = c.select(key.alias("id"), F.element_at(F.array(*kinds), (key % 6 + 1).cast("int")).alias("name"))
    others = [c.where("c_acctbal > 3000").select(F.col("c_name").alias("name")), fx.table(spark, sf, "nation").select(F.col("n_name").alias("name")), fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"))]
    return op.missing_fuzzy(a, others, "name", "id").select("id", "name")


@query("l17_rank_top", "SELECT c_custkey, c_acctbal AS score FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def l17(spark, sf):
    return op.rank_top(fx.table(spark, sf, "customer"), F.col("c_acctbal"), "c_custkey", 25).select("c_custkey", "score")


@query("l17_rank_top_per_key", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer QUALIFY rank <= 3")
def l17b(spark, sf):
    return op.rank_top(fx.table(spark, sf, "customer"), F.col("c_acctbal"), "c_custkey", 3, ["c_nationkey"]).select("c_nationkey", "c_custkey", "rank")
