"""Operators on ledgers: audits of outputs, measurements, attempts, verdicts and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import Names, clamp, finite, fold, gathered, ordered_fold, over
from ..sources.scratch import staged

#: File endings that count as output images.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]
#: Backends whose times count.
BACKENDS = ["ncnn-vulkan", "onnx-dml", "onnx-cpu"]


def backend_name(col: str, backends: Sequence[str]) -> Column:
    """The backend in lower case without blanks around it; null if it is none of those known."""
    name = F.lower(F.trim(col))
    return F.when(name.isin([b.lower() for b in backends]), name)


def stem(path: Column) -> Column:
    """File name without its folder and without any image endings, in lower case."""
    name = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.regexp_replace(F.lower(name), rf"(\.({'|'.join(IMAGE_EXTENSIONS)}))+$", "")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_EXTENSIONS)})$")


def missing_outputs(inputs: DataFrame, outputs: DataFrame, path: str = "path") -> DataFrame:
    """Inputs without an output image of the same stem. Blank stems are not reported."""
    made = outputs.where(is_image(F.col(path))).select(stem(F.col(path)).alias("stem")).distinct()
    wanted = inputs.withColumn("stem", stem(F.col(path)))
    return wanted.where(F.trim("stem") != "").join(made, "stem", "left_anti")


def output_defects(outputs: DataFrame, by: Names, expected: str, present: str, size: str, order: str) -> DataFrame:
    """The first thing wrong with each group of outputs, and the first bad one; null if none is."""
    bad = F.when(~F.col(present), "absent").when(F.col(size) <= 0, "empty")
    rows = outputs.withColumn("_bad", bad)
    g = rows.groupBy(*by).agg(F.max(expected).alias("want"), F.count(order).alias("n"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col(order))).alias("first"), F.min(F.when(F.col("_bad").isNotNull(), F.col(order))).alias("at"))
    problem = F.when(F.col("want") <= 0, "expected").when(F.col("n") == 0, "none").when(F.col("n") != F.col("want"), "count").otherwise(F.col("first"))
    return g.withColumn("problem", problem).select(*by, "problem", F.when(F.col("problem").isin("absent", "empty"), F.col("at")).alias("at"))


def two_point_cost(t1: Column, tn: Column, n: Column, pixels: Column, reference: int = 2_073_600) -> tuple[Column, Column, Column]:
    """Seconds a frame, fixed seconds, and seconds a frame at a reference size, from the times of
    one frame and of ``n``. Without a size the seconds a frame stand as they are."""
    slope = F.when(n >= 2, (tn - t1) / F.when(n >= 2, n - 1)).otherwise(0.0)
    floor = F.when(n >= 2, t1 - slope).otherwise(0.0)
    return slope, floor, F.when(pixels > 0, slope * reference / F.when(pixels > 0, pixels)).otherwise(slope)


def validate_measures(df: DataFrame, backends: Sequence[str] = BACKENDS) -> DataFrame:
    """``reject``: the first rule that a measurement breaks, null if it is accepted. What is missing
    breaks a rule too, and times that are not finite do, and backends other than those known."""
    slope, _, _ = two_point_cost(F.col("t1"), F.col("tn"), F.col("n"), F.col("pixels"))
    no = lambda good: ~F.coalesce(good, F.lit(False))
    time = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    rule = (
        F.when(no(F.trim("model") != ""), "model")
        .when(no(F.col("scale") >= 1), "scale")
        .when(no(F.col("n") >= 4), "frames")
        .when(no(time("t1")), "time")
        .when(no(time("tn")), "sample_time")
        .when(no(F.col("pixels") > 0), "pixels")
        .when(no(F.trim("machine") != ""), "machine")
        .when(no(backend_name("backend", backends).isNotNull()), "backend")
        .when(~(F.col("tn") > F.col("t1")), "order")
        .when(F.col("tn") - F.col("t1") < 0.15 * F.col("t1"), "noise")
        .when((slope <= 0.0005) | (slope > 120), "slope")
    )
    return df.withColumn("reject", rule)


def upsert_latest(book: DataFrame, new: DataFrame, keys: Names, arrival: str) -> DataFrame:
    """The book with new rows in place of those with the same keys; of several the last to arrive."""
    both = book.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(arrival))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_new")


def resolve_measure(asks: DataFrame, book: DataFrame, value: str, ask_id: str = "ask_id", backends: Sequence[str] = BACKENDS) -> DataFrame:
    """For each ask (model, scale, machine, backend) the newest record that fits: ``found``. A null or
    blank machine fits all, and so does a null backend; one that is not among ``backends`` fits none
    and gets no answer at all. Besides, ``other_machine``: the machine of the newest record that any
    other machine has for the model and scale, whatever its backend; and, if nothing was found and
    a backend was asked for, ``other_backend``: that of the newest record of the asked machine.

    Asks meet sums by equal keys only: the newest record by all four keys, by three and by two, and the
    newest two machines of a model and scale, of which one is another than the asked one."""
    newest = F.struct("measured_at", "seq")
    machine = F.coalesce(F.trim("machine"), F.lit(""))
    records = book.select("model", "scale", machine.alias("_m"), backend_name("backend", backends).alias("_b"), newest.alias("at"), F.col(value).alias("v"))
    records = records.groupBy("model", "scale", "_m", "_b").agg(F.max(F.struct("at", "v")).alias("_one"))
    at, v = F.col("_one.at").alias("at"), F.col("_one.v").alias("v")
    by_machine = records.groupBy("model", "scale", "_m").agg(F.max(F.struct(at, F.col("_b").alias("b"), v)).alias("_own"))
    by_backend = records.groupBy("model", "scale", "_b").agg(F.max("_one").alias("_same"))
    # The newest of each model and scale, and the newest that another machine than that one's has.
    top = by_machine.groupBy("model", "scale").agg(F.max(F.struct(F.col("_own.at").alias("at"), F.col("_m").alias("m"), F.col("_own.b").alias("b"), F.col("_own.v").alias("v"))).alias("_top"))
    next_ = by_machine.join(top, ["model", "scale"]).where(F.col("_m") != F.col("_top.m"))
    next_ = next_.groupBy("model", "scale").agg(F.max(F.struct(F.col("_own.at").alias("at"), F.col("_m").alias("m"))).alias("_next"))

    rows = asks.select(ask_id, "model", "scale", F.when(machine != "", machine).alias("_m"), backend_name("backend", backends).alias("_b"), F.col("backend").alias("_asked"))
    rows = rows.join(top, ["model", "scale"], "left").join(next_, ["model", "scale"], "left")
    rows = rows.join(by_machine, ["model", "scale", "_m"], "left").join(by_backend, ["model", "scale", "_b"], "left").join(records, ["model", "scale", "_m", "_b"], "left")
    free, everywhere = F.col("_asked").isNull(), F.col("_m").isNull()
    pick = lambda own, same, one, whole: F.when(everywhere, F.when(free, whole).otherwise(same)).otherwise(F.when(free, own).otherwise(one))
    found = pick(F.col("_own.v"), F.col("_same.v"), F.col("_one.v"), F.col("_top.v"))
    hit = pick(*[F.col(c).isNotNull() for c in ("_own", "_same", "_one", "_top")])
    other = F.when(~everywhere, F.when(F.col("_top.m") != F.col("_m"), F.col("_top.m")).otherwise(F.col("_next.m")))
    backend = F.when(~hit & ~free, F.when(everywhere, F.col("_top.b")).otherwise(F.col("_own.b")))
    answers = free | F.col("_b").isNotNull()
    return rows.select(ask_id, F.when(answers, found).alias("found"), F.when(answers, other).alias("other_machine"), F.when(answers, backend).alias("other_backend"))


def perf_history(runs: DataFrame, flags: Names, version: int) -> DataFrame:
    """Seconds a frame and megapixel of the newest run of each engine, scale, area tier and flags."""
    tier = F.greatest(F.lit(1), F.least(F.lit(40), F.bround(F.col("area") * 10).cast("int")))
    rows = runs.where((F.col("version") == version) & (F.col("seconds") > 0) & (F.col("frames") > 0)).withColumn("tier", tier)
    cost = F.col("seconds") / F.col("frames") / F.greatest(F.lit(0.25), F.col("area"))
    return rows.groupBy("engine", "scale", "tier", *flags).agg(F.max_by(cost, F.struct("at", "seq")).alias("cost"))


def strike_streak(attempts: DataFrame, by: Names, order: Names, limit: int = 3, device: str | None = None) -> DataFrame:
    """Failures in a row since the last success of each key; ``broken`` at the limit. Keys with a
    negative device are exempt."""
    last = attempts.groupBy(*by).agg(F.max(F.when(F.col("ok"), F.struct(*order))).alias("_ok"))
    rows = attempts.join(last, list(by)).where(~F.col("ok") & (F.col("_ok").isNull() | (F.struct(*order) > F.col("_ok"))))
    out = last.select(*by).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("strikes")), list(by), "left").withColumn("strikes", F.coalesce("strikes", F.lit(0)))
    exempt = F.col(device) < 0 if device else F.lit(False)
    return out.withColumn("broken", (F.col("strikes") >= limit) & ~exempt)


def verdict_key(*parts: Column) -> Column:
    """Parts of a key, trimmed, in lower case, without separators, joined by pipes."""
    return F.concat_ws("|", *[F.regexp_replace(F.lower(F.trim(F.coalesce(p, F.lit("")))), r"[\t\r\n|]", "_") for p in parts])


def verdict_step(failures: Column, at: Column, now: Column, ok: Column, denied: Column, ttl: float, limit: int) -> Column:
    """Failures after an attempt: none after a success, the limit after a denial, else one more if
    the record is fresh. A record from the future is not."""
    age = now - at
    fresh = at.isNotNull() & (age >= 0) & (age <= ttl)
    return F.when(ok, 0).when(denied, limit).when(fresh, failures + 1).otherwise(1)


def verdict_state(attempts: DataFrame, by: Names, order: Names, now: Column, ttl: float, limit: int, denial: Column | None = None, success_ttl: float | None = None, device: str | None = None) -> DataFrame:
    """What the ledger says about each key at ``now``: ``ok``, ``failures``, ``at`` and ``denied``.
    Failures live for ``ttl``, successes for ``success_ttl`` (the same if not given); expired records
    and those from the future are left out. A denial is a failure that reaches the limit at once.
    Attempts with a negative ``device`` are not booked. An ordered fold; a key's attempts are one
    array."""
    rows = attempts.where(F.coalesce(F.col(device) >= 0, F.lit(True))) if device else attempts
    rows = rows.withColumn("_deny", F.coalesce(denial, F.lit(False)) if denial is not None else F.lit(False))
    rows = gathered(rows.withColumn("ok", F.col("ok") & ~F.col("_deny")), by, order, ["ok", "_deny"])
    start = F.struct(F.lit(0).alias("failures"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("boolean").alias("ok"))

    def step(acc: Column, r: Column) -> Column:
        when = r[order[0]].cast("long")
        return F.struct(verdict_step(acc["failures"], acc["at"], when, r["ok"], r["_deny"], ttl, limit).cast("int").alias("failures"), when.alias("at"), r["ok"].alias("ok"))

    out = rows.select(*by, fold(F.col("rows"), start, step).alias("s")).select(*by, "s.*")
    age = now - F.col("at")
    lives = F.when(F.col("ok"), F.lit(ttl if success_ttl is None else success_ttl)).otherwise(F.lit(ttl))
    return out.where((age >= 0) & (age <= lives)).withColumn("denied", ~F.col("ok") & (F.col("failures") >= limit))


def all_or_unknown(df: DataFrame, by: Names, flag: str) -> DataFrame:
    """Whether all flags are true; null without any."""
    return df.groupBy(*by).agg(F.bool_and(flag).alias("all"))


def verdict_lookup(asks: DataFrame, verdicts: DataFrame, ok: str = "ok") -> DataFrame:
    """The verdict for (engine, device, model), else the engine-wide one (blank model), else null."""
    exact = verdicts.where("model <> ''").select("engine", "device", "model", F.col(ok).alias("_exact"))
    wide = verdicts.where("model = ''").select("engine", "device", F.col(ok).alias("_wide"))
    rows = asks.join(exact, ["engine", "device", "model"], "left").join(wide, ["engine", "device"], "left")
    return rows.withColumn("verdict", F.coalesce("_exact", "_wide")).drop("_exact", "_wide")


def eta_average(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the average rate; -1 until four are done in a second, and once all are."""
    known = (done >= 4) & (elapsed >= 1) & (total > done)
    return F.when(known, (total - done) * elapsed / F.when(known, done)).otherwise(-1.0)


def eta_blended(progress: DataFrame, by: Names, done: str, total: str, elapsed: str, lag: int, overhead: float = 0.0) -> DataFrame:
    """``eta`` from the recent rate (since ``lag`` rows before) and the average rate, the recent one
    weighing up to four fifths as work gets done; plus a fixed overhead. The recent rate counts if
    something was done by then and a fifth of a second had passed; -1 where the average is unknown."""
    w = over(by, [done])
    d0, t0 = F.lag(done, lag).over(w), F.lag(elapsed, lag).over(w)
    rows = progress.withColumns({"_d0": d0, "_t0": t0})
    average = eta_average(F.col(done), F.col(total), F.col(elapsed))
    moved = (F.col("_d0") > 0) & (F.col(done) > F.col("_d0")) & (F.col("_t0") > 0.2) & (F.col(elapsed) > F.col("_t0"))
    recent = (F.col(done) - F.col("_d0")) / F.when(moved, F.col(elapsed) - F.col("_t0"))
    weight = 0.8 * clamp(F.col(done) / 60, 0, 1)
    overall = F.col(done) / F.when(F.col(elapsed) > 0, F.col(elapsed))
    rate = F.when(F.coalesce(moved, F.lit(False)), weight * recent + (1 - weight) * overall).otherwise(overall)
    eta = F.when(average < 0, -1.0).otherwise((F.col(total) - F.col(done)) / F.when(rate > 0, rate) + max(0.0, overhead))
    return rows.withColumn("eta", eta).drop("_d0", "_t0")


def shown_next(last: float | None, left: float, least: float | None) -> float:
    """What to show after ``last``: never more than that, if it was above 0, but the floor at least."""
    bound = min(last, left) if last is not None and last > 0 else left
    return max(bound, 0.0 if least is None else least, 0.0)


def eta_shown(rows: DataFrame, by: Names, order: str, eta: str, floor: str) -> DataFrame:
    """``shown`` along a job's progress: never more than before, once more than 0 was shown; never under
    the floor; an unknown one changes nothing. The floor feeds back, so this is a fold."""

    def step(last: float | None, row: tuple) -> tuple[float | None, tuple]:
        at, left, least = row
        if left is not None and left >= 0:
            last = shown_next(last, left, least)
        return last, (at, last)

    rows = rows.select(*by, F.col(order).cast("long").alias(order), F.col(eta).cast("double").alias(eta), F.col(floor).cast("double").alias(floor))
    return ordered_fold(rows, by, [order], [eta, floor], step, f"`{order}` long, shown double")


def top_reasons(df: DataFrame, reason: str, k: int) -> DataFrame:
    """The ``k`` most frequent reasons with their counts, and those of the rest in sum."""
    counts = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    head = counts.orderBy(F.desc("n"), reason).limit(k)
    rest = counts.join(head.select(reason), reason, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return head.select(reason, "n", F.lit(False).alias("rest")).unionAll(rest.select(F.lit(None).cast("string"), "n", F.lit(True)))


def sum_by_owner(counters: DataFrame, name: str, value: str, pattern: str, capacity: float) -> DataFrame:
    """Sums of positive values by the owner in the counter's name, and what is left of a capacity."""
    owner = F.regexp_extract(name, pattern, 1)
    rows = counters.withColumn("owner", owner).where((F.col("owner") != "") & ~F.isnan(value) & (F.col(value) > 0))
    return rows.groupBy("owner").agg(F.sum(value).alias("used")).withColumn("free", F.greatest(F.lit(0.0), capacity - F.col("used")))


#: Names shorter than this say too little to be compared; parts of this length find their like.
LEAST_NAME = 8


def same_name(a: Column, b: Column) -> Column:
    """Both have eight characters or more, and one holds the other; case does not matter."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (F.length(x) >= LEAST_NAME) & (F.length(y) >= LEAST_NAME) & (x.contains(y) | y.contains(x))


def _holders(names: DataFrame) -> DataFrame:
    """``short`` and ``long`` of all pairs of different names (column ``name``, distinct, long enough)
    of which one holds the other. A holder has every part of what it holds, so a name looks only
    among those that have its rarest part."""
    starts = F.sequence(F.lit(1), F.length("name") - LEAST_NAME + 1)
    parts = names.select("name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("name", i, LEAST_NAME)))).alias("part"))
    rarity = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(rarity, "part").groupBy("name").agg(F.min_by("part", F.struct("n", "part")).alias("part")).withColumnRenamed("name", "short")
    return rarest.join(parts.withColumnRenamed("name", "long"), "part").where((F.length("long") > F.length("short")) & F.col("long").contains(F.col("short"))).select("short", "long")


def missing_fuzzy(a: DataFrame, others: Sequence[DataFrame], col: str, order: str) -> DataFrame:
    """Names of ``a``, trimmed, that none of the others has. Of names of ``a`` that are the same as
    one kept before, by ``order``, none is kept; a name that is like a dropped one only stays.
    Names shorter than eight characters are like no other; blank ones are left out.

    What is kept depends on what was kept before it, so names are settled in rounds: one with no
    open earlier like stays, and drops its later ones. A round's state is written out."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    known = others[0].select(key(col).alias("name"))
    for o in others[1:]:
        known = known.unionAll(o.select(key(col).alias("name")))
    known = known.where(F.length("name") >= LEAST_NAME).distinct()
    mine = a.select(F.trim(F.col(col)).alias(col), order, key(col).alias("_name")).where("_name <> ''")
    long_names = mine.where(F.length("_name") >= LEAST_NAME).groupBy(F.col("_name").alias("name")).agg(F.min(order).alias("at"))
    pairs = staged(_holders(long_names.select("name").unionAll(known).distinct()), "pairs")
    either = pairs.unionAll(pairs.select(F.col("long").alias("short"), F.col("short").alias("long")))
    met = known.unionAll(either.join(known.withColumnRenamed("name", "long"), "long").select(F.col("short").alias("name"))).distinct()
    # Names that are open, and pairs of an earlier and a later one.
    open_names = staged(long_names.join(met, "name", "left_anti"), "names")
    first, second = open_names.select(F.col("name").alias("short"), F.col("at").alias("_a")), open_names.select(F.col("name").alias("long"), F.col("at").alias("_b"))
    met_here = pairs.join(first, "short").join(second, "long")
    early = F.col("_a") < F.col("_b")
    links = staged(met_here.select(F.when(early, F.col("short")).otherwise(F.col("long")).alias("early"), F.when(early, F.col("long")).otherwise(F.col("short")).alias("late")), "links")
    gone = None
    while not links.isEmpty():
        stays = links.select(F.col("early").alias("name")).distinct().join(links.select(F.col("late").alias("name")), "name", "left_anti")
        out = links.join(stays.withColumnRenamed("name", "early"), "early").select(F.col("late").alias("name")).distinct()
        out = staged(out, "gone")
        gone = out if gone is None else gone.unionAll(out)
        left = links.join(out.withColumnRenamed("name", "early"), "early", "left_anti").join(out.withColumnRenamed("name", "late"), "late", "left_anti")
        links = staged(left.join(stays.withColumnRenamed("name", "early"), "early", "left_anti"), "links")
    kept = open_names if gone is None else open_names.join(gone, "name", "left_anti")
    short = mine.where(F.length("_name") < LEAST_NAME).select(col, order)
    return short.unionAll(mine.join(kept.select(F.col("name").alias("_name"), F.col("at").alias(order)), ["_name", order], "left_semi").select(col, order))


def rank_top(df: DataFrame, score: Column, id_col: str, k: int, by: Names = ()) -> DataFrame:
    """The ``k`` best, of all or of each key; ties by id."""
    if not by:
        return df.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id_col)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
