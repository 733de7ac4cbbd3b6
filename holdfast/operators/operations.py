"""Operations analytics over runs, rejections and logs; profiles and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..scratch import Scratch, broadcast_if_small

RANGE = 1_000_000  #: rows of a range of values that are ordered in one place
GRID = 100  #: steps of a sketch that narrows a range
BROADCAST_RANKS = 100_000  #: ranges that may be broadcast


def latest_with_ties(runs: DataFrame) -> DataFrame:
    """Every run that started last in its source: joined to the map-side combined maximum, so no source is sorted."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("started_at"))
    return runs.join(last, ["source", "started_at"], "left_semi")


def latest(runs: DataFrame) -> DataFrame:
    """One run for each source; of ties the largest id."""
    columns = [c for c in runs.columns if c not in ("source", "started_at", "run_id")]
    best = runs.groupBy("source").agg(F.max(F.struct("started_at", "run_id", *columns)).alias("b"))
    return best.select("source", "b.*")


def newest(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max(F.struct("started_at", "run_id", "source", "status")).alias("b")).select("b.*").filter("run_id IS NOT NULL")


def listed(runs: DataFrame, status: str | None = None, source: str | None = None, before: Column | None = None) -> DataFrame:
    """Filters first; order and limit come after, with the id as tie-break."""
    for condition in (status and F.col("status") == status, source and F.col("source") == source, before is not None and F.col("started_at") < before):
        if isinstance(condition, Column):
            runs = runs.filter(condition)
    return runs


def source_health(registry: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Every registered source, never-run ones too. Only the latest run counts: a success before a failure doesn't."""
    rows = registry.join(latest(runs), "source", "left")
    success = F.when(F.col("status") == "success", F.col("finished_at"))
    age, state = S.staleness(success, now)
    return rows.select("source", "run_id", F.col("status").alias("last_status"), "started_at", age.alias("age_hours"), state.alias("state"))


def last_success(runs: DataFrame) -> DataFrame:
    """The variant that looks past failures."""
    return runs.filter("status = 'success'").groupBy("source").agg(F.max("finished_at").alias("last_success_at"))


def rejection_rollup(rejections: DataFrame) -> DataFrame:
    """Count and the smallest reference (as text) by reason, most frequent first, then by reason."""
    rows = rejections.groupBy("reason_code").agg(F.count("*").alias("count"), F.min("source_ref").alias("example_source_ref"))
    return rows.orderBy(F.desc("count"), "reason_code")


def run_detail(runs: DataFrame, rejections: DataFrame) -> DataFrame:
    """Each run with its rejections: how many, and by reason their count and smallest reference, most frequent first.

    Rejections combine by run and reason before they are gathered, so a run's list has a row for each reason only.
    """
    reasons = rejections.groupBy(F.col("import_id").alias("run_id"), "reason_code").agg(F.count("*").alias("count"), F.min("source_ref").alias("example_source_ref"))
    order = F.struct((-F.col("count")).alias("order"), "reason_code", "count", "example_source_ref")
    lists = reasons.groupBy("run_id").agg(F.sum("count").alias("rejected"), F.transform(F.array_sort(F.collect_list(order)), lambda r: r.dropFields("order")).alias("reasons"))
    return runs.join(lists, "run_id", "left").fillna(0, ["rejected"])


def stays(now: Column, short_days: int = 30, long_days: int = 365) -> Column:
    """False for debug and info rows older than short_days and others older than long_days."""
    age = lambda days: F.coalesce(F.col("at") < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    minor = F.coalesce(F.col("level").isin("debug", "info"), F.lit(False))
    return ~((minor & age(short_days)) | (~minor & age(long_days)))


def kept_logs(logs: DataFrame, now: Column, short_days: int = 30, long_days: int = 365) -> DataFrame:
    return logs.filter(stays(now, short_days, long_days))


def recent(logs: DataFrame, limit: int, level: str | None = None) -> DataFrame:
    rows = logs if level is None else logs.filter(F.col("level") == level)
    return rows.orderBy(F.desc("at"), F.desc("log_id")).limit(limit)


def routed(logs: DataFrame) -> DataFrame:
    return logs.withColumn("forwarded", S.forwarded(F.col("level"), F.col("category")))


def metered(usage: DataFrame) -> DataFrame:
    """Usage of known features with a positive quantity."""
    return usage.filter(F.col("feature").isin(V.FEATURES) & (F.col("quantity") > 0))


def at_ranks(samples: DataFrame, by: list[str], value: str, ranks: Column) -> DataFrame:
    """by, rank, n and v: the exact element at each rank (from 1) of a group's sorted values; NULL values don't count.

    ranks: an array by ``n``, the group's count. Each rank has a range of values that surely holds it, at first the whole
    group. Quantile sketches, which combine map-side, narrow the ranges until none holds more than RANGE rows; what lies
    in a range is then counted by value and ordered. So no task orders more than that, whatever the values are.
    """
    scratch = Scratch(samples.sparkSession, "ranks")
    rows = samples.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = ends.select(*by, "n", F.explode(F.array_distinct(ranks.cast("array<bigint>"))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    wanted, step = scratch.save(wanted.filter("rank BETWEEN 1 AND n"), "wanted-0"), 0
    key = [*by, "rank"]

    def within(wanted: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(wanted, BROADCAST_RANKS), by).filter(F.col("v").between(F.col("low"), F.col("high")))

    while not (wide := wanted.filter((F.col("inside") > RANGE) & (F.col("low") < F.col("high")))).isEmpty():
        # the rank's place in its range, and cuts one step of the grid aside of it; the sketch errs by far less
        cuts = within(wide).groupBy(*key).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 50 * GRID).alias("cuts"))
        place = (F.col("rank") - F.col("before")) / F.col("inside") * GRID
        aside = lambda i: F.get("cuts", F.greatest(F.least(i, F.lit(GRID)), F.lit(0)).cast("int"))
        narrow = wide.join(cuts, key).withColumns({"lower": aside(F.floor(place) - 1), "upper": aside(F.ceil(place) + 1)}).drop("cuts")
        narrow = scratch.save(narrow, f"narrow-{step}")
        counted = within(narrow).groupBy(*key).agg(F.count_if(F.col("v") < F.col("lower")).alias("less"), F.count_if(F.col("v").between(F.col("lower"), F.col("upper"))).alias("now"))
        narrow = narrow.join(counted, key)
        sure = (F.col("rank") > F.col("before") + F.col("less")) & (F.col("rank") <= F.col("before") + F.col("less") + F.col("now")) & (F.col("now") < F.col("inside"))
        pick = lambda new, old: F.when(sure, new).otherwise(old)
        moved = narrow.select(
            *by, "n", "rank", pick(F.col("lower"), F.col("low")).alias("low"), pick(F.col("upper"), F.col("high")).alias("high"),
            pick(F.col("before") + F.col("less"), F.col("before")).alias("before"), F.when(sure, F.col("now")).otherwise(0).alias("inside"),
        )
        rest = wanted.join(wide.select(*key), key, "left_anti").select(*moved.columns)
        step += 1
        wanted = scratch.save(rest.unionByName(moved), f"wanted-{step}")
    counts = within(wanted).groupBy(*key, "n", "before", "v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*key).orderBy("v"))
    return counts.withColumn("upto", upto).filter("upto >= rank").groupBy(*key, "n").agg(F.min("v").alias("v"))


def latency(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, p95 (element int(n * 0.95) - 1 of the sorted samples) and maximum by group."""
    one, two, late = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"), F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))
    found = at_ranks(samples, by, value, F.array(one, two, late, F.col("n")))
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    return found.groupBy(*by, "n").agg(at(F.col("n")).alias("max"), ((at(one) + at(two)) / 2).alias("median"), at(late).alias("p95"))


def quantiles(samples: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """by and q: the exact quantiles, between two elements in proportion, for groups of any size."""
    places = [(F.col("n") - 1) * f for f in fractions]
    ranks = F.array(*(end(p).cast("long") + 1 for p in places for end in (F.floor, F.ceil)))
    found = at_ranks(samples, by, value, ranks)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    between = lambda p: at(F.floor(p) + 1) + (at(F.ceil(p) + 1) - at(F.floor(p) + 1)) * F.max(p - F.floor(p))
    return found.groupBy(*by, "n").agg(F.array(*map(between, places)).alias("q")).drop("n")


def taken_handles(profiles: DataFrame) -> DataFrame:
    """Handles that more than one profile holds."""
    return profiles.groupBy("handle").agg(F.count("*").alias("holders")).filter("handle IS NOT NULL AND holders > 1")


def patched_profiles(profiles: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles after the patches, refused patches). patches: user_id, handle, currency; NULL keeps.

    A patch is refused if a value is malformed, if another profile holds the handle, or if a smaller user_id asks for it
    in a patch that is not malformed. Of several patches of one user those count in order of ``seq``, if there is such a
    column: of each value the last that is given and not refused; so each profile stays one row.
    """
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    asked = patches.select("user_id", seq.alias("_seq"), S.handle(F.col("handle")).alias("_handle"), S.currency(F.col("currency")).alias("_currency"), F.col("handle").isNotNull().alias("_h"), F.col("currency").isNotNull().alias("_c"))
    bad = (F.col("_h") & F.col("_handle").isNull()) | (F.col("_c") & F.col("_currency").isNull())
    asked = asked.withColumn("bad", bad)
    held = profiles.select(F.col("handle").alias("_handle"), F.col("user_id").alias("_owner")).filter("_handle IS NOT NULL")
    # minima over the handles asked for combine map-side; patches without a handle go round the joins
    first = asked.filter("NOT bad AND _handle IS NOT NULL").groupBy("_handle").agg(F.min("user_id").alias("_first"))
    named = asked.filter("_handle IS NOT NULL").join(first, "_handle", "left").join(held, "_handle", "left")
    taken = (F.col("_owner") != F.col("user_id")) | (F.col("_first") != F.col("user_id"))
    columns = ["user_id", "_seq", "_handle", "_currency", "refused"]
    named = named.withColumn("refused", F.col("bad") | F.coalesce(taken, F.lit(False))).select(*columns)
    judged = named.unionByName(asked.filter("_handle IS NULL").withColumn("refused", F.col("bad")).select(*columns))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_seq", c)))[c].alias(c)
    good = judged.filter("NOT refused").groupBy("user_id").agg(last("_handle"), last("_currency"))
    out = profiles.join(good, "user_id", "left")
    out = out.withColumn("handle", F.coalesce("_handle", "handle")).withColumn("currency", F.coalesce("_currency", "currency"))
    return out.select(*profiles.columns), judged.filter("refused").select("user_id")
