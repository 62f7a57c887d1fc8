"""Analytics over load tests: phases, trials, attainment, saturation, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold_sorted


def phase_aggregate(phases: DataFrame, by: list[str], means: list[str], sums: list[str], phase: str | None = None) -> DataFrame:
    """Means of percentiles and sums of counts over phases whose name holds ``phase``."""
    rows = phases.filter(F.col("phase").contains(phase)) if phase else phases
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).cast("long").alias(c) for c in sums])


def trial_aggregate(trials: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """Mean over trials, half of its 95 % interval (0 for one trial) and whole mean counts."""
    n = F.count("*")
    half = F.when(n < 2, F.lit(0.0)).otherwise(F.stddev_samp(value) / F.sqrt(n) * 1.96)
    return trials.groupBy(*by).agg(n.alias("trials"), F.avg(value).alias("mean"), half.alias("ci95"), F.floor(F.sum(count) / n).cast("long").alias("count"))


def series_summary(series: DataFrame, by: list[str], value: str) -> DataFrame:
    rows = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def attainment(jobs: DataFrame, by: list[str], elapsed: Column, target: Column) -> DataFrame:
    """Jobs completed, and how many of them in time."""
    done = elapsed.isNotNull()
    met = F.count_if(done & (elapsed <= target))
    return jobs.groupBy(*by).agg(F.count_if(done).alias("completed"), met.alias("met"), F.when(F.count_if(done) > 0, met / F.count_if(done)).alias("attainment"))


def degradation(results: DataFrame, value: str, baseline: int = 0) -> DataFrame:
    """Percent by which each scenario is worse than the baseline scenario."""
    base = results.filter(F.col("scenario") == baseline).select(F.col(value).alias("__base"))
    rows = results.crossJoin(F.broadcast(base))
    return rows.withColumn("degradation", F.when(F.col("__base") > 0, (F.col(value) - F.col("__base")) / F.col("__base") * 100).otherwise(0.0)).drop("__base")


def saturation(probes: DataFrame, step: int = 5, worst_ratio: float = 3.0, worst_errors: float = 0.05) -> DataFrame:
    """(rate): the first probed rate whose tail latency or errors are too high, less a step, and at least 1."""
    order = W.orderBy("rate")
    done = probes.filter("completed > 0").withColumn("base", F.first("ttft_p99").over(order)).withColumn("n", F.row_number().over(order))
    bad = ((F.col("n") > 1) & (F.col("base") > 0) & (F.col("ttft_p99") > worst_ratio * F.col("base"))) | (F.col("error_rate") > worst_errors)
    return done.agg(F.min(F.when(bad, F.greatest(F.lit(1), F.col("rate") - step))).alias("rate"))


def sweep(results: DataFrame, value: str) -> DataFrame:
    """Per scenario, its (rate, value) points by rate."""
    return results.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("rate", F.col(value).alias("value")))).alias("points"))


def progress_deltas(samples: DataFrame, key: str, at: str, done: str) -> DataFrame:
    """Adds ``delta``: what finished since the sample before."""
    last = F.lag(done).over(W.partitionBy(key).orderBy(at))
    return samples.withColumn("delta", F.col(done) - F.coalesce(last, F.lit(0)))


def completion_time(samples: DataFrame, key: str, at: str, status: str = "status") -> DataFrame:
    """First sample at which a job is seen completed."""
    return samples.groupBy(key).agg(F.min(F.when(F.col(status) == "completed", F.col(at))).alias("completed_at"))


def metric_steps(samples: DataFrame, step_s: int = 15) -> DataFrame:
    """The last value of each metric in each step of a range query."""
    start = (F.floor(F.col("at") / step_s) * step_s).cast("long")
    return samples.groupBy("metric", start.alias("step")).agg(F.max_by("value", "at").alias("value"))


def deciles_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., deciles): p0, p10 ... p100, between neighbours by their distance.

    Equal values are counted first. Values fall into classes by their magnitude, whose few counts tell which classes hold the
    wanted ranks; only these are looked through, so no task holds a group's values.
    """
    x = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs("v")) * 64) + 100_000
    klass = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise((F.signum("v") * size).cast("long"))
    counts = rows.filter(x.isNotNull()).groupBy(*by, x.alias("v")).agg(F.count("*").alias("n")).withColumn("klass", klass)
    classes = counts.groupBy(*by, "klass").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("klass").rowsBetween(W.unboundedPreceding, 0))
    classes = classes.withColumns({"end": upto, "total": F.sum("n").over(W.partitionBy(*by))}).withColumn("begin", F.col("end") - F.col("n")).drop("n")
    place = lambda i: (F.col("total") - 1) * F.lit(i / 10)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(place(i)) if up else F.floor(place(i))).alias("rank"), (place(i) - F.floor(place(i))).alias("share")) for i in range(11) for up in (False, True)])
    wanted = classes.select(*by, "klass", "begin", "end", F.inline(wanted)).filter("rank >= begin and rank < end").drop("end")
    within = F.sum("n").over(W.partitionBy(*by, "klass").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    near = counts.join(wanted.select(*by, "klass", "begin").distinct(), [*by, "klass"]).withColumn("end", F.col("begin") + within).withColumn("begin", F.col("end") - F.col("n"))
    near = near.select(*by, "klass", "v", F.col("begin").alias("first"), F.col("end").alias("past"))
    hit = wanted.drop("begin").join(near, [*by, "klass"]).filter("rank >= first and rank < past")
    ends = hit.groupBy(*by, "i").agg(F.max(F.when(~F.col("up"), F.col("v"))).alias("low"), F.max(F.when(F.col("up"), F.col("v"))).alias("high"), F.max("share").alias("share"))
    point = F.struct("i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("p"))
    return ends.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(point)), lambda e: e["p"]).alias("deciles"))


def first_prompts(turns: DataFrame, default_system: str = "You are a helpful assistant.") -> DataFrame:
    """Per conversation: its first system text, or the default, and its first user text; conversations without a user turn have none."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return turns.groupBy("conv_id").agg(F.coalesce(first("system"), F.lit(default_system)).alias("system"), first("user").alias("prompt")).filter("prompt is not null")


def slot_schedule(requests: DataFrame, key: str, arrival: str, duration: str, order: str, slots: int) -> DataFrame:
    """Per key, what bounded concurrency costs: each request, in order, starts when it has arrived and a slot is free.

    (key, requests, waited, finished): all waiting together, and when the last one is done.
    """
    def place(state: tuple, r: dict) -> tuple:
        free, n, waited = state
        begin = max(free[0], r["a"])  # the slot that is free first stands first
        return sorted([*free[1:], begin + r["d"]]), n + 1, waited + begin - r["a"]

    rows = requests.select(key, F.col(order).alias("o"), F.col(arrival).cast("double").alias("a"), F.col(duration).cast("double").alias("d"))
    return fold_sorted(rows, [key], ["o", "a", "d"], lambda: ([0.0] * slots, 0, 0.0), place, lambda s: {"requests": s[1], "waited": s[2], "finished": max(s[0])}, "requests long, waited double, finished double")


def two_level_schedule(requests: DataFrame, pool: str, endpoint: str, endpoints: int, arrival: str, duration: str, order: str, slots: int, pool_slots: int) -> DataFrame:
    """Per pool, what two levels of bounded concurrency cost: a request, in order, takes a slot of its endpoint (numbered from 0),
    then one of the pool, and starts when it has both. (pool, requests, waited, finished) as in ``slot_schedule``."""

    def place(state: tuple, r: dict) -> tuple:
        ends, free, n, waited, done = state
        mine = ends[r["e"]]
        begin = max(mine[0], free[0], r["a"])
        end = begin + r["d"]
        ends[r["e"]] = sorted([*mine[1:], end])
        return ends, sorted([*free[1:], end]), n + 1, waited + begin - r["a"], max(done, end)

    rows = requests.select(pool, F.col(order).alias("o"), F.col(endpoint).alias("e"), F.col(arrival).cast("double").alias("a"), F.col(duration).cast("double").alias("d"))
    begin = lambda: ([[0.0] * slots for _ in range(endpoints)], [0.0] * pool_slots, 0, 0.0, 0.0)
    return fold_sorted(rows, [pool], ["o", "e", "a", "d"], begin, place, lambda s: {"requests": s[2], "waited": s[3], "finished": s[4]}, "requests long, waited double, finished double")


def sweep_json(points: DataFrame) -> DataFrame:
    """One JSON document a scenario, as a report reads it."""
    return points.select("scenario", F.to_json(F.struct("scenario", "points")).alias("document"))
