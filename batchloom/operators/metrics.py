"""Operational metrics and the query shapes that dashboards and alerts use over them.

``rate`` and ``increase`` are the reset-aware growth of a counter inside a window; they are not
extrapolated to the window's edges. ``range_growth`` gives them for windows that slide by steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from .folds import fold_sorted


def buckets(kind: str) -> list[float]:
    """Upper bounds of an exponential histogram."""
    start, factor, count = S.HISTOGRAMS[kind]
    return [start * factor**i for i in range(count)]


def histogram(rows: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts: (by..., le, n), with an infinite last bound. One pass counts all bounds."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*by, F.inline(F.array(*entries)))


def histogram_quantile(q: float, cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value): linear interpolation in the bucket that holds rank q, from 0 in the first; the highest
    finite bound if that is the infinite one. Buckets are summed before, so a fleet's quantile is of the sum."""
    summed = cumulative.groupBy(*by, "le").agg(F.sum("n").alias("n"))
    sides = F.sort_array(F.collect_list(F.struct("le", "n")))
    rows = summed.groupBy(*by).agg(sides.alias("b"))
    total = F.element_at("b", -1)["n"]
    at = F.array_position(F.transform("b", lambda x: x["n"] >= F.lit(q) * total), True).cast("int")
    hit = F.get("b", at - 1)
    before = F.when(at > 1, F.get("b", at - 2))
    low, base = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0))
    inside = low + (hit["le"] - low) * (F.lit(q) * total - base) / (hit["n"] - base)
    value = F.when(hit["le"] == float("inf"), F.get("b", F.size("b") - 2)["le"]).otherwise(inside)
    return rows.filter(total > 0).select(*by, value.alias("value"))


def growth(series: DataFrame, keys: Sequence[str], at: str = "at", value: str = "value", span: int = 86_400, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``delta``: growth since the sample before; a counter that fell has been reset and starts from 0.

    Samples of one time go by ``ties``, and then by value. Samples are compared within spans of ``at``; a span's first one takes
    the last of the span before from a table of one row a span, so a series is no one task's.
    """
    order = [at, *ties, value]
    rows = series.withColumn("__span", F.floor(F.col(at) / span))
    ends = rows.groupBy(*keys, "__span").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    ends = ends.select(*keys, "__span", F.lag("__end").over(W.partitionBy(*keys).orderBy("__span")).alias("__before"))
    last = F.coalesce(F.lag(value).over(W.partitionBy(*keys, "__span").orderBy(*order)), F.col("__before"))
    delta = F.when(F.col("__last").isNull(), 0.0).when(F.col(value) < F.col("__last"), F.col(value)).otherwise(F.col(value) - F.col("__last"))
    return rows.join(ends, [*keys, "__span"]).withColumn("__last", last).withColumn("delta", delta).select(*series.columns, "delta")


def range_growth(grown: DataFrame, keys: Sequence[str], window_s: int, step_s: int, at: str = "at", value: str = "value", ties: Sequence[str] = ()) -> DataFrame:
    """(keys..., step, samples, increase, rate) of a range vector: at every multiple of ``step_s`` the growth over the last ``window_s`` seconds.

    A window holds its end and not its beginning, and counts growth between its own samples, so it needs two; the first one's growth
    since the sample before lies outside. ``window_s`` must be a multiple of ``step_s``: samples are first summed by panes of one step, and windows are
    sums of panes, from which what the first pane has carried in is taken off. Take the steps of a range query by a filter on ``step``.
    """
    if window_s % step_s:
        raise ValueError("a window must be whole steps")
    pane = F.ceil(F.col(at) / step_s).cast("long")
    first = F.struct(at, *ties, value)
    panes = grown.groupBy(*keys, pane.alias("__pane")).agg(F.count("*").alias("__n"), F.sum("delta").alias("__sum"), F.min_by("delta", first).alias("__carried"))
    return _slide(panes, keys, window_s, step_s)


def _slide(panes: DataFrame, keys: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """``range_growth`` from its panes (keys..., __pane, __n, __sum, __carried)."""
    seen = panes.withColumn("__step", F.explode(F.sequence("__pane", F.col("__pane") + (window_s // step_s - 1))))
    grew = F.sum("__sum") - F.min_by("__carried", "__pane")
    out = seen.groupBy(*keys, "__step").agg(F.sum("__n").alias("samples"), grew.alias("increase")).filter("samples > 1")
    return out.select(*keys, (F.col("__step") * step_s).alias("step"), "samples", "increase", (F.col("increase") / float(window_s)).alias("rate"))


def bucket_growth(rows: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str], window_s: int, step_s: int, reset_s: int, at: str = "at", ties: Sequence[str] = ()) -> DataFrame:
    """``range_growth`` of a histogram's buckets, counters (by..., le) that each sample of ``rows`` adds to and that start again at every multiple of ``reset_s``.

    Samples are counted by pane and bucket at once, beside the first one's value; counters run over panes only, so no task holds a series' samples.
    Bounds don't hold infinity, which is added. Samples of one time go by ``ties``.
    """
    if window_s % step_s:
        raise ValueError("a window must be whole steps")
    run, pane = F.floor(F.col(at) / reset_s).alias("__run"), F.ceil(F.col(at) / step_s).cast("long").alias("__pane")
    every = [*map(float, bounds), float("inf")]
    counts = [F.count_if(value <= b).alias(f"__b{i}") for i, b in enumerate(every)]
    wide = rows.groupBy(*by, run, pane).agg(F.count("*").alias("__n"), F.min_by(value, F.struct(at, *ties)).alias("__first"), *counts)
    entry = lambda i, b: F.struct(F.lit(b).alias("le"), F.col(f"__b{i}").alias("__in"), F.coalesce((F.col("__first") <= b).cast("long"), F.lit(0)).alias("__one"))
    parts = wide.select(*by, "__run", "__pane", "__n", F.inline(F.array(*[entry(i, b) for i, b in enumerate(every)])))
    keys = [*by, "le"]
    # A pane may lie in two runs; within a run counters only grow.
    level = F.coalesce(F.sum("__in").over(W.partitionBy(*keys, "__run").orderBy("__pane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__begin", level + F.col("__one")).withColumn("__end", level + F.col("__in"))
    last = F.lag("__end").over(W.partitionBy(*keys).orderBy("__run", "__pane"))
    carried = F.when(last.isNull(), 0).when(F.col("__begin") < last, F.col("__begin")).otherwise(F.col("__begin") - last).cast("double")
    parts = parts.withColumn("__carried", carried)
    grew = F.col("__carried") + F.col("__end") - F.col("__begin")
    panes = parts.groupBy(*keys, "__pane").agg(F.sum("__n").alias("__n"), F.sum(grew).alias("__sum"), F.min_by("__carried", "__run").alias("__carried"))
    return _slide(panes, keys, window_s, step_s)


def rate(grown: DataFrame, window_s: int, by: Sequence[str] = (), at: str = "at") -> DataFrame:
    """(by..., window_start, rate): growth per second in tumbling windows, summed over all other labels."""
    start = (F.floor(F.col(at) / window_s) * window_s).cast("long")
    return grown.groupBy(*by, start.alias("window_start")).agg((F.sum("delta") / float(window_s)).alias("rate"))


def increase(grown: DataFrame, window_s: int, by: Sequence[str] = (), at: str = "at") -> DataFrame:
    start = (F.floor(F.col(at) / window_s) * window_s).cast("long")
    return grown.groupBy(*by, start.alias("window_start")).agg(F.sum("delta").alias("increase"))


def in_flight(requests: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", span: int = 86_400) -> DataFrame:
    """(by..., at, in_flight, until) of a gauge that each request raises at its start and lowers at its end: its value from every change to the next (``until``, null at the last).

    A sweep over changes. They are summed by time first, and running sums are kept inside spans of time on top of the sums of the spans before, one row
    a span, so no task holds a key's history. A request without an end stays in flight; one that ends before it starts, or has no start, is left out.
    """
    ok = requests.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    change = lambda at, d: F.struct(at.alias("at"), F.lit(d).cast("long").alias("d"))
    moved = ok.select(*by, F.inline(F.array(change(F.col(start), 1), change(F.col(end), -1)))).filter("at is not null")
    moved = moved.groupBy(*by, "at").agg(F.sum("d").alias("d")).withColumn("__span", F.floor(F.col("at") / span))
    key = W.partitionBy(*by).orderBy("__span")
    spans = moved.groupBy(*by, "__span").agg(F.sum("d").alias("__sum"), F.min("at").alias("__first"))
    spans = spans.select(*by, "__span", F.coalesce(F.sum("__sum").over(key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.lead("__first").over(key).alias("__next"))
    inside = W.partitionBy(*by, "__span").orderBy("at")
    level = F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = moved.withColumns({"__level": level, "__lead": F.lead("at").over(inside)}).join(spans, [*by, "__span"])
    return rows.select(*by, "at", (F.col("__level") + F.col("__base")).alias("in_flight"), F.coalesce("__lead", "__next").alias("until"))


def in_flight_summary(gauge: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., peak, mean) of ``in_flight``: the highest value, and the mean over time from the first change to the last."""
    held = F.col("until") - F.col("at")
    return gauge.groupBy(*by).agg(F.max("in_flight").alias("peak"), (F.sum(F.col("in_flight") * held) / F.sum(held)).alias("mean"))


def ratio(numerator: Column, denominator: Column, least: float = 0.001) -> Column:
    return numerator / F.greatest(denominator, F.lit(least))


def held_for(samples: DataFrame, firing: Column, samples_back: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``alert``: the condition held at this and all of the samples before, as many as asked for."""
    back = W.partitionBy(*by).orderBy("window_start").rowsBetween(-samples_back, 0)
    held = F.min(firing.cast("int")).over(back) == 1
    return samples.withColumn("alert", held & (F.count("*").over(back) > samples_back))


def token_usage(results: DataFrame) -> DataFrame:
    """Tokens by model over successful results; a negative number counts as none."""
    tokens = lambda c: F.sum(F.when(F.col(c) >= 0, F.col(c)).otherwise(0)).cast("long").alias(c)
    return results.filter("status_code between 200 and 299").groupBy("model").agg(F.count("*").alias("requests"), tokens("prompt_tokens"), tokens("completion_tokens"))


def counts(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def first_family(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first metric family, or the second where the first has no sample at all."""
    empty = primary.agg((F.count("*") == 0).alias("__empty"))
    return primary.unionByName(fallback.crossJoin(F.broadcast(empty)).filter("__empty").drop("__empty"))


def aimd_signal(status_code: Column, capacity_retry: Column, has_response: Column) -> Column:
    """-1 for a result that asks to slow down, +1 for success (any other answer, 4xx too), 0 for none."""
    slow = (status_code == 429) | (status_code >= 500) | capacity_retry
    return F.when(~has_response, 0).when(slow, -1).otherwise(1)


def aimd(signals: DataFrame, key: str, order: str, signal: str, start: int = S.AIMD_MAX, least: int = S.AIMD_MIN, most: int = S.AIMD_MAX, factor: float = S.AIMD_FACTOR, step: int = S.AIMD_STEP) -> DataFrame:
    """Per key: the limit after all signals in order, and how often it rose and fell.

    As many successes as the limit allows raise it by ``step``; a slow-down cuts it by ``factor`` and
    starts the count again; it stays within [least, most].
    """
    begin = max(least, min(most, start))

    def move(s: tuple, row: dict) -> tuple:
        limit, wins, ups, downs = s
        x = row[signal]
        full = x == 1 and wins + 1 >= limit
        new = max(least, int(limit * factor)) if x == -1 else min(limit + step, most) if full else limit
        wins = 0 if x == -1 or full else wins + 1 if x == 1 else wins
        return new, wins, ups + (new > limit), downs + (new < limit)

    rows = signals.select(key, F.col(order).alias("at"), signal)
    return fold_sorted(rows, [key], ["at", signal], lambda: (begin, 0, 0, 0), move, lambda s: dict(zip(("limit", "wins", "ups", "downs"), s)), "limit long, wins long, ups long, downs long")
