"""Expiring click deduplication: repeats of a click inside a window of hours are counted and compared with the click that opened it.

A Structured Streaming query of ``transformWithStateInPandas`` on RocksDB. For every click_id its ValueState holds the open
window: its start, the opener's digest, the numbers of repeats and of conflicts, and the sum of the conflicts' checksums. A
batch's rows of a click are sorted and folded into it. An event-time timer at the end of the earliest window closes those
that the watermark has passed; times are shifted by a second against the watermark, so that "not after" and "before" agree
with Spark's own comparisons, and by SHIFT_H hours, so that they are positive. The query is started anew for every batch, on
one checkpoint. Spark moves the watermark between starts, so a start first closes what was due after the batch before it: where a group has
rows, before they are folded, and elsewhere by its timer. A sentinel row in the last batch moves the watermark past all windows, and one micro-batch without rows closes them.

Spark calls the processor once a group and batch, which costs milliseconds whatever the group holds, so clicks share groups by the
hash of their ids: ``group_rows`` rows or so of all batches are one group. With ``group_rows`` of 0 every click_id is a group of its own.

Defined cases: rows without click_id or arrived_at are left out, as are those that arrived before 1870; null fields are empty in the
digest; a value that isn't a number counts as 0, an infinite one as the largest or smallest long; equal rows are
repeats without a conflict; rows of one hour go by digest; very long fields only pass through the digest; negative ids have the
copies of their non-negative remainder; an empty table gives no rows; other columns are not read. The rows that one click
has in one batch are sorted in one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import new_folder, release, ship

SPAN_H = 24
LATE_H = 96
BATCHES = 8
#: Rows of all batches to a group, and the fewest groups.
GROUP_ROWS = 4000
LEAST_GROUPS = 64
#: Hours from the shifted clock's start to 1970.
SHIFT_H = 876_000
HOUR_MS = 3_600_000

_WINDOW = ("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc", "hash")
_OUT = "click_id long, start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash binary, closed_batch int"
_STATE = ", ".join(f"{n} array<{'binary' if n == 'hash' else 'long'}>" for n in _WINDOW)
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # RocksDB would set 4 MB of disk aside for each partition.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Executors give up the local state of ended starts in their maintenance; by Spark's own minute that of all starts would pile up.
    "spark.sql.streaming.stateStore.maintenanceInterval": "4s",
}


class Windows(StatefulProcessor):
    """The open windows of a group's clicks, one each, in the start for ``batch``; ``before`` is the batch of the start before, ``over`` the watermark by the sentinel."""

    def __init__(self, span_h: int, batch: int, before: int, over: int):
        self.span_h, self.batch, self.before, self.over = span_h, batch, before, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", _STATE)

    def _load(self, now: int) -> tuple[dict[int, tuple], int | None, list[tuple]]:
        """The windows that stay open, the timer that is set, and those that the watermark has passed."""
        held = self.state.get()
        windows = list(zip(*held)) if held else []
        batch = self.batch if now >= self.over else self.before
        return {w[0]: w for w in windows if self._end(w) > now}, min(map(self._end, windows), default=None), [(*w, batch) for w in windows if self._end(w) <= now]

    def _store(self, windows: dict[int, tuple], timer: int | None) -> None:
        """Keeps the windows, and one timer at the earliest end; ``timer`` is the one that is set."""
        if windows:
            self.state.update(tuple(map(list, zip(*windows.values()))))
        else:
            self.state.clear()
        due = min(map(self._end, windows.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def _end(self, window: tuple) -> int:
        return (window[1] + SHIFT_H + self.span_h) * HOUR_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: list[tuple] = []
        for f in rows:
            came += zip(*(f[c].tolist() for c in ("click_id", "hour", "hash", "crc")))
        now = timerValues.getCurrentWatermarkInMs()
        late = now // HOUR_MS - SHIFT_H
        windows, timer, closed = self._load(now)
        for click, hour, digest, crc in sorted(r for r in came if r[1] > late and r[2] is not None):  # without late rows and the sentinel
            w = windows.get(click)
            if w and hour <= w[1] + self.span_h:
                differs = digest != w[5]
                windows[click] = (click, w[1], w[2] + 1, w[3] + differs, w[4] + crc * differs, w[5])
                continue
            if w:
                closed.append((*w, self.batch))
            windows[click] = (click, hour, 0, 0, 0, digest)
        self._store(windows, timer)
        if closed:
            yield pd.DataFrame(closed, columns=[*_WINDOW, "closed_batch"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, _, closed = self._load(timerValues.getCurrentWatermarkInMs())
        self._store(windows, None)  # the timer that has fired is taken back by Spark
        if closed:
            yield pd.DataFrame(closed, columns=[*_WINDOW, "closed_batch"])

    def close(self) -> None:
        pass


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(name))


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, late, hash, crc): the deliveries of each row, ``late`` hours after ``hour``; the digest holds what tells two of a click apart."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.when(F.isnan("value"), 0).otherwise(F.floor(F.col("value") * 100 + 0.5))
    fields = F.concat_ws("|", text(F.col("client_id")), text(F.col("kind")), text(value), text(_micros(clicks, "ts")), text(F.col("props")))
    rows = clicks.filter("click_id is not null and arrived_at is not null").select("click_id", F.floor(_micros(clicks, "arrived_at") / 3_600_000_000).alias("arrived"), fields.alias("fields"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("click_id", F.lit(3).cast("long")))).alias("j"))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string"))))
    digest = F.sha2(F.concat_ws("|", "fields", (F.col("c") % 3).cast("string")), 256)
    return rows.select(
        "click_id", (F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)).alias("hour"), (F.floor(F.col("c") / 10) % 200).alias("late"), F.unhex(digest).alias("hash"), F.crc32(digest).alias("crc"),
    ).filter(F.col("hour") > 1 - SHIFT_H)


def dedup(rows: DataFrame, batches: int = BATCHES, span_h: int = SPAN_H, late_h: int = LATE_H, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash) of every window of (click_id, hour, late, hash, crc).

    Rows come in ``batches`` batches by hour plus lateness, each an own start of the query.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = new_folder(spark, "clicks")
    due = F.col("hour") + F.col("late")
    low, high, last, n = rows.agg(F.min(due), F.max(due), F.max("hour"), F.count("*")).first()
    if n:
        at = lambda hour: F.timestamp_seconds((hour.cast("long") + SHIFT_H) * 3600)
        group = F.pmod(F.xxhash64("click_id"), F.lit(max(LEAST_GROUPS, n // group_rows))) if group_rows else F.col("click_id")
        batch = F.floor((due - low) * batches / (high - low + 1)).cast("int")
        dealt = rows.select(group.alias("group"), "click_id", "hour", at(F.col("hour")).alias("at"), "hash", "crc", batch.alias("batch"))
        dealt.write.partitionBy("batch").parquet(f"{folder}/copies")
        end = last + span_h + late_h + 2
        sentinel = [F.lit(None if name == "hash" else 0).cast(kind).alias(name) for name, kind in dealt.dtypes if name not in ("at", "batch")]
        sentinel = spark.range(1).select(*sentinel, at(F.lit(end)).alias("at"))
        sentinel.write.mode("append").parquet(f"{folder}/copies/batch={batches - 1}")
        release(spark)
        _run(dealt.drop("batch"), folder, batches, span_h, late_h, end)
    out = spark.read.schema(_OUT).parquet(f"{folder}/windows/*") if n else spark.createDataFrame([], _OUT)
    return out.select("click_id", "start_hour", F.col("closed_batch").cast("long").alias("closed_batch"), "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def _run(rows: DataFrame, folder: str, batches: int, span_h: int, late_h: int, end: int) -> None:
    """Moves one batch after the other to where the query reads, and runs the query on it to the end; ``end`` is the sentinel's hour."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/feed"))
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    kept = {k: spark.conf.get(k, None) for k in (*_ROCKS, empty)}
    over = (end - late_h + SHIFT_H) * HOUR_MS - 1000
    before = 0
    try:
        for batch in range(batches):
            if not fs.exists(path(f"{folder}/copies/batch={batch}")):
                continue  # no row is due then
            fs.rename(path(f"{folder}/copies/batch={batch}"), path(f"{folder}/feed/{batch}"))
            for k, v in (_ROCKS | {empty: str(batch == batches - 1).lower()}).items():
                spark.conf.set(k, v)

            def write(df: DataFrame, n: int, batch: int = batch) -> None:
                """A micro-batch's folder is named by its number: one that is run again overwrites itself."""
                df.write.mode("overwrite").parquet(f"{folder}/windows/{batch}-{n}")

            came = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/feed").withWatermark("at", f"{late_h} hours 1 second").drop("at")
            closed = came.groupBy("group").transformWithStateInPandas(Windows(span_h, batch, before, over), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
            closed.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
            release(spark)
            before = batch
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    for name in ("feed", "state", "copies"):
        fs.delete(path(f"{folder}/{name}"), True)
