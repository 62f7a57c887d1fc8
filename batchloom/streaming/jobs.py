"""Structured Streaming versions of the stateful operators; each gives what its batch version gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas as S
from ..functions.scalars import succeeded


def first_wins_stream(deliveries: DataFrame, delay: str, keys: tuple[str, ...] = ("batch_id", "custom_id"), at: str = "ts") -> DataFrame:
    """First delivery of each request; later ones inside the watermark's delay are dropped."""
    return deliveries.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def progress_stream(commits: DataFrame) -> DataFrame:
    """Running counts by batch, for update mode: push them every PROGRESS_S seconds."""
    ok = succeeded(F.col("status_code"), F.col("error_code"))
    return commits.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"))


def push_progress(progress: DataFrame, push: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: push(df))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{S.PROGRESS_S} seconds")).start()


def route_stream(results: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Results with their subscribers, a null one for the residue: a stream joined with a table, which Spark broadcasts only if it is small."""
    return results.join(subscribers, "batch_id", "left")


def pending_stream(requests: DataFrame, answers: DataFrame, wait: str, delay: str = "0 seconds") -> DataFrame:
    """Requests with their answers; one that has none within ``wait`` comes out without, as not executed."""
    asked = requests.withWatermark("asked_at", delay)
    got = answers.select(F.col("request_id").alias("answered"), "answered_at", "status_code", "error_code").withWatermark("answered_at", delay)
    on = F.expr(f"request_id = answered AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {wait}")
    joined = asked.join(got, on, "leftOuter")
    lost = F.col("answered").isNull()
    return joined.withColumn("error_code", F.when(lost, "batch_expired").otherwise(F.col("error_code"))).drop("answered")


def live_events(events: DataFrame, delay: str) -> DataFrame:
    """Events that haven't expired by the watermark: expired ones fall behind it and are dropped with their state."""
    return events.withWatermark("expires_ts", delay).dropDuplicatesWithinWatermark(["id"])


def commit_exactly_once(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch once: its folder is named by the batch's number, so a replay overwrites itself."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


class Aimd(StatefulProcessor):
    """The limit of one endpoint, kept across micro-batches; signals are folded in order."""

    def __init__(self, start: int = S.AIMD_MAX, least: int = S.AIMD_MIN, most: int = S.AIMD_MAX, factor: float = S.AIMD_FACTOR, step: int = S.AIMD_STEP):
        self.start, self.least, self.most, self.factor, self.step = max(least, min(most, start)), least, most, factor, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", "lim long, wins long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit, wins = self.state.get() if self.state.exists() else (self.start, 0)
        for x in pd.concat(list(rows)).sort_values("seq")["signal"]:
            if x == -1:
                limit, wins = max(self.least, int(limit * self.factor)), 0
            elif x == 1:
                wins += 1
                if wins >= limit:
                    limit, wins = min(limit + self.step, self.most), 0
        self.state.update((int(limit), int(wins)))
        yield pd.DataFrame({"endpoint": [key[0]], "lim": [int(limit)], "wins": [int(wins)]})

    def close(self) -> None:
        pass


def aimd_stream(signals: DataFrame, **limits) -> DataFrame:
    """(endpoint, lim, wins) after each micro-batch of (endpoint, seq, signal)."""
    return signals.groupBy("endpoint").transformWithStateInPandas(Aimd(**limits), outputStructType="endpoint string, lim long, wins long", outputMode="Update", timeMode="None")


class StateMachine(StatefulProcessor):
    """The state of one job: transitions apply in order if their expectations hold, else they conflict."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, epoch long, owner string, applied long, conflicts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, epoch, owner, applied, conflicts = self.state.get() if self.state.exists() else ("validating", 0, None, 0, 0)
        for t in pd.concat(list(rows)).sort_values("seq").itertuples():
            fits = status == t.expected_status and (pd.isna(t.expected_epoch) or int(t.expected_epoch) == epoch) and status not in S.TERMINAL
            if not fits:
                conflicts += 1
                continue
            applied += 1
            status = t.set_status
            epoch += bool(t.bump_epoch)
            owner = None if status == "validating" else (owner if pd.isna(t.set_owner) else t.set_owner)
        self.state.update((status, int(epoch), owner, int(applied), int(conflicts)))
        yield pd.DataFrame({"batch_id": [key[0]], "status": [status], "epoch": [int(epoch)], "owner": [owner], "applied": [int(applied)], "conflicts": [int(conflicts)]})

    def close(self) -> None:
        pass


def state_stream(log: DataFrame) -> DataFrame:
    """State of each job after each micro-batch of its transition log."""
    schema = "batch_id string, status string, epoch long, owner string, applied long, conflicts long"
    return log.groupBy("batch_id").transformWithStateInPandas(StateMachine(), outputStructType=schema, outputMode="Update", timeMode="None")


class Leases(StatefulProcessor):
    """Owners of jobs by heartbeat: a lease that isn't renewed in time is reported lapsed."""

    def __init__(self, ttl_ms: int = S.LEASE_S * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def _row(self, key, state: str) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": [key[0]], "lease": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in rows:
            r.shape  # the beat itself is the message
        until = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield self._row(key, "held")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.until.get()[0]:
            self.until.clear()
            yield self._row(key, "lapsed")

    def close(self) -> None:
        pass


def lease_stream(beats: DataFrame, ttl_s: int = S.LEASE_S) -> DataFrame:
    return beats.groupBy("batch_id").transformWithStateInPandas(Leases(ttl_s * 1000), outputStructType="batch_id string, lease string", outputMode="Update", timeMode="ProcessingTime")
