"""The recovery hold as a stream: requests that a lost processor had in flight wait for their stranded results before they are sent again."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Workers get the processors with the query, wherever the package is installed.
register_pickle_by_value(sys.modules[__name__])

OUT = "batch_id string, request_id string, outcome string, at long"


class Hold(StatefulProcessor):
    """The holds of a group's batches: when each began, ends, and was last answered, and its requests that still wait. One timer stands at the earliest end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holds = handle.getValueState("holds", "batch_id array<string>, start array<long>, until array<long>, last array<long>")
        self.waiting = handle.getValueState("waiting", "batch_id array<string>, request_id array<string>")

    def _load(self) -> tuple[dict, dict[str, dict], int | None]:
        """The holds by batch, the requests that wait by batch, and the timer that is set."""
        held, waits = self.holds.get(), self.waiting.get()
        holds = {b: hold for b, *hold in zip(*held)} if held else {}
        waiting: dict[str, dict] = {b: {} for b in holds}
        for batch, request in zip(*waits) if waits else ():
            waiting[batch][request] = None
        return holds, waiting, min((h[1] for h in holds.values()), default=None)

    def _store(self, holds: dict, waiting: dict[str, dict], timer: int | None) -> None:
        if holds:
            self.holds.update((list(holds), *map(list, zip(*holds.values()))))
            self.waiting.update(tuple(map(list, zip(*[(b, r) for b in holds for r in waiting[b]]))))
        else:
            self.holds.clear()
            self.waiting.clear()
        due = min((h[1] for h in holds.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer * 1000)
            if due is not None:
                self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, list[tuple]] = {}
        for f in rows:
            for batch, *row in zip(f["batch_id"].tolist(), f["kind"].eq("result").tolist(), f["sec"].tolist(), f["request_id"].tolist(), f["wait_s"].tolist()):
                came.setdefault(batch, []).append(row)
        out: list[tuple] = []
        holds, waiting, timer = self._load()
        for batch, rows_of in came.items():
            hold, wait_for, skipped = holds.get(batch), waiting.setdefault(batch, {}), {}
            for is_result, sec, request, wait in sorted(rows_of, key=lambda x: (x[0], x[1], x[2])):
                if not is_result:
                    if wait <= 0:
                        out.append((batch, request, "submit", sec))
                        skipped[sec] = (batch, None, "skipped", sec)
                        continue
                    if hold is None:
                        hold = [sec, sec + int(wait), sec]
                    wait_for.setdefault(request)
                elif hold is not None and hold[0] <= sec <= hold[1] and request in wait_for:
                    del wait_for[request]
                    hold[2] = max(hold[2], sec)
                    out.append((batch, request, "delivered", sec))
            out += skipped.values()
            if hold is not None and not wait_for:  # nothing is left to wait for
                out.append((batch, None, "resolved", hold[2]))
                holds.pop(batch, None)
            elif hold is not None:
                holds[batch] = hold
        self._store(holds, waiting, timer)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holds, waiting, _ = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        for batch in [b for b, h in holds.items() if h[1] * 1000 <= now]:
            until = holds.pop(batch)[1]
            out += [*[(batch, request, "submit", until) for request in waiting[batch]], (batch, None, "timed_out", until)]
        self._store(holds, waiting, None)  # the timer that has fired is taken back by Spark
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def recovery_stream(rows: DataFrame, delay: str, groups: int | None = None) -> DataFrame:
    """(batch_id, request_id, outcome, at) of (batch_id, request_id, kind, at, sec, wait_s), a stream of what is held and of results.

    A row of kind ``held`` puts a request on hold from ``sec`` for ``wait_s`` seconds (see ``recovery_wait``), by kind ``result`` its result has come. A request is
    ``delivered`` by a result within the hold, or it is to be sent again: ``submit``. A row without a request tells how the batch's hold ended:
    resolved as soon as nothing waits, timed_out at its end by the watermark, skipped where there is no time to wait. A batch's held requests come in one
    micro-batch; results may come in any order within the watermark's ``delay``, and results of other requests are left out.

    Spark calls the processor once a group, at some milliseconds a call: so batches share ``groups`` groups of state by the hash of their id, or without
    that number each has its own. A checkpoint stays with its number of groups.
    """
    group = F.pmod(F.xxhash64("batch_id"), F.lit(groups)) if groups else F.col("batch_id")
    timed = rows.withWatermark("at", delay).select(group.alias("group"), "batch_id", "request_id", "kind", "sec", "wait_s", "at")
    return timed.groupBy("group").transformWithStateInPandas(Hold(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
