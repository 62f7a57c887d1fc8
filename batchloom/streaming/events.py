"""Event delivery as a stream: a durable first-in-first-out queue a job, whose events go to a channel of few slots or expire."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Workers get the processors with the query, wherever the package is installed.
register_pickle_by_value(sys.modules[__name__])

OUT = "job_id string, id long, outcome string, at long"


class Channel(StatefulProcessor):
    """One job: a list of its events that wait, in order, and how many slots of its channel are taken."""

    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, expires long")
        self.taken = handle.getValueState("taken", "n long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for f in rows:
            came += zip(f["sec"].tolist(), f["id"].tolist(), f["expires"].tolist(), f["takes"].tolist())
        waiting = [tuple(w) for w in self.waiting.get()]
        taken, timer = self.taken.get() or (0, 0)
        out = []
        for sec, id_, expires, takes in sorted(came):
            if takes:
                taken = max(0, taken - int(takes))
            else:
                waiting.append((id_, int(expires)))
            left = []
            for w in waiting:  # in order; a full channel stops all that come after
                if w[1] > sec and taken < self.slots:
                    taken += 1
                    out.append((key[0], w[0], "delivered", sec))
                else:
                    left.append(w)
            waiting = left
        self._store(waiting, taken, timer)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [tuple(w) for w in self.waiting.get()]
        now = timerValues.getCurrentWatermarkInMs()
        gone = [(key[0], id_, "expired", expires) for id_, expires in waiting if expires * 1000 < now]
        self._store([w for w in waiting if w[1] * 1000 >= now], (self.taken.get() or (0, 0))[0], 0)
        if gone:
            yield self._frame(gone)

    def _store(self, waiting: list[tuple], taken: int, timer: int) -> None:
        """Keeps the job, and one timer just after its first expiry; ``timer`` is the one that is set, or 0."""
        due = min((w[1] for w in waiting), default=-1) * 1000 + 1 if waiting else 0
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.taken.update((taken, due))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def delivery_stream(rows: DataFrame, slots: int, delay: str) -> DataFrame:
    """(job_id, id, outcome, at) of (job_id, id, sec, at, expires, takes), a stream of events and of the reader's takes (``takes`` slots freed; 0 for an event).

    An event is delivered, and with that acknowledged, as soon as a slot is free and no earlier one waits; it must not have expired by then. One that
    waits until after its expiry is expired by the watermark; one that expires just now is neither. Rows of a job go by ``sec`` and id within a micro-batch.
    """
    timed = rows.withWatermark("at", delay)
    return timed.groupBy("job_id").transformWithStateInPandas(Channel(slots), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
