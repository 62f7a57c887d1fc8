"""Folds over rows in order that hold one state, not one key's whole history.

Rows are dealt by their keys and sorted within the partitions (Spark spills what memory does not hold), and each
partition is read once, in Arrow batches. A key's fold is a chain of steps, so one key is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def fold_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], start: Callable[[], object], step: Callable[[object, dict], object], finish: Callable[[object], dict], schema: str) -> DataFrame:
    """(keys..., what ``finish`` gives by ``schema``): ``step`` takes the state and a row, a dict of all its columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([rows.schema[k] for k in keys] + list(T._parse_datatype_string(schema)))
    arrow, names = to_arrow_schema(kind), list(keys)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for r in b.to_pylist():
                key = tuple(r[k] for k in names)
                if key != now:
                    if now is not None:
                        done.append(dict(zip(names, now)) | finish(state))
                    now, state = key, start()
                state = step(state, r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now)) | finish(state)], schema=arrow)

    return ordered.mapInArrow(run, kind)
