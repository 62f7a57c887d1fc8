"""One batch job as a plan: lines -> validated -> planned -> dispatched -> results -> entries -> artifacts.

Each arrow is a function from DataFrame to DataFrame. The shuffles are those of the operators: one on
(batch, custom_id) for uniqueness, one on (batch, model) for planning, one on (batch, request) for
first-wins, and one by batch and route for the artifacts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import request_id
from ..operators import ingest, results


class InferenceExecutor(Protocol):
    """Answers requests, batch by batch: rows of {request_id, line} to rows of {request_id, status_code, error_code, body}."""

    def __call__(self, rows: list[dict]) -> list[dict]: ...


def lookup_executor(answers: dict[str, tuple[int | None, str | None, str]]) -> InferenceExecutor:
    """Answers by custom_id from a table; 200 and an empty object for others."""

    def run(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            status, error, body = answers.get(r["custom_id"], (200, None, "{}"))
            out.append({"request_id": r["request_id"], "status_code": status, "error_code": error, "body": body})
        return out

    return run


def validate(lines: DataFrame, endpoint: str) -> DataFrame:
    """(batch_id, ordinal, line) with the parsed fields, ``reason`` and request_id."""
    parsed = ingest.parse_lines(lines)
    reason = ingest.reject_reason(endpoint, parsed=F.col("parsed"), system_ok=F.col("system_ok"))
    return parsed.withColumn("reason", reason).withColumn("request_id", request_id(F.col("batch_id"), F.col("custom_id")))


def runnable(validated: DataFrame) -> DataFrame:
    """Requests of batches in which every line is valid: one bad line, or a repeated custom_id, fails its batch."""
    good = ingest.batch_validity(validated, F.col("reason")).filter("valid").select("batch_id")
    return validated.join(good, "batch_id", "left_semi")


def split_registered(requests: DataFrame, registry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): without a registry all models are served."""
    if registry is None:
        return requests, requests.limit(0).withColumn("error_code", F.lit("model_not_found"))
    return requests.join(registry.select("model"), "model", "left_semi"), ingest.unregistered(requests, registry)


def dispatch(planned: DataFrame, executor: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Answers of the executor, in Arrow batches, requests in plan order within their partition."""
    rows = planned.select("batch_id", "custom_id", "ordinal", "request_id", "model", "line", "position")
    ordered = rows.repartition("batch_id", "model").sortWithinPartitions("batch_id", "model", "position")
    schema = pa.schema([("batch_id", pa.string()), ("custom_id", pa.string()), ("ordinal", pa.int64()), ("request_id", pa.string()), ("status_code", pa.int32()), ("error_code", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.to_pylist()
            answers = {a["request_id"]: a for a in executor(asked)}
            lost = {"status_code": None, "error_code": "server_error", "body": None}
            out = [{k: r[k] for k in ("batch_id", "custom_id", "ordinal", "request_id")} | {k: answers.get(r["request_id"], lost)[k] for k in lost} for r in asked]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, "batch_id string, custom_id string, ordinal long, request_id string, status_code int, error_code string, body string")


def run(lines: DataFrame, endpoint: str, executor: Callable[[list[dict]], list[dict]], registry: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Finished entries (batch_id, ordinal, custom_id, request_id, status_code, error_code, body) of all runnable batches.

    ``done`` are entries of an earlier run: their requests are skipped, and their results kept.
    """
    valid = runnable(validate(lines, endpoint))
    accepted, rejected = split_registered(valid, registry)
    todo = results.skip_terminal(accepted, done) if done is not None else accepted
    answers = dispatch(ingest.plan(todo), executor)
    columns = ["batch_id", "ordinal", "custom_id", "request_id", "status_code", "error_code", "body"]
    refused = rejected.withColumns({"status_code": F.lit(None).cast("int"), "body": F.lit(None).cast("string")})
    out = answers.select(*columns).unionByName(refused.select(*columns))
    if done is not None:
        kept = done.filter(F.col("status").isin("completed", "failed")).join(refused.select("batch_id", "custom_id"), ["batch_id", "custom_id"], "left_anti")
        out = out.unionByName(kept.select(*columns))
    return out
