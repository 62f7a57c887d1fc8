"""Results: normalisation, first-wins commits, routing, artifacts, resume and integrity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import compact_json, html_safe
from ..functions.scalars import not_executed_message, result_error, result_key, succeeded
from ..schemas import DROPPED_LATE

ROUTES = ("output", "error")


def first_wins(deliveries: DataFrame, keys: tuple[str, ...] = ("batch_id", "custom_id"), order: str = "arrival") -> DataFrame:
    """One delivery a request, the first: at-least-once delivery, exactly-once accounting.

    A minimum over the row keeps a partial aggregate in the map side, so a request that is delivered over
    and over isn't sorted in one task.
    """
    rest = [c for c in deliveries.columns if c not in keys]
    row = F.struct(F.col(order).alias("__order"), *[F.col(c) for c in rest])
    return deliveries.groupBy(*keys).agg(F.min(row).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def route(error_code: Column) -> Column:
    """A request that failed without an error object, on its HTTP status alone, is an output line."""
    return F.when(error_code.isNull(), "output").otherwise("error")


def finalize_counts(entries: DataFrame) -> DataFrame:
    """Per batch: total, completed, failed (with what never ran), lines of either artifact and bytes."""
    ok = succeeded(F.col("status_code"), F.col("error_code"))
    to = route(F.col("error_code"))
    return entries.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"),
        F.count_if(to == "output").alias("output_lines"), F.count_if(to == "error").alias("error_lines"), F.sum("result_bytes").cast("long").alias("bytes"),
    )


def status_counts(entries: DataFrame) -> DataFrame:
    """Per batch, entries by status."""
    s = F.col("status")
    return entries.groupBy("batch_id").agg(*[F.count_if(s == v).alias(v) for v in ("pending", "in_flight", "completed", "failed")])


def terminal_ids(entries: DataFrame) -> DataFrame:
    """Per batch, the requests a resumed run skips, by ordinal."""
    done = entries.filter(F.col("status").isin("completed", "failed"))
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "custom_id")))
    return done.groupBy("batch_id").agg(F.transform(rows, lambda r: r["custom_id"]).alias("ids"))


def skip_terminal(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests still to run."""
    done = entries.filter(F.col("status").isin("completed", "failed")).select("batch_id", "custom_id")
    return requests.join(done, ["batch_id", "custom_id"], "left_anti")


def open_batches(entries: DataFrame) -> DataFrame:
    """Batches with any entry that isn't final."""
    return entries.filter(F.col("status").isin("pending", "in_flight")).select("batch_id").distinct()


def in_flight_by_submitter(entries: DataFrame) -> DataFrame:
    """Foreign submitters of entries in flight: whose queues a recovery has to listen to."""
    rows = entries.filter((F.col("status") == "in_flight") & F.col("submitted_by").isNotNull())
    return rows.groupBy("submitted_by").agg(F.count("*").alias("entries"), F.countDistinct("batch_id").alias("batches"))


def owned_entries(entries: DataFrame, batches: DataFrame, owner: str, epoch: int) -> DataFrame:
    """Entries of the batches that an owner holds in an epoch."""
    held = batches.filter((F.col("processor_id") == owner) & (F.col("epoch") == epoch)).select(F.col("id").alias("batch_id"))
    return entries.join(held, "batch_id")


def enrich(results: DataFrame, pending: DataFrame) -> DataFrame:
    """Results with what the pending set knows, where they lack it; without a custom_id on either side they are dropped."""
    known = pending.select("request_id", *[F.col(c).alias(f"__{c}") for c in ("custom_id", "model", "submitted_at")])
    joined = results.join(known, "request_id", "left")
    filled = joined.withColumns({c: F.coalesce(F.when(F.col(c) != "", F.col(c)) if c != "submitted_at" else F.col(c), F.col(f"__{c}")) for c in ("custom_id", "model", "submitted_at")})
    return filled.filter("custom_id is not null").select(*results.columns)


def broadcast_results(results: DataFrame, subscribers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results for every subscriber that owns their batch, and the residue that none owns."""
    return results.join(subscribers, "batch_id"), results.join(subscribers.select("batch_id").distinct(), "batch_id", "left_anti")


def safe_residue(residue: DataFrame, entries: DataFrame) -> DataFrame:
    """Residue that may be acknowledged: its batch has no open entry."""
    return residue.join(open_batches(entries), "batch_id", "left_anti")


def normalise_async(results: DataFrame) -> DataFrame:
    """(status_code, error_code, body) of queue results to response and error: status_out, code_out, message_out, body_out.

    No status but a code or message is an error; no status else is 200; an empty or unreadable body is an
    error under 2xx, and otherwise keeps the status.
    """
    status, code, body = F.coalesce(F.col("status_code"), F.lit(0)), F.coalesce(F.col("error_code"), F.lit("")), F.coalesce(F.col("body"), F.lit(""))
    message = F.coalesce(F.col("error_message"), F.lit(""))
    broken = (status == 0) & ((code != "") | (message != ""))
    real = F.when(status == 0, F.lit(200)).otherwise(status)
    good = real.between(200, 299)
    readable = F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{")
    fault = F.when(broken, F.when(code != "", code).otherwise(F.lit("server_error"))).when(good & (body == ""), "server_error").when(good & ~readable, "parse_error")
    text = F.when(broken, F.when(message != "", message).otherwise(F.lit("async request failed"))).when(good & (body == ""), "async response has no body").when(good & ~readable, "response body could not be parsed")
    wrapped = F.to_json(F.struct(F.struct(body.alias("message")).alias("error")))
    return results.withColumns(
        {
            "status_out": F.when(fault.isNull(), real),
            "code_out": fault,
            "message_out": text,
            "body_out": F.when(fault.isNull(), F.when(body == "", F.lit("{}")).when(readable, body).otherwise(wrapped)),
        }
    )


def normalise_sync(results: DataFrame) -> DataFrame:
    """(status_code, category, dropped_reason, body) of direct calls: status_out and code_out.

    Without a status the category is the code; a request dropped for its deadline is a batch_expired
    error; an unreadable body under 200 is a parse error; any other status is a response.
    """
    status, body = F.coalesce(F.col("status_code"), F.lit(0)), F.coalesce(F.col("body"), F.lit(""))
    unreadable = (body != "") & ~(F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{"))
    code = (
        F.when(status <= 0, F.coalesce(F.col("category"), F.lit("SERVER_ERROR")))
        .when((status != 200) & (F.col("dropped_reason") == DROPPED_LATE), "batch_expired")
        .when((status == 200) & unreadable, "PARSE_ERROR")
    )
    return results.withColumn("code_out", code).withColumn("status_out", F.when(code.isNull(), status))


def result_lines(entries: DataFrame) -> DataFrame:
    """(batch_id, ordinal, route, line) of finished requests, with the line's size and digest.

    ``body`` is the response's JSON text and goes into the line in its canonical form (``canonical_json``); without one, or if it can't be read, the
    body is null. An error's ``error_message`` is used where the entries have that column and it isn't null, else the code's own text.
    """
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    said = not_executed_message(F.col("error_code"))
    message = F.coalesce(F.col("error_message"), said) if "error_message" in entries.columns else said
    body = F.coalesce(compact_json(F.col("body")), F.lit("null"))
    response = F.concat(F.lit('{"status_code":'), F.coalesce(F.col("status_code").cast("string"), F.lit("0")), F.lit(',"request_id":'), text(F.col("request_id")), F.lit(',"body":'), body, F.lit("}"))
    err = F.concat(F.lit('{"code":'), text(F.col("error_code")), F.lit(',"message":'), text(message), F.lit("}"))
    failed = F.col("error_code").isNotNull()
    line = F.concat(
        F.lit('{"id":'), text(F.col("request_id")), F.lit(',"custom_id":'), text(F.col("custom_id")), F.lit(',"response":'), F.when(failed, "null").otherwise(response),
        F.lit(',"error":'), F.when(failed, err).otherwise("null"), F.lit("}\n"),
    )
    return entries.withColumn("line", html_safe(line)).withColumns({"route": route(F.col("error_code")), "bytes": F.octet_length("line").cast("long"), "sha256": F.sha2("line", 256)})


def artifacts(lines: DataFrame, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """Per (batch, route): lines, bytes and digest of the artifact in ordinal order; a route without lines has no row.

    Digests are fed with an artifact's lines batch by batch, so an artifact is never held as one text. ``dealt`` says that all lines of an artifact
    are in one partition already, so that lines aren't shuffled; else ``tasks`` deals them out. A null line is refused.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = "batch_id string, route string, lines long, bytes long, sha256 string"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    rows = lines.select("batch_id", "route", "ordinal", "line")
    rows = rows if dealt else rows.repartition(*([tasks] if tasks else []), "batch_id", "route")
    rows = rows.sortWithinPartitions("batch_id", "route", "ordinal", "line").select("batch_id", "route", "line")

    def run(batches):
        key, state, count, size = None, None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if b.column(2).null_count:
                raise ValueError("an artifact has a line that is null")
            # Lines stand one behind the other in the column, so an artifact's are one piece of it.
            text = b.column(2).cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
            data = memoryview(text.buffers()[2] or b"")
            ids, routes = (b.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1))
            codes = [c.indices.to_numpy() for c in (ids, routes)]
            starts = np.flatnonzero(np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])]))
            heads = list(zip(b.column(0).take(pa.array(starts)).to_pylist(), b.column(1).take(pa.array(starts)).to_pylist()))
            cuts = [*starts.tolist(), n]
            at = ends[cuts].tolist()
            done = []
            for k, head in enumerate(heads):
                if head != key or state is None:
                    if state is not None:
                        done.append((*key, count, size, state.hexdigest()))
                    key, state, count, size = head, hashlib.sha256(), 0, 0
                state.update(data[at[k] : at[k + 1]])
                count += cuts[k + 1] - cuts[k]
                size += at[k + 1] - at[k]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*key, count, size, state.hexdigest())))], schema=arrow)

    return rows.mapInArrow(run, schema)


def verify_artifacts(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``same``: whether a re-derived artifact equals the stored one in size and digest."""
    s = stored.select("batch_id", "route", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha256"))
    joined = derived.join(s, ["batch_id", "route"], "left")
    return joined.withColumn("same", F.coalesce((F.col("bytes") == F.col("__bytes")) & (F.col("sha256") == F.col("__sha256")), F.lit(False))).drop("__bytes", "__sha256")


def write_artifacts(lines: DataFrame, path: str) -> None:
    """One folder a batch and route, lines in ordinal order; nothing is written for a route without lines."""
    rows = lines.select("batch_id", "route", "ordinal", F.rtrim(F.col("line"), F.lit("\n")).alias("value"))
    dealt = rows.repartition("batch_id", "route").sortWithinPartitions("batch_id", "route", "ordinal")
    dealt.drop("ordinal").write.mode("errorifexists").partitionBy("batch_id", "route").text(path)


def checked_results(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries with their result objects, and ``intact``: whether bytes and digest are as recorded."""
    o = objects.select("result_key", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha256"))
    same = (F.col("result_bytes") == F.col("__bytes")) & (F.col("result_sha256") == F.col("__sha256"))
    return entries.join(o, "result_key", "left").withColumn("intact", F.coalesce(same, F.lit(False))).drop("__bytes", "__sha256")


def object_keys(results: DataFrame) -> DataFrame:
    """Keys of result objects: a second object of a request with other content gets a key of its own, the same content reuses it."""
    content = results.groupBy("batch_id", "request_id", "sha256").agg(F.min("arrival").alias("arrival"), F.count("*").alias("deliveries"))
    n = F.row_number().over(W.partitionBy("batch_id", "request_id").orderBy("arrival", "sha256"))
    base = result_key(F.col("batch_id"), F.col("request_id"))
    return content.withColumn("n", n).withColumn("key", F.when(F.col("n") == 1, base).otherwise(F.concat(F.regexp_replace(base, r"\.jsonl$", ""), F.lit("-"), F.substring("sha256", 1, 16), F.lit(".jsonl"))))


def not_executed(planned: DataFrame, dispatched: DataFrame, code: str) -> DataFrame:
    """Error rows for all requests that were never dispatched, so that lines add up to the total."""
    left = planned.join(dispatched.select("batch_id", "custom_id"), ["batch_id", "custom_id"], "left_anti")
    return left.withColumn("error_code", F.lit(code)).withColumn("message", not_executed_message(F.col("error_code")))


def manifest_mismatches(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Positions at which a re-derived manifest and the stored entries differ: missing, another identity, or rejected on one side only."""
    m = manifest.select("batch_id", "ordinal", F.col("custom_id").alias("m_id"), F.col("rejected").alias("m_rejected"))
    e = entries.select("batch_id", "ordinal", F.col("custom_id").alias("e_id"), ((F.col("status") == "failed") & (F.col("attempts") == 0)).alias("e_rejected"))
    both = m.join(e, ["batch_id", "ordinal"], "full_outer")
    kind = (
        F.when(F.col("e_id").isNull(), "missing").when(F.col("m_id").isNull(), "extra").when(F.col("m_id") != F.col("e_id"), "identity").when(F.col("m_rejected") != F.col("e_rejected"), "rejected")
    )
    return both.withColumn("mismatch", kind).filter("mismatch is not null").select("batch_id", "ordinal", "mismatch")


def coverage(requests: DataFrame, output: DataFrame, error: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per batch: requests, lines, requests without a line, lines without a request, and repeated lines. A null id equals no other.

    Requests and lines are counted together by their ids, in place of a join; ``tasks`` deals them out by batch, so that no task grows with the input.
    """
    def tagged(rows: DataFrame, asked: int) -> DataFrame:
        side = F.when(F.col("batch_id").isNull() | F.col("custom_id").isNull(), asked).otherwise(0)
        return rows.select("batch_id", "custom_id", side.alias("side"), F.lit(asked).alias("asked"), F.lit(1 - asked).cast("long").alias("line"))

    every = tagged(requests, 1).unionByName(tagged(output, 0)).unionByName(tagged(error, 0))
    every = every.repartition(tasks, "batch_id") if tasks else every
    ids = every.groupBy("batch_id", "custom_id", "side").agg(F.max("asked").alias("asked"), F.sum("line").alias("lines"))
    asked = F.col("asked") == 1
    return ids.groupBy("batch_id").agg(
        F.count_if(asked).alias("requests"), F.sum("lines").alias("lines"), F.count_if(F.col("lines") == 0).alias("uncovered"),
        F.count_if(~asked).alias("unasked"), F.count_if(F.col("lines") > 1).alias("repeated"),
    )


def error_counts(entries: DataFrame) -> DataFrame:
    return entries.withColumn("error", result_error(F.col("status_code"), F.col("error_code"))).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))
