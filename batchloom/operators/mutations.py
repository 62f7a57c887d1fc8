"""Writes as projections: each gives the rows after the write and, where a caller must know, what became of each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import priority_us, same_json

OPEN_ENTRIES = ("pending", "in_flight")


def _open(status: str = "status") -> Column:
    return ~F.col(status).isin(*S.TERMINAL)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with new rows; all of its columns are required."""
    missing = set(table.columns) - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, changes: DataFrame, columns: Sequence[str], fences: Sequence[str] = ()) -> DataFrame:
    """Verdict of each change (id, new_<column>..., expected_<fence>...): applied, conflict or not_found, with the row's new values.

    Empty new values leave a column as it is; a fence that is null isn't checked.
    """
    rows = table.select("id", *dict.fromkeys([*columns, *fences]), F.lit(True).alias("__there"))
    joined = changes.join(rows, "id", "left")
    held = reduce(lambda a, b: a & b, [F.col(f"expected_{c}").isNull() | F.col(f"expected_{c}").eqNullSafe(F.col(c)) for c in fences], F.lit(True))
    verdict = F.when(F.col("__there").isNull(), "not_found").when(held, "applied").otherwise("conflict")
    new = [F.when(verdict == "applied", F.coalesce(F.when(F.col(f"new_{c}") != "", F.col(f"new_{c}")), F.col(c))).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select("id", verdict.alias("verdict"), *new)


def delete(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, ids that were deleted)."""
    wanted = ids.select("id").distinct()
    return table.join(wanted, "id", "left_anti"), table.select("id").join(wanted, "id", "left_semi")


def set_counts(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Progress (id, at_epoch, total, completed, failed) goes into open rows of its epoch; other rows keep what they have."""
    new = counts.select("id", "at_epoch", *[F.col(c).alias(f"__{c}") for c in ("total", "completed", "failed")])
    ok = F.coalesce((F.col("at_epoch") == F.col("epoch")) & _open(), F.lit(False))
    out = items.join(new, "id", "left")
    return out.withColumns({c: F.when(ok, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("total", "completed", "failed")}).select(*items.columns)


def cancel_if_queued(items: DataFrame, ids: DataFrame, now_s: int) -> DataFrame:
    """Rows of ``ids`` (id) that are cancelled at once, as they are fresh and nobody has claimed them: a new epoch, and the time of it."""
    hit = (F.col("status") == "validating") & F.col("processor_id").isNull() & ~F.col("resumable")
    queued = items.filter(hit).join(ids.select("id").distinct(), "id", "left_semi")
    return queued.withColumns({"status": F.lit("cancelled"), "cancelled_at": F.lit(now_s).cast("long"), "epoch": F.col("epoch") + 1})


def claim(items: DataFrame, top: DataFrame, owner: str, now_s: int, lease_s: int) -> DataFrame:
    """The rows of ``top`` (id) as their claimant gets them: owned, a new epoch. A resumable row gets a lease and keeps its attempts;
    a fresh one has no lease and begins with none."""
    again = F.col("resumable")
    return items.join(top.select("id"), "id", "left_semi").withColumns(
        {
            "processor_id": F.lit(owner), "epoch": F.col("epoch") + 1, "recovery_attempts": F.when(again, F.col("recovery_attempts")).otherwise(F.lit(0).cast("long")),
            "lease_at": F.when(again, F.lit(now_s + lease_s).cast("long")),
        }
    )


def enqueue(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (id, owner, at_epoch, expected_status) that their owner gives back: validating, unowned, a new epoch. Resumable, final or
    meanwhile changed rows don't go back."""
    rows = items.join(jobs.select("id", "owner", "at_epoch", "expected_status"), "id")
    ok = (F.col("epoch") == F.col("at_epoch")) & (F.col("processor_id") == F.col("owner")) & (F.col("status") == F.col("expected_status")) & ~F.col("resumable") & _open()
    return rows.filter(ok).withColumns({"status": F.lit("validating"), "processor_id": F.lit(None).cast("string"), "epoch": F.col("epoch") + 1}).select(*items.columns)


def requeue_orphans(items: DataFrame, orphans: DataFrame, now_s: int, count_attempt: bool = True) -> DataFrame:
    """Orphans (id, owner, at_epoch, need_lapsed) that go back to the queue under a new epoch; one whose lease was renewed meanwhile
    doesn't, nor one without a lease where it has to have lapsed. ``old_owner`` is whom to record as submitter."""
    rows = items.join(orphans.select("id", "owner", "at_epoch", "need_lapsed"), "id")
    lapsed = F.coalesce(F.col("lease_at") <= now_s, F.lit(False))
    ok = (F.col("processor_id") == F.col("owner")) & (F.col("epoch") == F.col("at_epoch")) & F.col("resumable") & _open() & (~F.col("need_lapsed") | lapsed)
    none = F.lit(None)
    out = rows.filter(ok).withColumns(
        {
            "old_owner": F.col("owner"), "processor_id": none.cast("string"), "lease_at": none.cast("long"), "epoch": F.col("epoch") + 1,
            "recovery_attempts": F.col("recovery_attempts") + int(count_attempt),
        }
    )
    return out.select(*items.columns, "old_owner")


def record_submitters(entries: DataFrame, requeued: DataFrame) -> DataFrame:
    """Entries in flight whose submitter isn't known take the owner that their batch (id, old_owner) has just lost."""
    lost = requeued.select(F.col("id").alias("batch_id"), F.col("old_owner").alias("__old"))
    hit = (F.col("status") == "in_flight") & F.col("submitted_by").isNull()
    out = entries.join(lost, "batch_id", "left")
    return out.withColumn("submitted_by", F.when(hit, F.col("__old")).otherwise(F.col("submitted_by"))).select(*entries.columns)


def finalize(items: DataFrame, targets: DataFrame, now_s: int) -> DataFrame:
    """Verdict of each terminal write (id, owner, at_epoch, expected_status, document), and the row's document, ``resumable`` and lease after it.

    Applied by the owner of a resumable row in its epoch, under an unexpired lease, from the expected status; same if the row
    holds the very document already (keys in any order); else a conflict. The owner stays in the row.
    """
    kept = items.select("id", "status", "status_document", "processor_id", "epoch", "resumable", "lease_at", F.lit(True).alias("__there"))
    rows = targets.join(kept, "id", "left")
    fence = (F.col("processor_id") == F.col("owner")) & (F.col("epoch") == F.col("at_epoch")) & F.col("resumable") & (F.col("lease_at") > now_s) & (F.col("status") == F.col("expected_status"))
    verdict = F.when(F.coalesce(fence, F.lit(False)), "applied").when(F.col("__there") & same_json(F.col("status_document"), F.col("document")), "same").otherwise("conflict")
    rows = rows.withColumn("verdict", verdict)
    done = F.col("verdict") == "applied"
    return rows.select(
        "id", "verdict", F.when(done, F.col("document")).otherwise(F.col("status_document")).alias("status_document"), F.when(done, F.lit(False)).otherwise(F.col("resumable")).alias("resumable"),
        F.when(~done, F.col("lease_at")).alias("lease_at"), "processor_id",
    )


def entry_writes(entries: DataFrame, items: DataFrame, writes: DataFrame, now_s: int) -> DataFrame:
    """Adds ``verdict`` to writes (batch_id, custom_id, owner, at_epoch, ...) to entries.

    updated: the writer owns the resumable, open batch in its epoch by an unexpired lease, and the entry is open; duplicate: the
    writer is the batch's owner, but the entry is final; else conflict.
    """
    b = items.select(
        F.col("id").alias("batch_id"), F.col("processor_id").alias("__owner"), F.col("epoch").alias("__epoch"), ((F.col("lease_at") > now_s) & F.col("resumable") & _open()).alias("__live")
    )
    e = entries.select("batch_id", "custom_id", F.col("status").alias("__status"))
    rows = writes.join(b, "batch_id", "left").join(e, ["batch_id", "custom_id"], "left")
    held = F.coalesce((F.col("__owner") == F.col("owner")) & (F.col("__epoch") == F.col("at_epoch")), F.lit(False))
    open_entry = F.col("__status").isin(*OPEN_ENTRIES)
    verdict = F.when(held & F.coalesce(F.col("__live") & open_entry, F.lit(False)), "updated").when(held & F.coalesce(~open_entry, F.lit(False)), "duplicate").otherwise("conflict")
    return rows.withColumn("verdict", verdict).select(*writes.columns, "verdict")


def mark_in_flight(entries: DataFrame, items: DataFrame, sent: DataFrame, now_s: int) -> DataFrame:
    """The entries after their submissions (batch_id, custom_id, owner, at_epoch) were recorded: in flight, one attempt more, by that owner."""
    done = entry_writes(entries, items, sent, now_s).filter("verdict = 'updated'").groupBy("batch_id", "custom_id").agg(F.first("owner").alias("__by"))
    hit = F.col("__by").isNotNull()
    out = entries.join(done, ["batch_id", "custom_id"], "left")
    return out.withColumns(
        {"attempts": F.col("attempts") + hit.cast("int"), "submitted_by": F.when(hit, F.col("__by")).otherwise(F.col("submitted_by")), "status": F.when(hit, "in_flight").otherwise(F.col("status"))}
    ).select(*entries.columns)


def checkpoint_results(entries: DataFrame, items: DataFrame, results: DataFrame, now_s: int) -> DataFrame:
    """The entries after results (batch_id, custom_id, owner, at_epoch, arrival, result_status, key, bytes, code, sha256) were committed.

    Only completed and failed commit; of several the first to arrive wins; a final entry stays as it is. An empty key, code or
    digest and no bytes are null.
    """
    results = results if "sha256" in results.columns else results.withColumn("sha256", F.lit(None).cast("string"))
    ok = entry_writes(entries, items, results.filter(F.col("result_status").isin("completed", "failed")), now_s).filter("verdict = 'updated'")
    first = ok.groupBy("batch_id", "custom_id").agg(F.min_by(F.struct("result_status", "key", "bytes", "code", "sha256"), "arrival").alias("__r"))
    hit = F.col("__r").isNotNull()
    new = {"status": F.col("__r.result_status"), "result_key": F.nullif("__r.key", F.lit("")), "result_bytes": F.when(F.col("__r.bytes") > 0, F.col("__r.bytes")), "result_sha256": F.nullif("__r.sha256", F.lit("")), "error_code": F.nullif("__r.code", F.lit("")), "completed_at": F.lit(now_s).cast("long")}
    old = {c: F.col(c) if c in entries.columns else F.lit(None) for c in new}
    out = entries.join(first, ["batch_id", "custom_id"], "left")
    return out.select(*[c for c in entries.columns if c not in new], *[F.when(hit, new[c]).otherwise(old[c]).alias(c) for c in new])


def status_check(rows: DataFrame, epoch: Column) -> Column:
    """Whether a status may still be written: a missing row, another epoch or a final status is a conflict."""
    gone = F.col("status").isNull() | (F.col("epoch") != epoch) | F.col("status").isin(*S.TERMINAL)
    return F.when(gone, "conflict").otherwise("ok")


def create_rows(requests: DataFrame) -> DataFrame:
    """Rows of accepted create requests (id, tenant_id, created_at, window_s, tags): validating, unclaimed, with a deadline."""
    return requests.select(
        "id", "tenant_id", F.lit("validating").alias("status"), "created_at", priority_us(F.col("created_at"), F.col("window_s")).alias("priority"), F.lit(None).cast("string").alias("processor_id"),
        F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("recovery_attempts"), F.lit(False).alias("resumable"), F.lit(0).cast("long").alias("expiry"),
    )


def live_processors(pods: DataFrame) -> DataFrame:
    """Processors that count as alive: their pod is ready."""
    return pods.filter("ready").select("processor_id").distinct()


def resolve_endpoints(requests: DataFrame, endpoints: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``target``: the endpoint of the request's model, or the global one if there is one."""
    e = endpoints.select("model", F.col("url").alias("__url")).dropDuplicates(["model"])
    return requests.join(e, "model", "left").withColumn("target", F.coalesce("__url", F.lit(default))).drop("__url")


def api_json(documents: DataFrame, omit_if_null: Sequence[str]) -> Column:
    """A row as JSON: nulls are written, but for some fields that are left out when empty."""
    keep = [c for c in documents.columns if c not in omit_if_null]
    fixed = F.to_json(F.struct(*keep), {"ignoreNullFields": "false"})
    extra = F.to_json(F.struct(*omit_if_null)) if omit_if_null else F.lit("{}")
    return F.when(extra == "{}", fixed).otherwise(F.concat(F.substring(fixed, F.lit(1), F.length(fixed) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra))))
