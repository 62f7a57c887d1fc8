"""The job's life: decisions as expressions, and state as a fold over an ordered log of transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import result_key
from .results import result_lines


def past_deadline(now_s: int) -> Column:
    """Strictly after the deadline; without one (0) never."""
    return (F.col("priority") != 0) & (F.lit(now_s * 1_000_000) > F.col("priority"))


def owned_fence(owner: str, epoch: int, now_s: int) -> Column:
    """Whether a writer may still touch a row: it owns it in this epoch, by an unexpired lease, and the job is resumable and open."""
    return (F.col("processor_id") == owner) & (F.col("epoch") == epoch) & (F.col("lease_at") > now_s) & F.col("resumable") & ~F.col("status").isin(*S.TERMINAL)


def cancel_route(status: Column, queued: Column) -> Column:
    return (
        F.when(status == "cancelled", "return").when(~status.isin(*S.CANCELLABLE), "reject").when(status == "cancelling", "resend").when(queued, "cancelled").otherwise("cancelling")
    )


def pickup_route(status: Column, resumable: Column, late: Column, attempts: Column) -> Column:
    """What a processor does with a job it has claimed."""
    fresh = F.when(late, "expired").when(status.isin(*S.RUNNABLE), "run").when(status == "cancelling", "cancelled").otherwise("skip")
    resumed = F.when(status == "cancelling", "cancelled").when(late, "expired").when(attempts > S.MAX_RECOVERY_ATTEMPTS, "failed").otherwise("resume")
    return F.when(resumable, resumed).otherwise(fresh)


def startup_route(status: Column, resumable: Column, attempts: Column) -> Column:
    """What a restarted processor does with a job it still owns."""
    return (
        F.when(resumable, "requeue").when(attempts > S.MAX_RECOVERY_ATTEMPTS, "failed").when(status == "validating", "requeue").when(status.isin(*S.TERMINAL), "clean_up").otherwise("failed")
    )


def abort_route(cause: Column, resumable: Column) -> Column:
    """Where a run that broke off goes; a shutdown leaves the job as it is."""
    return F.when(cause == "cancelled", "cancelled").when(cause == "expired", "expired").when(cause == "shutdown", "leave").otherwise("failed")


def finalize_status(cancel_requested: Column) -> Column:
    return F.when(cancel_requested, "cancelled").otherwise("completed")


def with_status(status_doc: Column, new: Column, at: Column, deadline: Column, counts: Column | None = None) -> Column:
    """The status document after a transition: status, the time that belongs to it, and counts if given."""
    out = status_doc.withField("status", new)
    times = {"in_progress": "in_progress_at", "completed": "completed_at", "failed": "failed_at", "cancelled": "cancelled_at", "expired": "expired_at", "finalizing": "finalizing_at", "cancelling": "cancelling_at"}
    for status, field in times.items():
        out = out.withField(field, F.when(new == status, at).otherwise(status_doc[field]))
    out = out.withField("expires_at", F.when(new == "validating", deadline).otherwise(status_doc["expires_at"]))
    return out.withField("request_counts", counts) if counts is not None else out


def keep_if_empty(new: Column, old: Column) -> Column:
    return F.coalesce(F.when(new != "", new), old)


def claim_owned(items: DataFrame, owner: str) -> DataFrame:
    """A restarted owner claims its open jobs again: a new epoch and one more attempt."""
    mine = items.filter((F.col("processor_id") == owner) & ~F.col("status").isin(*S.TERMINAL))
    return mine.withColumn("epoch", F.col("epoch") + 1).withColumn("recovery_attempts", F.col("recovery_attempts") + 1)


def renew_leases(items: DataFrame, owner: str, epoch: int, now_s: int, ttl_s: int = S.LEASE_S) -> DataFrame:
    """Leases of rows that pass the fence move on; others stay."""
    return items.withColumn("lease_at", F.when(owned_fence(owner, epoch, now_s), F.lit(now_s + ttl_s)).otherwise(F.col("lease_at")))


def manifest_entries(lines: DataFrame) -> DataFrame:
    """The entries with which a batch is activated, of its lines (batch_id, ordinal, custom_id, request_id, reject_code, reject_message).

    A line that ingestion accepted is pending; a rejected one has failed without an attempt, and names its result object with the bytes and digest
    of its error line.
    """
    rejected = F.col("reject_code").isNotNull()
    written = result_lines(lines.withColumns({"error_code": F.col("reject_code"), "error_message": F.col("reject_message"), "status_code": F.lit(None).cast("int"), "body": F.lit(None).cast("string")}))
    return written.select(
        "batch_id", "ordinal", "custom_id", "request_id", F.when(rejected, "failed").otherwise("pending").alias("status"), F.col("reject_code").alias("error_code"),
        F.when(rejected, result_key(F.col("batch_id"), F.col("request_id"))).alias("result_key"), F.when(rejected, F.col("bytes")).alias("result_bytes"),
        F.when(rejected, F.col("sha256")).alias("result_sha256"), F.when(rejected, F.col("line")).alias("error_line"),
    )


def activate(items: DataFrame, entries: DataFrame, manifest: DataFrame, claims: DataFrame, now_s: int, ttl_s: int = S.LEASE_S) -> tuple[DataFrame, DataFrame]:
    """(new entries, activated items) of the claims (batch_id, owner, at_epoch) that hold: still validating, not resumable, without entries.

    ``manifest`` (batch_id, ordinal, custom_id, status, error_code, and what it has of request_id, result_key, result_bytes and result_sha256) must name
    entries of a batch for it to be activated. Entries start without an attempt; one that starts as failed is done at once, with the metadata of its error
    line (``manifest_entries``). The item is in progress, resumable and leased.
    """
    extra = [F.col(n) if n in manifest.columns else F.lit(None).cast(kind).alias(n) for n, kind in (("request_id", "string"), ("result_key", "string"), ("result_bytes", "long"), ("result_sha256", "string"))]
    kept = items.join(claims.select(F.col("batch_id").alias("id"), "owner", "at_epoch"), "id")
    fence = (F.col("processor_id") == F.col("owner")) & (F.col("epoch") == F.col("at_epoch")) & (F.col("status") == "validating") & ~F.col("resumable")
    free = kept.filter(fence).select(F.col("id").alias("batch_id")).join(entries.select("batch_id").distinct(), "batch_id", "left_anti")
    ready = free.join(manifest.select("batch_id").distinct(), "batch_id", "left_semi")
    # A manifest's own entries show that their batch has some, so they are read once.
    new = manifest.join(free, "batch_id", "left_semi").select(
        "batch_id", "ordinal", "custom_id", "status", F.lit(0).cast("long").alias("attempts"), "error_code", F.when(F.col("status") == "failed", F.lit(now_s).cast("long")).alias("completed_at"), *extra
    )
    long = lambda x: F.lit(x).cast("long")
    begun = items.join(ready.withColumnRenamed("batch_id", "id"), "id", "left_semi").withColumns({"status": F.lit("in_progress"), "in_progress_at": long(now_s), "resumable": F.lit(True), "lease_at": long(now_s + ttl_s)})
    return new, begun


def violations(log: DataFrame) -> DataFrame:
    """(from, to) pairs of statuses that the machine doesn't allow, with their number."""
    spark = log.sparkSession
    allowed = spark.createDataFrame(list(S.TRANSITIONS), "expected_status string, set_status string")
    return log.join(F.broadcast(allowed), ["expected_status", "set_status"], "left_anti").groupBy("expected_status", "set_status").agg(F.count("*").alias("n"))


def fold(log: DataFrame) -> DataFrame:
    """Per batch: the state after all transitions in order, and how many applied.

    A transition applies if its expectations (status, and epoch if given) match the state so far and the
    job isn't final; else it is a conflict. This takes the place of row locks: of two writers the first
    valid one wins, a stale epoch is refused, and a final state stays.
    """
    steps = F.sort_array(F.collect_list(F.struct("seq", "expected_status", "expected_epoch", "set_status", "set_owner", "bump_epoch")))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("validating").alias("status"), zero.alias("epoch"), F.lit(None).cast("string").alias("owner"), zero.alias("applied"), zero.alias("conflicts"))

    def step(state: Column, t: Column) -> Column:
        fits = (state["status"] == t["expected_status"]) & (t["expected_epoch"].isNull() | (t["expected_epoch"] == state["epoch"])) & ~state["status"].isin(*S.TERMINAL)
        owner = F.when(t["set_status"] == "validating", F.lit(None).cast("string")).otherwise(F.coalesce(t["set_owner"], state["owner"]))
        return F.struct(
            F.when(fits, t["set_status"]).otherwise(state["status"]).alias("status"),
            (state["epoch"] + (fits & t["bump_epoch"]).cast("long")).alias("epoch"),
            F.when(fits, owner).otherwise(state["owner"]).alias("owner"),
            (state["applied"] + fits.cast("long")).alias("applied"),
            (state["conflicts"] + (~fits).cast("long")).alias("conflicts"),
        )

    folded = log.groupBy("batch_id").agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select("batch_id", "s.*")


def migrate_priority(items: DataFrame) -> DataFrame:
    """Rows from before the queue: a deadline that is null comes from a tag, and an owner that reconciliation takes for dead goes to running rows without one.

    Resumable rows have no owner while they wait for their next claim, and keep none.
    """
    tag = F.element_at("tags", F.lit("slo_unix_micro"))
    orphan = F.col("processor_id").isNull() & ~F.col("resumable") & F.col("status").isin("in_progress", "finalizing", "cancelling")
    return items.withColumns(
        {
            "priority": F.when(F.col("priority").isNull(), tag.try_cast("long")).otherwise(F.col("priority")),
            "processor_id": F.when(orphan, F.lit(S.BEFORE_QUEUE)).otherwise(F.col("processor_id")),
        }
    )


def upsert_identical(new: DataFrame, stored: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """Adds ``action`` to new records: insert, or reuse if the stored one is the same, else conflict."""
    s = stored.select(*keys, *[F.col(c).alias(f"__{c}") for c in body], F.lit(True).alias("__there"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in body])
    return new.join(s, keys, "left").withColumn("action", F.when(F.col("__there").isNull(), "insert").when(same, "reuse").otherwise("conflict")).select(*new.columns, "action")


def triage(items: DataFrame, live: DataFrame, now_s: int) -> DataFrame:
    """Adds ``action`` to owned open jobs that need one: cancelled, failed or requeue; a live owner with a lease keeps its job."""
    owned = items.filter(F.col("processor_id").isNotNull() & ~F.col("status").isin(*S.TERMINAL))
    alive = live.select(F.col("processor_id").alias("__live")).distinct()
    rows = owned.join(alive, F.col("processor_id") == F.col("__live"), "left").withColumn("alive", F.col("__live").isNotNull())
    resumable = F.when(~F.col("alive") | ~F.coalesce(F.col("lease_at") > now_s, F.lit(False)), "requeue")
    plain = F.when(F.col("alive"), F.lit(None)).when(F.col("status") == "cancelling", "cancelled").when(past_deadline(now_s), "failed").when(F.col("priority") == 0, "error").otherwise("requeue")
    return rows.withColumn("action", F.when(F.col("resumable"), resumable).otherwise(plain)).filter("action is not null").drop("__live")


def collect_expired(items: DataFrame, entries: DataFrame, now_s: int) -> tuple[DataFrame, DataFrame]:
    """Expired items with the number of entries that go with them, and the entries that stay."""
    gone = items.filter((F.col("expiry") > 0) & (F.col("expiry") <= now_s))
    cascade = entries.groupBy("batch_id").agg(F.count("*").alias("entries"))
    removed = gone.join(cascade, F.col("id") == F.col("batch_id"), "left").select("id", "tenant_id", F.coalesce("entries", F.lit(0)).alias("entries"))
    return removed, entries.join(gone.select(F.col("id").alias("batch_id")), "batch_id", "left_anti")
