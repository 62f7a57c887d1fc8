"""The job and file catalogue: typed filters, paging, projections and the queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S


def ids_in(ids: Sequence[str]) -> Column:
    return F.col("id").isin(list(ids))


def tagged(selectors: Mapping[str, str], any_of: bool = False, tags: str = "tags") -> Column:
    """Tag containment, all selectors or any."""
    parts = [F.coalesce(F.element_at(F.col(tags), F.lit(k)) == v, F.lit(False)) for k, v in selectors.items()]
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts)


def expired(now: int) -> Column:
    return (F.col("expiry") > 0) & (F.col("expiry") <= now)


def non_terminal(status: str = "status") -> Column:
    return ~F.col(status).isin(*S.TERMINAL)


def query(
    items: DataFrame,
    *,
    ids: Sequence[str] | None = None,
    tenant: str | None = None,
    tags: Mapping[str, str] | None = None,
    any_tag: bool = False,
    expired_at: int | None = None,
    equal: Mapping[str, object] | None = None,
    only_non_terminal: bool = False,
    owned: bool = False,
    after: str | None = None,
    descending: bool = False,
    start: int = 0,
    limit: int | None = None,
    static: bool = True,
    static_columns: Sequence[str] = ("spec",),
) -> DataFrame:
    """Items that meet all given conditions, ordered by id. Without any condition the result is empty, not everything.

    ``after`` is a keyset cursor and makes ``start`` void; a page has one row more than ``limit`` as the
    sign that another follows (see ``page``).
    """
    conditions: list[Column] = []
    if ids:
        conditions.append(ids_in(ids))
    if tenant:
        conditions.append(F.col("tenant_id") == tenant)
    if tags:
        conditions.append(tagged(tags, any_tag))
    if expired_at is not None:
        conditions.append(expired(expired_at))
    conditions += [F.col(k) == v for k, v in (equal or {}).items() if v not in (None, "")]
    if only_non_terminal:
        conditions.append(non_terminal())
    if owned:
        conditions.append(F.col("processor_id").isNotNull())
    if not conditions:
        return items.limit(0)
    if after:
        conditions.append(F.col("id") < after if descending else F.col("id") > after)
    out = items.filter(reduce(lambda a, b: a & b, conditions))
    if not static:
        out = out.drop(*static_columns)
    out = out.orderBy(F.col("id").desc() if descending else F.col("id").asc())
    if start and not after:
        out = out.offset(start)
    return out.limit(limit + 1) if limit is not None else out


def page(rows: DataFrame, limit: int, descending: bool = False) -> DataFrame:
    """One row: first_id, last_id, n and has_more of a page that ``query`` has read with one row to spare."""
    ends = (F.max("id"), F.min("id")) if descending else (F.min("id"), F.max("id"))
    order = F.sort_array(F.collect_list("id"), asc=not descending)
    shown = rows.agg(F.slice(order, 1, limit).alias("ids"), F.count("*").alias("n"), ends[0].alias("first"))
    return shown.select(F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.least("n", F.lit(limit)).alias("n"), (F.col("n") > limit).alias("has_more"))


def cursor(value: str | None, prefix: str, limit: int | None, most: int, default: int = 20) -> tuple[int, str | None, int]:
    """(start, after, limit) of list parameters: digits are an offset, a prefixed id is a keyset cursor."""
    limit = default if limit is None else limit
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if not value:
        return 0, None, limit
    if value.isdigit():
        return int(value), None, limit
    if value.startswith(prefix):
        return 0, value, limit
    raise ValueError("after must be an offset or an id")


def api_object(items: DataFrame) -> DataFrame:
    """The static and the changing document side by side, as the API shows them."""
    return items.select("id", "spec.*", "status.*")


def queued() -> Column:
    return (F.col("status") == "validating") & F.col("processor_id").isNull()


def queue_top(items: DataFrame, k: int, lease_s: int = 0) -> DataFrame:
    """The k most urgent unclaimed jobs: fresh ones, and requeued resumable ones if claims carry a lease."""
    fresh = (F.col("status") == "validating") & ~F.col("resumable")
    again = F.col("resumable") & non_terminal() if lease_s > 0 else F.lit(False)
    return items.filter(F.col("processor_id").isNull() & (fresh | again)).orderBy("priority", "id").limit(k)


def keyset_entries(entries: DataFrame, batch_id: str, after: int, n: int) -> DataFrame:
    return entries.filter((F.col("batch_id") == batch_id) & (F.col("ordinal") > after)).orderBy("ordinal").limit(n)


def split_tags(tags: Column, prefix: str) -> Column:
    """The tags under a prefix, without it."""
    return F.transform_keys(F.map_filter(tags, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))


def events_due(events: DataFrame, now: int, slots: int) -> DataFrame:
    """Unexpired events, first in first out, as many as there are free slots."""
    return events.filter(F.col("expires_at") > now).orderBy("id").limit(slots)


def deliver_events(events: DataFrame, now: int, full: Column) -> DataFrame:
    """Unexpired events that are delivered, and so acknowledged: each job's in order, up to the first one whose slot is ``full``."""
    before = W.partitionBy("job_id").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    stopped = F.max(full.cast("int")).over(before)
    return events.filter(F.col("expires_at") > now).withColumn("__stopped", stopped).filter("__stopped = 0").drop("__stopped")


def purge_events(events: DataFrame, now: int) -> DataFrame:
    """Events a sweep removes. One that expires just now is neither drained nor purged."""
    return events.filter(F.col("expires_at") < now)


def validate_create(rows: DataFrame, endpoints: Sequence[str] = S.ENDPOINTS) -> DataFrame:
    """Adds ``problem``: the first rule that a create request breaks, or null."""
    from ..functions.scalars import duration_seconds

    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    keys, values = F.map_keys("metadata"), F.map_values("metadata")
    problem = (
        F.when(blank("completion_window"), "completion_window is required")
        .when(duration_seconds(c("completion_window")).isNull(), "completion_window must be a valid duration")
        .when(blank("endpoint"), "endpoint is required")
        .when(~c("endpoint").isin(*endpoints), "invalid endpoint")
        .when(blank("input_file_id"), "input_file_id is required")
        .when(F.coalesce(F.size("metadata"), F.lit(0)) > S.MAX_METADATA, "metadata: too many keys")
        .when(F.coalesce(F.exists(keys, lambda k: F.octet_length(k) > S.MAX_KEY), F.lit(False)), "metadata: key too long")
        .when(F.coalesce(F.exists(values, lambda v: F.octet_length(v) > S.MAX_VALUE), F.lit(False)), "metadata: value too long")
        .when(c("expires_anchor").isNotNull() & (c("expires_anchor") != "created_at"), "output_expires_after.anchor must be 'created_at'")
        .when(c("expires_anchor").isNotNull() & ~c("expires_seconds").between(S.MIN_EXPIRY_S, S.MAX_EXPIRY_S), "output_expires_after.seconds out of range")
    )
    return rows.withColumn("problem", problem)


def validate_upload(rows: DataFrame, most_bytes: int = S.MAX_FILE_BYTES) -> DataFrame:
    """Adds ``problem``: the first rule that a file upload breaks, or null."""
    c = F.col
    given = lambda x: F.coalesce(c(x), F.lit("")) != ""
    seconds = c("expires_seconds").try_cast("long")
    problem = (
        F.when(c("bytes") > most_bytes, "file too large")
        .when(~given("purpose"), "purpose is required")
        .when(~c("purpose").isin(*S.PURPOSES), "invalid purpose")
        .when(given("expires_anchor") != given("expires_seconds"), "anchor and seconds go together")
        .when(given("expires_anchor") & (c("expires_anchor") != "created_at"), "invalid anchor")
        .when(given("expires_seconds") & seconds.isNull(), "seconds must be an integer")
        .when(given("expires_seconds") & ~seconds.between(S.MIN_EXPIRY_S, S.MAX_EXPIRY_S), "seconds out of range")
    )
    return rows.withColumn("problem", problem)


def input_file_check(batches: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``problem`` to (tenant_id, input_file_id): the file must be the tenant's own and of purpose batch."""
    f = files.select(F.col("id").alias("input_file_id"), F.col("tenant_id").alias("__owner"), F.col("purpose").alias("__purpose"))
    problem = F.when(F.col("__owner").isNull() | (F.col("__owner") != F.col("tenant_id")), "not found").when(F.col("__purpose") != "batch", "wrong purpose")
    return batches.join(f, "input_file_id", "left").withColumn("problem", problem).drop("__owner", "__purpose")
