"""Registered queries of the fenced writes. Their SQL states what a database's UPDATE with the same conditions leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import schemas as S
from .operators import catalog, lifecycle, mutations, results
from .plans.fixtures import LIVE, NOW, view
from .queries import LIVE_SQL, TERMINAL, _entries, _items, _query, c

#: What writers believe: some name another owner or an epoch that is past.
BELIEF = "case when k % 13 = 0 then 'proc-x' else processor_id end as owner, case when k % 11 = 0 then epoch - 1 else epoch end as at_epoch"


def _belief(items):
    return items.withColumns({"owner": F.when(c("k") % 13 == 0, "proc-x").otherwise(c("processor_id")), "at_epoch": F.when(c("k") % 11 == 0, c("epoch") - 1).otherwise(c("epoch"))})


@_query(f"select id, 'cancelled' as status, {NOW} as cancelled_at, epoch + 1 as epoch from fx_items where processor_id is null and resumable = false and status = 'validating'")
def cancelled_in_queue(spark, sf):
    items = _items(spark, sf)
    return mutations.cancel_if_queued(items, items.select("id"), NOW).select("id", "status", "cancelled_at", "epoch")


@_query(
    f"select id, priority, 'proc-9' as processor_id, epoch + 1 as epoch, case when resumable then recovery_attempts else 0 end as recovery_attempts, case when resumable then {NOW} + 300 end as lease_at "
    f"from fx_items where id in (select id from fx_items where processor_id is null and ((status = 'validating' and resumable = false) or (resumable and status not in {TERMINAL})) order by priority, id limit 200)"
)
def claimed_jobs(spark, sf):
    items = _items(spark, sf)
    out = mutations.claim(items, catalog.queue_top(items, 200, S.LEASE_S), "proc-9", NOW, S.LEASE_S)
    return out.select("id", "priority", "processor_id", "epoch", "recovery_attempts", "lease_at")


@_query(
    "with w as (select id, " + BELIEF + ", case when k % 5 = 2 then 'finalizing' else status end as expected_status from fx_items) "
    "select b.id, 'validating' as status, cast(null as varchar) as processor_id, b.epoch + 1 as epoch, b.recovery_attempts from fx_items b, w "
    f"where b.id = w.id and b.epoch = w.at_epoch and b.processor_id = w.owner and b.status = w.expected_status and b.resumable = false and b.status not in {TERMINAL}"
)
def enqueued_again(spark, sf):
    items = _items(spark, sf)
    jobs = _belief(items).withColumn("expected_status", F.when(c("k") % 5 == 2, "finalizing").otherwise(c("status")))
    return mutations.enqueue(items, jobs).select("id", "status", "processor_id", "epoch", "recovery_attempts")


_ORPHANS = (
    f"w as (select id, {BELIEF}, processor_id in {LIVE_SQL} as need_lapsed from fx_items where processor_id is not null), "
    "r as (select b.id, b.status, cast(null as varchar) as processor_id, cast(null as bigint) as lease_at, b.epoch + 1 as epoch, b.recovery_attempts + 1 as recovery_attempts, w.owner as old_owner from fx_items b, w "
    f"where b.id = w.id and b.processor_id = w.owner and b.epoch = w.at_epoch and b.resumable and b.status not in {TERMINAL} and (not w.need_lapsed or b.lease_at <= {NOW}))"
)


def _requeued(spark, sf):
    items = _items(spark, sf)
    return mutations.requeue_orphans(items, _belief(items.filter("processor_id is not null")).withColumn("need_lapsed", c("processor_id").isin(*LIVE)), NOW)


@_query(f"with {_ORPHANS} select * from r")
def requeued_orphans(spark, sf):
    return _requeued(spark, sf).select("id", "status", "processor_id", "lease_at", "epoch", "recovery_attempts", "old_owner")


@_query(f"with {_ORPHANS} select e.batch_id, e.custom_id, e.status, case when e.status = 'in_flight' and e.submitted_by is null and r.id is not null then r.old_owner else e.submitted_by end as submitted_by from fx_entries e left join r on r.id = e.batch_id")
def recorded_submitters(spark, sf):
    return mutations.record_submitters(_entries(spark, sf), _requeued(spark, sf)).select("batch_id", "custom_id", "status", "submitted_by")


_MANIFEST = "case when ordinal = 2 then 'failed' else 'pending' end as status, case when ordinal = 2 then case when k % 2 = 0 then 'model_not_found' else 'parse_error' end end as error_code"
#: Rows that validate and are owned: a dequeued job before its activation.
_CLAIMED = "b as (select id, k, status, resumable, epoch, case when k % 3 = 0 then null else concat('proc-', cast(k % 7 as varchar)) end as processor_id from fx_items)"
_READY = (
    f"{_CLAIMED}, w as (select id, {BELIEF} from b), "
    "candidate as (select b.* from b, w where b.id = w.id and b.processor_id = w.owner and b.epoch = w.at_epoch and b.status = 'validating' and b.resumable = false "
    "and not exists (select 1 from fx_entries x where x.batch_id = b.id and x.ordinal = 7))"
)


def _activated(spark, sf):
    items = _items(spark, sf).withColumn("processor_id", F.when(c("k") % 3 != 0, F.concat(F.lit("proc-"), (c("k") % 7).cast("string"))))
    rejected = F.when(c("ordinal") == 2, F.when(F.substring("batch_id", -1, 1).cast("int") % 2 == 0, "model_not_found").otherwise("parse_error"))
    entries = _entries(spark, sf)
    lines = entries.select("batch_id", "ordinal", "custom_id", F.concat_ws("_", F.lit("batch_req"), "custom_id").alias("request_id"), rejected.alias("reject_code"), F.lit("a < b & c").alias("reject_message"))
    manifest = lifecycle.manifest_entries(lines)
    return lifecycle.activate(items, entries.filter("ordinal = 7"), manifest, _belief(items).withColumnRenamed("id", "batch_id"), NOW)


#: The error line of a rejected request, as ingestion writes it.
_ERROR_LINE = (
    "concat('{\"id\":\"batch_req_', e.custom_id, '\",\"custom_id\":\"', e.custom_id, '\",\"response\":null,\"error\":{\"code\":\"', case when cast(right(c.id, 1) as int) % 2 = 0 then 'model_not_found' else 'parse_error' end, "
    "'\",\"message\":\"a \\u003c b \\u0026 c\"}}', chr(10))"
)


@_query(
    f"with {_READY} select c.id as batch_id, e.ordinal, e.custom_id, {_MANIFEST.replace('case when ordinal = 2 then ', 'case when e.ordinal = 2 then ')}, cast(0 as bigint) as attempts, case when e.ordinal = 2 then {NOW} end as completed_at, "
    f"concat('batch_req_', e.custom_id) as request_id, case when e.ordinal = 2 then concat('results/', c.id, '/batch_req_', e.custom_id, '.jsonl') end as result_key, case when e.ordinal = 2 then strlen({_ERROR_LINE}) end as result_bytes, "
    f"case when e.ordinal = 2 then sha256({_ERROR_LINE}) end as result_sha256 from candidate c join fx_entries e on e.batch_id = c.id"
)
def activation(spark, sf):
    return _activated(spark, sf)[0]


@_query(f"with {_READY} select id, 'in_progress' as status, {NOW} as in_progress_at, true as resumable, {NOW} + 300 as lease_at, processor_id, epoch from candidate c where exists (select 1 from fx_entries e where e.batch_id = c.id)")
def activated_items(spark, sf):
    return _activated(spark, sf)[1].select("id", "status", "in_progress_at", "resumable", "lease_at", "processor_id", "epoch")


@_query(
    f"with w as (select id, {BELIEF}, case when k % 5 = 2 then 'validating' else status end as expected_status, "
    "case when k % 2 = 0 then concat('{ \"by\": ', cast(k % 4 as varchar), ', \"status\": \"completed\" }') else '{\"status\":\"failed\",\"by\":9}' end as document from fx_items), "
    f"v as (select b.*, w.document, coalesce(b.processor_id = w.owner and b.epoch = w.at_epoch and b.resumable and b.lease_at > {NOW} and b.status = w.expected_status, false) as ok from fx_items b, w where b.id = w.id) "
    "select id, case when ok then 'applied' when json_extract_string(status_document, '$.status') = json_extract_string(document, '$.status') and json_extract(status_document, '$.by') = json_extract(document, '$.by') then 'same' else 'conflict' end as verdict, "
    "case when ok then document else status_document end as status_document, case when ok then false else resumable end as resumable, case when not ok then lease_at end as lease_at, processor_id from v"
)
def terminal_writes(spark, sf):
    items = _items(spark, sf)
    done = F.concat(F.lit('{ "by": '), (c("k") % 4).cast("string"), F.lit(', "status": "completed" }'))
    targets = _belief(items).withColumns({"expected_status": F.when(c("k") % 5 == 2, "validating").otherwise(c("status")), "document": F.when(c("k") % 2 == 0, done).otherwise('{"status":"failed","by":9}')})
    return mutations.finalize(items, targets.select("id", "owner", "at_epoch", "expected_status", "document"), NOW)


_WRITES = (
    "w as (select e.batch_id, e.custom_id, e.ordinal, e.result_bytes as bytes, e.status as before, b.owner, b.at_epoch from fx_entries e join (select id, " + BELIEF + " from fx_items) b on b.id = e.batch_id), "
    "owner as (select w.*, coalesce(b.processor_id = w.owner and b.epoch = w.at_epoch, false) as held, "
    f"coalesce(b.processor_id = w.owner and b.epoch = w.at_epoch and b.lease_at > {NOW} and b.resumable and b.status not in {TERMINAL}, false) as ok from w join fx_items b on b.id = w.batch_id)"
)


def _writes(spark, sf):
    beliefs = _belief(_items(spark, sf)).select(c("id").alias("batch_id"), "owner", "at_epoch")
    return _entries(spark, sf).select("batch_id", "custom_id", "ordinal", c("result_bytes").alias("bytes")).join(beliefs, "batch_id")


@_query(f"with {_WRITES} select batch_id, custom_id, case when ok and before in ('pending', 'in_flight') then 'updated' when held and before in ('completed', 'failed') then 'duplicate' else 'conflict' end as verdict from owner")
def entry_write_verdicts(spark, sf):
    return mutations.entry_writes(_entries(spark, sf), _items(spark, sf), _writes(spark, sf), NOW).select("batch_id", "custom_id", "verdict")


@_query(
    f"with {_WRITES} select e.batch_id, e.custom_id, case when o.ok and e.status in ('pending', 'in_flight') then 'in_flight' else e.status end as status, "
    "e.attempts + case when o.ok and e.status in ('pending', 'in_flight') then 1 else 0 end as attempts, case when o.ok and e.status in ('pending', 'in_flight') then o.owner else e.submitted_by end as submitted_by "
    "from fx_entries e left join owner o on e.batch_id = o.batch_id and e.custom_id = o.custom_id"
)
def entries_in_flight(spark, sf):
    out = mutations.mark_in_flight(_entries(spark, sf), _items(spark, sf), _writes(spark, sf), NOW)
    return out.select("batch_id", "custom_id", "status", "attempts", "submitted_by")


_RESULT = "case when ordinal = 4 then 'pending' when ordinal % 2 = 0 then 'completed' else 'failed' end"


@_query(
    f"with {_WRITES}, r as (select *, {_RESULT} as result_status from owner) "
    "select e.batch_id, e.custom_id, case when u then r.result_status else e.status end as status, case when u and e.ordinal <> 1 then concat('results/', e.batch_id, '/', e.custom_id) end as result_key, "
    "case when not u then e.result_bytes when r.bytes % 7 > 0 then r.bytes % 7 end as result_bytes, case when not u then e.error_code when r.result_status = 'failed' then 'http_500' end as error_code, "
    f"case when u then sha256(concat(e.batch_id, ' ', e.custom_id)) end as result_sha256, case when u then {NOW} end as completed_at from (select e.*, coalesce(r.ok and e.status in ('pending', 'in_flight') and r.result_status in ('completed', 'failed'), false) as u "
    "from fx_entries e left join r on e.batch_id = r.batch_id and e.custom_id = r.custom_id) e left join r on e.batch_id = r.batch_id and e.custom_id = r.custom_id"
)
def checkpointed_results(spark, sf):
    status = F.when(c("ordinal") == 4, "pending").when(c("ordinal") % 2 == 0, "completed").otherwise("failed")
    key = F.when(c("ordinal") == 1, "").otherwise(F.concat_ws("/", F.lit("results"), "batch_id", "custom_id"))
    sent = _writes(spark, sf).withColumns({"bytes": c("bytes") % 7, "code": F.when(status == "failed", "http_500").otherwise(""), "sha256": F.sha2(F.concat_ws(" ", "batch_id", "custom_id"), 256)})
    arrival = lambda n, key, status: F.struct(F.lit(n).alias("arrival"), key.alias("key"), status.alias("result_status"))
    # A result and its late repeat from one row, so that both stay where the entries were dealt; of a union Spark would shuffle each.
    twice = F.array(arrival(1, key, status), arrival(2, F.lit("late"), F.when(status == "pending", "pending").otherwise("completed")))
    out = mutations.checkpoint_results(_entries(spark, sf), _items(spark, sf), sent.select("*", F.inline(twice)), NOW)
    return out.select("batch_id", "custom_id", "status", "result_key", "result_bytes", "result_sha256", "error_code", "completed_at")


#: A third of the result objects have been changed after their commit, and some are gone.
_LINE_OF = "concat('{\"id\":\"', %s, '/', %s, '\"}', chr(10))"


@_query(
    f"with {_WRITES} select o.batch_id, o.custom_id, case when o.ok and o.before in ('pending', 'in_flight') then 'completed' else o.before end as status, "
    "case when o.ok and o.before in ('pending', 'in_flight') then o.bytes % 11 > 0 and o.bytes % 3 > 0 else false end as intact from owner o"
)
def checkpoint_integrity(spark, sf):
    """From the commit of results to the check of their objects: what was recorded has to be what is there."""
    line = F.expr(_LINE_OF % ("batch_id", "custom_id"))
    sent = _writes(spark, sf).withColumns({"line": line, "key": F.concat_ws("/", F.lit("results"), "batch_id", "custom_id")})
    done = sent.withColumns({"result_status": F.lit("completed"), "code": F.lit(""), "arrival": F.lit(1), "sha256": F.sha2("line", 256), "size": F.octet_length("line").cast("long")})
    objects = done.filter("bytes % 11 > 0").select(c("key").alias("result_key"), c("size").alias("bytes"), F.when(c("bytes") % 3 > 0, c("sha256")).otherwise(F.sha2(F.upper("line"), 256)).alias("sha256"))
    entries = mutations.checkpoint_results(_entries(spark, sf), _items(spark, sf), done.withColumn("bytes", c("size")), NOW)
    return results.checked_results(entries, objects).select("batch_id", "custom_id", "status", "intact")


@_query(
    "select id, case when k % 4 = 0 then case when k % 8 = 0 then k * 1000 end else priority end as priority, "
    "case when processor_id is null and resumable = false and status in ('in_progress', 'finalizing', 'cancelling') then 'pre-migration' else processor_id end as processor_id from fx_items"
)
def migrated_rows(spark, sf):
    tags = F.when(c("k") % 8 == 0, F.create_map(F.lit("slo_unix_micro"), (c("k") * 1000).cast("string"))).otherwise(F.create_map(F.lit("env"), c("env")))
    old = _items(spark, sf).withColumns({"priority": F.when(c("k") % 4 != 0, c("priority")), "tags": tags})
    return lifecycle.migrate_priority(old).select("id", "priority", "processor_id")


@_query("select count(*) as n, count(*) filter (k < 0) as added, cast(sum(epoch) as bigint) as epochs from (select k, epoch from fx_items union all select -k, epoch from fx_items where k % 10 = 0)")
def rows_after_insert(spark, sf):
    items = view(spark, sf, "items").select("k", "epoch")
    return mutations.insert(items, items.filter(c("k") % 10 == 0).select("epoch", (-c("k")).alias("k"))).agg(F.count("*").alias("n"), F.count_if(c("k") < 0).alias("added"), F.sum("epoch").alias("epochs"))
