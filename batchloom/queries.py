"""Registered queries over the catalogue, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas as S
from .functions import scalars as fn
from .operators import analysis, catalog, ingest, lifecycle, metrics, mutations, results
from .plans.fixtures import LIVE, MODELS, NOW, tasks_for, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

c = F.col


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def _items(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.map_from_arrays(F.array(F.lit("env"), F.lit("team")), F.array("env", "team"))
    return view(spark, sf, "items").withColumn("tags", tags)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "entries")


def _live(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in LIVE], "processor_id string")


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MODELS], "model string")


TERMINAL = "('completed', 'failed', 'expired', 'cancelled')"
LIVE_SQL = "('proc-0', 'proc-1', 'proc-2', 'proc-3')"
SUCCEEDED = "(error_code is null and status_code between 200 and 299)"

# ---------------------------------------------------------------- catalogue


@_query("select id, tenant_id, status, priority from fx_items where tenant_id = 'tenant_3' and id > 'batch_00000100' order by id limit 21")
def list_batches_page(spark, sf):
    return catalog.query(_items(spark, sf), tenant="tenant_3", after="batch_00000100", limit=20).select("id", "tenant_id", "status", "priority")


@_query(
    "with p as (select id from fx_items where tenant_id = 'tenant_3' and id > 'batch_00000100' order by id limit 21), "
    "s as (select id, row_number() over (order by id) as r from p) "
    "select min(id) as first_id, max(id) filter (r <= 20) as last_id, least((select count(*) from p), 20) as n, (select count(*) from p) > 20 as has_more from s"
)
def list_batches_response(spark, sf):
    return catalog.page(catalog.query(_items(spark, sf), tenant="tenant_3", after="batch_00000100", limit=20), 20)


@_query("select id, bytes, created_at from fx_files where tenant_id = 'tenant_4' and purpose = 'batch' and id < 'file_0000000900' order by id desc limit 11")
def list_files_by_purpose_desc(spark, sf):
    return catalog.query(view(spark, sf, "files"), tenant="tenant_4", equal={"purpose": "batch"}, after="file_0000000900", descending=True, limit=10).select("id", "bytes", "created_at")


@_query("select id, tenant_id from fx_items where status = 'validating' order by id limit 11 offset 40")
def list_by_offset(spark, sf):
    return catalog.query(_items(spark, sf), equal={"status": "validating"}, start=40, limit=10).select("id", "tenant_id")


@_query("select id, tenant_id, status, expiry from fx_items where expiry > 0 and env = 'F'")
def items_without_spec(spark, sf):
    """Items without their static part: nothing of it is read."""
    items = _items(spark, sf).select("id", "tenant_id", "status", "expiry", "env", F.struct("created_at", "window_s", "k").alias("spec"))
    return catalog.query(items, equal={"env": "F"}, expired_at=10**12, static=False).drop("env")


#: Cursors as a client sends them: none, an offset, and the id of the last row that it has seen.
_CURSORS = (None, "40", "batch_00000100")


@_query(
    "with i as (select id, row_number() over (order by id) as r from fx_items where tenant_id = 'tenant_3') "
    "select 'none' as cursor, id from i where r <= 21 union all select '40', id from i where r between 41 and 61 "
    "union all select 'batch_00000100', id from (select id from i where id > 'batch_00000100' order by id limit 21)"
)
def pages_by_cursor(spark, sf):
    pages = []
    for value in _CURSORS:
        start, after, limit = catalog.cursor(value, "batch_", None, 100)
        rows = catalog.query(_items(spark, sf), tenant="tenant_3", start=start, after=after, limit=limit)
        pages.append(rows.select(F.lit(value or "none").alias("cursor"), "id"))
    return reduce(DataFrame.unionByName, pages)


@_query("select id from fx_items where env = 'F' and team = 't1' order by id")
def tag_filter_and(spark, sf):
    return catalog.query(_items(spark, sf), tags={"env": "F", "team": "t1"}).select("id")


@_query("select id from fx_items where env = 'F' or team = 't1' order by id")
def tag_filter_or(spark, sf):
    return catalog.query(_items(spark, sf), tags={"env": "F", "team": "t1"}, any_tag=True).select("id")


@_query("select id, priority, created_at from fx_items where id in ('batch_00000001', 'batch_00000007', 'batch_99999999')")
def items_by_ids(spark, sf):
    return catalog.query(_items(spark, sf), ids=["batch_00000001", "batch_00000007", "batch_99999999"]).select("id", "priority", "created_at")


@_query("select id from fx_items where false")
def no_condition_no_rows(spark, sf):
    return catalog.query(_items(spark, sf)).select("id")


@_query(f"select id, expiry from fx_items where expiry > 0 and expiry <= {NOW}")
def expired_items(spark, sf):
    return catalog.query(_items(spark, sf), expired_at=NOW).select("id", "expiry")


@_query(f"select id, processor_id, status, epoch from fx_items where status not in {TERMINAL} and processor_id is not null")
def owned_open_items(spark, sf):
    return catalog.query(_items(spark, sf), only_non_terminal=True, owned=True).select("id", "processor_id", "status", "epoch")


@_query("select id, tenant_id from fx_items where tenant_id = 'tenant_1' and k between 1 and 60")
def tenant_isolation(spark, sf):
    return catalog.query(_items(spark, sf), tenant="tenant_1", ids=[f"batch_{k:08d}" for k in range(1, 61)]).select("id", "tenant_id")


@_query(
    f"select id, priority from fx_items where processor_id is null and ((status = 'validating' and not resumable) or (resumable and status not in {TERMINAL})) order by priority, id limit 25"
)
def queue_topk(spark, sf):
    return catalog.queue_top(_items(spark, sf), 25, S.LEASE_S).select("id", "priority")


@_query("select id from fx_items where status = 'validating' and processor_id is null")
def queue_members(spark, sf):
    return _items(spark, sf).filter(catalog.queued()).select("id")


@_query("select custom_id, ordinal, status from fx_entries where batch_id = 'batch_00000007' and ordinal > 1 order by ordinal limit 3")
def entries_page(spark, sf):
    return catalog.keyset_entries(_entries(spark, sf), "batch_00000007", 1, 3).select("custom_id", "ordinal", "status")


@_query("select * from fx_entries where batch_id = 'batch_00000007' and custom_id = 'req-3'")
def entry_lookup(spark, sf):
    return _entries(spark, sf).filter("batch_id = 'batch_00000007' and custom_id = 'req-3'")


@_query(f"select id, job_id, event_type from fx_fifo where expires_at > {NOW} order by id limit 50")
def event_fifo_unexpired(spark, sf):
    return catalog.events_due(view(spark, sf, "fifo"), NOW, 50).select("id", "job_id", "event_type")


@_query(f"select event_type, count(*) as n from fx_fifo where expires_at < {NOW} group by event_type")
def event_purge(spark, sf):
    return metrics.counts(catalog.purge_events(view(spark, sf, "fifo"), NOW), "event_type")


@_query("select id, case when f.tenant_id is null or f.tenant_id <> b.tenant_id then 'not found' when f.purpose <> 'batch' then 'wrong purpose' end as problem "
        "from (select id as batch, tenant_id, concat('file_', lpad(cast(k % 1000 as varchar), 10, '0')) as fid from fx_items) b left join fx_files f on b.fid = f.id".replace("select id,", "select batch as id,", 1))  # fmt: skip
def input_file_checks(spark, sf):
    wanted = _items(spark, sf).select(c("id").alias("batch"), "tenant_id", F.concat(F.lit("file_"), F.lpad((c("k") % 1000).cast("string"), 10, "0")).alias("input_file_id"))
    return catalog.input_file_check(wanted, view(spark, sf, "files")).select(c("batch").alias("id"), "problem")


@_query("select id, status, created_at, case when created_at > 0 and window_s <> 0 then (created_at + window_s) * 1000000 else 0 end as priority, total from fx_items")
def api_objects(spark, sf):
    docs = _items(spark, sf).select("id", F.struct("created_at", "window_s").alias("spec"), F.struct("status", "total").alias("status"))
    flat = catalog.api_object(docs)
    return flat.select("id", "status", "created_at", fn.priority_us(c("created_at"), c("window_s")).alias("priority"), "total")


@_query("select sum(bytes) as bytes, count(*) as files, max(lines) as most_lines from (select strlen(text) as bytes, "
        "len(text) - len(replace(text, chr(10), '')) + case when text <> '' and text[-1:] <> chr(10) then 1 else 0 end as lines from documents)".replace("sum(bytes)", "cast(sum(bytes) as bigint)"))  # fmt: skip
def file_totals(spark, sf):
    return ingest.file_totals(view(spark, sf, "documents")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.max("lines").alias("most_lines"))


@_query("select concat(id, case when filename like '%.%' then regexp_extract(filename, '(\\.[^./]*)$', 1) else '.jsonl' end) as name, concat('t-', substr(sha256(tenant_id), 1, 61)) as folder from fx_files")
def storage_names(spark, sf):
    return view(spark, sf, "files").select(fn.storage_name(c("id"), c("filename")).alias("name"), fn.tenant_folder(c("tenant_id")).alias("folder"))


# ---------------------------------------------------------------- requests

REASON = (
    "case when coalesce(custom_id, '') = '' then 'custom_id is required' when coalesce(method, '') = '' then 'method is required' when method <> 'POST' then 'invalid method' "
    "when coalesce(url, '') = '' then 'url is required' when url not like '/%' or url like '//%' or url like '%://%' then 'url must be relative' "
    "when url not in ('/v1/responses', '/v1/chat/completions', '/v1/embeddings', '/v1/completions', '/v1/moderations') then 'invalid endpoint' "
    "when url <> '/v1/chat/completions' then 'endpoint mismatch' when coalesce(model, '') = '' then 'model is empty' when stream then 'streaming is not supported' end"
)


def _reason():
    return ingest.reject_reason("/v1/chat/completions")


@_query(f"select conv_id, {REASON} as reason from fx_requests")
def validate_requests(spark, sf):
    return view(spark, sf, "requests").select("conv_id", _reason().alias("reason"))


@_query(
    f"with r as (select *, {REASON} as reason, row_number() over (partition by batch_id, custom_id order by ordinal) as o from fx_requests) "
    "select batch_id, count(*) as lines, min(ordinal) filter (reason is not null or o > 1) as first_bad, count(*) filter (reason is not null or o > 1) = 0 as valid from r group by batch_id"
)
def batch_validity(spark, sf):
    return ingest.batch_validity(view(spark, sf, "requests"), _reason())


@_query("select batch_id, custom_id, ordinal, o as occurrence from (select *, row_number() over (partition by batch_id, custom_id order by ordinal) as o from fx_requests) where o > 1")
def duplicate_custom_ids(spark, sf):
    return ingest.duplicates(view(spark, sf, "requests")).select("batch_id", "custom_id", "ordinal", c("occurrence").cast("long").alias("occurrence"))


@_query("select batch_id, conv_id, model, 'model_not_found' as error_code from fx_requests where model not in ('model-0', 'model-1', 'model-2', 'model-3')")
def unregistered_models(spark, sf):
    return ingest.unregistered(view(spark, sf, "requests"), _registry(spark)).select("batch_id", "conv_id", "model", "error_code")


@_query("select batch_id, model, count(*) as requests from fx_requests group by batch_id, model")
def model_counts(spark, sf):
    return ingest.model_counts(view(spark, sf, "requests"))


@_query("select conv_id, line_bytes + 1 as length, cast(coalesce(sum(line_bytes + 1) over (partition by batch_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from fx_requests")
def plan_offsets(spark, sf):
    return ingest.offsets(view(spark, sf, "requests"), c("line_bytes")).select("conv_id", "length", "offset")


FNV = (
    "case when strlen(system_text) = 0 then 4294967295 else cast(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, strlen(system_text)), "
    "lambda i: ('0x' || substr(hex(encode(system_text)), 2 * i + 1, 2))::UBIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295::UBIGINT) as bigint) end"
)


@_query(f"with h as (select *, {FNV} as prefix_hash from fx_requests) select conv_id, prefix_hash, row_number() over (partition by batch_id, model order by prefix_hash, ordinal) as position from h")
def plan_prefix_order(spark, sf):
    return ingest.plan(view(spark, sf, "requests")).select("conv_id", "prefix_hash", "position")


@_query(
    "with m as (select p_brand as batch_id, p_type || ':' || p_size % 3 || case when p_partkey % 2 = 0 then '' else '?' end as model, min(p_partkey) as first_seen from part group by 1, 2), "
    "b as (select *, regexp_replace(model, '[^a-zA-Z0-9._-]+', '_', 'g') as base from m), r as (select *, row_number() over (partition by batch_id, base order by first_seen) as n from b) "
    "select batch_id, model, base || case when n > 1 then '_' || n else '' end as safe_name from r"
)
def safe_model_names(spark, sf):
    model = F.concat("p_type", F.lit(":"), (c("p_size") % 3).cast("string"), F.when(c("p_partkey") % 2 == 0, "").otherwise("?"))
    models = view(spark, sf, "part").select(c("p_brand").alias("batch_id"), model.alias("model"), "p_partkey").groupBy("batch_id", "model").agg(F.min("p_partkey").alias("first_seen"))
    return ingest.safe_names(models, ["batch_id"])


UUID5 = "substr(x,1,8) || '-' || substr(x,9,4) || '-5' || substr(x,14,3) || '-' || printf('%02x', (('0x'||substr(x,17,2))::INT & 63)|128) || substr(x,19,2) || '-' || substr(x,21,12)"


@_query(
    f"with d as (select batch_id, custom_id, sha1(unhex('{fn.OID_NAMESPACE}') || encode(batch_id) || unhex('00') || encode(custom_id)) as x from fx_entries) "
    f"select batch_id, custom_id, 'batch_req_' || {UUID5} as request_id from d"
)
def stable_request_ids(spark, sf):
    return _entries(spark, sf).select("batch_id", "custom_id", fn.request_id(c("batch_id"), c("custom_id")).alias("request_id"))


@_query(f"with d as (select id, sha1(unhex('{fn.OID_NAMESPACE}') || encode(id) || unhex('00') || encode('output')) as x from fx_items) select id, 'file_' || {UUID5} as output_file_id from d")
def artifact_ids(spark, sf):
    return _items(spark, sf).select("id", fn.artifact_id(c("id"), F.lit("output")).alias("output_file_id"))


@_query("select conv_id, coalesce((select text from conversations s where s.conv_id = c.conv_id and s.role = 'system' order by turn limit 1), 'You are a helpful assistant.') as system, "
        "(select text from conversations u where u.conv_id = c.conv_id and u.role = 'user' order by turn limit 1) as prompt from conversations c where role = 'user' group by conv_id")  # fmt: skip
def first_prompts(spark, sf):
    return analysis.first_prompts(view(spark, sf, "conversations"))


# ---------------------------------------------------------------- results


@_query("select batch_id, custom_id, status_code, error_code, result_bytes from fx_deliveries where arrival = 1")
def first_wins_results(spark, sf):
    return results.first_wins(view(spark, sf, "deliveries")).select("batch_id", "custom_id", "status_code", "error_code", "result_bytes")


@_query(
    f"select batch_id, count(*) as total, count(*) filter {SUCCEEDED} as completed, count(*) - count(*) filter {SUCCEEDED} as failed, count(*) filter (error_code is null) as output_lines, "
    "count(*) filter (error_code is not null) as error_lines, cast(sum(result_bytes) as bigint) as bytes from fx_deliveries where arrival = 1 group by batch_id"
)
def finalize_counts(spark, sf):
    return results.finalize_counts(results.first_wins(view(spark, sf, "deliveries")))


@_query("select batch_id, custom_id, case when error_code is null then 'output' else 'error' end as route from fx_entries")
def artifact_routing(spark, sf):
    return _entries(spark, sf).select("batch_id", "custom_id", results.route(c("error_code")).alias("route"))


@_query(
    "select batch_id, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'in_flight') as in_flight, count(*) filter (status = 'completed') as completed, "
    "count(*) filter (status = 'failed') as failed from fx_entries group by batch_id"
)
def entry_resume_state(spark, sf):
    return results.status_counts(_entries(spark, sf))


@_query("select batch_id, string_agg(custom_id, ',' order by ordinal) as ids from fx_entries where status in ('completed', 'failed') group by batch_id")
def terminal_ids(spark, sf):
    return results.terminal_ids(_entries(spark, sf)).select("batch_id", F.array_join("ids", ",").alias("ids"))


@_query("select d.batch_id, d.custom_id from (select distinct batch_id, custom_id from fx_deliveries) d where not exists (select 1 from fx_entries e where e.batch_id = d.batch_id and e.custom_id = d.custom_id and e.status in ('completed', 'failed'))")
def resume_skip_set(spark, sf):
    asked = view(spark, sf, "deliveries").select("batch_id", "custom_id").distinct()
    return results.skip_terminal(asked, _entries(spark, sf))


@_query("select distinct batch_id from fx_entries where status in ('pending', 'in_flight')")
def open_batches(spark, sf):
    return results.open_batches(_entries(spark, sf))


@_query("select submitted_by, count(*) as entries, count(distinct batch_id) as batches from fx_entries where status = 'in_flight' and submitted_by is not null group by submitted_by")
def in_flight_submitters(spark, sf):
    return results.in_flight_by_submitter(_entries(spark, sf))


@_query("select e.batch_id, e.custom_id, e.status from fx_entries e join fx_items i on i.id = e.batch_id where i.processor_id = 'proc-2' and i.epoch = 1")
def owned_entries(spark, sf):
    return results.owned_entries(_entries(spark, sf), _items(spark, sf), "proc-2", 1).select("batch_id", "custom_id", "status")


@_query("select d.batch_id, d.custom_id, count(*) as deliveries from fx_deliveries d where d.batch_id not in (select id from fx_items where processor_id is not null) group by d.batch_id, d.custom_id")
def result_residue(spark, sf):
    subscribers = _items(spark, sf).filter("processor_id is not null").select(c("id").alias("batch_id"), "processor_id")
    _, residue = results.broadcast_results(view(spark, sf, "deliveries"), subscribers)
    return residue.groupBy("batch_id", "custom_id").agg(F.count("*").alias("deliveries"))


@_query("select i.processor_id, count(*) as deliveries from fx_deliveries d join fx_items i on i.id = d.batch_id where i.processor_id is not null group by i.processor_id")
def results_by_subscriber(spark, sf):
    subscribers = _items(spark, sf).filter("processor_id is not null").select(c("id").alias("batch_id"), "processor_id")
    owned, _ = results.broadcast_results(view(spark, sf, "deliveries"), subscribers)
    return metrics.counts(owned, "processor_id", name="deliveries")


@_query(
    "select d.batch_id, count(*) as deliveries from fx_deliveries d where d.batch_id not in (select id from fx_items where processor_id is not null) "
    "and d.batch_id not in (select batch_id from fx_entries where status in ('pending', 'in_flight')) group by d.batch_id"
)
def safe_residue(spark, sf):
    subscribers = _items(spark, sf).filter("processor_id is not null").select(c("id").alias("batch_id"), "processor_id")
    _, residue = results.broadcast_results(view(spark, sf, "deliveries"), subscribers)
    return metrics.counts(results.safe_residue(residue, _entries(spark, sf)), "batch_id", name="deliveries")


def _manifest(spark, sf):
    return _entries(spark, sf).filter("ordinal <> 5").select("batch_id", "ordinal", F.when(c("ordinal") % 3 == 0, F.concat("custom_id", F.lit("x"))).otherwise(c("custom_id")).alias("custom_id"), (c("ordinal") == 2).alias("rejected"))


@_query(
    "with m as (select batch_id, ordinal, case when ordinal % 3 = 0 then custom_id || 'x' else custom_id end as custom_id, ordinal = 2 as rejected from fx_entries where ordinal <> 5), "
    "j as (select coalesce(m.batch_id, e.batch_id) as batch_id, coalesce(m.ordinal, e.ordinal) as ordinal, case when e.custom_id is null then 'missing' when m.custom_id is null then 'extra' "
    "when m.custom_id <> e.custom_id then 'identity' when m.rejected <> (e.status = 'failed' and e.attempts = 0) then 'rejected' end as mismatch "
    "from m full join fx_entries e on m.batch_id = e.batch_id and m.ordinal = e.ordinal) select * from j where mismatch is not null"
)
def manifest_integrity(spark, sf):
    return results.manifest_mismatches(_manifest(spark, sf), _entries(spark, sf))


@_query(
    "select e.batch_id, e.custom_id, 'batch_cancelled' as error_code, 'This request was not executed because the batch was cancelled.' as message from fx_entries e where e.attempts = 0"
)
def not_executed_requests(spark, sf):
    e = _entries(spark, sf)
    return results.not_executed(e.select("batch_id", "custom_id"), e.filter("attempts > 0"), "batch_cancelled")


@_query(
    "with l as (select batch_id, custom_id, count(*) as n from fx_deliveries group by 1, 2), a as (select distinct batch_id, custom_id from fx_entries where ordinal <> 7) "
    "select coalesce(a.batch_id, l.batch_id) as batch_id, count(a.batch_id) as requests, cast(coalesce(sum(n), 0) as bigint) as lines, count(*) filter (l.batch_id is null) as uncovered, "
    "count(*) filter (a.batch_id is null) as unasked, count(*) filter (n > 1) as repeated from a full join l on a.batch_id = l.batch_id and a.custom_id = l.custom_id group by 1"
)
def coverage(spark, sf):
    d = view(spark, sf, "deliveries")
    asked = _entries(spark, sf).filter("ordinal <> 7")
    return results.coverage(asked, d.filter("error_code is null"), d.filter("error_code is not null"), tasks_for(view(spark, sf, "lineitem")))


@_query(
    "select error, count(*) as n from (select case when error_code is not null then error_code when status_code is not null then 'http_' || status_code else 'unknown' end as error "
    f"from fx_entries where not coalesce{SUCCEEDED.replace('(error', '((error', 1)[:-1]}), false)) group by error"
)
def error_code_counts(spark, sf):
    return results.error_counts(_entries(spark, sf))


def _answered(entries):
    e = entries.withColumn("request_id", fn.request_id(c("batch_id"), c("custom_id")))
    # As a server may send it: keys in no order, blanks, markup, a number with a point.
    body = F.when(c("result_bytes") % 5 != 0, F.concat(F.lit('{ "usage" : {"total":1e2, "n":'), c("result_bytes").cast("string"), F.lit('.0}, "object":"<b>chat</b> & more", "id":"'), "custom_id", F.lit('"}')))
    return results.result_lines(e.withColumn("body", body))


_LINES_SQL = (
    "with l as (select batch_id, ordinal, case when error_code is null then 'output' else 'error' end as route, "
    "'{\"id\":\"' || rid || '\",\"custom_id\":\"' || custom_id || '\",\"response\":' || case when error_code is null then '{\"status_code\":' || coalesce(cast(status_code as varchar), '0') || ',\"request_id\":\"' || rid || "
    "'\",\"body\":' || case when result_bytes % 5 <> 0 then '{\"id\":\"' || custom_id || '\",\"object\":\"\\u003cb\\u003echat\\u003c/b\\u003e \\u0026 more\",\"usage\":{\"n\":' || result_bytes || ',\"total\":100}}' else 'null' end || '}' else 'null' end || ',\"error\":' || case when error_code is null then 'null' else '{\"code\":\"' || error_code || '\",\"message\":\"This request could not be executed.\"}' end || '}' || chr(10) as line "
    f"from (select *, 'batch_req_' || {UUID5} as rid from (select *, sha1(unhex('{fn.OID_NAMESPACE}') || encode(batch_id) || unhex('00') || encode(custom_id)) as x from fx_entries))) "
)


@_query(_LINES_SQL + "select batch_id, route, count(*) as lines, cast(sum(strlen(line)) as bigint) as bytes, sha256(string_agg(line, '' order by ordinal)) as sha256 from l group by batch_id, route")
def artifact_digests(spark, sf):
    # Entries are dealt out by batch, so an artifact's lines are in one task as they are made.
    return results.artifacts(_answered(_entries(spark, sf)), dealt=True)


#: Deliveries whose lines are stored as plain text; those of more are compressed.
_PLAIN_ROWS = 400_000


def _release(spark: SparkSession, *folders: str) -> None:
    """Deletes what has served: folders, and the shuffle files of finished steps, which Spark deletes when the driver collects its garbage."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


@_query(_LINES_SQL + "select batch_id, route, batch_id not like '%7' as same from (select distinct batch_id, route from l)")
def artifact_verification(spark, sf):
    """Artifacts derived again against what was written as files and read back; of some batches a line was lost on the way."""
    from .queries_streaming import _folder
    from .sources.lines import read_lines

    entries, folder = _entries(spark, sf), _folder(spark, "artifacts")
    first = F.min("ordinal").over(W.partitionBy("batch_id", "route"))
    kept = entries.withColumn("route", results.route(c("error_code"))).withColumn("first", first).filter(~(c("batch_id").endswith("7") & (c("ordinal") == c("first"))))
    # Written as they are dealt out: all lines of a batch are in one file, those of an artifact in their order.
    sent = _answered(kept.drop("first")).select("batch_id", "route", "ordinal", "line").sortWithinPartitions("batch_id", "route", "ordinal")
    sent = sent.select(F.concat_ws(" ", "batch_id", "route", F.rtrim("line", F.lit("\n"))).alias("value"))
    table, cut = view(spark, sf, "lineitem"), F.split("line", " ", 3)
    parts = (cut[0].alias("batch_id"), cut[1].alias("route"), "ordinal", F.concat(cut[2], F.lit("\n")).alias("line"))
    derived = results.artifacts(_answered(entries), dealt=True)
    if table.count() <= _PLAIN_ROWS:
        sent.write.text(folder)
        stored = results.artifacts(read_lines(spark, folder).select(*parts), tasks_for(table))
        return results.verify_artifacts(derived, stored).select("batch_id", "route", "same")
    # Many lines take far more disk than their table, so they are compressed. A compressed file is read whole and in its order, so what one task
    # wrote is digested by one task, and no line is shuffled; digests are kept as bytes, and the lines go before the next step.
    sent.write.option("compression", "gzip").text(folder)
    _release(spark)
    back = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ordinal"))
    short = lambda a: a.select("batch_id", "route", "bytes", F.unhex("sha256").alias("sha256"))
    stored, digests = short(results.artifacts(back.select(*parts), dealt=True)), _folder(spark, "digests")
    stored.write.option("compression", "zstd").parquet(digests)
    _release(spark, folder)
    return results.verify_artifacts(short(derived), spark.read.schema(stored.schema).parquet(digests)).select("batch_id", "route", "same")


# ---------------------------------------------------------------- lifecycle

LATE = f"(priority <> 0 and {NOW}000000 > priority)"


@_query("select id, case when status = 'cancelled' then 'return' when status not in ('validating', 'in_progress', 'cancelling') then 'reject' when status = 'cancelling' then 'resend' when status = 'validating' and processor_id is null then 'cancelled' else 'cancelling' end as action from fx_items")
def cancel_routing(spark, sf):
    return _items(spark, sf).select("id", lifecycle.cancel_route(c("status"), catalog.queued()).alias("action"))


@_query(
    f"select id, case when resumable then case when status = 'cancelling' then 'cancelled' when {LATE} then 'expired' when recovery_attempts > 3 then 'failed' else 'resume' end "
    f"when {LATE} then 'expired' when status in ('validating', 'in_progress') then 'run' when status = 'cancelling' then 'cancelled' else 'skip' end as action from fx_items"
)
def pickup_routing(spark, sf):
    return _items(spark, sf).select("id", lifecycle.pickup_route(c("status"), c("resumable"), lifecycle.past_deadline(NOW), c("recovery_attempts")).alias("action"))


@_query(f"select id, case when resumable then 'requeue' when recovery_attempts > 3 then 'failed' when status = 'validating' then 'requeue' when status in {TERMINAL} then 'clean_up' else 'failed' end as action from fx_items where processor_id = 'proc-1'")
def startup_recovery(spark, sf):
    mine = _items(spark, sf).filter("processor_id = 'proc-1'")
    return mine.select("id", lifecycle.startup_route(c("status"), c("resumable"), c("recovery_attempts")).alias("action"))


@_query(
    f"select id, case when resumable then case when processor_id in {LIVE_SQL} and coalesce(lease_at > {NOW}, false) then null else 'requeue' end when processor_id in {LIVE_SQL} then null "
    f"when status = 'cancelling' then 'cancelled' when {LATE} then 'failed' when priority = 0 then 'error' else 'requeue' end as action from fx_items "
    f"where processor_id is not null and status not in {TERMINAL}".replace("select id,", "select * from (select id,", 1) + ") where action is not null"
)
def orphan_triage(spark, sf):
    return lifecycle.triage(_items(spark, sf), _live(spark), NOW).select("id", "action")


@_query(
    f"select i.id, i.tenant_id, coalesce(e.n, 0) as entries from fx_items i left join (select batch_id, count(*) as n from fx_entries group by batch_id) e on e.batch_id = i.id where expiry > 0 and expiry <= {NOW}"
)
def expiry_collect_cascade(spark, sf):
    removed, _ = lifecycle.collect_expired(_items(spark, sf), _entries(spark, sf), NOW)
    return removed


@_query(f"select e.batch_id, count(*) as n from fx_entries e where e.batch_id not in (select id from fx_items where expiry > 0 and expiry <= {NOW}) group by e.batch_id")
def entries_after_collection(spark, sf):
    _, left = lifecycle.collect_expired(_items(spark, sf), _entries(spark, sf), NOW)
    return metrics.counts(left, "batch_id")


@_query(f"select id from fx_items where processor_id = 'proc-5' and epoch = 2 and lease_at > {NOW} and resumable and status not in {TERMINAL}")
def fenced_rows(spark, sf):
    return _items(spark, sf).filter(lifecycle.owned_fence("proc-5", 2, NOW)).select("id")


@_query(f"select id, case when processor_id = 'proc-5' and epoch = 2 and lease_at > {NOW} and resumable and status not in {TERMINAL} then {NOW} + 300 else lease_at end as lease_at from fx_items")
def lease_renewal(spark, sf):
    return lifecycle.renew_leases(_items(spark, sf), "proc-5", 2, NOW).select("id", "lease_at")


@_query(f"select id, epoch + 1 as epoch, recovery_attempts + 1 as recovery_attempts from fx_items where processor_id = 'proc-3' and status not in {TERMINAL}")
def claim_owned(spark, sf):
    return lifecycle.claim_owned(_items(spark, sf), "proc-3").select("id", "epoch", "recovery_attempts")


@_query(
    "with recursive n as (select * , max(seq) over (partition by batch_id) as last from fx_transitions), "
    "f as (select distinct batch_id, cast(0 as bigint) as seq, 'validating' as status, cast(0 as bigint) as epoch, cast(null as varchar) as owner, cast(0 as bigint) as applied, cast(0 as bigint) as conflicts, last from n "
    "union all select f.batch_id, n.seq, case when ok then n.set_status else f.status end, f.epoch + case when ok and n.bump_epoch then 1 else 0 end, "
    "case when not ok then f.owner when n.set_status = 'validating' then null else coalesce(n.set_owner, f.owner) end, f.applied + case when ok then 1 else 0 end, f.conflicts + case when ok then 0 else 1 end, f.last "
    f"from f join n on n.batch_id = f.batch_id and n.seq = f.seq + 1, lateral (select f.status = n.expected_status and coalesce(n.expected_epoch = f.epoch, true) and f.status not in {TERMINAL} as ok) x) "
    "select batch_id, status, epoch, owner, applied, conflicts from f where seq = last"
)
def state_fold(spark, sf):
    return lifecycle.fold(view(spark, sf, "transitions"))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in S.TRANSITIONS)


@_query(f"select expected_status, set_status, count(*) as n from (select case when seq % 5 = 0 then 'completed' else expected_status end as expected_status, set_status from fx_transitions) where (expected_status, set_status) not in ({_ALLOWED}) group by 1, 2")
def transition_violations(spark, sf):
    log = view(spark, sf, "transitions").withColumn("expected_status", F.when(c("seq") % 5 == 0, "completed").otherwise(c("expected_status")))
    return lifecycle.violations(log)


@_query("select id, created_at + window_s as deadline, k % 500 as queue_wait, case when status in ('completed', 'failed', 'expired', 'cancelled') then k % 500 + k % 9000 end as e2e, "
        "case when k % 50 + 1 < 100 then '100' else '1000' end as bucket from fx_items")  # fmt: skip
def job_times(spark, sf):
    items = _items(spark, sf).withColumns({"started_at": c("created_at") + c("k") % 500, "ended_at": F.when(c("status").isin(*S.TERMINAL), c("created_at") + c("k") % 500 + c("k") % 9000)})
    wait, e2e = fn.job_times(c("created_at"), c("started_at"), c("ended_at"))
    return items.select("id", (fn.priority_us(c("created_at"), c("window_s")) / 1_000_000).cast("long").alias("deadline"), wait.alias("queue_wait"), e2e.alias("e2e"), fn.size_bucket(c("total")).alias("bucket"))


# ---------------------------------------------------------------- writes


@_query(
    f"select c.id, case when i.id is null then 'not_found' when c.want = i.status then 'applied' else 'conflict' end as verdict, case when c.want = i.status and c.new <> '' then c.new else i.status end as status "
    "from (select case when k % 97 = 0 then concat('gone_', id) else id end as id, case when k % 2 = 0 then status else 'validating' end as want, case when k % 3 = 0 then '' else 'failed' end as new from fx_items) c left join fx_items i on c.id = i.id"
)
def partial_update(spark, sf):
    items = _items(spark, sf)
    changes = items.select(
        F.when(c("k") % 97 == 0, F.concat(F.lit("gone_"), "id")).otherwise(c("id")).alias("id"), F.when(c("k") % 2 == 0, c("status")).otherwise("validating").alias("expected_status"),
        F.when(c("k") % 3 == 0, "").otherwise("failed").alias("new_status"),
    )
    return mutations.update(items, changes, ["status"], ["status"])


@_query("select id from fx_items where k % 7 = 3")
def deleted_ids(spark, sf):
    items = _items(spark, sf)
    return mutations.delete(items, items.filter(c("k") % 7 == 3).unionByName(items.filter(c("k") % 7 == 3)))[1]


@_query("select tenant_id, count(*) as n from fx_items where k % 7 <> 3 group by tenant_id")
def rows_after_delete(spark, sf):
    items = _items(spark, sf)
    return metrics.counts(mutations.delete(items, items.filter(c("k") % 7 == 3))[0], "tenant_id")


@_query(f"select id, case when ok then 100 else total end as total, case when ok then 60 else 0 end as completed, case when ok then 40 else 0 end as failed from (select *, k % 2 = epoch and status not in {TERMINAL} as ok from fx_items)")
def counts_update(spark, sf):
    items = _items(spark, sf).withColumn("completed", F.lit(0)).withColumn("failed", F.lit(0))
    progress = items.select("id", (c("k") % 2).alias("at_epoch"), F.lit(100).alias("total"), F.lit(60).alias("completed"), F.lit(40).alias("failed"))
    return mutations.set_counts(items, progress).select("id", "total", "completed", "failed")


@_query(f"select id, case when epoch <> 1 or status in {TERMINAL} then 'conflict' else 'ok' end as verdict from fx_items")
def status_checks(spark, sf):
    items = _items(spark, sf)
    return items.select("id", mutations.status_check(items, F.lit(1)).alias("verdict"))


@_query("select id, case when k % 9 = 0 then null else concat('http://', model) end as target from (select concat('r', cast(conv_id as varchar)) as id, conv_id as k, model from fx_requests) where model <> 'model-3' "
        "union all select concat('r', cast(conv_id as varchar)), null from fx_requests where model = 'model-3'".replace("case when k % 9 = 0 then null else concat('http://', model) end", "concat('http://', model)"))  # fmt: skip
def endpoint_resolution(spark, sf):
    ends = spark.createDataFrame([(m, f"http://{m}") for m in ("model-0", "model-1", "model-2", "model-4")], "model string, url string")
    out = mutations.resolve_endpoints(view(spark, sf, "requests"), ends)
    return out.select(F.concat(F.lit("r"), c("conv_id").cast("string")).alias("id"), "target")


@_query("select conv_id, concat(batch_id, '/', model) as route, n_messages from fx_requests")
def planned_lines(spark, sf):
    r = view(spark, sf, "requests")
    entries = ingest.plan(r).select("batch_id", "ordinal", "position")
    lines = r.select("batch_id", "ordinal", "conv_id", "model", "n_messages")
    return ingest.lines_at(entries, lines).select("conv_id", ingest.route_key(c("batch_id"), c("model"), True).alias("route"), "n_messages")


@_query(
    "select id, '{\"id\":\"' || id || '\",\"processor_id\":' || coalesce('\"' || processor_id || '\"', 'null') || ',\"epoch\":' || epoch || case when lease_at is null then '' else ',\"lease_at\":' || lease_at end || '}' as doc from fx_items"
)
def api_documents(spark, sf):
    docs = _items(spark, sf).select("id", "processor_id", "epoch", "lease_at")
    return docs.select("id", mutations.api_json(docs, ["lease_at"]).alias("doc"))


# ---------------------------------------------------------------- metrics


@_query("select endpoint, status_code, count(*) as n from fx_signals group by endpoint, status_code")
def request_counts(spark, sf):
    return metrics.counts(view(spark, sf, "signals"), "endpoint", "status_code")


@_query(
    "select category, type, retryable, count(*) as n from (select case when status_code = 400 then 'INVALID_REQ' when status_code in (401, 403) then 'AUTH_ERROR' when status_code = 429 then 'RATE_LIMIT' when status_code >= 500 then 'SERVER_ERROR' else 'UNKNOWN' end as category, "
    "case when status_code = 429 then 'rate_limit_error' when status_code >= 500 then 'server_error' when status_code = 404 then 'not_found_error' else 'api_error' end as type, status_code = 429 or status_code >= 500 as retryable from fx_signals) group by 1, 2, 3"
)
def error_category_counts(spark, sf):
    s = view(spark, sf, "signals")
    s = s.withColumn("category", fn.http_category(c("status_code"))).withColumn("type", fn.api_error_type(c("status_code")))
    return metrics.counts(s.withColumn("retryable", fn.retryable_category(c("category"))), "category", "type", "retryable")


@_query("select model, count(*) as requests, cast(sum(case when tokens >= 0 then tokens else 0 end) as bigint) as prompt_tokens, cast(sum(case when tokens - 50 >= 0 then tokens - 50 else 0 end) as bigint) as completion_tokens from fx_signals where status_code between 200 and 299 group by model")
def token_usage_by_model(spark, sf):
    s = view(spark, sf, "signals").withColumn("prompt_tokens", c("tokens")).withColumn("completion_tokens", c("tokens") - 50)
    return metrics.token_usage(s)


@_query("select bucket, count(*) as n from (select case when n < 100 then '100' when n < 1000 then '1000' when n < 10000 then '10000' when n < 30000 then '30000' else 'large' end as bucket from (select user_id, count(*) * [1, 10, 100, 1000, 10000][user_id % 5 + 1] as n from fx_signals group by user_id)) group by bucket")
def size_bucket_hist(spark, sf):
    sizes = view(spark, sf, "signals").groupBy("user_id").agg((F.count("*") * F.pow(F.lit(10), c("user_id") % 5)).cast("long").alias("n"))
    return metrics.counts(sizes.withColumn("bucket", fn.size_bucket(c("n"))), "bucket")


@_query("select status, case when recovery_attempts > 3 then 'exhausted' when resumable then 'resumed' else 'fresh' end as reason, count(*) as n from fx_items group by 1, 2")
def jobs_by_outcome(spark, sf):
    reason = F.when(c("recovery_attempts") > S.MAX_RECOVERY_ATTEMPTS, "exhausted").when(c("resumable"), "resumed").otherwise("fresh")
    return metrics.counts(_items(spark, sf).withColumn("reason", reason), "status", "reason")


@_query("select event_type as method, endpoint as path, status_code, count(*) as n, round(avg(latency_s), 6) as mean, count(*) filter (latency_s > 1) as slow from fx_signals group by 1, 2, 3")
def http_requests(spark, sf):
    s = view(spark, sf, "signals").select(c("event_type").alias("method"), c("endpoint").alias("path"), "status_code", "latency_s")
    return s.groupBy("method", "path", "status_code").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 6).alias("mean"), F.count_if(c("latency_s") > 1).alias("slow"))


@_query(f"select count(*) as collected, count(*) filter (purpose = 'batch') as inputs, cast(sum(bytes) as bigint) as bytes from fx_files where expiry > 0 and expiry <= {NOW}")
def collector_counters(spark, sf):
    gone = view(spark, sf, "files").filter(catalog.expired(NOW))
    return gone.agg(F.count("*").alias("collected"), F.count_if(c("purpose") == "batch").alias("inputs"), F.sum("bytes").cast("long").alias("bytes"))


@_query("select endpoint, count(*) filter (status_code = 200) as busy, cast(sum(tokens) as bigint) as tokens, round(count(*) filter (status_code = 200) / greatest(cast(count(*) as double), 1.0), 9) as saturation, round(avg(latency_s), 6) as mean from fx_signals group by endpoint")
def gauges(spark, sf):
    s = view(spark, sf, "signals")
    busy = F.count_if(c("status_code") == 200)
    return s.groupBy("endpoint").agg(busy.alias("busy"), F.sum("tokens").alias("tokens"), F.round(metrics.ratio(busy, F.count("*").cast("double"), 1.0), 9).alias("saturation"), F.round(F.avg("latency_s"), 6).alias("mean"))


_BOUNDS = metrics.buckets("process")
_LE = ", ".join(repr(b) for b in _BOUNDS)


@_query(f"select endpoint, le, count(*) filter (latency_s <= le) as n from fx_signals, (select unnest([{_LE}, 'infinity'::double]) as le) group by endpoint, le")
def latency_histogram(spark, sf):
    return metrics.histogram(view(spark, sf, "signals"), c("latency_s"), _BOUNDS, ["endpoint"])


_HIST = f"h as (select endpoint, le, count(*) filter (latency_s <= le) as n from fx_signals, (select unnest([{_LE}, 'infinity'::double]) as le) group by endpoint, le)"


def _quantile_sql(by: str) -> str:
    keys, part = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    return (
        f"with {_HIST}, s as (select {keys}le, sum(n) as n from h group by {keys}le), w as (select *, lag(le) over ({part}order by le) as low, lag(n) over ({part}order by le) as base, "
        f"max(n) over ({part.rstrip()}) as total from s), k as (select *, row_number() over ({part}order by le) as r from w where n >= 0.95 * total) "
        f"select {keys}case when le = 'infinity' then low else coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - coalesce(base, 0)) / (n - coalesce(base, 0)) end as value from k where r = 1"
    )


@_query("select endpoint, round(value, 6) as value from (" + _quantile_sql("endpoint") + ")")
def prom_quantile_95(spark, sf):
    h = metrics.histogram(view(spark, sf, "signals"), c("latency_s"), _BOUNDS, ["endpoint"])
    return metrics.histogram_quantile(0.95, h, ["endpoint"]).withColumn("value", F.round("value", 6))


@_query("select round(value, 6) as value from (" + _quantile_sql("") + ")")
def prom_quantile_95_fleet(spark, sf):
    h = metrics.histogram(view(spark, sf, "signals"), c("latency_s"), _BOUNDS, ["endpoint"])
    return metrics.histogram_quantile(0.95, h).withColumn("value", F.round("value", 6))


def _counter(spark, sf):
    s = view(spark, sf, "signals")
    # A counter that starts again every 7 days.
    week = F.floor(c("sec") / 604800)
    running = F.count("*").over(_w("endpoint", week))
    return metrics.growth(s.withColumn("value", running.cast("double")), ["endpoint"], "sec", ties=["event_id"])


def _w(key, part):
    from pyspark.sql import Window

    return Window.partitionBy(key, part).orderBy("sec", "event_id").rowsBetween(Window.unboundedPreceding, 0)


_COUNTER = (
    "v as (select endpoint, sec, event_id, cast(count(*) over (partition by endpoint, floor(sec / 604800) order by sec, event_id rows unbounded preceding) as double) as value from fx_signals), "
    "g as (select *, lag(value) over (partition by endpoint order by sec, event_id) as last from v), "
    "d as (select *, case when last is null then 0.0 when value < last then value else value - last end as delta from g)"
)


@_query(f"with {_COUNTER} select endpoint, cast(floor(sec / 3600) * 3600 as bigint) as window_start, round(sum(delta) / 3600.0, 9) as rate from d group by 1, 2")
def prom_rate(spark, sf):
    return metrics.rate(_counter(spark, sf), 3600, ["endpoint"], "sec").withColumn("rate", F.round("rate", 9))


@_query(f"with {_COUNTER} select cast(floor(sec / 3900) * 3900 as bigint) as window_start, cast(sum(delta) as double) as increase from d group by 1 having sum(delta) > 0")
def alert_increase(spark, sf):
    return metrics.increase(_counter(spark, sf), 3900, at="sec").filter("increase > 0")


_RATIO = "r as (select cast(floor(sec / 86400) * 86400 as bigint) as window_start, count(*) filter (status_code >= 500) / greatest(cast(count(*) as double), 0.001) as ratio from fx_signals group by 1)"


@_query(
    f"with {_RATIO} select window_start, round(ratio, 9) as ratio, min(case when ratio > 0.19 then 1 else 0 end) over (order by window_start rows between 2 preceding and current row) = 1 "
    "and count(*) over (order by window_start rows between 2 preceding and current row) > 2 as alert from r"
)
def alert_failure_ratio(spark, sf):
    day = (F.floor(c("sec") / 86400) * 86400).cast("long")
    share = view(spark, sf, "signals").groupBy(day.alias("window_start")).agg(metrics.ratio(F.count_if(c("status_code") >= 500), F.count("*").cast("double")).alias("ratio"))
    return metrics.held_for(share, c("ratio") > 0.19, 2).withColumn("ratio", F.round("ratio", 9))


_WAIT = "sum(case when latency_s <= le then 1 else 0 end)"


@_query(
    f"with b as (select cast(floor(sec / 86400) * 86400 as bigint) as window_start, le, {_WAIT} as n from fx_signals, (select unnest([{_LE}, 'infinity'::double]) as le) group by 1, 2), "
    "w as (select *, lag(le) over (partition by window_start order by le) as low, lag(n) over (partition by window_start order by le) as base, max(n) over (partition by window_start) as total from b), "
    "k as (select *, row_number() over (partition by window_start order by le) as r from w where n >= 0.95 * total), "
    "v as (select window_start, case when le = 'infinity' then low else coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - coalesce(base, 0)) / (n - coalesce(base, 0)) end as value from k where r = 1) "
    "select window_start, round(value, 6) as value, min(case when value > 1.45 then 1 else 0 end) over (order by window_start rows between 1 preceding and current row) = 1 "
    "and count(*) over (order by window_start rows between 1 preceding and current row) > 1 as alert from v"
)
def alert_queue_wait(spark, sf):
    day = (F.floor(c("sec") / 86400) * 86400).cast("long")
    s = view(spark, sf, "signals").withColumn("window_start", day)
    p95 = metrics.histogram_quantile(0.95, metrics.histogram(s, c("latency_s"), _BOUNDS, ["window_start"]), ["window_start"])
    return metrics.held_for(p95, c("value") > 1.45, 1).withColumn("value", F.round("value", 6))


@_query(f"with {_COUNTER} select endpoint, event_id, delta from d where delta <> 1")
def counter_resets(spark, sf):
    return _counter(spark, sf).filter("delta <> 1").select("endpoint", "event_id", "delta")


@_query(
    "with recursive s as (select endpoint, cast(sec as double) as a, latency_s * 20000 as d, row_number() over (partition by endpoint order by event_id) as r, count(*) over (partition by endpoint) as last from fx_signals), "
    "f as (select distinct endpoint, cast(0 as bigint) as r, last, [0.0::double, 0.0::double, 0.0::double] as free, 0.0::double as waited from s "
    "union all select f.endpoint, s.r, f.last, list_sort(list_append(f.free[2:3], greatest(f.free[1], s.a) + s.d)), f.waited + greatest(f.free[1], s.a) - s.a from f join s on s.endpoint = f.endpoint and s.r = f.r + 1) "
    "select endpoint, last as requests, round(waited, 3) as waited, round(list_max(free), 3) as finished from f where r = last"
)
def slot_schedule(spark, sf):
    s = view(spark, sf, "signals").withColumn("d", c("latency_s") * 20000)
    out = analysis.slot_schedule(s, "endpoint", "sec", "d", "event_id", 3)
    return out.withColumn("waited", F.round("waited", 3)).withColumn("finished", F.round("finished", 3))


@_query(
    "with recursive s as (select endpoint, row_number() over (partition by endpoint order by event_id) as r, case when status_code = 429 or status_code >= 500 then -1 else 1 end as x, count(*) over (partition by endpoint) as last from fx_signals), "
    "f as (select distinct endpoint, cast(0 as bigint) as r, cast(10 as bigint) as lim, cast(0 as bigint) as wins, cast(0 as bigint) as ups, cast(0 as bigint) as downs, last from s "
    "union all select f.endpoint, s.r, n.lim, case when s.x = -1 or f.wins + 1 >= f.lim then 0 else f.wins + 1 end, f.ups + case when n.lim > f.lim then 1 else 0 end, f.downs + case when n.lim < f.lim then 1 else 0 end, f.last "
    "from f join s on s.endpoint = f.endpoint and s.r = f.r + 1, lateral (select cast(case when s.x = -1 then greatest(5, floor(f.lim * 0.5)) when f.wins + 1 >= f.lim then least(f.lim + 1, 10) else f.lim end as bigint) as lim) n) "
    "select endpoint, lim as \"limit\", wins, ups, downs from f where r = last"
)
def aimd_trace(spark, sf):
    s = view(spark, sf, "signals").withColumn("signal", metrics.aimd_signal(c("status_code"), F.lit(False), F.lit(True)))
    return metrics.aimd(s, "endpoint", "event_id", "signal")


# ---------------------------------------------------------------- load-test analytics


@_query("select scenario, phase, avg(ttft_p50) as ttft_p50, avg(ttft_p99) as ttft_p99, cast(sum(completed) as bigint) as completed, cast(sum(errors) as bigint) as errors from fx_phases where phase like '%u%' group by 1, 2".replace("avg(ttft_p50)", "round(avg(ttft_p50), 6)").replace("avg(ttft_p99)", "round(avg(ttft_p99), 6)"))
def phase_aggregate(spark, sf):
    out = analysis.phase_aggregate(view(spark, sf, "phases"), ["scenario", "phase"], ["ttft_p50", "ttft_p99"], ["completed", "errors"], "u")
    return out.withColumn("ttft_p50", F.round("ttft_p50", 6)).withColumn("ttft_p99", F.round("ttft_p99", 6))


@_query("select scenario, phase, count(*) as trials, round(avg(ttft_p50), 6) as mean, round(case when count(*) < 2 then 0 else stddev_samp(ttft_p50) / sqrt(count(*)) * 1.96 end, 6) as ci95, cast(floor(sum(completed) / count(*)) as bigint) as count from fx_phases group by 1, 2")
def trial_ci95(spark, sf):
    out = analysis.trial_aggregate(view(spark, sf, "phases"), ["scenario", "phase"], "ttft_p50", "completed")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("ci95", F.round("ci95", 6))


@_query("select window_s, count(*) filter (status in ('completed', 'failed')) as completed, count(*) filter (status in ('completed', 'failed') and k % 9000 <= window_s) as met, "
        "round(case when count(*) filter (status in ('completed', 'failed')) > 0 then count(*) filter (status in ('completed', 'failed') and k % 9000 <= window_s) / count(*) filter (status in ('completed', 'failed')) end, 9) as attainment from fx_items group by window_s")  # fmt: skip
def slo_attainment(spark, sf):
    elapsed = F.when(c("status").isin("completed", "failed"), c("k") % 9000)
    return analysis.attainment(_items(spark, sf), ["window_s"], elapsed, c("window_s")).withColumn("attainment", F.round("attainment", 9))


_P = ", ".join(f"quantile_cont(ttft_p50, {i / 10})" for i in range(11))


@_query(f"select scenario, round(d[10] + 0.5 * (d[11] - d[10]), 6) as p95, round(d[10] + 0.9 * (d[11] - d[10]), 6) as p99 from (select scenario, [{_P}] as d from fx_phases group by scenario)")
def decile_p99(spark, sf):
    d = analysis.deciles_of(view(spark, sf, "phases"), ["scenario"], "ttft_p50")
    return d.select("scenario", F.round(fn.percentile_of_deciles(c("deciles"), 95), 6).alias("p95"), F.round(fn.percentile_of_deciles(c("deciles"), 99), 6).alias("p99"))


@_query("with a as (select scenario, avg(ttft_p99) as v from fx_phases group by scenario) select scenario, round((v - b) / b * 100, 6) as degradation from a, (select v as b from a where scenario = 0)")
def degradation(spark, sf):
    means = view(spark, sf, "phases").groupBy("scenario").agg(F.avg("ttft_p99").alias("v"))
    return analysis.degradation(means, "v").select("scenario", F.round("degradation", 6).alias("degradation"))


_PROBE = "select scenario * 5 + 5 as rate, max(ttft_p99) as ttft_p99, sum(errors) / cast(sum(completed) as double) * 10 as error_rate, sum(completed) as completed from fx_phases group by scenario"


@_query(
    f"with p as ({_PROBE}), o as (select *, first_value(ttft_p99) over (order by rate) as base, row_number() over (order by rate) as n from p where completed > 0) "
    "select min(greatest(1, rate - 5)) as rate from o where (n > 1 and base > 0 and ttft_p99 > 3 * base) or error_rate > 0.05"
)
def saturating_rate(spark, sf):
    p = view(spark, sf, "phases").groupBy("scenario").agg(F.max("ttft_p99").alias("ttft_p99"), (F.sum("errors") / F.sum("completed") * 10).alias("error_rate"), F.sum("completed").alias("completed"))
    return analysis.saturation(p.withColumn("rate", c("scenario") * 5 + 5))


@_query("with p as (select endpoint as metric, cast(floor(sec / 15) * 15 as bigint) as step, latency_s as v, event_id from fx_signals) select metric, step, arg_max(v, event_id) as value from p group by 1, 2")
def range_query_steps(spark, sf):
    s = view(spark, sf, "signals").select(c("endpoint").alias("metric"), "sec", c("latency_s").alias("value"), "event_id")
    start = (F.floor(c("sec") / 15) * 15).cast("long")
    return s.groupBy("metric", start.alias("step")).agg(F.max_by("value", "event_id").alias("value"))


@_query("select user_id, event_id, tokens - coalesce(lag(tokens) over (partition by user_id order by event_id), 0) as delta from fx_signals")
def progress_deltas(spark, sf):
    return analysis.progress_deltas(view(spark, sf, "signals"), "user_id", "event_id", "tokens").select("user_id", "event_id", "delta")


@_query("select id, case when window_s < 60 then window_s || 's' when window_s // 60 < 60 then (window_s // 60) || 'm' when (window_s // 60) % 60 = 0 then (window_s // 3600) || 'h' else (window_s // 3600) || 'h ' || ((window_s // 60) % 60) || 'm' end as shown, "
        "round(ln(window_s) - ln(1 + 1.0 / 4) / 2, 9) as mu from fx_items".replace("window_s <", "window_s + k % 4000 <").replace("window_s //", "(window_s + k % 4000) //").replace("window_s ||", "(window_s + k % 4000) ||"))  # fmt: skip
def shown_durations(spark, sf):
    mu, _ = fn.lognormal_parameters(c("window_s").cast("double"), c("window_s") / 2)
    return _items(spark, sf).select("id", fn.human_duration(c("window_s") + c("k") % 4000).alias("shown"), F.round(mu, 9).alias("mu"))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: what a batch's finalization writes, from raw deliveries."""
    return finalize_counts(spark, sf_dir)


from . import queries_metrics, queries_objects, queries_rules, queries_streaming, queries_writes  # noqa: E402, F401 (they register their queries here)
