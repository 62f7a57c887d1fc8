"""Registered queries of the rules: what a request, a header, a result or a run is taken for, over rows of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import schemas as S
from .functions import scalars as fn
from .operators import analysis, catalog, deliveries, ingest, lifecycle, metrics, mutations, results
from .plans.fixtures import NOW, tasks_for, view
from .queries import TERMINAL, _entries, _items, _query, c


def _pick(k, *values):
    """The value at ``k`` modulo their number; None is null."""
    out = None
    for i, v in enumerate(values):
        when = k % len(values) == i
        out = F.when(when, F.lit(v)) if out is None else out.when(when, F.lit(v))
    return out


def _case(k: str, *values) -> str:
    """The same in SQL."""
    text = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when {k} % {len(values)} = {i} then {text(v)}" for i, v in enumerate(values)) + " end"


WINDOWS = ("24h", "", "1h30m", "soon", "500ms", None, "-2h")
ENDS = ("/v1/chat/completions", "", "/v1/embeddings", "/v1/nothing")


@_query(
    f"with r as (select id, k, {_case('k', *WINDOWS)} as w, {_case('k // 2', *ENDS)} as e, case when k % 10 = 0 then '' else 'file_' || k end as f, k % 20 as n, 60 + k % 8 as kl, 508 + k % 8 as vl, "
    f"{_case('k // 3', None, 'created_at', 'updated_at')} as a, k * 1000 as s from fx_items) "
    "select id, case when coalesce(w, '') = '' then 'completion_window is required' when w = 'soon' then 'completion_window must be a valid duration' when e = '' then 'endpoint is required' "
    "when e = '/v1/nothing' then 'invalid endpoint' when f = '' then 'input_file_id is required' when n > 16 then 'metadata: too many keys' when n > 0 and kl + length(cast(n - 1 as varchar)) > 64 then 'metadata: key too long' "
    "when n > 0 and vl > 512 then 'metadata: value too long' when a = 'updated_at' then 'output_expires_after.anchor must be ''created_at''' when a is not null and s not between 3600 and 2592000 then 'output_expires_after.seconds out of range' end as problem from r"
)
def create_problems(spark, sf):
    k = c("k")
    keys = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.repeat(F.lit("k"), 60 + k % 8), (i - 1).cast("string")))
    n = (k % 20).cast("int")
    metadata = F.map_from_arrays(F.slice(keys, 1, n), F.array_repeat(F.repeat(F.lit("v"), (508 + k % 8).cast("int")), n))
    rows = _items(spark, sf).select(
        "id", _pick(k, *WINDOWS).alias("completion_window"), _pick(F.floor(k / 2), *ENDS).alias("endpoint"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("file_"), k.cast("string"))).alias("input_file_id"),
        metadata.alias("metadata"), _pick(F.floor(k / 3), None, "created_at", "updated_at").alias("expires_anchor"), (k * 1000).alias("expires_seconds"),
    )
    return catalog.validate_create(rows).select("id", "problem")


@_query(
    f"with r as (select id, bytes * 100000 as bytes, {_case('k', 'batch', '', 'user_data', 'other')} as p, {_case('k // 4', None, 'created_at', 'later')} as a, {_case('k // 12', None, '7200', 'x', '10')} as s from fx_files) "
    "select id, case when bytes > 209715200 then 'file too large' when p = '' then 'purpose is required' when p = 'other' then 'invalid purpose' when (a is null) <> (s is null) then 'anchor and seconds go together' "
    "when a = 'later' then 'invalid anchor' when s = 'x' then 'seconds must be an integer' when s = '10' then 'seconds out of range' end as problem from r"
)
def upload_problems(spark, sf):
    k = c("k")
    rows = view(spark, sf, "files").select(
        "id", (c("bytes") * 100000).alias("bytes"), _pick(k, "batch", "", "user_data", "other").alias("purpose"), _pick(F.floor(k / 4), None, "created_at", "later").alias("expires_anchor"),
        _pick(F.floor(k / 12), None, "7200", "x", "10").alias("expires_seconds"),
    )
    return catalog.validate_upload(rows).select("id", "problem")


@_query(
    "select id, 'validating' as status, case when k % 6 > 0 and window_s <> 0 then (k % 6 + window_s) * 1000000 else 0 end as priority, cast(null as varchar) as processor_id, 0 as epoch, 0 as recovery_attempts, false as resumable from fx_items"
)
def created_rows(spark, sf):
    asked = _items(spark, sf).select("id", "tenant_id", (c("k") % 6).alias("created_at"), "window_s")
    return mutations.create_rows(asked).select("id", "status", "priority", "processor_id", "epoch", "recovery_attempts", "resumable")


@_query("select distinct 'proc-' || (k % 9) as processor_id from fx_items where k % 4 <> 0 and k % 9 < 6")
def ready_processors(spark, sf):
    pods = _items(spark, sf).select(F.concat(F.lit("proc-"), (c("k") % 9).cast("string")).alias("processor_id"), ((c("k") % 4 != 0) & (c("k") % 9 < 6)).alias("ready"))
    return mutations.live_processors(pods)


@_query("select id, env as env_tag, case when k % 2 = 0 then team end as team_tag, case when k % 2 = 0 then 2 else 1 end as n from fx_items")
def prefixed_tags(spark, sf):
    tags = F.when(c("k") % 2 == 0, F.create_map(F.lit("pth:env"), "env", F.lit("pth:team"), "team", F.lit("x"), F.lit("1"))).otherwise(F.create_map(F.lit("pth:env"), "env", F.lit("otel:team"), "team"))
    split = catalog.split_tags(tags, "pth:")
    return _items(spark, sf).select("id", split["env"].alias("env_tag"), split["team"].alias("team_tag"), F.size(split).cast("long").alias("n"))


@_query(
    "select conv_id, case when conv_id % 90 >= 40 then cast(conv_id % 90 - 40 as varchar) end as ttft, case when conv_id % 3 = 0 then 'fast' end as objective, "
    "case when conv_id % 4 = 0 then 'own' else batch_id end as fairness, case when conv_id % 4 = 0 then 1 else 0 end + 1 + case when conv_id % 90 >= 40 then 1 else 0 end + case when conv_id % 3 = 0 then 1 else 0 end - case when conv_id % 4 = 0 then 1 else 0 end as n from fx_requests"
)
def dispatch_headers(spark, sf):
    k, fair = c("conv_id"), "x-gateway-inference-fairness-id"
    given = F.when(k % 4 == 0, F.create_map(F.lit(fair), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    h = ingest.request_headers(given, k % 90, F.lit(40), F.when(k % 3 == 0, "fast").otherwise(""), c("batch_id"))
    out = view(spark, sf, "requests").select("conv_id", h.alias("h"))
    return out.select("conv_id", c("h")["x-slo-ttft-ms"].alias("ttft"), c("h")["x-gateway-inference-objective"].alias("objective"), c("h")[fair].alias("fairness"), F.size("h").cast("long").alias("n"))


@_query(
    f"with s as (select *, {_case('k', 'in_progress', 'completed', 'cancelled', 'validating', 'expired')} as new from fx_items) "
    "select id, new as status, case when new = 'in_progress' then 1000 + k else 1 end as in_progress_at, case when new = 'completed' then 1000 + k end as completed_at, case when new = 'cancelled' then 1000 + k end as cancelled_at, "
    "case when new = 'expired' then 1000 + k end as expired_at, case when new = 'validating' then created_at + window_s else 7 end as expires_at from s"
)
def status_documents(spark, sf):
    long = lambda x: F.lit(x).cast("long")
    fields = {"in_progress_at": 1, "completed_at": None, "failed_at": None, "cancelled_at": None, "expired_at": None, "finalizing_at": None, "cancelling_at": None, "expires_at": 7}
    doc = F.struct(c("status"), *[long(v).alias(f) for f, v in fields.items()])
    rows = _items(spark, sf).withColumn("doc", doc)
    new = lifecycle.with_status(c("doc"), _pick(c("k"), "in_progress", "completed", "cancelled", "validating", "expired"), long(1000) + c("k"), c("created_at") + c("window_s"))
    return rows.select("id", new.alias("d")).select("id", "d.status", "d.in_progress_at", "d.completed_at", "d.cancelled_at", "d.expired_at", "d.expires_at")


@_query("select id, case when k % 3 = 0 then 'cancelled' else 'completed' end as final, case when k % 2 = 0 then env else team end as kept from fx_items")
def finalization_status(spark, sf):
    return _items(spark, sf).select("id", lifecycle.finalize_status(c("k") % 3 == 0).alias("final"), lifecycle.keep_if_empty(F.when(c("k") % 2 == 0, c("env")).otherwise(""), c("team")).alias("kept"))


CAUSES = ("cancelled", "expired", "shutdown", None, "other")


@_query(f"select id, case {_case('k', *CAUSES)} when 'cancelled' then 'cancelled' when 'expired' then 'expired' when 'shutdown' then 'leave' else 'failed' end as route from fx_items")
def abort_routes(spark, sf):
    return _items(spark, sf).select("id", lifecycle.abort_route(_pick(c("k"), *CAUSES), c("resumable")).alias("route"))


@_query(
    f"with r as (select id, {_case('k', *CAUSES)} as cause, k % 3 as failed, total - k % 2 as completed, total, case when k % 4 = 0 then null else 'finalize_error' end as error from fx_items) "
    "select id, case when cause in ('expired', 'cancelled') then cause when cause = 'shutdown' and not (failed = 0 and completed = total) then cause when cause = 'shutdown' then 'none' when error is not null then error else 'none' end as outcome from r"
)
def run_outcomes(spark, sf):
    error = F.when(c("k") % 4 != 0, "finalize_error")
    return _items(spark, sf).select("id", fn.outcome(_pick(c("k"), *CAUSES), c("k") % 3, c("total") - c("k") % 2, c("total"), error).alias("outcome"))


@_query(f"select id, case when k % 5 > 0 then {NOW} + k % 5 when k % 3 > 0 then {NOW} + k % 3 else 0 end as expires_at, case when k % 7 = 0 then 300 when k % 900 - 300 <= 0 then 0 else least(300, k % 900 - 300) end as held from fx_items")
def expiry_and_wait(spark, sf):
    k = c("k")
    hold = fn.recovery_wait(F.lit(S.RECOVERY_WINDOW_S).cast("long"), F.when(k % 7 != 0, NOW + k % 900), F.lit(NOW).cast("long"))
    return _items(spark, sf).select("id", fn.output_expiry(k % 5, k % 3, F.lit(NOW).cast("long")).alias("expires_at"), hold.alias("held"))


@_query(
    "with r as (select id, k % 9 + 1 as asked, floor(k * 300 / ((k % 7 + 1) * 500)) as fit from fx_items) "
    "select id, case when fit >= 1 then least(asked, cast(fit as bigint)) end as workers from r"
)
def workers_that_fit(spark, sf):
    k = c("k")
    return _items(spark, sf).select("id", fn.effective_workers(k % 9 + 1, k * 1000, F.lit(30), (k % 7 + 1) * 500).alias("workers"))


CODES = (200, 400, 429, 500, 503, None, 404)


@_query(
    f"with r as (select id, {_case('k', *CODES)} as code, case when k % 2 = 0 then 'rejected-ttl-expired' end as dropped, k % 6 as attempt, {_case('k', None, '5', '+7', 'x', '0', '-3')} as after from fx_items), "
    "a as (select *, case when after in ('5', '+7', '0') then cast(after as bigint) end as secs from r) "
    "select id, case when code is null then true when code in (429, 503) then dropped is null else code >= 500 end as retry, secs, "
    "case when code in (429, 503) and secs is not null then greatest(cast(secs as double), 1.0) else least((case when code = 429 then 3.0 else 1.0 end) * pow(2, greatest(attempt, 1) - 1), case when code in (502, 503, 504) then 15.0 else 30.0 end) end as delay from a"
)
def retry_plan(spark, sf):
    code, after = _pick(c("k"), *CODES), fn.retry_after_seconds(_pick(c("k"), None, "5", "+7", "x", "0", "-3"), F.lit(NOW).cast("long"))
    return _items(spark, sf).select(
        "id", fn.should_retry(code, F.when(c("k") % 2 == 0, S.DROPPED_LATE)).alias("retry"), after.alias("secs"), fn.backoff_seconds(code, c("k") % 6, after, 1.0, 30.0).alias("delay")
    )


@_query(f"select id, case {_case('k', *WINDOWS)} when '24h' then 86400::double when '1h30m' then 5400 when '500ms' then 0.5 when '-2h' then -7200 end as seconds from fx_items")
def window_seconds(spark, sf):
    return _items(spark, sf).select("id", fn.duration_seconds(_pick(c("k"), *WINDOWS)).alias("seconds"))


CONTENTS = ('"a \\"b\\" c"', '[{"type":"text","text":"x"},{"type":"image_url","text":"no"},{"type":"text","text":"y"}]', "null", None, "7", "[]", '{"a":1}')
TEXTS = ('a "b" c', "xy", "", "", None, "", None)


@_query(f"select id, {_case('k', *TEXTS)} as text from fx_items")
def message_texts(spark, sf):
    return _items(spark, sf).select("id", ingest.message_text(_pick(c("k"), *CONTENTS)).alias("text"))


@_query("select id, k % 4 <> 3 as same from fx_items")
def same_documents(spark, sf):
    a = F.concat(F.lit('{"a":1,"b":'), (c("k") % 4).cast("string"), F.lit("}"))
    b = F.concat(F.lit('{ "b" : '), F.when(c("k") % 4 == 3, "9").otherwise((c("k") % 4).cast("string")), F.lit(', "a": 1 }'))
    return _items(spark, sf).select("id", fn.same_json(a, b).alias("same"))


@_query("select id, k % 3 <> 2 as same from fx_items")
def same_ids(spark, sf):
    a = F.array("env", "team", "env")
    return _items(spark, sf).select("id", fn.same_members(a, F.when(c("k") % 3 != 2, F.array("team", "env", "env")).otherwise(F.array("team", "team", "env"))).alias("same"))


_KEYS = "select batch_id, custom_id, arrival, sha256(cast(result_bytes % 2 as varchar)) as sha256 from fx_deliveries"


@_query(
    f"with d as ({_KEYS}), g as (select batch_id, custom_id, sha256, min(arrival) as arrival, count(*) as deliveries from d group by 1, 2, 3), n as (select *, row_number() over (partition by batch_id, custom_id order by arrival, sha256) as n from g) "
    "select 'results/' || batch_id || '/' || custom_id || case when n = 1 then '' else '-' || substr(sha256, 1, 16) end || '.jsonl' as key, deliveries from n"
)
def result_object_keys(spark, sf):
    d = view(spark, sf, "deliveries").select("batch_id", c("custom_id").alias("request_id"), "arrival", F.sha2((c("result_bytes") % 2).cast("string"), 256).alias("sha256"))
    return results.object_keys(d).select("key", "deliveries")


@_query("select batch_id, custom_id, ordinal % 3 <> 1 and ordinal <> 5 as intact from fx_entries")
def intact_results(spark, sf):
    e = _entries(spark, sf).select("batch_id", "custom_id", "ordinal", fn.result_key(c("batch_id"), c("custom_id")).alias("result_key"), "result_bytes", F.sha2("custom_id", 256).alias("result_sha256"))
    objects = e.filter("ordinal <> 5").select("result_key", (c("result_bytes") + (c("ordinal") % 3 == 1).cast("long")).alias("bytes"), c("result_sha256").alias("sha256"))
    return results.checked_results(e, objects).select("batch_id", "custom_id", "intact")


@_query(
    "select d.batch_id || d.custom_id as request_id, case when d.arrival % 2 = 0 then 'own' else e.custom_id end as custom_id, case when d.ordinal % 3 = 0 then 'm' else e.status end as model, count(*) as n from fx_deliveries d "
    "left join (select * from fx_entries where ordinal <> 2) e on d.batch_id = e.batch_id and d.custom_id = e.custom_id where d.arrival % 2 = 0 or e.custom_id is not null group by 1, 2, 3"
)
def enriched_results(spark, sf):
    rid = F.concat("batch_id", "custom_id").alias("request_id")
    pending = _entries(spark, sf).filter("ordinal <> 2").select(rid, "custom_id", c("status").alias("model"), c("attempts").alias("submitted_at"))
    got = view(spark, sf, "deliveries").select(
        rid, F.when(c("arrival") % 2 == 0, "own").otherwise("").alias("custom_id"), F.when(c("ordinal") % 3 == 0, "m").alias("model"), F.lit(None).cast("long").alias("submitted_at")
    )
    # Both sides in as many tasks as their rows need; the groups are found where the join leaves them.
    tasks = tasks_for(view(spark, sf, "lineitem"))
    got, pending = got.repartition(tasks, "request_id"), pending.repartition(tasks, "request_id")
    return results.enrich(got, pending).groupBy("request_id", "custom_id", "model").agg(F.count("*").alias("n"))


@_query(
    f"with r as (select event_id, {_case('event_id', 0, 200, 403, 500, None)} as status, {_case('event_id // 5', None, '', 'boom')} as code, {_case('event_id // 7', '{{\"a\":1}}', '', 'nope')} as body from fx_signals), ".replace("{{", "{").replace("}}", "}")
    + "x as (select event_id, coalesce(status, 0) as s, coalesce(code, '') as code, body from r), "
    "y as (select *, case when s = 0 and code <> '' then code when (s = 0 or s between 200 and 299) and body = '' then 'server_error' when (s = 0 or s between 200 and 299) and body = 'nope' then 'parse_error' end as fault from x) "
    "select event_id, case when fault is null then case when s = 0 then 200 else s end end as status_out, fault as code_out, "
    "case when fault is null then case when body = '' then '{}' when body = 'nope' then '{\"error\":{\"message\":\"nope\"}}' else body end end as body_out from y"
)
def queue_results(spark, sf):
    k = c("event_id")
    rows = view(spark, sf, "signals").select(
        "event_id", _pick(k, 0, 200, 403, 500, None).alias("status_code"), _pick(F.floor(k / 5), None, "", "boom").alias("error_code"), F.lit(None).cast("string").alias("error_message"), _pick(F.floor(k / 7), '{"a":1}', "", "nope").alias("body")
    )
    return results.normalise_async(rows).select("event_id", "status_out", "code_out", "body_out")


@_query(
    f"with r as (select event_id, {_case('event_id', 0, 200, 429, 500, None)} as status, {_case('event_id // 5', None, 'RATE_LIMIT')} as category, {_case('event_id // 2', None, 'rejected-ttl-expired', 'x')} as dropped, {_case('event_id // 3', 'a', '')} as body from fx_signals), "
    "x as (select *, case when coalesce(status, 0) <= 0 then coalesce(category, 'SERVER_ERROR') when status <> 200 and dropped = 'rejected-ttl-expired' then 'batch_expired' when status = 200 and body = 'a' then 'PARSE_ERROR' end as code from r) "
    "select event_id, code as code_out, case when code is null then status end as status_out from x"
)
def direct_results(spark, sf):
    k = c("event_id")
    rows = view(spark, sf, "signals").select(
        "event_id", _pick(k, 0, 200, 429, 500, None).alias("status_code"), _pick(F.floor(k / 5), None, "RATE_LIMIT").alias("category"), _pick(F.floor(k / 2), None, S.DROPPED_LATE, "x").alias("dropped_reason"), _pick(F.floor(k / 3), "a", "").alias("body")
    )
    return results.normalise_sync(rows).select("event_id", "code_out", "status_out")


@_query("select e.batch_id, e.custom_id, case when ordinal = 6 then 'insert' when ordinal % 2 = 0 then 'conflict' else 'reuse' end as action from fx_entries e")
def record_actions(spark, sf):
    e = _entries(spark, sf)
    stored = e.filter("ordinal <> 6").select("batch_id", "custom_id", (c("result_bytes") + (c("ordinal") % 2 == 0).cast("long")).alias("result_bytes"))
    return lifecycle.upsert_identical(e.select("batch_id", "custom_id", "result_bytes"), stored, ["batch_id", "custom_id"], ["result_bytes"]).select("batch_id", "custom_id", "action")


@_query(
    f"with t as (select *, case when status in {TERMINAL} then 'done' when processor_id is null then 'queued' else 'active' end as phase from fx_items) "
    "select 'cancel' as counter, phase as status, case status when 'cancelled' then 'return' else case when status not in ('validating', 'in_progress', 'cancelling') then 'reject' when status = 'cancelling' then 'resend' when status = 'validating' and processor_id is null then 'cancelled' else 'cancelling' end end as action, count(*) as n from t group by 1, 2, 3 "
    f"union all select 'recovery', status, case when resumable then 'requeue' when recovery_attempts > 3 then 'failed' when status = 'validating' then 'requeue' when status in {TERMINAL} then 'clean_up' else 'failed' end, count(*) from t where processor_id is not null group by 1, 2, 3"
)
def recovery_counters(spark, sf):
    items = _items(spark, sf)
    phase = F.when(c("status").isin(*S.TERMINAL), "done").when(c("processor_id").isNull(), "queued").otherwise("active")
    cancels = items.select(F.lit("cancel").alias("counter"), lifecycle.cancel_route(c("status"), catalog.queued()).alias("action"), phase.alias("status"))
    recoveries = items.filter("processor_id is not null").select(F.lit("recovery").alias("counter"), lifecycle.startup_route(c("status"), c("resumable"), c("recovery_attempts")).alias("action"), "status")
    return metrics.counts(cancels.unionByName(recoveries), "counter", "status", "action")


@_query("select endpoint, round(avg(v), 6) as mean, min(v) as least, max(v) as most from (select endpoint, latency_s as v from fx_signals where event_id % 5 <> 0) group by endpoint")
def series_summaries(spark, sf):
    s = view(spark, sf, "signals").withColumn("v", F.when(c("event_id") % 10 == 0, float("nan")).when(c("event_id") % 10 == 5, None).otherwise(c("latency_s")))
    return analysis.series_summary(s, ["endpoint"], "v").withColumn("mean", F.round("mean", 6))


@_query("select user_id, min(sec) filter (event_id % 3 = 0) as completed_at from fx_signals group by user_id")
def completion_times(spark, sf):
    s = view(spark, sf, "signals").withColumn("status", F.when(c("event_id") % 3 == 0, "completed").otherwise("in_progress"))
    return analysis.completion_time(s, "user_id", "sec")


@_query("select scenario, count(*) as points, min(rate) as first_rate, arg_max(value, rate) as last_value from (select scenario, trial * 10 + scenario as rate, round(avg(ttft_p99), 6) as value from fx_phases group by 1, 2) group by scenario")
def rate_sweeps(spark, sf):
    p = view(spark, sf, "phases").groupBy("scenario", (c("trial") * 10 + c("scenario")).alias("rate")).agg(F.round(F.avg("ttft_p99"), 6).alias("value"))
    out = analysis.sweep(p, "value")
    return out.select("scenario", F.size("points").cast("long").alias("points"), F.get("points", F.lit(0))["rate"].alias("first_rate"), F.element_at("points", -1)["value"].alias("last_value"))


@_query("select endpoint, count(*) as n, 'second' as family from fx_signals where status_code = 500 group by endpoint union all select endpoint, count(*), 'first' from fx_signals where status_code = 200 group by endpoint")
def metric_families(spark, sf):
    s = view(spark, sf, "signals")
    of = lambda code: metrics.counts(s.filter(c("status_code") == code), "endpoint")
    missing = metrics.first_family(of(599), of(500)).withColumn("family", F.lit("second"))
    return missing.unionByName(metrics.first_family(of(200), of(500)).withColumn("family", F.lit("first")))


@_query(
    "with r as (select created_at // 2592000 * 2592000 as window_start, count(*) filter (status = 'expired') / greatest(cast(count(*) as double), 0.001) as ratio from fx_items group by 1) "
    "select window_start, round(ratio, 9) as ratio, min(case when ratio > 0.03 then 1 else 0 end) over (order by window_start rows between 1 preceding and current row) = 1 and count(*) over (order by window_start rows between 1 preceding and current row) > 1 as alert from r"
)
def alert_expired_ratio(spark, sf):
    month = (F.floor(c("created_at") / 2592000) * 2592000).cast("long")
    share = _items(spark, sf).groupBy(month.alias("window_start")).agg(metrics.ratio(F.count_if(c("status") == "expired"), F.count("*").cast("double")).alias("ratio"))
    return metrics.held_for(share, c("ratio") > 0.03, 1).withColumn("ratio", F.round("ratio", 9))


@_query("select job_id, id, event_type from (select *, row_number() over (partition by job_id order by id) as r from (select *, max(case when rejected then 1 else 0 end) over (partition by job_id order by id rows unbounded preceding) as stopped "
        f"from (select *, id % 13 = 0 as rejected from fx_fifo where expires_at > {NOW}))) where stopped = 0")  # fmt: skip
def delivered_events(spark, sf):
    return catalog.deliver_events(view(spark, sf, "fifo"), NOW, c("id") % 13 == 0).select("job_id", "id", "event_type")


@_query(
    "with recursive s as (select cast(floor(sec / 86400) as bigint) as pool, user_id % 8 + 1 as e, cast(sec as double) as a, latency_s * 90000 as d, event_id from fx_signals), "
    "o as (select *, row_number() over (partition by pool order by event_id) as r, count(*) over (partition by pool) as last from s), "
    "f as (select distinct pool, cast(0 as bigint) as r, last, [[0.0::double, 0.0::double] for i in range(8)] as ends, [0.0::double, 0.0::double, 0.0::double] as free, 0.0::double as waited, 0.0::double as done from o "
    "union all select f.pool, o.r, f.last, [case when i = o.e then list_sort([f.ends[i][2], x.t + o.d]) else f.ends[i] end for i in range(1, 9)], list_sort([f.free[2], f.free[3], x.t + o.d]), f.waited + x.t - o.a, greatest(f.done, x.t + o.d) "
    "from f join o on o.pool = f.pool and o.r = f.r + 1, lateral (select greatest(f.ends[o.e][1], f.free[1], o.a) as t) x) "
    "select pool, last as requests, round(waited, 3) as waited, round(done, 3) as finished from f where r = last"
)
def two_level_schedule(spark, sf):
    s = view(spark, sf, "signals").withColumns({"pool": F.floor(c("sec") / 86400).cast("long"), "e": (c("user_id") % 8).cast("int"), "d": c("latency_s") * 90000})
    out = analysis.two_level_schedule(s, "pool", "e", 8, "sec", "d", "event_id", 2, 3)
    return out.withColumn("waited", F.round("waited", 3)).withColumn("finished", F.round("finished", 3))


_QUEUE = f"q as (select event_id as seq, case when event_id % 3 = 0 then {NOW} + (event_id % 5 - 2) * 100 end as lease_until from fx_signals)"


def _queue(spark, sf):
    return view(spark, sf, "signals").select(c("event_id").alias("seq"), F.when(c("event_id") % 3 == 0, NOW + (c("event_id") % 5 - 2) * 100).alias("lease_until"))


_FREE = f"r as (select seq from q where lease_until is null or lease_until <= {NOW} order by seq limit 100)"


@_query(f"with {_QUEUE}, {_FREE} select q.seq, case when r.seq is not null then {NOW} + 300 else q.lease_until end as lease_until from q left join r on q.seq = r.seq where q.seq % 7 <> 0 or r.seq is null")
def leased_receive(spark, sf):
    received, after = deliveries.receive(_queue(spark, sf), 100, NOW, S.LEASE_S)
    return deliveries.acknowledge(after, received.filter("seq % 7 = 0"))


@_query(f"with {_QUEUE}, {_FREE} select q.* from q where seq not in (select seq from r)")
def destructive_receive(spark, sf):
    return deliveries.receive(_queue(spark, sf), 100, NOW)[1]


@_query(
    "select batch_id, action, count(*) as n from (select d.batch_id, case when d.batch_id in (select id from fx_items where processor_id is not null) then 'deliver' "
    "when d.batch_id in (select batch_id from fx_entries where status in ('pending', 'in_flight')) then 'hold' else 'ack' end as action from fx_deliveries d) group by 1, 2"
)
def delivery_actions(spark, sf):
    live = _items(spark, sf).filter("processor_id is not null").select(c("id").alias("batch_id"))
    return metrics.counts(deliveries.route_deliveries(view(spark, sf, "deliveries").select("batch_id", "custom_id"), live, results.open_batches(_entries(spark, sf))), "batch_id", "action")


_COMMITS = "d as (select batch_id as run, custom_id, ordinal * 10000 + arrival as seq, ordinal % 4 <> 3 as owned, case when p % 17 = 0 then 'conflict' when p % 19 = 0 then 'error' when arrival > 1 then 'duplicate' else 'ok' end as outcome from fx_deliveries)"


def _commits(spark, sf):
    outcome = F.when(c("p") % 17 == 0, "conflict").when(c("p") % 19 == 0, "error").when(c("arrival") > 1, "duplicate").otherwise("ok")
    return view(spark, sf, "deliveries").select(c("batch_id").alias("run"), "custom_id", (c("ordinal") * 10000 + c("arrival")).alias("seq"), (c("ordinal") % 4 != 3).alias("owned"), outcome.alias("outcome"))


@_query(
    f"with {_COMMITS}, f as (select run, min(seq) as at, arg_min(outcome, seq) as error from d where owned and outcome in ('conflict', 'error') group by run) "
    "select d.run, d.seq, d.owned and (f.at is null or d.seq < f.at) as acked, case when d.owned and d.seq >= f.at then f.error end as error from d left join f on d.run = f.run"
)
def drained_commits(spark, sf):
    return deliveries.drain(_commits(spark, sf), "run").select("run", "seq", "acked", "error")


@_query(
    f"with {_COMMITS}, f as (select run, min(seq) as at, arg_min(outcome, seq) as error from d where owned and outcome in ('conflict', 'error') group by run) "
    "select d.run, max(f.error) as error, count(*) filter (d.owned and (f.at is null or d.seq < f.at)) as acked from d left join f on d.run = f.run group by d.run"
)
def run_errors(spark, sf):
    return deliveries.run_error(_commits(spark, sf), "run")
