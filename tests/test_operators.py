import hashlib
import json

import pytest
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.operators import analysis, catalog, deliveries, folds, ingest, lifecycle, metrics, mutations, results
from batchloom.plans import job
from batchloom.sources import jsonl, lines

CHAT = "/v1/chat/completions"


def line(**over):
    doc = {"custom_id": "a", "method": "POST", "url": CHAT, "body": {"model": "m", "messages": [{"role": "user", "content": "hi"}]}}
    body = over.pop("body", {})
    doc["body"] |= body
    return json.dumps(doc | over)


CASES = [
    (line(), None), ("{", "invalid json"), ("", "invalid json"), (line(custom_id=""), "custom_id is required"), (line(method=""), "method is required"), (line(method="GET"), "invalid method"),
    (line(url=""), "url is required"), (line(url="http://x/v1"), "url must be relative"), (line(url="//x"), "url must be relative"), (line(url="/v2"), "invalid endpoint"),
    (line(url="/v1/embeddings"), "endpoint mismatch"), (line(body={"model": ""}), "model is empty"), (line(body={"stream": True}), "streaming is not supported"), (line(body={"stream": False}), None),
    (line(body={"messages": [{"role": "system", "content": 5}]}), "system content"), (line(body={"messages": [{"role": "user", "content": 5}]}), None),
    (line(body={"messages": [{"role": "system", "content": "x"}, {"role": "system", "content": 5}]}), None),
    (line(custom_id="", method="GET"), "custom_id is required"),
]


def test_validation_order(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, line string")
    got = ingest.parse_lines(df).select("i", ingest.reject_reason(CHAT, parsed=F.col("parsed"), system_ok=F.col("system_ok")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("content,want", [('"x"', "x"), ("null", ""), (None, ""), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]', "ab"), ("5", None), ('{"a":1}', None), ('"a\\"b"', 'a"b')])
def test_message_text(spark, content, want):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(ingest.message_text(F.col("c")).alias("x")).first()["x"] == want


def test_system_prompt_is_the_first_with_text(spark):
    m = [{"role": "system", "content": ""}, {"role": "system", "content": [{"type": "text", "text": "P"}]}, {"role": "system", "content": "Q"}]
    df = spark.createDataFrame([(line(body={"messages": m}),)], "line string")
    assert ingest.parse_lines(df).first()["system_text"] == "P"


def test_safe_names_reserve_numbers(spark):
    rows = [("a/b", 1), ("a_b_2", 2), ("a:b", 3), ("a?b", 4), ("", 5)]
    got = {r["model"]: r["safe_name"] for r in ingest.safe_names(spark.createDataFrame(rows, "model string, first_seen int")).collect()}
    assert got == {"a/b": "a_b", "a_b_2": "a_b_2", "a:b": "a_b_3", "a?b": "a_b_4", "": "unknown"}


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\r\ntwo\n\nfour")
    (tmp_path / "b.jsonl").write_bytes(b"x\n")
    (tmp_path / "c.jsonl").write_bytes(b"")
    got = [(r["path"][-7:], r["ordinal"], r["line"]) for r in lines.read_lines(spark, str(tmp_path)).orderBy("path", "ordinal").collect()]
    assert got == [("a.jsonl", 0, "one\r"), ("a.jsonl", 1, "two"), ("a.jsonl", 2, ""), ("a.jsonl", 3, "four"), ("b.jsonl", 0, "x")]
    limits = {r["path"][-7:]: r["within"] for r in lines.line_limits(lines.read_lines(spark, str(tmp_path)), 100, 3).collect()}
    assert limits == {"a.jsonl": False, "b.jsonl": True}


def test_plan_file(spark, tmp_path):
    entries = [(0, 10, 7), (10, 2**31, S.NO_PREFIX), (2**40, 1, 0)]
    (tmp_path / "m.plan").write_bytes(jsonl.pack_plan(entries))
    got = [tuple(r)[2:] for r in jsonl.read_plan(spark, str(tmp_path / "m.plan")).orderBy("position").collect()]
    assert got == entries
    (tmp_path / "bad.plan").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple of 16"):
        jsonl.read_plan(spark, str(tmp_path / "bad.plan")).collect()


def test_model_map_and_load_test(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"model_to_safe": {"a/b": "a_b"}, "safe_to_model": {"a_b": "a/b"}, "line_count": 3, "rejected_count": 1}, indent=1))
    assert jsonl.read_model_map(spark, str(tmp_path / "m.json")).first()["model_to_safe"] == {"a/b": "a_b"}
    assert jsonl.load_test_row("Latency,,Errors\nmean,p99,rate\nms,ms,\n1,2,0.5") == {"Latency mean ms": "1", "Latency p99 ms": "2", "Errors rate": "0.5"}


@pytest.mark.parametrize("kind", ["fixed", "normal", "lognormal", "uniform"])
def test_synthetic(spark, kind):
    df = jsonl.synthetic_requests(spark, 2000, 1500, 1200, 10, 4096, 4, kind)
    r = df.agg(F.min("tokens"), F.max("tokens"), F.avg("tokens"), F.countDistinct("system")).first()
    assert 10 <= r[0] <= r[1] <= 4096 and r[3] == 4
    if kind in ("fixed", "lognormal"):
        assert abs(r[2] - 1500) < 200


@pytest.mark.parametrize("value,limit,want", [(None, None, (0, None, 20)), ("40", 10, (40, None, 10)), ("batch_x", 100, (0, "batch_x", 100))])
def test_cursor(value, limit, want):
    assert catalog.cursor(value, "batch_", limit, 100) == want


@pytest.mark.parametrize("value,limit", [("zzz", 5), (None, 0), (None, 101)])
def test_bad_cursor(value, limit):
    with pytest.raises(ValueError):
        catalog.cursor(value, "batch_", limit, 100)


def test_create_rules(spark):
    good = dict(completion_window="24h", endpoint=CHAT, input_file_id="f", metadata={"k": "v"}, expires_anchor=None, expires_seconds=None)
    cases = [
        (good, None), (good | {"completion_window": ""}, "completion_window is required"), (good | {"completion_window": "1d"}, "completion_window must be a valid duration"),
        (good | {"endpoint": ""}, "endpoint is required"), (good | {"endpoint": "/x"}, "invalid endpoint"), (good | {"input_file_id": ""}, "input_file_id is required"),
        (good | {"metadata": {str(i): "" for i in range(17)}}, "metadata: too many keys"), (good | {"metadata": {"k" * 65: ""}}, "metadata: key too long"),
        (good | {"metadata": {"k": "v" * 513}}, "metadata: value too long"), (good | {"metadata": None}, None), (good | {"expires_anchor": "x"}, "output_expires_after.anchor must be 'created_at'"),
        (good | {"expires_anchor": "created_at", "expires_seconds": 3599}, "output_expires_after.seconds out of range"), (good | {"expires_anchor": "created_at", "expires_seconds": 3600}, None),
    ]
    schema = "completion_window string, endpoint string, input_file_id string, metadata map<string,string>, expires_anchor string, expires_seconds long, i int"
    df = spark.createDataFrame([tuple(c.values()) + (i,) for i, (c, _) in enumerate(cases)], schema)
    assert {r["i"]: r["problem"] for r in catalog.validate_create(df).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_upload_rules(spark):
    rows = [
        (10, "batch", None, None, None), (S.MAX_FILE_BYTES + 1, "batch", None, None, "file too large"), (1, "", None, None, "purpose is required"), (1, "x", None, None, "invalid purpose"),
        (1, "batch", "created_at", None, "anchor and seconds go together"), (1, "batch", "y", "3600", "invalid anchor"), (1, "batch", "created_at", "abc", "seconds must be an integer"),
        (1, "batch", "created_at", "1", "seconds out of range"), (1, "batch", "created_at", "3600", None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, bytes long, purpose string, expires_anchor string, expires_seconds string")
    assert {r["i"]: r["problem"] for r in catalog.validate_upload(df).collect()} == {i: r[4] for i, r in enumerate(rows)}


def test_events_at_the_boundary(spark):
    ev = spark.createDataFrame([(1, 9), (2, 10), (3, 11)], "id long, expires_at long")
    assert [r["id"] for r in catalog.events_due(ev, 10, 5).collect()] == [3]
    assert [r["id"] for r in catalog.purge_events(ev, 10).collect()] == [1]


def test_tags(spark):
    df = spark.createDataFrame([({"pth:a": "1", "otel:t": "2", "x": "3"},)], "tags map<string,string>")
    assert df.select(catalog.split_tags(F.col("tags"), "pth:").alias("t")).first()["t"] == {"a": "1"}


def test_headers(spark):
    df = spark.createDataFrame([({"k": "v"}, 100, 40, "", "t1"), ({"x-gateway-inference-fairness-id": "own"}, 10, 40, "fast", "t1")], "h map<string,string>, d long, n long, o string, t string")
    got = [r["x"] for r in df.select(ingest.request_headers(F.col("h"), F.col("d"), F.col("n"), F.col("o"), F.col("t")).alias("x")).collect()]
    assert got == [{"k": "v", "x-slo-ttft-ms": "60", "x-gateway-inference-fairness-id": "t1"}, {"x-gateway-inference-fairness-id": "own", "x-gateway-inference-objective": "fast"}]


def test_async_results(spark):
    rows = [
        (0, "boom", "", "", (None, "boom")), (0, "", "gone", "", (None, "server_error")), (0, "", "", '{"a":1}', (200, None)), (200, "", "", "", (None, "server_error")),
        (403, "", "", "", (403, None)), (200, "", "", "nope", (None, "parse_error")), (500, "", "", "nope", (500, None)), (201, "", "", '{"a":1}', (201, None)),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, status_code int, error_code string, error_message string, body string")
    got = {r["i"]: (r["status_out"], r["code_out"]) for r in results.normalise_async(df).collect()}
    assert got == {i: r[4] for i, r in enumerate(rows)}


def test_sync_results(spark):
    rows = [(0, "RATE_LIMIT", None, None, (None, "RATE_LIMIT")), (429, "RATE_LIMIT", "rejected-ttl-expired", None, (None, "batch_expired")), (500, "SERVER_ERROR", None, "x", (500, None)), (200, None, None, "x", (None, "PARSE_ERROR")), (200, None, None, "{}", (200, None))]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, status_code int, category string, dropped_reason string, body string")
    assert {r["i"]: (r["status_out"], r["code_out"]) for r in results.normalise_sync(df).collect()} == {i: r[4] for i, r in enumerate(rows)}


def test_object_keys(spark):
    df = spark.createDataFrame([("b", "r", "aa" * 32, 1), ("b", "r", "aa" * 32, 2), ("b", "r", "bb" * 32, 3)], "batch_id string, request_id string, sha256 string, arrival long")
    keys = {r["sha256"][:2]: (r["key"], r["deliveries"]) for r in results.object_keys(df).collect()}
    assert keys == {"aa": ("results/b/r.jsonl", 2), "bb": ("results/b/r-" + "b" * 16 + ".jsonl", 1)}


def test_enrich(spark):
    r = spark.createDataFrame([("1", None, None, None), ("2", "own", "m", 5), ("3", None, None, None)], "request_id string, custom_id string, model string, submitted_at long")
    p = spark.createDataFrame([("1", "a", "m1", 1), ("2", "b", "m2", 2)], "request_id string, custom_id string, model string, submitted_at long")
    assert sorted(tuple(x) for x in results.enrich(r, p).collect()) == [("1", "a", "m1", 1), ("2", "own", "m", 5)]


def test_checked_results(spark):
    e = spark.createDataFrame([("k1", 3, "x"), ("k2", 3, "x"), ("k3", 3, "x")], "result_key string, result_bytes long, result_sha256 string")
    o = spark.createDataFrame([("k1", 3, "x"), ("k2", 4, "x")], "result_key string, bytes long, sha256 string")
    assert {r["result_key"]: r["intact"] for r in results.checked_results(e, o).collect()} == {"k1": True, "k2": False, "k3": False}


ITEM = "id string, status string, processor_id string, resumable boolean, lease_at long, priority long, epoch long, recovery_attempts long, expiry long, tenant_id string"


def test_triage(spark):
    now = 1000
    rows = [
        ("dead", "in_progress", "gone", False, None, 10**12, "requeue"), ("late", "in_progress", "gone", False, None, 5, "failed"), ("cancel", "cancelling", "gone", False, None, 5, "cancelled"),
        ("alive", "in_progress", "p", False, None, 5, None), ("held", "in_progress", "p", True, 1001, 5, None), ("lapsed", "in_progress", "p", True, 1000, 5, "requeue"),
        ("r-dead", "cancelling", "gone", True, 5000, 5, "requeue"), ("nodl", "validating", "gone", False, None, 0, "error"), ("done", "completed", "gone", False, None, 5, None), ("free", "validating", None, False, None, 5, None),
    ]
    df = spark.createDataFrame([(*r[:6], 0, 0, 0, "t") for r in rows], ITEM)
    live = spark.createDataFrame([("p",)], "processor_id string")
    assert {r["id"]: r["action"] for r in lifecycle.triage(df, live, now).collect()} == {r[0]: r[6] for r in rows if r[6]}


def test_fold(spark):
    log = [
        ("b", 1, "validating", None, "in_progress", "p1", True), ("b", 2, "validating", None, "in_progress", "p2", True), ("b", 3, "in_progress", 0, "failed", None, False),
        ("b", 4, "in_progress", 1, "finalizing", None, False), ("b", 5, "finalizing", None, "completed", None, False), ("b", 6, "completed", None, "validating", None, True),
    ]
    df = spark.createDataFrame(log, S.TRANSITION)
    assert tuple(lifecycle.fold(df).first()) == ("b", "completed", 1, "p1", 3, 3)


def test_status_document(spark):
    doc = "struct<status:string, in_progress_at:long, completed_at:long, failed_at:long, cancelled_at:long, expired_at:long, finalizing_at:long, cancelling_at:long, expires_at:long>"
    df = spark.createDataFrame([(("validating", None, None, None, None, None, None, None, 50),)], f"d {doc}")
    got = df.select(lifecycle.with_status(F.col("d"), F.lit("in_progress"), F.lit(7).cast("long"), F.lit(99).cast("long")).alias("d")).first()["d"]
    assert (got["status"], got["in_progress_at"], got["expires_at"]) == ("in_progress", 7, 50)


def test_upsert(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, bytes long")
    old = spark.createDataFrame([("a", 1), ("b", 9)], "id string, bytes long")
    assert {r["id"]: r["action"] for r in lifecycle.upsert_identical(new, old, ["id"], ["bytes"]).collect()} == {"a": "reuse", "b": "conflict", "c": "insert"}


def test_migrate(spark):
    item = "id string, status string, processor_id string, resumable boolean, priority long, tags map<string,string>"
    tag = {"slo_unix_micro": "77"}
    rows = [("old", "in_progress", None, False, None, tag), ("zero", "completed", "p", False, 0, tag), ("waits", "in_progress", None, True, 5, {}), ("fresh", "validating", None, False, None, {})]
    got = {r["id"]: (r["processor_id"], r["priority"]) for r in lifecycle.migrate_priority(spark.createDataFrame(rows, item)).collect()}
    assert got == {"old": (S.BEFORE_QUEUE, 77), "zero": ("p", 0), "waits": (None, 5), "fresh": (None, None)}


CATALOGUE = "id string, status string, status_document string, processor_id string, epoch long, resumable boolean, lease_at long, recovery_attempts long"
ENTRY = "batch_id string, custom_id string, status string, attempts long, submitted_by string, error_code string, result_bytes long"


def stored(spark, status="in_progress", owner="p", epoch=3, resumable=True, lease=1100):
    return spark.createDataFrame([("b", status, '{"status":"%s"}' % status, owner, epoch, resumable, lease, 2)], CATALOGUE)


def claims(spark, owner="p", epoch=3, **more):
    return spark.createDataFrame([("b", owner, epoch)], "id string, owner string, at_epoch long").withColumns({k: F.lit(v) for k, v in more.items()})


def test_enqueue_fence(spark):
    job = claims(spark, expected_status="in_progress")
    got = mutations.enqueue(stored(spark, resumable=False), job).first()
    assert (got["status"], got["processor_id"], got["epoch"]) == ("validating", None, 4)
    for state in (dict(), dict(resumable=False, epoch=4), dict(resumable=False, owner="q"), dict(resumable=False, status="finalizing"), dict(resumable=False, status="completed")):
        assert mutations.enqueue(stored(spark, **state), job).count() == 0


def test_requeue_orphan(spark):
    out = mutations.requeue_orphans(stored(spark), claims(spark, need_lapsed=False), 1000)
    got = out.first()
    assert (got["status"], got["processor_id"], got["lease_at"], got["epoch"], got["recovery_attempts"]) == ("in_progress", None, None, 4, 3)
    assert mutations.requeue_orphans(stored(spark), claims(spark, need_lapsed=False), 1000, count_attempt=False).first()["recovery_attempts"] == 2
    for lease, lapsed in ((1001, 0), (1000, 1), (None, 0)):
        assert mutations.requeue_orphans(stored(spark, lease=lease), claims(spark, need_lapsed=True), 1000).count() == lapsed
    # The old owner's next write is stale, and a second requeue too.
    assert mutations.requeue_orphans(out.drop("old_owner"), claims(spark, need_lapsed=False), 1000).count() == 0
    entries = spark.createDataFrame([("b", "1", "in_flight", 1, None, None, 0), ("b", "2", "in_flight", 1, "q", None, 0), ("b", "3", "pending", 0, None, None, 0)], ENTRY)
    assert {r["custom_id"]: r["submitted_by"] for r in mutations.record_submitters(entries, out).collect()} == {"1": "p", "2": "q", "3": None}


def test_claim(spark):
    fresh, again = stored(spark, "validating", None, resumable=False, lease=None), stored(spark, "in_progress", None).withColumn("id", F.lit("r"))
    got = {r["id"]: r for r in mutations.claim(fresh.unionByName(again), fresh.unionByName(again), "q", 1000, 60).collect()}
    assert (got["b"]["epoch"], got["b"]["recovery_attempts"], got["b"]["lease_at"]) == (4, 0, None)
    assert (got["r"]["epoch"], got["r"]["recovery_attempts"], got["r"]["lease_at"]) == (4, 2, 1060)


def test_cancel_if_queued(spark):
    hit = mutations.cancel_if_queued(stored(spark, "validating", None, resumable=False), claims(spark), 7).first()
    assert (hit["status"], hit["cancelled_at"], hit["epoch"]) == ("cancelled", 7, 4)
    for state in (dict(owner="p", resumable=False), dict(owner=None, resumable=True)):
        assert mutations.cancel_if_queued(stored(spark, "validating", **state), claims(spark), 7).count() == 0


def test_activate(spark):
    manifest = spark.createDataFrame([("b", 1, "x", "pending", None), ("b", 2, "y", "failed", "parse_error")], "batch_id string, ordinal long, custom_id string, status string, error_code string")
    none, claim = spark.createDataFrame([], ENTRY), claims(spark).withColumnRenamed("id", "batch_id")
    new, item = lifecycle.activate(stored(spark, "validating", resumable=False, lease=None), none, manifest, claim, 1000, 60)
    no = (None,) * 4  # this manifest has no request ids and no metadata
    assert sorted(map(tuple, new.collect())) == [("b", 1, "x", "pending", 0, None, None, *no), ("b", 2, "y", "failed", 0, "parse_error", 1000, *no)]
    got = item.first()
    assert (got["status"], got["resumable"], got["lease_at"], got["in_progress_at"], got["epoch"]) == ("in_progress", True, 1060, 1000, 3)
    for state in (dict(epoch=4), dict(owner="q"), dict(resumable=True)):
        new, item = lifecycle.activate(stored(spark, "validating", **{"resumable": False, **state}), none, manifest, claim, 1000)
        assert (new.count(), item.count()) == (0, 0)
    new, item = lifecycle.activate(stored(spark, "validating", resumable=False), none, manifest.limit(0), claim, 1000)
    assert (new.count(), item.count()) == (0, 0)


def test_finalize(spark):
    doc = '{"status": "completed"}'
    target = claims(spark, expected_status="in_progress", document=doc)
    got = mutations.finalize(stored(spark), target, 1000).first()
    assert (got["verdict"], got["status_document"], got["resumable"], got["lease_at"], got["processor_id"]) == ("applied", doc, False, None, "p")
    assert mutations.finalize(stored(spark, "completed", resumable=False, lease=None), target, 1000).first()["verdict"] == "same"
    for state in (dict(lease=1000), dict(epoch=4), dict(owner="q"), dict(status="cancelling"), dict(resumable=False)):
        assert mutations.finalize(stored(spark, **state), target, 1000).first()["verdict"] == "conflict"
    assert mutations.finalize(stored(spark).limit(0), target, 1000).first()["verdict"] == "conflict"


def test_entry_writes(spark):
    entries = spark.createDataFrame([("b", "1", "pending", 0, None, None, None), ("b", "2", "completed", 1, "p", None, 9)], ENTRY)
    sent = spark.createDataFrame([("b", i, "p", 3) for i in ("1", "2", "gone")], "batch_id string, custom_id string, owner string, at_epoch long")
    verdicts = lambda **state: {r["custom_id"]: r["verdict"] for r in mutations.entry_writes(entries, stored(spark, **state), sent, 1000).collect()}
    assert verdicts() == {"1": "updated", "2": "duplicate", "gone": "conflict"}
    assert verdicts(lease=1000) == {"1": "conflict", "2": "duplicate", "gone": "conflict"}
    assert verdicts(epoch=4) == {"1": "conflict", "2": "conflict", "gone": "conflict"}
    marked = {r["custom_id"]: (r["status"], r["attempts"], r["submitted_by"]) for r in mutations.mark_in_flight(entries, stored(spark), sent, 1000).collect()}
    assert marked == {"1": ("in_flight", 1, "p"), "2": ("completed", 1, "p")}
    results_in = sent.crossJoin(spark.createDataFrame([(2, "failed", "", 0, "late"), (1, "completed", "k", 5, ""), (0, "pending", "n", 5, "")], "arrival int, result_status string, key string, bytes long, code string"))
    done = {r["custom_id"]: r for r in mutations.checkpoint_results(entries, stored(spark), results_in, 1000).collect()}
    assert tuple(done["1"][k] for k in ("status", "result_key", "result_bytes", "error_code", "completed_at")) == ("completed", "k", 5, None, 1000)
    assert (done["2"]["status"], done["2"]["result_bytes"], done["2"]["completed_at"]) == ("completed", 9, None)


def test_deliver_events(spark):
    df = spark.createDataFrame([(1, "a", 9, False), (2, "a", 9, True), (3, "a", 9, False), (4, "b", 5, False), (5, "b", 9, False)], "id long, job_id string, expires_at long, full boolean")
    assert sorted(r["id"] for r in catalog.deliver_events(df, 5, F.col("full")).collect()) == [1, 5]


def test_lines_carry_the_body(spark):
    df = spark.createDataFrame([("b", 0, "r", 'a"b', 200, None, '{"z":[1, 2],"a":null}'), ("b", 1, "s", "c", 200, None, ""), ("b", 2, "t", "d", None, "batch_expired", "x")], "batch_id string, ordinal long, request_id string, custom_id string, status_code int, error_code string, body string")
    got = [json.loads(r["line"]) for r in results.result_lines(df).orderBy("ordinal").collect()]
    assert got[0] == {"id": "r", "custom_id": 'a"b', "response": {"status_code": 200, "request_id": "r", "body": {"z": [1, 2], "a": None}}, "error": None}
    assert got[1]["response"]["body"] is None
    assert got[2]["response"] is None and got[2]["error"] == {"code": "batch_expired", "message": S.NOT_EXECUTED["batch_expired"]}


@pytest.mark.parametrize("cause,resumable,want", [("cancelled", True, "cancelled"), ("expired", False, "expired"), ("shutdown", True, "leave"), (None, False, "failed")])
def test_abort(spark, cause, resumable, want):
    df = spark.createDataFrame([(cause, resumable)], "c string, r boolean")
    assert df.select(lifecycle.abort_route(F.col("c"), F.col("r")).alias("x")).first()["x"] == want


def aimd(spark, signals, **kw):
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(signals)], "endpoint string, seq long, signal int")
    return metrics.aimd(df, "endpoint", "seq", "signal", **kw).first()["limit"]


@pytest.mark.parametrize("signals,kw,want", [
    ([1] * 10, dict(start=10, least=5, most=100), 11), ([1] * 10 + [-1], dict(start=10, least=5, most=100), 5), ([1] * 10 + [-1] + [1] * 5, dict(start=10, least=5, most=100), 6),
    ([0] * 50, dict(start=10, least=5, most=100), 10), ([-1] * 9, dict(start=10, least=5, most=100), 5), ([], dict(), None), ([1], dict(start=200, least=5, most=100), 100), ([0], dict(start=1, least=5, most=100), 5),
    ([-1], dict(start=10, least=1, most=100, factor=0.75), 7),
])
def test_aimd(spark, signals, kw, want):
    if signals:
        assert aimd(spark, signals, **kw) == want


def test_aimd_signal(spark):
    rows = [(200, False, True, 1), (429, False, True, -1), (503, False, True, -1), (404, False, True, 1), (200, True, True, -1), (None, False, False, 0)]
    df = spark.createDataFrame(rows, "s int, r boolean, h boolean, w int")
    assert all(r["g"] == r["w"] for r in df.select("w", metrics.aimd_signal(F.col("s"), F.col("r"), F.col("h")).alias("g")).collect())


def test_quantile_edges(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (float("inf"), 10)], "le double, n long")
    assert metrics.histogram_quantile(0.5, df).first()["value"] == 1.0
    assert metrics.histogram_quantile(0.25, df).first()["value"] == 0.5
    assert metrics.histogram_quantile(0.95, df).first()["value"] == 2.0


def test_first_family(spark):
    a, b, none = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,)], "v int"), spark.createDataFrame([], "v int")
    assert [r["v"] for r in metrics.first_family(a, b).collect()] == [1]
    assert [r["v"] for r in metrics.first_family(none, b).collect()] == [2]


def test_counter_reset(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 15.0), ("s", 3, 4.0)], "k string, at long, value double")
    assert [r["delta"] for r in metrics.growth(df, ["k"]).orderBy("at").collect()] == [0.0, 5.0, 4.0]


def test_growth_of_tied_times_is_the_same_in_any_partitioning(spark):
    rows = [("k", 10, 1, 5.0), ("k", 10, 2, 8.0), ("k", 10, 0, 2.0), ("k", 30, 3, 9.0), ("k", 30, 4, 1.0)]
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "k string, at long, seq long, value double").repartition(n, "value")
        got = {r["seq"]: r["delta"] for r in metrics.growth(df, ["k"], ties=["seq"], span=20).collect()}
        assert got == {0: 0.0, 1: 3.0, 2: 3.0, 3: 1.0, 4: 1.0}
        untold = metrics.growth(df.drop("seq"), ["k"]).agg(F.sum("delta")).first()[0]
        assert untold == 6.0 + 1.0 + 8.0  # by value: 2, 5, 8 and, after a reset, 1, 9


def test_range_vectors(spark):
    rows = [("a", t, v) for t, v in [(1, 1.0), (16, 4.0), (44, 2.0), (300, 3.0), (301, 7.0)]] + [("b", 30, 1.0)]
    grown = metrics.growth(spark.createDataFrame(rows, "k string, at long, value double"), ["k"])
    got = {(r["k"], r["step"]): (r["samples"], r["increase"]) for r in metrics.range_growth(grown, ["k"], 60, 15).collect()}
    want = {}
    for k in "ab":
        for step in range(0, 400, 15):
            inside = [(t, v) for q, t, v in rows if q == k and step - 60 < t <= step]
            if len(inside) > 1:
                want[k, step] = (len(inside), sum(v if v < u else v - u for (_, u), (_, v) in zip(inside, inside[1:])))
    assert got == want and len(want) > 5
    with pytest.raises(ValueError):
        metrics.range_growth(grown, ["k"], 50, 15)


def test_growth_goes_on_between_spans(spark):
    rows = [("s", t, float(v)) for t, v in ((0, 3), (5, 4), (11, 9), (31, 2), (39, 2), (40, 8))]
    df = spark.createDataFrame(rows, "k string, at long, value double")
    want = [0.0, 1.0, 5.0, 2.0, 0.0, 6.0]
    assert all([r["delta"] for r in metrics.growth(df, ["k"], span=s).orderBy("at").collect()] == want for s in (1, 10, 1000))


def test_deciles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {0: [5.0], 1: rng.normal(0, 3, 1000).round(1).tolist(), 2: (-rng.exponential(5, 77)).tolist(), 3: [0.0] * 50 + [1e-9, 7.0], 4: rng.uniform(1e6, 1e9, 333).tolist()}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(1, None), (9, None)], "k int, x double")
    got = {r["k"]: r["deciles"] for r in analysis.deciles_of(df, ["k"], "x").collect()}
    assert set(got) == set(groups)
    assert all(np.allclose(got[k], np.percentile(v, range(0, 101, 10)), rtol=1e-12, atol=1e-12) for k, v in groups.items())


def test_folds_hold_one_state(spark):
    from pyspark.sql import types as T

    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    out = folds.fold_sorted(df, ["k"], ["o"], lambda: [], lambda s, r: [r["o"], *s[:1]], lambda s: {"last": s[0], "before": s[1]}, "last long, before long")
    assert out.schema["k"].dataType == T.LongType()
    assert sorted(map(tuple, out.collect())) == [(0, 4998, 4995), (1, 4999, 4996), (2, 4997, 4994)]
    plan = metrics.aimd(df.withColumn("signal", F.lit(1)), "k", "o", "signal")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_analysis(spark):
    s = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0)], "k int, v double")
    assert tuple(analysis.series_summary(s, ["k"], "v").first()) == (1, 2.0, 1.0, 3.0)
    seen = spark.createDataFrame([("j", 5, "in_progress"), ("j", 9, "completed"), ("j", 12, "completed"), ("q", 1, "failed")], "job string, at long, status string")
    assert {r["job"]: r["completed_at"] for r in analysis.completion_time(seen, "job", "at").collect()} == {"j": 9, "q": None}
    probes = spark.createDataFrame([(1, 10.0, 0.0, 5), (5, 20.0, 0.0, 5), (10, 31.0, 0.0, 5)], "rate int, ttft_p99 double, error_rate double, completed long")
    assert analysis.saturation(probes).first()["rate"] == 5
    points = analysis.sweep(probes.withColumn("scenario", F.lit(1)), "ttft_p99").first()["points"]
    assert [p["rate"] for p in points] == [1, 5, 10]
    steps = spark.createDataFrame([("m", 1, 1.0), ("m", 14, 2.0), ("m", 15, 3.0)], "metric string, at long, value double")
    assert sorted(tuple(r) for r in analysis.metric_steps(steps).collect()) == [("m", 0, 2.0), ("m", 15, 3.0)]


def job_lines(spark):
    rows = [("b1", i, line(custom_id=f"r{i}", body={"model": f"m{i % 3}"})) for i in range(30)] + [("b2", 0, line()), ("b2", 1, line())] + [("b3", 0, line(method="GET"))]
    return spark.createDataFrame(rows, "batch_id string, ordinal long, line string")


def test_job_invariants(spark, tmp_path):
    answers = {"r3": (500, None, "{}"), "r4": (None, "server_error", "")}
    registry = spark.createDataFrame([("m0",), ("m1",)], "model string")
    done = job.run(job_lines(spark), CHAT, job.lookup_executor(answers), registry).cache()
    counts = results.finalize_counts(done.withColumn("result_bytes", F.lit(1).cast("long"))).collect()
    assert [r["batch_id"] for r in counts] == ["b1"]  # a repeated id and a bad line fail their batches
    r = counts[0]
    assert (r["total"], r["completed"] + r["failed"], r["output_lines"] + r["error_lines"]) == (30, 30, 30)
    assert (r["completed"], r["error_lines"]) == (18, 11)
    lines = results.result_lines(done)
    results.write_artifacts(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).count()
    assert back == 30
    assert [x["custom_id"] for x in map(json.loads, (row["line"] for row in lines.filter("route = 'output'").orderBy("ordinal").collect()))] == [f"r{i}" for i in range(30) if i % 3 != 2 and i != 4]
    # A second run with all results in place dispatches nothing and gives the same artifacts.
    stored = done.withColumn("status", F.when(F.col("error_code").isNull() & F.col("status_code").between(200, 299), "completed").otherwise("failed")).withColumn("attempts", F.lit(1))
    again = job.run(job_lines(spark), CHAT, lambda rows: 1 / 0 if rows else [], registry, stored)
    assert sorted(map(tuple, results.artifacts(results.result_lines(again)).collect())) == sorted(map(tuple, results.artifacts(lines).collect()))


def test_writes(spark):
    table = spark.createDataFrame([("a", 1)], "id string, v long")
    assert mutations.insert(table, spark.createDataFrame([(2, "b")], "v long, id string")).count() == 2
    with pytest.raises(ValueError, match="v"):
        mutations.insert(table, spark.createDataFrame([("b",)], "id string"))
    pods = spark.createDataFrame([("p", True), ("q", False)], "processor_id string, ready boolean")
    assert [r[0] for r in mutations.live_processors(pods).collect()] == ["p"]
    ends = mutations.resolve_endpoints(spark.createDataFrame([("m",), ("n",)], "model string"), spark.createDataFrame([("m", "u")], "model string, url string"), "all")
    assert {r["model"]: r["target"] for r in ends.collect()} == {"m": "u", "n": "all"}
    made = mutations.create_rows(spark.createDataFrame([("i", "t", 10, 5), ("j", "t", 0, 5)], "id string, tenant_id string, created_at long, window_s long"))
    assert {r["id"]: (r["status"], r["priority"]) for r in made.collect()} == {"i": ("validating", 15_000_000), "j": ("validating", 0)}
    kept = lifecycle.keep_if_empty(F.lit(""), F.lit("old"))
    assert spark.range(1).select(kept.alias("x"), lifecycle.finalize_status(F.lit(True)).alias("y")).first()[:] == ("old", "cancelled")


def test_slots(spark):
    rows = [("e", i, a, d) for i, (a, d) in enumerate([(0, 10), (0, 10), (1, 5), (30, 1)])]
    df = spark.createDataFrame(rows, "k string, o long, a long, d long")
    assert tuple(analysis.slot_schedule(df, "k", "a", "d", "o", 2).first()) == ("e", 4, 9.0, 31.0)
    points = analysis.sweep(spark.createDataFrame([(1, 5, 2.0)], "scenario int, rate int, v double"), "v")
    assert json.loads(analysis.sweep_json(points).first()["document"]) == {"scenario": 1, "points": [{"rate": 5, "value": 2.0}]}


def test_staged_object(spark, tmp_path):
    df = spark.createDataFrame([("a\n",), ("b\n",)], "line string")
    top = f"file://{tmp_path}/objects"
    first, second = jsonl.StagedObject(spark, f"{top}/x"), jsonl.StagedObject(spark, f"{top}/x")
    first.write(df)
    assert not (tmp_path / "objects" / "x").exists()
    first.commit()
    second.write(df.limit(1))
    with pytest.raises(FileExistsError):
        second.commit()
    second.abort()
    assert sorted(r["value"] for r in spark.read.text(f"{top}/x").collect()) == ["a", "b"]
    assert [p.name for p in (tmp_path / "objects").iterdir() if not p.name.startswith(".")] == ["x"]


def test_rejected_entries_name_their_error_lines(spark):
    lines = spark.createDataFrame([("b", 1, "x", "r1", None, None), ("b", 2, "y", "r2", "model_not_found", "no <m>")], "batch_id string, ordinal long, custom_id string, request_id string, reject_code string, reject_message string")
    good, bad = lifecycle.manifest_entries(lines).orderBy("ordinal").collect()
    assert (good["status"], good["error_code"], good["result_key"], good["result_bytes"], good["result_sha256"], good["error_line"]) == ("pending", None, None, None, None, None)
    line = '{"id":"r2","custom_id":"y","response":null,"error":{"code":"model_not_found","message":"no \\u003cm\\u003e"}}\n'
    assert (bad["status"], bad["result_key"], bad["result_bytes"], bad["error_line"]) == ("failed", "results/b/r2.jsonl", len(line), line)
    assert bad["result_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_drain(spark):
    rows = [("r", 1, True, "ok"), ("r", 2, False, "conflict"), ("r", 3, True, "duplicate"), ("r", 4, True, "conflict"), ("r", 5, True, "ok"), ("r", 6, True, "error"), ("s", 1, True, "ok")]
    df = spark.createDataFrame(rows, "run string, seq long, owned boolean, outcome string")
    assert sorted((r["run"], r["seq"]) for r in deliveries.drain(df, "run").filter("acked").collect()) == [("r", 1), ("r", 3), ("s", 1)]
    assert {r["run"]: (r["error"], r["acked"]) for r in deliveries.run_error(df, "run").collect()} == {"r": ("conflict", 2), "s": (None, 1)}


def test_entries_are_dealt_by_batch_and_rows(spark, monkeypatch):
    from batchloom.plans import fixtures
    from tests.conftest import SF

    monkeypatch.setattr(fixtures, "_TASK_ROWS", 100)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fixtures.view(spark, SF, "entries").rdd.getNumPartitions() == -(-n // 100)
    plan = fixtures.view(spark, SF, "entries").groupBy("batch_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_coverage_in_place_of_a_join(spark):
    from batchloom.operators import results

    frame = lambda rows: spark.createDataFrame(rows, "batch_id string, custom_id string")
    asked, out, err = frame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None), (None, "1")]), frame([("a", "1"), ("a", "3"), ("b", None)]), frame([("a", "1"), (None, "1")])
    for tasks in (None, 3):
        got = results.coverage(asked, out, err, tasks)
        assert {tuple(r) for r in got.collect()} == {("a", 2, 3, 1, 1, 1), ("b", 1, 1, 1, 1, 0), (None, 1, 1, 1, 1, 0)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_artifacts_without_a_shuffle_of_lines(spark):
    from batchloom.plans.fixtures import view
    from batchloom.queries import QUERIES
    from tests.conftest import SF

    texts = {("b1", "output"): [f"line {k} é\n" for k in range(50)], ("b1", "error"): ["x\n"], ("b2", "output"): ["", "y\n"], ("b3", "output"): ["z\n"]}
    df = spark.createDataFrame([(b, r, k, x) for (b, r), xs in texts.items() for k, x in enumerate(xs)][::-1], "batch_id string, route string, ordinal long, line string")
    want = sorted((b, r, len(xs), len("".join(xs).encode()), hashlib.sha256("".join(xs).encode()).hexdigest()) for (b, r), xs in texts.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for out in (results.artifacts(df), results.artifacts(df, tasks=3), results.artifacts(df.repartition(3, "batch_id"), dealt=True)):
            assert sorted(map(tuple, out.collect())) == want
        with pytest.raises(Exception, match="line that is null"):
            results.artifacts(df.withColumn("line", F.nullif("line", F.lit("x\n")))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(QUERIES["artifact_digests"](spark, SF)) == exchanges(view(spark, SF, "entries")) == 1


def test_stored_artifacts_are_written_where_they_were_dealt(spark, tmp_path, monkeypatch):
    from batchloom import queries_streaming
    from batchloom.plans import fixtures
    from batchloom.queries import QUERIES
    from tests.conftest import SF

    monkeypatch.setattr(fixtures, "_TASK_ROWS", 50)
    monkeypatch.setattr(queries_streaming, "_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    got = QUERIES["artifact_verification"](spark, SF).collect()
    assert len(list(tmp_path.rglob("part-*"))) > 64  # files grow in number with the rows, not in size
    batches = [{x.split(" ", 1)[0] for x in p.read_text().splitlines()} for p in tmp_path.rglob("part-*")]
    assert sum(map(len, batches)) == len(set().union(*batches))
    assert {r["same"] for r in got} == {True, False}


def test_many_stored_artifacts_are_compressed_and_go_when_digested(spark, tmp_path, monkeypatch):
    from batchloom import queries, queries_streaming
    from batchloom.plans import fixtures
    from tests.conftest import SF, same_rows

    there = lambda: {p.name.split(".", 1)[1] for p in tmp_path.rglob("part-*")}
    release, seen = queries._release, []
    monkeypatch.setattr(queries, "_release", lambda *a: (seen.append(there()), release(*a), seen.append(there())))
    monkeypatch.setattr(queries, "_PLAIN_ROWS", 0)
    monkeypatch.setattr(fixtures, "_TASK_ROWS", 50)
    monkeypatch.setattr(queries_streaming, "_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    got = queries.QUERIES["artifact_verification"](spark, SF)
    same_rows(got, queries.SQL["artifact_verification"])
    texts, digests = {"txt.gz"}, {"zstd.parquet"}
    assert seen == [texts, texts, texts | digests, digests]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan  # lines are read once, and not for the join


def test_results_that_come_twice_are_not_a_union(spark):
    """Of a union Spark would shuffle each part again."""
    from batchloom.queries import QUERIES
    from tests.conftest import SF

    plan = QUERIES["checkpointed_results"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Generate inline" in plan


def test_activation_reads_its_manifest_once(spark):
    from batchloom.operators import lifecycle
    from batchloom.queries import QUERIES
    from tests.conftest import SF

    plan = QUERIES["activation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2  # the manifest's lines, and the entries that are there
    items = spark.createDataFrame([(b, "p", 1, "validating", False) for b in ("a", "b", "c")], "id string, processor_id string, epoch long, status string, resumable boolean")
    manifest = spark.createDataFrame([("a", 0, "r", "pending", None), ("b", 0, "r", "pending", None), ("x", 0, "r", "pending", None)], "batch_id string, ordinal long, custom_id string, status string, error_code string")
    claims = items.select(F.col("id").alias("batch_id"), F.lit("p").alias("owner"), F.lit(1).alias("at_epoch"))
    new, begun = lifecycle.activate(items, spark.createDataFrame([("b",)], "batch_id string"), manifest, claims, 5)
    assert [r["batch_id"] for r in new.collect()] == ["a"] and [r["id"] for r in begun.collect()] == ["a"]  # b has entries, c no manifest
