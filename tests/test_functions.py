import uuid

import pytest
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions import scalars as fn


def one(spark, column, **values):
    types = {k: ("string" if isinstance(v, (str, type(None))) else "long" if isinstance(v, int) else "double") for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in types.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("text", ["a", "You are helpful.", "héllo wörld ✓"])
def test_fnv(spark, text):
    assert one(spark, fn.fnv1a32(F.col("t")), t=text) == fnv(text)
    assert one(spark, fn.prefix_hash(F.col("t")), t=text) == fnv(text)


@pytest.mark.parametrize("text", ["", None])
def test_no_prompt_sorts_last(spark, text):
    assert one(spark, fn.prefix_hash(F.col("t")), t=text) == S.NO_PREFIX


@pytest.mark.parametrize("batch,custom", [("batch_1", "req-1"), ("b", ""), ("bé", "ü✓")])
def test_request_id(spark, batch, custom):
    name = batch.encode() + b"\0" + custom.encode()
    import hashlib

    raw = bytearray(hashlib.sha1(uuid.NAMESPACE_OID.bytes + name).digest()[:16])
    raw[6], raw[8] = raw[6] & 15 | 80, raw[8] & 63 | 128
    assert one(spark, fn.request_id(F.col("b"), F.col("c")), b=batch, c=custom) == "batch_req_" + str(uuid.UUID(bytes=bytes(raw)))


@pytest.mark.parametrize(
    "text,seconds",
    [("24h", 86400.0), ("1h30m", 5400.0), ("500ms", 0.5), ("1.5s", 1.5), ("-2m", -120.0), ("0", 0.0), ("1d", None), ("", None), ("h", None), ("3", None)],
)
def test_duration(spark, text, seconds):
    got = one(spark, fn.duration_seconds(F.col("t")), t=text)
    assert got == (pytest.approx(seconds) if seconds is not None else None)


@pytest.mark.parametrize("model,name", [("org/model-A:1", "org_model-A_1"), ("", "unknown"), ("a.b-c_d", "a.b-c_d"), (None, "unknown")])
def test_safe_model(spark, model, name):
    assert one(spark, fn.safe_model(F.col("m")), m=model) == name


def test_storage_and_folder(spark):
    assert one(spark, fn.storage_name(F.lit("file_1"), F.col("f")), f="x.tar.gz") == "file_1.gz"
    assert one(spark, fn.storage_name(F.lit("file_1"), F.col("f")), f="x") == "file_1.jsonl"
    assert len(one(spark, fn.tenant_folder(F.col("t")), t="acme")) == 63
    assert one(spark, fn.tenant_folder(F.col("t")), t="") is None


@pytest.mark.parametrize("status,error,want", [(200, None, None), (204, None, None), (403, None, "http_403"), (500, None, "http_500"), (None, "server_error", "server_error"), (200, "x", "x"), (None, None, "unknown")])
def test_result_error(spark, status, error, want):
    df = spark.createDataFrame([(status, error)], "s int, e string")
    assert df.select(fn.result_error(F.col("s"), F.col("e")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("code,category,kind,api", [
    (400, "INVALID_REQ", "invalid_request_error", "invalid_request_error"), (401, "AUTH_ERROR", "authentication_error", "authentication_error"),
    (403, "AUTH_ERROR", "authentication_error", "permission_error"), (404, "UNKNOWN", "unknown_error", "not_found_error"), (422, "UNKNOWN", "unknown_error", "invalid_request_error"),
    (429, "RATE_LIMIT", "rate_limit_error", "rate_limit_error"), (503, "SERVER_ERROR", "server_error", "server_error"), (418, "UNKNOWN", "unknown_error", "api_error"),
])
def test_http(spark, code, category, kind, api):
    row = spark.range(1).select(fn.http_category(F.lit(code)).alias("c"), fn.category_type(fn.http_category(F.lit(code))).alias("k"), fn.api_error_type(F.lit(code)).alias("a")).first()
    assert tuple(row) == (category, kind, api)


@pytest.mark.parametrize("code,dropped,want", [(429, None, True), (429, "rejected-ttl-expired", False), (503, "rejected-ttl-expired", False), (500, "rejected-ttl-expired", True), (404, None, False), (None, None, True)])
def test_retry(spark, code, dropped, want):
    df = spark.createDataFrame([(code, dropped)], "c int, d string")
    assert df.select(fn.should_retry(F.col("c"), F.col("d")).alias("x")).first()["x"] is want


@pytest.mark.parametrize("value,want", [("120", 120), ("0", 0), ("-1", None), ("Thu, 01 Dec 1994 16:00:00 GMT", 100), ("soon", None)])
def test_retry_after(spark, value, want):
    assert one(spark, fn.retry_after_seconds(F.col("v"), F.lit(786297600 - 100)), v=value) == want


@pytest.mark.parametrize("code,attempt,after,want", [(429, 1, None, 3.0), (429, 1, 20, 20.0), (500, 3, None, 4.0), (500, 9, None, 60.0), (502, 9, None, 30.0), (503, 1, 0, 1.0), (500, 1, 20, 1.0)])
def test_backoff(spark, code, attempt, after, want):
    df = spark.createDataFrame([(code, attempt, after)], "c int, a int, r long")
    assert df.select(fn.backoff_seconds(F.col("c"), F.col("a"), F.col("r"), 1.0, 60.0).alias("x")).first()["x"] == want


def test_small_ones(spark):
    lit = F.lit
    row = spark.range(1).select(
        fn.human_duration(lit(59)).alias("a"), fn.human_duration(lit(480)).alias("b"), fn.human_duration(lit(7200)).alias("c"), fn.human_duration(lit(4500)).alias("d"),
        fn.percentile_of_deciles(F.array(*[lit(float(i)) for i in range(11)]), 99).alias("e"), fn.percentile_of_deciles(F.array(lit(1.0)), 99).alias("f"),
        fn.effective_workers(lit(5), lit(1000), lit(50), lit(200)).alias("g"), fn.effective_workers(lit(5), lit(100), lit(50), lit(200)).alias("h"),
        fn.same_json(lit('{"a":1,"b":[2]}'), lit('{ "b":[2], "a":1 }')).alias("i"), fn.same_members(F.array(lit(1), lit(2), lit(2)), F.array(lit(2), lit(1), lit(2))).alias("j"),
        fn.same_members(F.array(lit(1), lit(2), lit(2)), F.array(lit(1), lit(1), lit(2))).alias("k"), fn.output_expiry(lit(None).cast("long"), lit(60).cast("long"), lit(100).cast("long")).alias("l"),
        fn.output_expiry(lit(5).cast("long"), lit(60).cast("long"), lit(100).cast("long")).alias("m"), fn.not_executed_message(lit("other")).alias("n"), fn.size_bucket(lit(30000)).alias("o"),
        fn.result_key(lit("b"), lit("r")).alias("p"),
    ).first()
    assert tuple(row) == ("59s", "8m", "2h", "1h 15m", pytest.approx(9.9), 0.0, 2, None, True, True, False, 160, 105, S.NOT_EXECUTED_OTHER, "large", "results/b/r.jsonl")


@pytest.mark.parametrize("cause,failed,done,total,error,want", [("expired", 0, 1, 1, None, "expired"), ("shutdown", 0, 2, 2, None, "none"), ("shutdown", 0, 1, 2, None, "shutdown"), (None, 0, 1, 1, "db", "db"), (None, 0, 1, 1, None, "none")])
def test_outcome(spark, cause, failed, done, total, error, want):
    df = spark.createDataFrame([(cause, failed, done, total, error)], "c string, f long, d long, t long, e string")
    assert df.select(fn.outcome(*[F.col(x) for x in "cfdte"]).alias("x")).first()["x"] == want


@pytest.mark.parametrize("deadline,want", [(None, 300), (1000 + 250, 0), (1000 + 400, 100), (1000 + 10_000, 300)])
def test_recovery_wait(spark, deadline, want):
    df = spark.createDataFrame([(deadline,)], "d long")
    assert df.select(fn.recovery_wait(F.lit(300).cast("long"), F.col("d"), F.lit(1000).cast("long")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('{ "b" : 1.0, "a" : [1e3, -0.5, 1E-7, 1e21, 1.5e300] }', '{"a":[1000,-0.5,1e-7,1e+21,1.5e+300],"b":1}'),
        ('{"z":{"y":true,"x":null},"":[]}', '{"":[],"z":{"x":null,"y":true}}'),
        ('{"t":"<a> & \\"1.0\\" {\\"k\\":2e3} \\\\"}', '{"t":"\\u003ca\\u003e \\u0026 \\"1.0\\" {\\"k\\":2e3} \\\\"}'),
        ('" é\\u2029"', '"\\u2028é\\u2029"'),
        ("12345678901234567890", "12345678901234567000"), ("1e1", "10"), ("0.000001", "0.000001"), ("120.50", "120.5"), ("100", "100"), ("not json", None), ('{"a":1,"a":2}', None), ("", None),
    ],
)
def test_canonical_json(spark, text, want):
    from batchloom.functions import encode

    assert spark.createDataFrame([(text,)], "t string").select(encode.canonical_json(F.col("t"))).first()[0] == want


def test_same_json_compares_numbers(spark):
    pairs = [("10", "1e1", True), ('{"a":1.0}', '{"a":1}', True), ('{"a":1}', '{"a":2}', False), ("x", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["same"] == r["want"] for r in df.withColumn("same", fn.same_json(F.col("a"), F.col("b"))).collect())


def test_canonical_json_of_a_long_string(spark):
    from batchloom.functions import encode

    long = 'a\\"1' * 20_000
    text = f'{{"n": [10.0, -3, 12345678901234567, 0.50, -0, 1e300], "1": "{long}"}}'
    got = spark.createDataFrame([(text,)], "t string").select(encode.canonical_json(F.col("t"))).first()[0]
    assert got == f'{{"1":"{long}","n":[10,-3,12345678901234568,0.5,0,1e+300]}}'
