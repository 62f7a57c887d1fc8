"""Scalar functions as Column builders: identity, names, classification, durations, quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .encode import canonical_json

#: Fixed value: the name space of object identifiers in RFC 9562.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def _ladder(rules: list[tuple[Column, object]], other: object = None) -> Column:
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(other)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    h = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    byte = F.transform(at, lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(byte, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def prefix_hash(system_text: Column) -> Column:
    """Hash of the first system prompt that isn't empty; requests without one sort last."""
    return F.when(F.coalesce(F.octet_length(system_text), F.lit(0)) > 0, fnv1a32(system_text)).otherwise(F.lit(S.NO_PREFIX).cast("long"))


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a binary name under the object identifier name space."""
    x = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), name))
    variant = F.lower(F.hex(F.conv(F.substring(x, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(63).cast("long")).bitwiseOR(F.lit(128).cast("long"))))
    return F.concat(F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-5"), F.substring(x, 14, 3), F.lit("-"), variant, F.substring(x, 19, 2), F.lit("-"), F.substring(x, 21, 12))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(F.encode(a, "UTF-8"), F.unhex(F.lit("00")), F.encode(b, "UTF-8"))


def request_id(batch_id: Column, custom_id: Column) -> Column:
    return F.concat(F.lit("batch_req_"), uuid5(_pair(batch_id, custom_id)))


def artifact_id(batch_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("file_"), uuid5(_pair(batch_id, kind)))


def tenant_folder(tenant: Column) -> Column:
    """Null for an empty tenant, which is an error."""
    return F.when(F.coalesce(tenant, F.lit("")) != "", F.concat(F.lit("t-"), F.substring(F.sha2(tenant, 256), 1, 61)))


def storage_name(file_id: Column, filename: Column) -> Column:
    ext = F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[^./]*)$", 1)
    return F.concat(file_id, F.when(ext == "", F.lit(".jsonl")).otherwise(ext))


def safe_model(model: Column) -> Column:
    base = F.regexp_replace(F.coalesce(model, F.lit("")), "[^a-zA-Z0-9._-]+", "_")
    return F.when(base == "", F.lit("unknown")).otherwise(base)


def result_key(batch_id: Column, req: Column) -> Column:
    return F.concat(F.lit("results/"), batch_id, F.lit("/"), req, F.lit(".jsonl"))


def succeeded(status_code: Column, error_code: Column) -> Column:
    return error_code.isNull() & F.coalesce(status_code.between(200, 299), F.lit(False))


def result_error(status_code: Column, error_code: Column) -> Column:
    """The error object's code, else http_<status>, else unknown; null where the request succeeded."""
    return _ladder(
        [(succeeded(status_code, error_code), F.lit(None).cast("string")), (error_code.isNotNull(), error_code), (status_code.isNotNull(), F.concat(F.lit("http_"), status_code.cast("string")))],
        F.lit("unknown"),
    )


def http_category(code: Column) -> Column:
    return _ladder(
        [(code == 400, F.lit("INVALID_REQ")), (code.isin(401, 403), F.lit("AUTH_ERROR")), (code == 429, F.lit("RATE_LIMIT")), (code >= 500, F.lit("SERVER_ERROR"))],
        F.lit("UNKNOWN"),
    )


def category_type(category: Column) -> Column:
    names = {"INVALID_REQ": "invalid_request_error", "AUTH_ERROR": "authentication_error", "RATE_LIMIT": "rate_limit_error", "SERVER_ERROR": "server_error", "PARSE_ERROR": "invalid_response"}
    return _ladder([(category == k, F.lit(v)) for k, v in names.items()], F.lit("unknown_error"))


def retryable_category(category: Column) -> Column:
    return category.isin("RATE_LIMIT", "SERVER_ERROR")


def api_error_type(code: Column) -> Column:
    names = {400: "invalid_request_error", 401: "authentication_error", 403: "permission_error", 404: "not_found_error", 422: "invalid_request_error", 429: "rate_limit_error"}
    return _ladder([*[(code == k, F.lit(v)) for k, v in names.items()], (code >= 500, F.lit("server_error"))], F.lit("api_error"))


def should_retry(code: Column, dropped_reason: Column) -> Column:
    """Network errors (null code) and 5xx are retried, 429 and 503 unless the request was dropped for its deadline."""
    fresh = ~dropped_reason.eqNullSafe(F.lit(S.DROPPED_LATE))
    return F.when(code.isNull(), F.lit(True)).when(code.isin(429, 503), fresh).otherwise(code >= 500)


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a whole number or an HTTP date; null if it is neither."""
    number = F.when(value.rlike("^[+]?[0-9]+$"), value.try_cast("long"))
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(value, r"^[A-Z][a-z]{2}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.coalesce(number, F.when(date.isNotNull(), F.greatest(date - now, F.lit(0).cast("long"))))


def backoff_seconds(code: Column, attempt: Column, retry_after: Column, initial: float, most: float) -> Column:
    """Delay before a retry without its jitter: doubling from the first delay up to a ceiling, both by status."""
    first = F.when(code == 429, F.lit(3 * initial)).otherwise(F.lit(float(initial)))
    ceiling = F.when(code.isin(502, 503, 504), F.lit(most / 2)).otherwise(F.lit(float(most)))
    grown = F.least(first * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), ceiling)
    return F.when(code.isin(429, 503) & retry_after.isNotNull(), F.greatest(retry_after.cast("double"), F.lit(float(initial)))).otherwise(grown)


def size_bucket(lines: Column) -> Column:
    return _ladder([(lines < n, F.lit(name)) for n, name in S.SIZE_BUCKETS], F.lit(S.SIZE_LARGE))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as 1h30m or 500ms; null if it isn't one."""
    units = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    body = F.regexp_replace(text, "^[-+]", "")
    part = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)"
    numbers, names = F.regexp_extract_all(body, F.lit(part), F.lit(1)), F.regexp_extract_all(body, F.lit(part), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    total = F.aggregate(F.zip_with(numbers, names, lambda n, u: n.cast("double") * scale[u]), F.lit(0.0), lambda a, b: a + b)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(body.rlike(f"^({part})+$"), signed).when(body == "0", F.lit(0.0))


def not_executed_message(code: Column) -> Column:
    return _ladder([(code == k, F.lit(v)) for k, v in S.NOT_EXECUTED.items()], F.lit(S.NOT_EXECUTED_OTHER))


def output_expiry(tag_ttl: Column, default_ttl: Column, now: Column) -> Column:
    """Expiry of an artifact: its tag's lifetime, else the default, else never (0)."""
    ttl = F.when(tag_ttl > 0, tag_ttl).when(default_ttl > 0, default_ttl)
    return F.coalesce(now + ttl, F.lit(0).cast("long"))


def priority_us(created_at: Column, window: Column) -> Column:
    return F.when((created_at > 0) & window.isNotNull() & (window != 0), ((created_at + window) * 1_000_000).cast("long")).otherwise(F.lit(0).cast("long"))


def job_times(created_at: Column, started_at: Column, ended_at: Column) -> tuple[Column, Column]:
    """(queue wait, end-to-end latency) in seconds: from creation to the start and to the final status; null while that is open."""
    return started_at - created_at, ended_at - created_at


def human_duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    text = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    return _ladder(
        [(seconds < 60, text(seconds, "s")), (minutes < 60, text(minutes, "m")), (rest == 0, text(hours, "h"))],
        F.concat(text(hours, "h"), F.lit(" "), text(rest, "m")),
    )


def percentile_of_deciles(deciles: Column, target: int) -> Column:
    """Linear interpolation in 11 values p0, p10 ... p100; 0 where fewer are there."""
    low = min(target // 10, 9)
    frac = (target - 10 * low) / 10
    a, b = F.get(deciles, F.lit(low)), F.get(deciles, F.lit(min(low + 1, 10)))
    return F.when(F.size(deciles) >= 11, a + F.lit(frac) * (b - a)).otherwise(F.lit(0.0))


def lognormal_parameters(mean: Column, stdev: Column) -> tuple[Column, Column]:
    """(mu, sigma) of the lognormal distribution with this mean and standard deviation."""
    v = F.log(1 + (stdev * stdev) / (mean * mean))
    return F.log(mean) - v / 2, F.sqrt(v)


def effective_workers(workers: Column, disk_bytes: Column, percent: Column, file_bytes: Column) -> Column:
    """Workers whose largest inputs fit the disk budget together; null if not even one does."""
    budget = F.floor(disk_bytes / 100) * percent + F.floor((disk_bytes % 100) * percent / 100)
    fit = F.floor(budget / file_bytes)
    return F.when(fit >= 1, F.least(workers.cast("long"), fit.cast("long")))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts mean the same: keys in any order, spaces of no matter, numbers by value."""
    one, other = canonical_json(a), canonical_json(b)
    return one.isNotNull() & (one == other)


def same_members(a: Column, b: Column) -> Column:
    """Equality of two arrays as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def outcome(cause: Column, failed: Column, completed: Column, total: Column, error: Column) -> Column:
    """How a run ended: by its abort cause; a shutdown after full success doesn't count."""
    full = (failed == 0) & (completed == total)
    return F.when(cause.isin("expired", "cancelled"), cause).when((cause == "shutdown") & full, F.lit("none")).when(cause == "shutdown", cause).otherwise(F.coalesce(error, F.lit("none")))


def recovery_wait(window: Column, deadline: Column, now: Column) -> Column:
    """Seconds to hold in-flight requests for stranded results: none if that would eat the time to send them again."""
    budget = deadline - now - window
    return F.when(deadline.isNull(), window).when(budget <= 0, F.lit(0).cast("long")).otherwise(F.least(window, budget))
