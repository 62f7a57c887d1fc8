"""Record schemas, enumerations and limits. These are fixed values, stated in their natural order."""

from __future__ import annotations

# Job statuses and the subsets the rules speak of.
STATUSES = ("validating", "failed", "in_progress", "finalizing", "completed", "expired", "cancelling", "cancelled")
TERMINAL = ("completed", "failed", "expired", "cancelled")
CANCELLABLE = ("validating", "in_progress", "cancelling")
RUNNABLE = ("validating", "in_progress")

# Which status may follow which.
TRANSITIONS = (
    ("validating", "in_progress"), ("validating", "cancelling"), ("validating", "cancelled"), ("validating", "failed"), ("validating", "expired"),
    ("in_progress", "finalizing"), ("in_progress", "cancelling"), ("in_progress", "failed"), ("in_progress", "expired"), ("in_progress", "validating"),
    ("finalizing", "completed"), ("finalizing", "failed"), ("finalizing", "cancelling"),
    ("cancelling", "cancelled"), ("cancelling", "failed"),
)

# Endpoints of a request, purposes of a file.
ENDPOINTS = ("/v1/responses", "/v1/chat/completions", "/v1/embeddings", "/v1/completions", "/v1/moderations")
PURPOSES = ("assistants", "assistants_output", "batch", "batch_output", "fine-tune", "fine-tune-results", "vision", "user_data")

# Codes of requests that were never executed, and what their users read.
NOT_EXECUTED = {
    "batch_expired": "This request could not be executed before the completion window expired.",
    "batch_cancelled": "This request was not executed because the batch was cancelled.",
    "batch_failed": "This request was not executed because the batch encountered a system error.",
}
NOT_EXECUTED_OTHER = "This request could not be executed."

# Size classes of a batch as (upper bound, name), and histogram buckets as (start, factor, count).
SIZE_BUCKETS = ((100, "100"), (1000, "1000"), (10000, "10000"), (30000, "30000"))
SIZE_LARGE = "large"
HISTOGRAMS = {"process": (0.1, 2.0, 15), "queue": (0.1, 2.0, 10), "e2e": (1.0, 3.0, 12), "reconcile": (0.1, 3.0, 10)}

# Limits and defaults.
MAX_FILE_BYTES = 200 * 1024 * 1024
MAX_FILE_LINES = 50_000
MIN_EXPIRY_S, MAX_EXPIRY_S = 3600, 2_592_000
MAX_METADATA, MAX_KEY, MAX_VALUE = 16, 64, 512
MAX_RECOVERY_ATTEMPTS = 3
NO_PREFIX = 4_294_967_295
PROGRESS_S, EVENT_SWEEP_S, LEASE_S, RECOVERY_WINDOW_S = 15, 30, 300, 300
AIMD_MIN, AIMD_MAX, AIMD_FACTOR, AIMD_STEP = 5, 10, 0.5, 1
#: Fixed value: why a server drops a request whose deadline has passed.
DROPPED_LATE = "rejected-ttl-expired"
#: Fixed value: the owner of rows from before the queue.
BEFORE_QUEUE = "pre-migration"
EVENT_TYPES = {0: "cancel", 1: "pause", 2: "resume"}

REQUEST_LINE = "custom_id string, method string, url string, body struct<model:string, stream:boolean, messages:array<struct<role:string, content:variant>>>"
RESULT_LINE = "id string, custom_id string, response struct<status_code:int, request_id:string, body:variant>, error struct<code:string, message:string>"
PLAN_ENTRY = "offset long, length long, prefix_hash long"
ENTRY = (
    "batch_id string, request_id string, ordinal long, custom_id string, status string, attempts long, submitted_by string, "
    "result_key string, result_bytes long, result_sha256 string, error_code string"
)
EVENT = "id long, job_id string, event_type int, expires_at long"
METRIC = "ts timestamp, metric string, labels map<string,string>, le double, value double"
TRANSITION = (
    "batch_id string, seq long, expected_status string, expected_epoch long, set_status string, set_owner string, bump_epoch boolean"
)
