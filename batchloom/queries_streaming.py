"""Registered queries of the streams: each runs to the end of what is there and gives the rows that it has written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fn
from .queries import _query, c
from .streaming import events, jobs, recovery

_CODES = {"error": 500, "signup": 429, "view": 404}
_CODE_SQL = "case event_type when 'error' then 500 when 'signup' then 429 when 'view' then 404 else 200 end"


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one; where no other machines are and none is named, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="batchloom-")
    return f"{shared.rstrip('/')}/batchloom/{label}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    code = F.coalesce(*[F.when(c("event_type") == t, n) for t, n in _CODES.items()], F.lit(200))
    # As a pattern: a stream takes a single file by no other path.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/[e]vents.parquet")
    return rows.select("event_id", "user_id", "event_type", c("ts").cast("timestamp").alias("ts"), code.alias("status_code"), F.lit(None).cast("string").alias("error_code"))


def _written(out: DataFrame, label: str) -> DataFrame:
    """The rows that a stream appends, each micro-batch once."""
    spark = out.sparkSession
    folder = _folder(spark, label)
    jobs.commit_exactly_once(out, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").select(out.columns)


@_query(f"with e as (select user_id as batch_id, {_CODE_SQL} between 200 and 299 as ok from events) select batch_id, count(*) as total, count(*) filter (ok) as completed, count(*) filter (not ok) as failed from e group by 1")
def streamed_progress(spark, sf):
    """Counts only grow, so the last push of a batch holds its largest ones."""
    progress = jobs.progress_stream(_events(spark, sf).withColumnRenamed("user_id", "batch_id"))
    folder = _folder(spark, "progress")
    jobs.push_progress(progress, lambda df: df.write.mode("append").parquet(f"{folder}/rows"), f"{folder}/state", once=True).awaitTermination()
    pushed = spark.read.schema(progress.schema).parquet(f"{folder}/rows")
    return pushed.groupBy("batch_id").agg(*[F.max(n).alias(n) for n in ("total", "completed", "failed")])


@_query("select distinct user_id, event_type from events")
def streamed_first_wins(spark, sf):
    first = jobs.first_wins_stream(_events(spark, sf), "60 days", ("user_id", "event_type"))
    return _written(first.select("user_id", "event_type"), "first-wins")


@_query("select case when user_id % 3 <> 0 then 'run-' || cast(user_id % 5 as varchar) end as subscriber, count(*) as n from events group by 1")
def streamed_routes(spark, sf):
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().filter("user_id % 3 <> 0")
    subscribers = users.select(c("user_id").alias("batch_id"), F.concat(F.lit("run-"), (c("user_id") % 5).cast("string")).alias("subscriber"))
    routed = jobs.route_stream(_events(spark, sf).select(c("user_id").alias("batch_id"), "event_id"), subscribers)
    return _written(routed.select("event_id", "subscriber"), "routes").groupBy("subscriber").agg(F.count("*").alias("n"))


_END = "(select least(max(ts) filter (event_type = 'click'), max(ts) filter (event_type in ('purchase', 'error'))) - interval 2 days from events)"


@_query(
    "select a.event_id as request_id, b.code as status_code, case when b.event_id is null then 'batch_expired' end as error_code from events a "
    f"left join (select event_id, ts, {_CODE_SQL} as code from events where event_type in ('purchase', 'error')) b on b.event_id = a.event_id + 1 and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour "
    f"where a.event_type = 'click' and a.ts < {_END}"
)
def streamed_answers(spark, sf):
    """Requests of the last two days may still wait for their answer, so they are left to a later run."""
    e = _events(spark, sf)
    asked = e.filter("event_type = 'click'").select(c("event_id").alias("request_id"), c("ts").alias("asked_at"))
    got = _events(spark, sf).filter("event_type in ('purchase', 'error')").select((c("event_id") - 1).alias("request_id"), c("ts").alias("answered_at"), "status_code", "error_code")
    rows = _written(jobs.pending_stream(asked, got, "1 HOUR").select("request_id", "asked_at", "status_code", "error_code"), "answers")
    ts = spark.read.parquet(f"{sf}/events.parquet").select("event_type", c("ts").cast("timestamp").alias("ts"))
    end = ts.agg(F.least(F.max(F.when(c("event_type") == "click", c("ts"))), F.max(F.when(c("event_type").isin("purchase", "error"), c("ts")))).alias("end"))
    return rows.join(end, c("asked_at") < F.expr("end - INTERVAL 2 DAYS")).select("request_id", "status_code", "error_code")


@_query("select event_type, count(*) as n from events group by 1")
def streamed_commits(spark, sf):
    """The second run, by the same checkpoint, finds nothing new and writes nothing twice."""
    folder = _folder(spark, "commits")
    out = _events(spark, sf).select("event_id", "event_type")
    for _ in range(2):
        jobs.commit_exactly_once(out, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


#: Clicks of a user and week are requests in flight at the week's begin; three in four have a result, at their own time. A third of the users have no deadline,
#: a third one that leaves no time to wait.
_WEEK_S, _HOLD_S = 604_800, 259_200
#: Rows of held requests and results to a group of state, and the fewest groups.
_GROUP_ROWS, _LEAST_GROUPS = 4000, 64
_LEFT = "case user_id % 3 when 1 then 400000 + user_id * 1000 when 2 then 200000 end"


@_query(
    f"with e as (select *, cast(floor(epoch(ts)) as bigint) as sec, {_LEFT} as left_s from events where event_type = 'click'), "
    f"h as (select concat(cast(user_id as varchar), '-', cast(sec // {_WEEK_S} as varchar)) as batch_id, cast(event_id as varchar) as request_id, sec // {_WEEK_S} * {_WEEK_S} as start, sec, event_id % 4 <> 0 as answered, "
    f"case when left_s is null then {_HOLD_S} when left_s - {_HOLD_S} <= 0 then 0 else least({_HOLD_S}, left_s - {_HOLD_S}) end as wait_s from e), "
    "d as (select *, answered and wait_s > 0 and sec <= start + wait_s as delivered from h) "
    "select batch_id, request_id, case when delivered then 'delivered' else 'submit' end as outcome, case when delivered then sec else start + wait_s end as at from d "
    "union all select batch_id, null, case when min(wait_s) = 0 then 'skipped' when bool_and(delivered) then 'resolved' else 'timed_out' end, "
    "case when min(wait_s) > 0 and bool_and(delivered) then max(sec) else min(start + wait_s) end from d group by batch_id"
)
def streamed_recovery(spark, sf):
    """Holds that end early, at their end and at once; a last row moves the watermark past all."""
    folder = _folder(spark, "recovery")
    sec = F.unix_seconds(c("ts").cast("timestamp"))
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").withColumn("sec", sec).withColumn("start", F.floor(sec / _WEEK_S) * _WEEK_S)
    wait = fn.recovery_wait(F.lit(_HOLD_S).cast("long"), c("start") + F.expr(_LEFT), c("start"))
    held = e.select(F.concat_ws("-", c("user_id").cast("string"), F.floor(c("sec") / _WEEK_S).cast("string")).alias("batch_id"), c("event_id").cast("string").alias("request_id"), "event_id", wait.alias("wait_s"), "start", "sec")
    row = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("sec"))
    rows = held.select("batch_id", "request_id", "wait_s", F.inline(F.when(c("event_id") % 4 != 0, F.array(row("held", c("start")), row("result", c("sec")))).otherwise(F.array(row("held", c("start"))))))
    end = held.agg(F.max("sec").alias("sec")).select(F.lit("").alias("batch_id"), F.lit("").alias("request_id"), F.lit(0).cast("long").alias("wait_s"), F.lit("result").alias("kind"), (c("sec") + 2 * _WEEK_S).alias("sec"))
    rows.unionByName(end).withColumn("at", F.timestamp_seconds("sec")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("batch_id string, request_id string, wait_s long, kind string, sec long, at timestamp").parquet(f"{folder}/in")
    groups = max(_LEAST_GROUPS, spark.read.parquet(f"{folder}/in").count() // _GROUP_ROWS)
    return _stateful(recovery.recovery_stream(stream, "1 second", groups), "recovery")


_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _stateful(out: DataFrame, label: str) -> DataFrame:
    """``_written`` for streams that keep state of their own, which only RocksDB holds."""
    conf = out.sparkSession.conf
    before = {k: conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        conf.set(k, v)
    try:
        return _written(out, label)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


#: A job's views take two slots of its channel's three; its other events wait for one, for as long as they live.
_SLOTS = 3


@_query(
    "with recursive v as (select concat('job-', cast(user_id as varchar)) as job_id, event_id as id, cast(floor(epoch(ts)) as bigint) as sec, cast(floor(epoch(ts)) as bigint) + event_id % 41 * 40000 as expires, "
    "case when event_type = 'view' then 2 else 0 end as takes from events), "
    "r as (select *, row_number() over (partition by job_id order by sec, id) as no from v), "
    "f as (select job_id, 0 as no, cast([] as struct(id bigint, expires bigint)[]) as waiting, 0 as taken, cast([] as struct(id bigint, expires bigint)[]) as sent, cast(0 as bigint) as sec from (select distinct job_id from r) "
    "union all select job_id, no, list_filter(q, lambda x: not list_contains(list_transform(s, lambda y: y.id), x.id)), free + len(s), s, sec from ("
    f"select *, list_filter(q, lambda x: x.expires > sec)[1 : {_SLOTS} - free] as s from ("
    "select r.job_id, r.no, r.sec, case when r.takes > 0 then f.waiting else list_append(f.waiting, struct_pack(id := r.id, expires := r.expires)) end as q, greatest(0, f.taken - r.takes) as free "
    "from f join r on r.job_id = f.job_id and r.no = f.no + 1))), "
    "d as (select job_id, unnest(sent).id as id, sec from f) "
    "select v.job_id, v.id, case when d.id is null then 'expired' else 'delivered' end as outcome, case when d.id is null then v.expires else d.sec end as at from v left join d on d.job_id = v.job_id and d.id = v.id where v.takes = 0"
)
def streamed_events(spark, sf):
    """Events that fill their job's channel, wait, are delivered or expire; a last row moves the watermark past all."""
    folder = _folder(spark, "events")
    sec = F.unix_seconds(c("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("job-"), c("user_id").cast("string")).alias("job_id"), c("event_id").alias("id"), sec.alias("sec"), (sec + c("event_id") % 41 * 40_000).alias("expires"),
        F.when(c("event_type") == "view", 2).otherwise(0).alias("takes"),
    )
    end = rows.agg(F.max("expires").alias("sec")).select(F.lit("").alias("job_id"), F.lit(-1).cast("long").alias("id"), (c("sec") + 1000).alias("sec"), F.lit(0).cast("long").alias("expires"), F.lit(1).alias("takes"))
    rows.unionByName(end).withColumn("at", F.timestamp_seconds("sec")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("job_id string, id long, sec long, expires long, takes int, at timestamp").parquet(f"{folder}/in")
    return _stateful(events.delivery_stream(stream, _SLOTS, "1 second"), "events")
