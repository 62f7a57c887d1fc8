"""Streams give what the batch operators give, across micro-batches."""

from pyspark.sql import functions as F

from batchloom.operators import lifecycle, metrics
from batchloom.streaming import jobs


def write_in_order(df, path, key, n):
    from pyspark.sql import Window

    cut = df.withColumn("__part", F.ntile(n).over(Window.orderBy(key)))
    for i in range(1, n + 1):
        cut.filter(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(str(path))


def run(stream, name, mode, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_aimd_over_micro_batches(spark, tmp_path):
    rows = [(f"e{k}", i, -1 if (i * 7 + k) % 13 == 0 else 1) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "endpoint string, seq long, signal int")
    write_in_order(df, tmp_path / "in", "seq", 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.aimd_stream(stream), "aimd", "update", tmp_path / "cp")
    want = {r["endpoint"]: (r["limit"], r["wins"]) for r in metrics.aimd(df, "endpoint", "seq", "signal").collect()}
    got = [tuple(r) for r in spark.table("aimd").collect()]
    assert {e: (l, w) for e, l, w in got if (l, w) == want[e]} == want
    assert len(got) == 9  # three micro-batches


def test_state_machine_over_micro_batches(spark, tmp_path):
    from batchloom.plans.fixtures import view

    log = view(spark, "/root/testdata/sf0.001", "transitions").filter("batch_id < 'batch_00000040'").select(
        "batch_id", F.col("seq").cast("long").alias("seq"), "expected_status", F.col("expected_epoch").cast("long").alias("expected_epoch"), "set_status", "set_owner", "bump_epoch"
    ).cache()
    write_in_order(log, tmp_path / "in", "seq", 2)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.state_stream(stream), "state", "update", tmp_path / "cp")
    last = spark.table("state").withColumn("n", F.col("applied") + F.col("conflicts")).groupBy("batch_id").agg(F.max_by(F.struct("status", "epoch", "owner", "applied", "conflicts"), "n").alias("s")).select("batch_id", "s.*")
    assert sorted(map(str, last.collect())) == sorted(map(str, lifecycle.fold(log).collect()))


def test_first_wins_and_progress(spark, tmp_path):
    rows = [("b", "r1", 1, 200), ("b", "r2", 2, 500), ("b", "r1", 3, 500)]
    df = spark.createDataFrame(rows, "batch_id string, custom_id string, t long, status_code int").select(
        "batch_id", "custom_id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "status_code", F.lit(None).cast("string").alias("error_code")
    )
    write_in_order(df, tmp_path / "in", "ts", 3)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.first_wins_stream(source(), "1 hour"), "wins", "append", tmp_path / "cp1")
    assert sorted((r["custom_id"], r["status_code"]) for r in spark.table("wins").collect()) == [("r1", 200), ("r2", 500)]
    pushed = []
    jobs.push_progress(jobs.progress_stream(source()), lambda d: pushed.extend(map(tuple, d.collect())), str(tmp_path / "cp2"), once=True).awaitTermination(120)
    assert pushed[-1] == ("b", 3, 1, 2)


def test_commits_survive_a_replay(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.lit(1))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        jobs.commit_exactly_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_pending_times_out(spark, tmp_path):
    t0 = 1_700_000_000
    asked = spark.createDataFrame([("1", t0), ("2", t0), ("9", t0 + 10_000)], "request_id string, t long").select("request_id", F.timestamp_seconds("t").alias("asked_at"))
    got = spark.createDataFrame([("1", t0 + 5, 200), ("8", t0 + 10_000, 200)], "request_id string, t long, status_code int").select("request_id", F.timestamp_seconds("t").alias("answered_at"), "status_code", F.lit(None).cast("string").alias("error_code"))
    asked.write.parquet(str(tmp_path / "a"))
    got.write.parquet(str(tmp_path / "b"))
    s = jobs.pending_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(got.schema).parquet(str(tmp_path / "b")), "60 SECONDS")
    run(s, "pending", "append", tmp_path / "cp")
    assert {(r["request_id"], r["status_code"], r["error_code"]) for r in spark.table("pending").collect()} >= {("1", 200, None), ("2", None, "batch_expired")}


def test_routes(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1), ("b2", 2)], "batch_id string, v int")
    df.write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([("b1", "p1"), ("b1", "p2")], "batch_id string, owner string")
    run(jobs.route_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), subs), "routes", "append", tmp_path / "cp")
    assert sorted((r["batch_id"], r["owner"] or "") for r in spark.table("routes").collect()) == [("b1", "p1"), ("b1", "p2"), ("b2", "")]


def test_leases(spark, tmp_path):
    beats = spark.createDataFrame([("b1",), ("b2",)], "batch_id string")
    beats.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(jobs.lease_stream(spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in")), 600), "leases", "update", tmp_path / "cp")
    assert sorted(tuple(r) for r in spark.table("leases").collect()) == [("b1", "held"), ("b2", "held")]


def test_recovery_hold_over_micro_batches(spark, tmp_path):
    from batchloom.streaming import recovery

    held = [("early", "a", 10, 100), ("early", "b", 10, 100), ("late", "c", 10, 100), ("late", "d", 10, 100), ("late", "d", 10, 100), ("none", "e", 10, 0), ("open", "f", 10, 10_000)]
    results = [("early", "b", 60), ("early", "a", 40), ("late", "c", 110), ("late", "d", 111), ("late", "x", 50), ("none", "e", 50), ("gone", "y", 50)]
    parts = [held, results[:4], [*results[4:], ("", "", 500)], [("", "", 900)]]
    for n, part in enumerate(parts):
        rows = [(b, r, "held", s, w[0]) if w else (b, r, "result", s, 0) for b, r, s, *w in part]
        df = spark.createDataFrame(rows, "batch_id string, request_id string, kind string, sec long, wait_s long").withColumn("at", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(recovery.recovery_stream(stream, "100 seconds"), "recovery", "append", tmp_path / "cp")
    got = sorted(map(str, (tuple(r) for r in spark.table("recovery").collect())))
    want = [
        ("early", "a", "delivered", 40), ("early", "b", "delivered", 60), ("early", None, "resolved", 60), ("late", "c", "delivered", 110), ("late", "d", "submit", 110),
        ("late", None, "timed_out", 110), ("none", "e", "submit", 10), ("none", None, "skipped", 10),
    ]
    assert got == sorted(map(str, want))


def test_event_channel_over_micro_batches(spark, tmp_path):
    """Order holds behind a full channel, an event may expire while it waits, and one that expires just now is neither delivered nor gone."""
    from batchloom.streaming import events

    parts = [
        [("j", 1, 10, 100, 0), ("j", 2, 11, 100, 0), ("j", 3, 12, 15, 0), ("j", 4, 12, 100, 0), ("k", 9, 10, 10, 0)],
        [("j", 5, 20, 0, 1), ("j", 6, 21, 90, 0), ("", 0, 25, 0, 1)],  # one slot is free: 3 has expired, so 4 goes
        [("j", 7, 90, 0, 1), ("k", 10, 91, 95, 0)],  # 6 expires at 90: neither
        [("", 0, 500, 0, 1)],
    ]
    for part in parts:
        df = spark.createDataFrame(part, "job_id string, id long, sec long, expires long, takes int").withColumn("at", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(events.delivery_stream(stream, 2, "10 seconds"), "channel", "append", tmp_path / "cp")
    got = sorted(map(tuple, spark.table("channel").collect()))
    assert got == [("j", 1, "delivered", 10), ("j", 2, "delivered", 11), ("j", 3, "expired", 15), ("j", 4, "delivered", 20), ("j", 6, "expired", 90), ("k", 9, "expired", 10), ("k", 10, "delivered", 91)]


def test_recovery_holds_share_groups(spark, tmp_path):
    """Holds of one group end at their own times, over micro-batches, as holds with a group each do; the processor is called by groups, not by batches."""
    from batchloom.streaming import recovery

    held = [(f"b{k}", f"r{k}-{j}", 10 + k % 3, 50 + 10 * (k % 7)) for k in range(60) for j in range(3)] + [("zero", "z1", 10, 0), ("zero", "z2", 10, 0)]
    results = [(f"b{k}", f"r{k}-{j}", 20 + k % 50) for k in range(60) for j in range(3) if k % 4 or j]
    parts = [held, results[:80], [*results[80:], ("", "", 65)], [("", "", 80)], [("b8", "r8-0", 85), ("", "", 500)], [("", "", 900)]]
    for part in parts:
        rows = [(b, r, "held", s, w[0]) if w else (b, r, "result", s, 0) for b, r, s, *w in part]
        df = spark.createDataFrame(rows, "batch_id string, request_id string, kind string, sec long, wait_s long").withColumn("at", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for groups in (None, 2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(recovery.recovery_stream(stream, "100 seconds", groups), f"shared_{groups}", "append", tmp_path / f"cp{groups}")
        got.append(sorted(map(str, (tuple(r) for r in spark.table(f"shared_{groups}").collect()))))
    assert got[0] == got[1]
    ends = [x for x in got[1] if "None" in x]
    assert len(ends) == 61 and all(any(kind in x for x in ends) for kind in ("resolved", "timed_out", "skipped"))
    assert len([x for x in got[1] if "None" not in x]) == len(held)
