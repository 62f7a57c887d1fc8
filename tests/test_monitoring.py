"""Metrics as text, range answers, load-test tables, and the gauge of requests in flight."""

import random

from pyspark.sql import functions as F

from batchloom.operators import metrics
from batchloom.sources import load_tests, prometheus


def test_exposition_is_read_back(spark):
    hard = ['a"b', "back\\slash", "line\nfeed", "\\n", "\\\\n\"", "", "plain", "ü, {x}=1"]
    df = spark.createDataFrame([(h, k, v) for h in hard for k, v in ((1, 0.5), (2, float("nan")))] + [("x", 3, float("inf")), ("y", 3, -2.0)], "name string, k long, value double")
    shown = prometheus.expose(df, "jobs_total", ["name", "k"])
    lines = [r["line"] for r in shown.orderBy("family", "rank").collect()]
    assert lines[0] == "# TYPE jobs_total counter" and 'jobs_total{k="3",name="x"} +Inf' in lines and 'jobs_total{k="3",name="y"} -2' in lines
    assert all("\n" not in x for x in lines)
    back = prometheus.read_exposition(shown).collect()
    assert sorted((r["labels"]["name"], int(r["labels"]["k"]), str(r["value"])) for r in back) == sorted((r["name"], r["k"], str(r["value"])) for r in df.collect())


def test_histogram_lines_are_in_order(spark):
    df = spark.createDataFrame([("b", 0.1), ("b", 7.0), ("a", 3.0)], "job string, v double")
    shown = prometheus.expose_histogram(metrics.histogram(df, F.col("v"), [0.5, 5.0, 10.0], ["job"]), df.groupBy("job").agg(F.sum("v").alias("sum")), "wait", ["job"])
    lines = [r["line"] for r in shown.orderBy("family", "rank", "line").collect()]
    assert lines == [
        "# TYPE wait histogram", 'wait_bucket{job="a",le="0.5"} 0', 'wait_bucket{job="a",le="5"} 1', 'wait_bucket{job="a",le="10"} 1', 'wait_bucket{job="a",le="+Inf"} 1', 'wait_count{job="a"} 1', 'wait_sum{job="a"} 3',
        'wait_bucket{job="b",le="0.5"} 1', 'wait_bucket{job="b",le="5"} 1', 'wait_bucket{job="b",le="10"} 2', 'wait_bucket{job="b",le="+Inf"} 2', 'wait_count{job="b"} 2', 'wait_sum{job="b"} 7.1',
    ]


def test_lines_that_are_no_samples(spark):
    df = spark.createDataFrame([("# HELP x y",), ("",), ("no value",), ("up 1",), ('up{a="1",} 2 1700000000',), ("broken{ 3",), ("x nan",)], "line string")
    assert sorted((r["name"], str(r["labels"]), str(r["value"])) for r in prometheus.read_exposition(df).collect()) == [("up", "{'a': '1'}", "2.0"), ("up", "{}", "1.0"), ("x", "{}", "nan")]


def test_range_answers(spark):
    good = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"up","job":"a"},"values":[[1700000000.5,"1"],[1700000015,"NaN"],[1700000030,"-Inf"],[1]]},{"metric":{},"values":[]}]}}'
    df = spark.createDataFrame([(good,), ('{"status":"error"}',), ("broken",), (None,)], "body string")
    got = [(r["labels"]["job"], r["ts"], str(r["value"])) for r in prometheus.read_range(df).orderBy("ts").collect()]
    assert got == [("a", 1700000000.5, "1.0"), ("a", 1700000015.0, "nan"), ("a", 1700000030.0, "-inf")]


def test_load_tests(spark, tmp_path):
    head = "Requests,Time to First Token,,Time to First Token\r\nSuccessful,Successful ms,,Successful ms\r\n,Median,,Percentiles\r\n"
    (tmp_path / "burst-12.csv").write_text(head + '7,"1,5",,"[1, 2.5]"\r\nmore,rows,are,left\r\n')
    (tmp_path / "idle.csv").write_text(head + "8,4.5,,[]")
    (tmp_path / "warm-up-x.csv").write_text(head + "9,1,,oops")
    (tmp_path / "short-1.csv").write_text("Requests\n")
    tests = load_tests.read_load_tests(spark, str(tmp_path))
    got = {(r["phase"], r["cycle"], r["position"]): (r["category"], r["stat"], r["value"], r["number"], r["deciles"]) for r in tests.collect()}
    assert got["burst", 12, 0] == ("Requests", "", "7", 7.0, None) and got["burst", 12, 1] == ("Time to First Token", "Median", "1,5", None, None)
    assert got["burst", 12, 3][4] == [1.0, 2.5] and got["idle", 0, 3][4] == [] and got["warm-up", 0, 3][3:] == (None, None)
    assert {(r["phase"], r["number"]) for r in load_tests.figure(tests, "Requests", "Successful").collect()} == {("burst", 7.0), ("idle", 8.0), ("warm-up", 9.0)}
    assert {r["number"] for r in load_tests.figure(tests, "First Token", "ms", "Median").collect()} == {None, 4.5, 1.0}


def test_in_flight(spark):
    r = random.Random(4)
    rows = [("a", s, s + r.randrange(40)) for s in (r.randrange(300) for _ in range(200))] + [("b", 5, None), ("b", 5, 5), ("b", 9, 3), ("b", None, 4)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    for span in (7, 100, 10_000):
        gauge = metrics.in_flight(df, ["k"], span=span)
        got = {(x["k"], x["at"]): (x["in_flight"], x["until"]) for x in gauge.collect()}
        want = {}
        for k in "ab":
            mine = [(s, e) for q, s, e in rows if q == k and s is not None and (e is None or e >= s)]
            times = sorted({t for x in mine for t in x if t is not None})
            for t, u in zip(times, [*times[1:], None]):
                want[k, t] = (sum(s <= t and (e is None or e > t) for s, e in mine), u)
        assert got == want
    top = {x["k"]: x["peak"] for x in metrics.in_flight_summary(gauge, ["k"]).collect()}
    assert top == {k: max(v for (q, _), (v, _) in want.items() if q == k) for k in "ab"}


def test_bucket_growth_is_the_growth_of_buckets(spark):
    from pyspark.sql import Window

    r = random.Random(5)
    rows = [(k, r.randrange(2000), i, r.choice([0.1, 0.7, 3.0, None])) for i in range(400) for k in ("ab" if i % 3 else "a")]
    df = spark.createDataFrame([*rows, ("a", 500, 900, 0.1), ("a", 1000, 901, 9.0), ("b", 1000, 902, 0.1)], "k string, at long, id long, v double")
    bounds, run = [0.5, 1.0], 500
    every = df.withColumn("le", F.explode(F.array(*map(F.lit, [*bounds, float("inf")]))))
    counted = F.sum(F.coalesce((F.col("v") <= F.col("le")).cast("long"), F.lit(0))).over(Window.partitionBy("k", "le", F.floor(F.col("at") / run)).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    grown = metrics.growth(every.withColumn("value", counted.cast("double")), ["k", "le"], ties=["id"])
    for window, step in ((120, 30), (77, 7)):  # panes of 7 lie in two runs
        want = metrics.range_growth(grown, ["k", "le"], window, step, ties=["id"]).collect()
        got = metrics.bucket_growth(df, F.col("v"), bounds, ["k"], window, step, run, ties=["id"]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_an_answer_is_bounded(spark, monkeypatch):
    from batchloom import queries_metrics
    from tests.conftest import SF

    sizes = []
    read = prometheus.read_range
    monkeypatch.setattr(prometheus, "read_range", lambda a: (sizes.append(a.select(F.max(F.length("body")), F.count("*")).first()), read(a))[1])
    assert queries_metrics.range_answers(spark, SF).select(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(queries_metrics, "_ANSWER_SAMPLES", 10)
    assert queries_metrics.range_answers(spark, SF).select(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert sizes[1][0] < 1000 and sizes[1][1] > sizes[0][1]


def test_answers_hold_samples_without_a_value_time_or_user(spark, tmp_path):
    import duckdb

    from batchloom import queries, queries_metrics

    day = "timestamp_ntz'2024-01-01 00:00:01.5'"
    values = [None, float("nan"), 0.0, float("inf"), float("-inf"), 1e-7, 0.1 + 0.2, 1.5e300]
    rows = [(i, k % 4 != 1, None if k % 4 == 2 else k, v) for k in range(4) for i, v in enumerate(values, 100 + 100 * k)] + [(None, True, 3, 2.0), (50, True, 3, None)]
    df = spark.createDataFrame(rows, "event_id long, timed boolean, user_id long, value double")
    df.select("event_id", F.expr(f"case when timed then {day} end").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props")).coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = queries_metrics.range_answers(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(f"select endpoint, ts, value, n from ({queries.SQL['range_answers']})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r["endpoint"], r["ts"], r["value"], r["n"])) for r in got.collect())
