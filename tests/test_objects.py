"""Files by byte ranges, and objects that are seen whole or not at all."""

import random

import pytest
from pyspark.sql import functions as F

from batchloom.sources import lines, objects


def test_a_file_is_read_in_many_tasks(spark, tmp_path):
    r = random.Random(2)
    rows = [bytes(r.choice(b"ab \r\xc3\xa9") for _ in range(r.choice((0, 1, 7, 300)))) for _ in range(3000)]
    (tmp_path / "large.jsonl").write_bytes(b"\n".join(rows))  # the last line is not terminated
    (tmp_path / "marked.jsonl").write_bytes(b"\xef\xbb\xbfone\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = lines.read_lines(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(x["path"].rsplit("/", 1)[1], x["ordinal"]): (x["offset"], x["length"], bytes(x["raw"])) for x in df.withColumn("raw", F.col("line").cast("binary")).drop("line").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, at = {("marked.jsonl", 0): (3, 4, b"one"), ("marked.jsonl", 1): (7, 4, b"two")}, 0
    for k, x in enumerate(rows[:-1] if rows[-1] == b"" else rows):
        want["large.jsonl", k] = (at, len(x) + 1, x)
        at += len(x) + 1
    assert got == want


def test_ordinals_alone_need_no_sort(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\ny\n")
    plan = lines.read_lines(spark, str(tmp_path)).select("ordinal", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert "earlier" not in plan


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith(".") and "_outcomes" not in p.parts)


def rows(spark, data):
    return spark.createDataFrame(data, "object string, ordinal long, line string")


def test_limits_hold_while_writing(spark, tmp_path):
    data = [("a/x.jsonl", k, f"line {k}") for k in range(10)] + [("a/y.jsonl", k, "z" * 50) for k in range(3)] + [("b.jsonl", 0, None), (None, 0, "lost")]
    got = {r["object"]: r for r in objects.write_objects(rows(spark, data[::-1]), str(tmp_path), most_bytes=120, most_lines=9).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a/x.jsonl": "too_many_lines", "a/y.jsonl": "too_large", "b.jsonl": "created"}
    assert files(tmp_path) == ["b.jsonl"] and (tmp_path / "b.jsonl").read_bytes() == b"\n"
    assert got["a/x.jsonl"]["name"] is None and got["b.jsonl"]["bytes"] == 1


def test_names_are_created_once(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    first = [("r/1.jsonl", 1, "b"), ("r/1.jsonl", 0, "a"), ("r/2.jsonl", 0, "c")]
    objects.write_objects(rows(spark, first), root)
    again = objects.write_objects(rows(spark, first[:2] + [("r/2.jsonl", 0, "other")]), root)
    assert sorted((r["object"], r["outcome"]) for r in again.collect()) == [("r/1.jsonl", "created"), ("r/1.jsonl", "same"), ("r/2.jsonl", "created"), ("r/2.jsonl", "taken")]
    for _ in range(2):  # a replay ends with the same objects
        objects.write_objects(rows(spark, [("r/2.jsonl", 0, "other")]), root, fallback=True)
        assert len(files(tmp_path / "o")) == 3
    assert (tmp_path / "o/r/1.jsonl").read_bytes() == b"a\nb\n" and (tmp_path / "o/r/2.jsonl").read_bytes() == b"c\n"
    with pytest.raises(Exception, match="never overwritten"):
        rows(spark, first).select("object", "line").write.format("batch_objects").mode("overwrite").save(root)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("line") == "c", F.raise_error(F.lit("broken row"))).otherwise(F.col("line"))
    data = rows(spark, [("1", 0, "a"), ("2", 0, "b"), ("3", 0, "c")]).repartition(3, "object")
    spark.dataSource.register(objects.ObjectSink)
    with pytest.raises(Exception, match="broken row"):
        data.select("object", bad.alias("line")).write.format("batch_objects").mode("append").save(str(tmp_path))
    assert files(tmp_path) == []


def test_the_commit_reads_no_objects_that_its_tasks_have_read(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/o"
    first = [(f"r/{k}.jsonl", 0, "a") for k in range(5)]
    again = [(f"r/{k}.jsonl", 0, "a" if k % 2 else "b") for k in range(5)]
    objects.write_objects(rows(spark, first), root, tasks=3)
    # A commit as the driver makes it, of what a task has listed.
    writer = objects.ObjectWriter({"path": root, "fallback": "true"})
    import pyarrow as pa

    done = writer.write(iter([pa.RecordBatch.from_pylist([{"object": o, "line": x} for o, _, x in again])]))
    read = []
    digest = objects._digest
    monkeypatch.setattr(objects, "_digest", lambda store, place: read.append(place) or digest(store, place))
    writer.commit([done])
    assert read == []
    got = sorted((r["object"], r["outcome"]) for r in objects.outcomes(spark, root).collect())
    assert got == sorted([(o, "created") for o, _, _ in first] + [(o, "fallback" if x == "b" else "same") for o, _, x in again])
    # A name that was taken between the task and the commit is found by the commit.
    late = objects.ObjectWriter({"path": root})
    done = late.write(iter([pa.RecordBatch.from_pylist([{"object": "r/new.jsonl", "line": "mine"}])]))
    (tmp_path / "o/r/new.jsonl").write_text("other\n")
    read.clear()
    late.commit([done])
    assert len(read) == 1 and (tmp_path / "o/r/new.jsonl").read_text() == "other\n"
