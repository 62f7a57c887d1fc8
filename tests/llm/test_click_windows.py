"""Expiring click windows against a fold in plain Python, over batches, late rows, ties and odd rows."""

import math
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from batchloom.llm import click_windows

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour long"
T0 = 473_352  # 2024-01-01, in hours


def clicks(spark):
    """Hours of three weeks; ids that are negative, null and many times there; equal rows; a very long field."""
    rows = []
    for k in range(300):
        arrived = T0 + (k * 37) % 500
        rows.append((k % 60 if k % 3 else 7, arrived - 1, arrived, k % 4, None if k % 5 == 0 else "view", None if k % 7 == 0 else k % 6 + 0.125, "x" * 70_000 if k == 5 else "p", k))
    rows += rows[:20] + [(None, T0, T0, 1, "a", 1.0, "", 0), (4, T0, None, 1, "a", 1.0, "", 0), (-5, T0, T0, 1, "a", float("nan"), None, 0), (-5, T0, T0, 1, "a", 0.0, "", 0)]
    df = spark.createDataFrame(rows, "click_id long, t long, a long, client_id long, kind string, value double, props string, hour long")
    ntz = lambda c: F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz")
    return rows, df.select("click_id", ntz("t").alias("ts"), ntz("a").alias("arrived_at"), "client_id", "kind", "value", "props", "hour")


def brute(rows, batches, span, late):
    made = []
    for i, t, a, client, kind, value, props, _ in rows:
        if i is None or a is None:
            continue
        number = "" if value is None else 0 if value != value else math.floor(100 * value + 0.5)
        for j in range(i % 3 + 1):
            c = zlib.crc32(f"{i}:{j}".encode())
            hour = a + 6 * j * (c % 10)
            text = "|".join(str("" if x is None else x) for x in (client, kind, number, t * 3_600_000_000, props, c % 3))
            made.append((hour + c // 10 % 200, i, hour, sha256(text.encode()).hexdigest()))
    low, high = min(made)[0], max(made)[0]
    open_, out, top = {}, [], None
    for b in range(batches):
        groups = defaultdict(list)
        mine = [r for r in made if (r[0] - low) * batches // (high - low + 1) == b]
        for _, i, hour, digest in mine:
            if top is None or hour >= top - late:
                groups[i].append((hour, digest))
        for i, came in groups.items():
            for hour, digest in sorted(came):
                w = open_.get(i)
                if w and hour <= w[0] + span:
                    bad = digest != w[1]
                    open_[i] = (w[0], w[1], w[2] + 1, w[3] + bad, w[4] + (zlib.crc32(digest.encode()) if bad else 0))
                    continue
                if w:
                    out.append((i, w[0], b, *w[2:], w[1]))
                open_[i] = (hour, digest, 0, 0, 0)
        top = max([r[2] for r in mine] + ([] if top is None else [top]), default=None)
        for i in [i for i, w in open_.items() if b == batches - 1 or w[0] + span < top - late]:
            w = open_.pop(i)
            out.append((i, w[0], b, *w[2:], w[1]))
    return sorted(out)


@pytest.mark.parametrize("batches, span, late, group_rows", [(3, 24, 96, 50), (2, 5, 24, 0)])
def test_windows(spark, batches, span, late, group_rows):
    rows, df = clicks(spark)
    got = click_windows.dedup(click_windows.copies(df), batches, span, late, group_rows)
    assert got.columns == ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]
    found = sorted(map(tuple, got.collect()))
    assert found == brute(rows, batches, span, late)
    assert {w[2] for w in found} == set(range(batches))


def test_empty_table(spark):
    assert click_windows.dedup(click_windows.copies(spark.createDataFrame([], CLICKS))).collect() == []


def test_zone_of_the_session_is_no_matter(spark):
    _, df = clicks(spark)
    first = sorted(map(tuple, click_windows.copies(df).collect()))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted(map(tuple, click_windows.copies(df).collect())) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
