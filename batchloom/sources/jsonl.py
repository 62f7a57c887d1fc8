"""Sources and sinks: plan files, model maps, load-test tables, synthetic requests."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_PLAN = struct.Struct("<qII")


def pack_plan(entries: Iterable[tuple[int, int, int]]) -> bytes:
    """Plan entries (offset, length, prefix hash), 16 bytes each, little endian."""
    return b"".join(_PLAN.pack(*e) for e in entries)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, offset, length, prefix_hash) of plan files; a size that isn't a multiple of 16 has no rows but an error."""
    whole = spark.read.format("binaryFile").load(path).select("path", F.hex("content").alias("h"), F.octet_length("content").alias("n"))
    checked = whole.withColumn("h", F.when(F.col("n") % 16 == 0, F.col("h")).otherwise(F.raise_error(F.lit("plan file size is not a multiple of 16"))))
    rows = checked.filter("n > 0").select("path", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 16).cast("int") - 1)).alias("position"), "h")

    def number(first: int, size: int):
        parts = [F.substring(F.col("h"), F.col("position") * 32 + 2 * (first + i) + 1, F.lit(2)) for i in reversed(range(size))]
        return F.conv(F.concat(*parts), 16, 10).cast("long")

    return rows.select("path", F.col("position").cast("long").alias("position"), number(0, 8).alias("offset"), number(8, 4).alias("length"), number(12, 4).alias("prefix_hash"))


def read_model_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model_to_safe map<string,string>, safe_to_model map<string,string>, line_count long, rejected_count long").json(path, multiLine=True)


def load_test_row(text: str) -> dict[str, str]:
    """One load test's figures, by name: three header rows (group, name, unit) over one row of values."""
    import csv

    rows = list(csv.reader(text.splitlines()))
    if len(rows) < 4:
        return {}
    group, out = "", {}
    for g, name, unit, value in zip(*rows[:4]):
        group = g or group
        out[" ".join(x for x in (group, name, unit) if x)] = value
    return out


def synthetic_requests(spark: SparkSession, n: int, mean: float, stdev: float, least: int, most: int, systems: int, kind: str = "lognormal", seed: int = 42) -> DataFrame:
    """(i, tokens, system): request lengths of a distribution, clamped, with system prompts in turn."""
    from ..functions.scalars import lognormal_parameters

    mu, sigma = lognormal_parameters(F.lit(float(mean)), F.lit(float(stdev)))
    z = F.randn(seed)
    drawn = {
        "fixed": F.lit(float(mean)), "normal": F.lit(float(mean)) + z * F.lit(float(stdev)), "lognormal": F.exp(mu + sigma * z),
        "uniform": F.lit(float(least)) + F.rand(seed) * F.lit(float(most - least)),
    }[kind]
    tokens = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(drawn).cast("int")))
    return spark.range(n).select(F.col("id").alias("i"), tokens.cast("long").alias("tokens"), (F.col("id") % systems).alias("system"))


def request_line(custom_id: str, model: str, messages: list[dict], url: str = "/v1/chat/completions") -> str:
    return json.dumps({"custom_id": custom_id, "method": "POST", "url": url, "body": {"model": model, "messages": messages}})


class StagedObject:
    """Lines that nobody sees before they are committed: they are written beside their place, under a name that readers skip, and moved there whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        folder, _, name = self.path.rpartition("/")
        self.staged = f"{folder}/_staged-{name}"
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, lines: DataFrame, column: str = "line") -> None:
        lines.select(F.rtrim(F.col(column), F.lit("\n")).alias("value")).write.mode("errorifexists").text(self.staged)

    def commit(self) -> None:
        """An object that is there already stays, and the commit fails."""
        if self._fs.exists(self._at(self.path)):
            raise FileExistsError(self.path)
        if not self._fs.rename(self._at(self.staged), self._at(self.path)):
            raise OSError(f"{self.staged} could not be moved")

    def abort(self) -> None:
        """Takes back what was written; after a commit there is nothing to take back."""
        self._fs.delete(self._at(self.staged), True)
