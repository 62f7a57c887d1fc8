"""JSON lines of files of any size: Spark cuts a file into byte ranges, and lines keep their numbers and byte offsets.

A line's number depends on all lines before it, so a reader that numbers as it goes takes a file as one task. Here every byte range is
numbered by itself; counts and bytes of the ranges, one row a range, are summed up before them, and each line's place
follows. A range holds the lines that begin in it, as Spark's own text reader deals them, so all of Spark's file systems, its
compressed files (whole) and its retries serve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of the mark that Spark's reader takes off the beginning of a file.
_MARK = 3


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, ordinal, offset, length, line) of text files, cut at line feeds only.

    ``offset`` and ``length`` are bytes in the file, the line feed counted, as an unterminated last line counts as if it had one;
    an empty line is a line, an empty tail none. A byte order mark belongs to no line.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), (F.octet_length("value") + 1).cast("long").alias("length"), F.col("value").alias("line"),
    )
    ranges = rows.groupBy("path", "range").agg(F.count("*").alias("lines"), F.sum("length").alias("bytes"), F.max("size").alias("size"), F.min("at").alias("first"))
    before = W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    marked = F.when(F.col("size") - F.sum("bytes").over(W.partitionBy("path")) >= _MARK - 1, _MARK).otherwise(0)
    starts = ranges.select(
        "path", "range", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"), (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + marked).alias("start")
    )
    # A range is read in order and in one task, so the scan's own ids number its lines; only offsets need a sort, and Spark leaves it out where nobody asks for them.
    earlier = F.sum("length").over(W.partitionBy("path", "range").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(starts, ["path", "range"])
    return placed.select("path", (F.col("at") + F.col("shift")).alias("ordinal"), (F.col("earlier") + F.col("start")).alias("offset"), "length", "line")


def line_limits(lines: DataFrame, most_bytes: int, most_lines: int) -> DataFrame:
    """Per file: bytes, lines and whether it is within the limits of an upload."""
    out = lines.groupBy("path").agg(F.sum("length").alias("bytes"), F.count("*").alias("lines"))
    return out.withColumn("within", (F.col("bytes") <= most_bytes) & (F.col("lines") <= most_lines))
