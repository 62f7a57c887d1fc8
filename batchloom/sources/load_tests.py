"""Tables of load tests: three header rows over one row of figures, read as rows from any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import read_lines

#: A cell with the comma before it; a line's first one is given one.
_CELL = r',(?:"((?:[^"]|"")*)"|([^,]*))'
HEADERS = ("category", "sub_header", "stat")


def read_load_tests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, phase, cycle, position, category, sub_header, stat, value, number, deciles): a figure a row.

    Cells meet by their positions in the rows. A file's name is its phase and cycle ("burst-2"; no number: cycle 0); a cell that is a number has it in
    ``number``, one that is an array of numbers in ``deciles``. Files of fewer than four rows have none; rows beyond the fourth are left out; a cell has no line feed.
    """
    rows = read_lines(spark, path).filter("ordinal < 4").select("path", "ordinal", F.concat(F.lit(","), F.rtrim("line", F.lit("\r"))).alias("line"))
    whole = rows.withColumn("rows", F.count("*").over(W.partitionBy("path"))).filter("rows = 4")
    quoted, plain = (F.regexp_extract_all("line", F.lit(_CELL), F.lit(k)) for k in (1, 2))
    cells = whole.select("path", "ordinal", F.posexplode(F.arrays_zip(quoted.alias("q"), plain.alias("p"))).alias("position", "cell"))
    text = F.when(F.col("cell.q") != "", F.replace("cell.q", F.lit('""'), F.lit('"'))).otherwise(F.col("cell.p"))
    at = lambda k, name: F.max(F.when(F.col("ordinal") == k, F.col("text"))).alias(name)
    met = cells.withColumn("text", text).groupBy("path", "position").agg(*[at(k, n) for k, n in enumerate((*HEADERS, "value"))])
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    phase, cycle = F.regexp_extract(stem, r"^(.*)-[0-9]+$", 1), F.regexp_extract(stem, r"-([0-9]+)$", 1)
    array = F.from_json("value", "array<double>")
    return met.filter("value is not null").select(
        "path", F.when(cycle != "", phase).otherwise(F.when(F.contains(stem, F.lit("-")), F.regexp_extract(stem, r"^(.*)-[^-]*$", 1)).otherwise(stem)).alias("phase"), F.coalesce(cycle.try_cast("int"), F.lit(0)).alias("cycle"),
        F.col("position").cast("int").alias("position"), *[F.coalesce(n, F.lit("")).alias(n) for n in HEADERS], "value",
        F.trim("value").try_cast("double").alias("number"), F.when(F.ltrim("value").startswith("["), array).alias("deciles"),
    )


def figure(tests: DataFrame, category: str, sub_header: str = "", stat: str = "") -> DataFrame:
    """(path, phase, cycle, number, deciles) of the first figure whose headers hold these words; an empty word asks for an empty header."""
    fits = lambda n, word: F.contains(n, F.lit(word)) if word else F.trim(n) == ""
    hit = tests.filter(fits("category", category) & fits("sub_header", sub_header) & fits("stat", stat))
    return hit.groupBy("path", "phase", "cycle").agg(F.min_by(F.struct("number", "deciles"), "position").alias("f")).select("path", "phase", "cycle", "f.number", "f.deciles")
