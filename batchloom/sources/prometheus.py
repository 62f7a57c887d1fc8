"""Metrics as text, as a monitor scrapes them, and the answers of its range queries as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
_SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})? +([^ ]+)(?: +[0-9-]+)?$"


def escape_label(value: Column) -> Column:
    text = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def unescape_label(text: Column) -> Column:
    """Escapes are read once, from left to right: a backslash that was escaped begins no other."""
    parts = F.transform(F.split(text, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))
    return F.array_join(parts, "\\")


def number(value: Column) -> Column:
    """A sample's value as text: NaN and infinities by name, a whole number without a point."""
    v = value.cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, F.floor(v).cast("string")).otherwise(v.cast("string"))


def read_number(text: Column) -> Column:
    return F.when(F.lower(text).isin("+inf", "inf"), float("inf")).when(F.lower(text) == "-inf", float("-inf")).when(F.lower(text) == "nan", float("nan")).otherwise(text.try_cast("double"))


def _labels(pairs: Sequence[tuple[str, Column]]) -> Column:
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{n}="'), escape_label(v), F.lit('"')) for n, v in pairs])
    return F.concat(F.lit("{"), inner, F.lit("}")) if pairs else F.lit("")


def _head(spark: SparkSession, name: str, kind: str) -> DataFrame:
    rank = F.struct(F.lit(0).alias("part"), F.lit("").alias("series"), F.lit(0.0).alias("at")).alias("rank")
    return spark.range(1).select(F.lit(name).alias("family"), rank, F.lit(f"# TYPE {name} {kind}").alias("line"))


def _lines(rows: DataFrame, family: str, name: str, labels: Sequence[str], value: Column, at: Column, extra: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    own = sorted(labels)
    series = F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in own])) if own else F.lit("")
    rank = F.struct(F.lit(1).alias("part"), series.alias("series"), at.alias("at")).alias("rank")
    return rows.select(F.lit(family).alias("family"), rank, F.concat(F.lit(name), _labels([*((n, F.col(n)) for n in own), *extra]), F.lit(" "), number(value)).alias("line"))


def expose(samples: DataFrame, name: str, labels: Sequence[str] = (), kind: str = "counter", value: str = "value") -> DataFrame:
    """(family, rank, line) of a counter or gauge: a line of its type, then one a sample. Sorted by family and rank they are an exposition."""
    return _head(samples.sparkSession, name, kind).unionByName(_lines(samples, name, name, labels, F.col(value), F.lit(0.0)))


def expose_histogram(cumulative: DataFrame, sums: DataFrame, name: str, labels: Sequence[str] = ()) -> DataFrame:
    """(family, rank, line) of a histogram (labels..., le, n) and its sums (labels..., sum): a series' buckets by bound, then its sum and count."""
    total = cumulative.groupBy(*labels).agg(F.max("n").alias("n"))
    last = F.lit(float("nan"))  # in Spark's order it comes after infinity
    out = _lines(cumulative, name, f"{name}_bucket", labels, F.col("n"), F.col("le").cast("double"), [("le", number(F.col("le")))])
    out = out.unionByName(_lines(sums, name, f"{name}_sum", labels, F.col("sum"), last)).unionByName(_lines(total, name, f"{name}_count", labels, F.col("n"), last))
    return _head(cumulative.sparkSession, name, "histogram").unionByName(out)


def read_exposition(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, labels, value) of an exposition's samples; comments, empty lines and lines that can't be read are left out."""
    part = lambda k: F.regexp_extract(F.col(line), _SAMPLE, k)
    names, values = (F.regexp_extract_all(part(2), F.lit(_LABEL), F.lit(k)) for k in (1, 2))
    rows = lines.filter(F.col(line).rlike(_SAMPLE) & ~F.col(line).startswith("#"))
    return rows.select(part(1).alias("name"), F.map_from_arrays(names, F.transform(values, unescape_label)).alias("labels"), read_number(part(3)).alias("value")).filter("value is not null")


_RANGE = "status string, data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"


def read_range(answers: DataFrame, body: str = "body") -> DataFrame:
    """(labels, ts, value) of the answers of range queries, [ts, "value"] pairs of each series; answers without success have no rows."""
    data = answers.select(F.from_json(body, _RANGE).alias("a")).filter("a.status = 'success'")
    series = data.select(F.explode("a.data.result").alias("s"))
    points = series.select(F.col("s.metric").alias("labels"), F.explode("s.values").alias("v")).filter(F.size("v") == 2)
    return points.select("labels", F.col("v")[0].try_cast("double").alias("ts"), read_number(F.col("v")[1]).alias("value"))
