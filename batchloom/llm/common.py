"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: texts may be long, and a worker holds one batch at a time.
BATCH_ROWS = 500

_shipped: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and there are no other machines (tests, a laptop) a local one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="batchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/batchloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read again: later losses of executors don't reach back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one run in a folder of its own under the shared one; those that a result doesn't read are deleted when they have served."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, new_folder(spark, label)
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.names.append(name)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        self.drop(*[n for n in self.names if n not in names])

    def drop(self, *names: str) -> None:
        self.names = [n for n in self.names if n not in names]
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package once per application, wherever the driver started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(prefix="batchloom-ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over plain Python columns: ``rows`` gets an iterator of {column: list} and yields such."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for b in batches:
                yield {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}

        for out in rows(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def raw_text(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def draw(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of their keys; a filter by another hash comes first, so that
    no task has to send its own ``n``."""
    total = df.count()
    if total > 4 * n:
        df = df.filter(F.pmod(F.xxhash64(*keys, F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def collect_within(df: DataFrame, label: str, most: int, *columns: str) -> list:
    """Collects the rows of ``df``, whose number the caller bounds; the rows longest by ``columns`` are left out until the
    others have at most ``most`` bytes there, so that very long texts don't fill the driver."""
    scratch = Scratch(df.sparkSession, label)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
    rows = scratch.table(df, "rows")
    limit, total = -1, 0
    for r in sorted(rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()):
        total += r["size"] * r["n"]
        if total > most:
            break
        limit = r["size"]
    out = rows.filter(size <= limit).collect()
    scratch.drop("rows")
    return out


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5: the contract's held-out fold is remainder 0 (a null id has none)."""
    return F.crc32(doc_id.cast("string")) % 5
