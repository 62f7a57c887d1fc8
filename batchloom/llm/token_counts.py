"""Token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens): ``version`` digests the tokenizer's file
and library, ``digest`` is SHA-256 of the normalised content (null as the empty text; the tokenizer's
own normaliser does the rest while encoding). Distinct digests that the cache lacks are encoded once,
appended, and every row takes its count by a join on the digest.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; a null id
stays null; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, new_folder

#: Texts encoded in one call of the library.
ENCODE_ROWS = 64


def _encode(path: str):
    def rows(batches):
        counter = bpe.load(bpe.Counter, path)
        for b in batches:
            counts = []
            for i in range(0, len(b["content"]), ENCODE_ROWS):
                counts += counter.counts(b["content"][i : i + ENCODE_ROWS])
            yield {"digest": b["digest"], "n_tokens": counts}

    return rows


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``cache`` is a folder all executors see (a new one if None)."""
    spark = docs.sparkSession
    cache = cache or new_folder(spark, "token-cache")
    version = bpe.version(tokenizer)
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).select(
        "doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.unhex(F.sha2("content", 256)).alias("digest"), "content"
    )
    spark.createDataFrame([], "digest binary, n_tokens long, version string").write.mode("append").partitionBy("version").parquet(cache)

    def stored() -> DataFrame:
        table = spark.read.schema("digest binary, n_tokens long, version string").parquet(cache)
        return table.filter(F.col("version") == version).select("digest", "n_tokens").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # Copies meet in the map side already, so a text with a third of the rows is shuffled once per task.
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(stored(), "digest", "left_anti")
    encoded = map_arrow(misses.select("digest", "content"), _encode(tokenizer), "digest binary, n_tokens long")
    encoded.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    return keyed.select("doc_id", "n_bytes", "digest").join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
