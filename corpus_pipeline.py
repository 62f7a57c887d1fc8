"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it
again as the next stage's documents. All stages but the last return the columns of ``documents``; where
a stage changes a text, a column n_chars follows it.

Defined cases: a null or empty text passes every filter, as it has nothing toxic, no line, no shingle and no window, and is packed as its end id
alone; repeated rows of one id and text are near copies, of which one stays; rows of one id and different texts are judged each by
its own text; a null id takes part, and of near copies ids that aren't null come first; very long texts are read whole by every stage; columns beside doc_id
and text go through unread, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import bpe, decontaminate, line_dedup, ngram_join, packing, toxicity
from batchloom.llm.common import Scratch, read_table

#: Near-duplicate documents: shares of five-word shingles, in percent.
SHINGLE_WORDS = 5
JACCARD_PERCENT = 80
WINDOW_WORDS = 10
CAPACITY = 1024
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what is predicted toxic; where the labels teach nothing, all rows."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document or line holds; ties go by id and line. A document goes if it lost lines and nothing but blank ones is left."""
    out = line_dedup.keep_lines(docs, least=1)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id."""
    return ngram_join.keep_one(docs, SHINGLE_WORDS, JACCARD_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), WINDOW_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece of a document."""
    return packing.pack(docs, bpe.default_path(), CAPACITY, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Learned scores and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
