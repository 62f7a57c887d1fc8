"""The pipeline's filters on small rows."""

from pyspark.sql import functions as F

from batchloom.llm import line_dedup


def test_documents_without_lines_left_go(spark):
    a, b = "a line of twenty or more code points", "another line of quite some length"
    rows = [(1, f"{a}\nshort"), (2, f"{a}\nshort"), (3, f"{a}\n{b}"), (4, "tiny"), (5, None), (6, ""), (7, f"{b}!\ntiny"), (None, a)]
    names = ("__lines", "__kept", "__doc", "__version", "__n_copies", "__copies", "__links", "row", "id", "kept", "n_near")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names}).withColumn("n_chars", F.length("text"))
    out = line_dedup.keep_lines(df)
    assert all(r[c] == c for r in out.collect() for c in names)
    assert out.columns == df.columns
    # A null id comes first in the order, so its line stays and the others are copies.
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {None: a, 3: b, 4: "tiny", 5: None, 6: ""}


def test_pipeline_keeps_documents_with_short_lines_left(spark):
    import corpus_pipeline

    a = "a licence of twenty or more code points"
    rows = [(1, a), (2, f"{a}\nroses are red\nviolets are blue"), (3, f"{a}\n\n \t"), (4, f"x\n{a}"), (5, "\n"), (6, None)]
    out = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: a, 2: "roses are red\nviolets are blue", 4: "x", 5: "\n", 6: None}
