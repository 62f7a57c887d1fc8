"""The registered queries over a whole small table, against SQL or brute force."""

import hashlib
import tempfile
from collections import defaultdict

import pytest

from batchloom.llm import queries

from ..conftest import SF, same_rows
from . import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name])


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_repeats(spark):
    rows = documents(spark)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_repeats(spark, SF).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute.repeats([t for _, t in rows], 400))}


def test_lines(spark):
    rows = documents(spark)
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op8_line_dedup(spark, SF).collect()}
    kept = {}
    lines = defaultdict(set)
    for d, t in rows:  # exact copies by brute force; near ones are in the operator's own test
        for x in (t or "").split("\n"):
            lines[x].add(d)
    assert set(got) == {d for d, _ in rows}
    for d, t in rows:
        if all(len(lines[x]) == 1 for x in t.split("\n")) and len(set(t.split("\n"))) == len(t.split("\n")):
            kept[d] = hashlib.sha256(t.encode()).hexdigest()
    assert sum(got[d] == h for d, h in kept.items()) >= len(kept) - 2


#: There the labels teach enough that each stage has rows to drop.
LARGER = "/root/testdata/sf0.01"


def test_pipeline(spark, tmp_path):
    import duckdb

    import corpus_pipeline as P

    sf = LARGER
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {d for d, _ in rows} and rows
            break
        assert after.columns == columns
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        assert 0.5 * len(rows) < len(left) < len(rows), f"{name} keeps rows and drops rows"
        if name == "toxicity":
            bad = {r["doc_id"] for r in queries.op6_toxicity(spark, sf).filter("predicted = 1").collect()}
            assert set(left) == {d for d, _ in rows} - bad
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
            assert len(bad & toxic) > 0.5 * len(toxic)
        if name == "line_dedup":
            con = duckdb.connect()
            con.execute(f"create view documents as select doc_id, text from '{tmp_path}/toxicity/*.parquet'")
            want = {r[0]: r[1] for r in con.execute(f"select doc_id, kept_sha256 from ({queries.OP8_SQL})").fetchall()}
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in left.items()} == {d: want[d] for d in left}
            texts = dict(rows)
            assert any(left[d] != texts[d] for d in left)
            assert all(want[d] != hashlib.sha256((texts[d] or "").encode()).hexdigest() for d in set(texts) - set(left) if (texts[d] or "").strip())
        if name == "ngram_join":
            _, _, roots = brute.links([t for _, t in rows], 5, 80)
            assert set(left) == {min(rows[k][0] for k, q in enumerate(roots) if q == r) for r in set(roots)}
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(left) == {d for d, t in rows if not brute.contamination(t, items)[1]}
        before = after
    assert P.run(spark, sf).count() == after.count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows, and columns whose names the stages use themselves: every stage gives the columns that it got."""
    import corpus_pipeline as P

    sf = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(40).write.parquet(f"{sf}/{t}.parquet")
    names = ["n", "key", "version", "component", "cluster", "id", "row", "others", "line", "no", "hit", "toxic", "score", "__id", "task", "side", "cid"]
    full = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", *[f"doc_id as `{n}`" for n in names])
    odd = spark.createDataFrame([(None, None, "x"), (900, "", "x"), (901, None, "x"), (901, None, "x")], "doc_id long, text string, lang string")
    for docs in (full.limit(0), full.unionByName(odd, allowMissingColumns=True)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            folder = tempfile.mkdtemp(dir=sf)
            out.write.mode("overwrite").parquet(folder)
            docs = spark.read.schema(out.schema).parquet(folder)
        for r in docs.collect():
            assert all(r[n] == r["doc_id"] for n in names if r[n] is not None)
        assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, sf).collect()} <= {r["doc_id"] for r in docs.collect()}
