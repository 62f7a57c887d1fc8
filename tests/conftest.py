import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def same_rows(spark_df, sql, sf=SF):
    """Compares a query with its SQL in DuckDB, cell by cell, rows in any order."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    cell = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(([cell(row[c]) for c in order] for row in spark_df.collect()), key=str)
    want = sorted(([cell(row[names.index(c)]) for c in order] for row in r.fetchall()), key=str)
    assert got == want
