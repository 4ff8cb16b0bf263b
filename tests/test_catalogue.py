import glob
import os

import duckdb
import pytest

import __spark_entry__
from matchloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_as_duckdb(spark, con, name):
    df = catalogue.QUERIES[name](spark, DIR)
    want = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql()) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_partitioning_changes_no_result(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, catalogue.QUERIES["retrieval_trace"](spark, DIR).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
