"""Every query of the stages against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rillwork.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, want.fetchall()))


def test_whole_texts_of_odd_documents(spark, tmp_path):
    """Empty and null texts, ids that repeat (with the same and with other texts) and null ids have a row each."""
    long = "é€😀" * 3000  # several chunks, with characters across their ends
    rows = [(1, "a"), (2, ""), (3, None), (4, long), (4, long), (4, "other" + long), (5, ""), (5, None), (5, "b")]
    rows += [(None, long), (None, ""), (None, None), (6, None), (6, None), (7, "\0 \n"), (8, "x" * 8192), (9, "x" * 8191 + "é")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = QUERIES["bytes2text_whole"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(ORACLE["bytes2text_whole"]).fetchall()
    assert len(want) == len(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
