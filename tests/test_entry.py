import duckdb
import pytest

import __spark_entry__

SQL = sorted(__spark_entry__.oracle_sql())


def test_the_flagship_query_has_rows(spark, data):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in SQL if n != "plain_word_counts"])
def test_queries_agree_with_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("release", "predictions", "judge_cache", "raw_predictions", "documents", "eval_items", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in sorted(df.columns)]
    assert sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())
