"""Every registered query on the smallest tables, against DuckDB where it has SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None:
            return ""
        return f"{float(x):.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), columns)


def test_streamed_table_of_several_files(spark, duck, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in entry.queries()["streamed_issue_counts"](spark, str(tmp_path)).select("source", "error", "warning", "style").collect()]
    assert rows and sorted(rows) == sorted(duck.execute(entry.oracle_sql()["streamed_issue_counts"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_payments_are_read_twice_by_the_loan_matrix(spark):
    """Once for the days and once for the sums; the loans they cover are written, not made again by each branch."""
    plan = entry.queries()["loan_matrix"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("l_shipdate#") and plan.count("Relation [l_orderkey#") == 2


def test_loan_matrix_reads_four_tables_and_writes_none(spark):
    """Orders as loans and as rates, line items for the loans they cover and for the days."""
    plan = entry.queries()["loan_matrix"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4 and plan.count("Relation [o_orderkey#") == 2
