"""Each registered query beside its SQL in DuckDB over the smallest tables."""

import glob
import os

import pytest

from tessera.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    ours = queries.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(ours) == rows(theirs)


def test_documents_without_the_aliased_segment(spark, duck, tmp_path):
    """One of many documents has no customer of the segment that the alias stands for; the alias is used all the same."""
    for name in ("nation", "region"):
        duck.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    duck.sql(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey // 50 = 1 AND c_mktsegment = 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment) FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    want = duck.sql(queries.SQL["lint_documents"]).fetchall()  # the SQL reads keys and nations only
    assert sorted(map(tuple, queries.QUERIES["lint_documents"](spark, str(tmp_path)).collect())) == sorted(want)


def test_entry_without_extras():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
