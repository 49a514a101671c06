"""What SQL can say of the operators, against that SQL on the smallest tables."""

import os

import pytest

from basalt.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, wanted = queries.QUERIES[name](spark, FOLDER), c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    columns = sorted(df.columns)
    place = [wanted.columns.index(x) for x in columns]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in wanted.fetchall()), key=repr)
