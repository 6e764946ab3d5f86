import duckdb
import pytest

from gleaner.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, sf)
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall())
    assert sorted(map(tuple, df.collect())) == want
