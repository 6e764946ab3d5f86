import datetime
import decimal

import duckdb
import pytest

from gleaner import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for n in TABLES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLES:
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    key = lambda r: str([plain(r[c]) for c in cols])
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_stream(spark, tmp_path, sf_dir):
    from gleaner.streaming import events as ev

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ev.windowed_counts(ev.read_events(spark, str(tmp_path / "in"), table.schema, 10))
    ev.run_to_table(stream, "counts", str(tmp_path / "cp"), "complete")
    assert spark.table("counts").count() == ev.windowed_counts(table).count()
