"""The registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return made


def plain(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, int | float):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_a", "doc_b", "sim", "severity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
