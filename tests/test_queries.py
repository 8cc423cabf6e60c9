"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("orders", "customer", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    key = lambda x: tuple(map(str, x))
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        got = sorted((tuple(r) for r in df.collect()), key=key)
        result = con.execute(sql)
        names = [x[0] for x in result.description]
        want = sorted((tuple(x[names.index(c)] for c in df.columns) for x in result.fetchall()), key=key)
        assert got == want, name


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
