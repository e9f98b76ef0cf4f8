"""Every own query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from foliant import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v).lower() if isinstance(v, bool) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    if name in queries.ORACLE_SQL:
        found = con.execute(queries.ORACLE_SQL[name])
        assert got == table([c[0] for c in found.description], found.fetchall())
    else:
        assert got[1]
