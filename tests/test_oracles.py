"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from sparkloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents pages events conversations embeddings benchmark labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(rows):
    return sorted([tuple("" if v is None else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert want and len(got) == len(want)
    assert key(got) == key(want)
