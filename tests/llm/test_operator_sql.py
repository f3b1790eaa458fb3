"""The operators' queries give the rows of their SQL, over whole tables."""

import duckdb
import pytest

from sparkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def key(row):
    return [(v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert want and sorted(got, key=key) == sorted(want, key=key)
