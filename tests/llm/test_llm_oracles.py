"""The text operators that SQL can express, against their SQL over the smallest tables."""

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert sorted(map(repr, (tuple(r[k] for k in order) for r in df.collect()))) == sorted(map(repr, want.select(*(f'"{k}"' for k in order)).fetchall()))
