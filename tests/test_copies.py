"""Queries against their SQL over three copies of the smallest tables: own keys are shifted, and orders stay with the first copy's customers."""

from pathlib import Path

import duckdb
import pytest
from test_oracles import SF, rows

from millrace import queries

SHIFTED = {"customer": "c_custkey + copy * 150 as c_custkey", "supplier": "s_suppkey + copy * 10 as s_suppkey", "orders": "o_orderkey + copy * 1500 as o_orderkey", "events": "event_id + copy * 1000 as event_id"}
#: Users and suppliers that reach beyond the customers.
APART = {"supplier": "s_suppkey + copy * 400 as s_suppkey", "events": "event_id + copy * 1000 as event_id, user_id + copy * 445 as user_id"}


@pytest.fixture(scope="module", params=[SHIFTED, {**SHIFTED, **APART}], ids=["shifted", "apart"])
def copies(request, tmp_path_factory):
    d = tmp_path_factory.mktemp("copies")
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        put = request.param.get(f.stem)
        c.sql(f"copy ({f"select t.* replace ({put}) from '{f}' t, range(3) r(copy)" if put else f"from '{f}'"}) to '{d / f.name}' (format parquet)")
        c.sql(f"create view {f.stem} as from '{d / f.name}'")
    return str(d), c


@pytest.mark.parametrize("name", ["join_chain", "rowset"])
def test_query(spark, copies, name):
    d, duck = copies
    df, want = queries.QUERIES[name](spark, d), duck.sql(queries.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
