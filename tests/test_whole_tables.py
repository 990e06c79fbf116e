"""The array, lambda, unnest and window operators are registered over whole tables, and no query is narrowed by an id."""

import re

import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, table, column", [("unnest", "vid", "embeddings", "vec_id"), ("arrays", "vid", "embeddings", "vec_id"), ("lambdas", "vid", "embeddings", "vec_id"), ("window_lag", "eid", "events", "event_id")])
def test_every_row_is_covered(spark, name, key, table, column):
    got = {r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}


def test_no_id_subsets():
    for name, text in queries.TEXTS.items():
        assert not re.search(r"where (vec|event|doc|orders|customer|part)\.(id|user) *(<|=|between)", text), name
