"""The queries that SQL can express, over a whole small table."""

import os

import duckdb
import pytest

from seqloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
