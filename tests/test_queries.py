"""Every registered query of the reference's operators against its SQL."""

import math
import os

import duckdb
import pytest

from seqloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(got.columns))) for r in got.collect())
    assert rows
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def test_names_and_coverage():
    families = {"a": 9, "s": 35, "w": 12, "d": 18, "l": 17, "f": 5, "t": 5}
    for letter, n in families.items():
        assert {name[:3] for name in registry.QUERIES if name[0] == letter} == {f"{letter}{i:02d}" for i in range(1, n + 1)}
    assert set(registry.ORACLE) <= set(registry.QUERIES)
