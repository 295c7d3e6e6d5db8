"""Every query with SQL equals it; every other one runs and has a stable schema."""

from __future__ import annotations

import pytest

from casework.plans import packets, packs, process, texts

from .oracle import compare, connect

QUERIES, SQL = {**process.QUERIES, **texts.QUERIES, **packets.QUERIES, **packs.QUERIES}, {**process.SQL, **texts.SQL, **packets.SQL, **packs.SQL}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    compare(QUERIES[name](spark, data), SQL[name], con)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
