from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(callable(q) for q in contract.queries().values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["id", "exchange_id", "ticker", "status", "created_at_utc", "turn"] and not got.isEmpty()
