"""Every registered query with a SQL twin gives the twin's rows; every other one gives rows."""

import pytest

from verify_queries import compare

from flowsieve.plans import catalog


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["flow_id", "pktCount", "totalBytes", "threat_score", "risk_level", "recommendation"]
    assert out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, name):
    state, note, _ = compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert state == "ok", f"{name}: {state} {note}"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert not catalog.QUERIES[name](spark, sf).isEmpty()
