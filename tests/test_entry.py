"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    out = entry.entry(spark)
    assert {"flow_id", "resource_id", "tier", "quantum", "decision"} == set(out.columns)
    assert out.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
