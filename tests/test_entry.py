"""The driver's contract."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    rows = entry.entry(spark)
    assert rows.columns == ["x", "y", "rule", "n"] and rows.count() > 0
