"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["store_host", "n_pages", "n_keys", "keeper_page"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
