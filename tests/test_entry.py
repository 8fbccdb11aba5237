import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())
