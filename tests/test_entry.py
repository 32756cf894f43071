import importlib


def test_entry_and_registry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 50
