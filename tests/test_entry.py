from __future__ import annotations


def test_entry_and_registers(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
