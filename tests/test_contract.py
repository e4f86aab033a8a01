import __spark_entry__ as E


def test_entry_and_names(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert E.entry(spark).count() > 0
