import __spark_entry__ as driver


def test_every_sql_twin_has_a_query():
    queries, twins = driver.queries(), driver.oracle_sql()
    assert set(twins) <= set(queries)
    assert not {name for name in set(queries) - set(twins) if name in driver.catalog.QUERIES}


def test_flagship_query(spark):
    rows = driver.entry(spark)
    assert rows.columns[:3] == ["cusip", "ticker", "issuer"]
    assert rows.count() > 0
