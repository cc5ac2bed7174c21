import __spark_entry__ as driver


def test_flagship_runs(spark):
    df = driver.entry(spark)
    assert df.columns[:2] == ["model", "split"] and df.count() == 15


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) > 200
