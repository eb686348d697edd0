import __spark_entry__


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["i", "v"] and rows.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
