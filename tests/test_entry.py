import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["c_custkey"] and df.count() > 0


def test_queries_and_oracles_agree_in_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
