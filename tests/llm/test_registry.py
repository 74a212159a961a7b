import __spark_entry__


def test_counterparts_are_sql_texts_of_queries():
    found = __spark_entry__.oracle_sql()
    assert {k for k, v in found.items() if not isinstance(v, str)} == set()
    assert set(found) <= set(__spark_entry__.queries())
