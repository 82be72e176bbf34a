import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "turn_index", "score"] and df.count() > 0


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 140 and set(o) <= set(q)
