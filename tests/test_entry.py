import __spark_entry__ as entry


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 30


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(rows[0].duration_hours - 24) < 0.2
