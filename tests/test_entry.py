import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0
    assert set(E.entry(spark).columns) == {"source", "pii_type", "n_entities"}


def test_every_query_has_a_name_and_oracles_are_known():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
