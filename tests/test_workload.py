import pytest

from sparktab.plans import checks, workload  # noqa: F401

from .oracle import SF, compared


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_equals_sql(spark, name):
    got, want = compared(spark, workload.QUERIES[name], workload.SQL[name])
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_the_entry_is_callable():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(workload.QUERIES) <= set(known)


def test_flagship_never_costs_more(spark):
    assert workload.QUERIES["savings_by_source"](spark, SF).filter("saved < 0").isEmpty()
