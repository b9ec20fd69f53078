"""Every registered query against its SQL on the smallest data set."""

import check_sql
import pytest

from gapspark.plans.registry import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def con(folder):
    return check_sql.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    if name == "replay_mix":
        pytest.skip("fewer than 20 new rows at this scale; see test_classify")
    good, note = check_sql.compare(spark, con, QUERIES[name], folder)
    assert good, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
