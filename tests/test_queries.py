"""Every signal query against its DuckDB form on the smallest tables."""

import pytest

from signalspark.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert_same(spark, con, SF, QUERIES[name], ORACLES[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_all_constraints_are_registered(spark):
    from signalspark.plans.constraints import REFERENCES, UNIQUE
    from signalspark.schemas import ENUMS

    got = {(r["TableName"], r["Rule"]) for r in QUERIES["all_constraint_violations"](spark, SF).collect()}
    assert len(got) == len(UNIQUE) + len(REFERENCES) + len(ENUMS)
    assert {t for t, _ in got} >= {"metrics", "log_records", "span_events", "span_links", "exemplars", "resources", "instrumentation_scopes"}
