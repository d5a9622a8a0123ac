"""Every registered query against its DuckDB oracle at sf0.01 (the
driver's correctness gate)."""

import pytest

from tests.conftest import SF_ORACLE
from tests.oracle_check import compare, duck

from fleetframe.plans.oracle import ORACLE
from fleetframe.plans.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_oracle():
    missing = set(QUERIES) - set(ORACLE)
    assert missing == set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, name, SF_ORACLE, con)
    assert result["status"] == "ok", result


TIME_QUERIES = ["first_success", "first_success_stream", "run_timeout", "phase_durations",
                "delimiter_runs", "log_roundtrip", "validity_status", "barrier_violations"]


@pytest.mark.parametrize("name", TIME_QUERIES)
def test_time_queries_ignore_session_time_zone(spark, con, name):
    """Wall-clock timestamps must give the same answers in any session zone
    (order dates cross daylight-saving changes in New York; see also
    test_lifecycle.test_durations_across_dst)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        result = compare(spark, name, SF_ORACLE, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert result["status"] == "ok", result
