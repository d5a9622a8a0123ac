import pytest

from fleetframe.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.01"


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    result = compare(spark, name, SF, duck(SF))
    assert result["status"] == "ok", result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op4_permutation_index"}))
def test_query_has_a_row_for_each_document(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
