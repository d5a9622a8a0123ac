import pytest

from tests.llm.cases import documents


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, clashing names."""
    return documents(spark)
