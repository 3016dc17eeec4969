import pytest

from silkgraph.llm.queries import ORACLES, QUERIES
from tests.helpers import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_eleven_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found
    assert {int(k[2:].split("_")[0]) for k in found if k.startswith("op") and k[2].isdigit()} == set(range(1, 11))
