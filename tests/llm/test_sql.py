"""The queries that SQL can express, against DuckDB."""

import pytest

from riskframe.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    problems, rows = oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name])
    assert not problems, problems
    assert rows


def test_numbered_queries_and_a_pipeline():
    import __spark_entry__ as entry

    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert "pipeline" in entry.queries()
