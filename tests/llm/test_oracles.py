"""Every operator query with SQL against DuckDB."""

import pytest

from lodestream import llm
from tests import test_queries


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    test_queries.compare(spark, sf_dir, llm.queries()[name], llm.oracle_sql()[name])
