import os

import pytest

from driftpanel.llm import queries
from tests.compare import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, FOLDER)) == rows_of_sql(queries.ORACLE_SQL[name], FOLDER)
