"""The registered queries of the subpackage next to their SQL twins; those without one against each other."""

import pytest
from check import compare, duck

from tallyloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    status, _, _, message = compare(spark, duck(SMALL), SMALL, name)
    assert status in ("ok", "EMPTY"), message


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline"}))
def test_query_covers_every_row(spark, name):
    got = {r[0] for r in queries.QUERIES[name](spark, SMALL).select("doc_id").collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
