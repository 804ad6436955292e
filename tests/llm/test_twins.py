"""Queries of this subpackage against their SQL twins on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from fieldspan.llm.queries import ORACLES, QUERIES
from tests.compare import difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables here")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), SF_DIR, ORACLES[name]) is None


TABLE = dict.fromkeys(QUERIES, "documents") | {"op1_link_trust": "pages"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/{TABLE[name]}.parquet").select("doc_id").collect())
