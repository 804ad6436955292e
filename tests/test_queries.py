"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from fieldspan.plans import registry
from tests.compare import difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TWINS = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables here")


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(registry.queries()) <= set(entry.queries())
    assert set(registry.queries()) - set(TWINS) == {"classifier_scores"}


# Seeds of fewer than a hundred members are an error, and the smallest tables have such a seed.
NEEDS_MORE = {"split_share"}


@pytest.mark.parametrize("name", sorted(set(TWINS) - NEEDS_MORE))
def test_query_equals_its_twin(spark, name):
    problem = difference(entry.queries()[name](spark, SF_DIR), SF_DIR, TWINS[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(NEEDS_MORE))
def test_query_on_larger_tables(spark, name):
    larger = SF_DIR.replace("sf0.001", "sf0.01")
    assert difference(entry.queries()[name](spark, larger), larger, TWINS[name]) is None
    if larger != SF_DIR:
        with pytest.raises(Exception, match="seed too small"):
            entry.queries()[name](spark, SF_DIR).collect()


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["expansion_level", "n"] and result.count() > 3


def test_classifier_scores(spark):
    """No SQL twin: every document once, probabilities, and seeds above the rest on average."""
    rows = {r.family_id: r.score for r in registry.queries()["classifier_scores"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs) and all(0 <= s <= 1 for s in rows.values())
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("doc_id in (%s)" % ", ".join(map(str, rows))).collect()
    mean = lambda y: sum(rows[r.doc_id] for r in labels if r.quality == y) / sum(r.quality == y for r in labels)
    assert mean(1) > mean(0) + 0.3
