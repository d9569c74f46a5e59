"""The registry, the flagship query and a few SQL comparisons at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from wardstream.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    names, checked = set(contract.queries()), set(contract.oracle_sql())
    assert checked <= names
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"pii_redact_library", "page_entities", "trained_scores"}


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "session_id", "stage", "status", "action_taken", "reason"]
    assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", ["pii_counts", "conv_shape_check", "session_escalation", "cache_hits", "ops_metrics", "first_violation"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "events", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = contract.queries()[name](spark, FOLDER).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
