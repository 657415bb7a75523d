"""Every registered query against its DuckDB oracle (the driver's correctness gate), at
sf0.01; the streaming and file-source queries run end to end as well."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_check import compare, duck

from tidemark.oracle_sql import oracles
from tidemark.queries import registry

ALL = entry.queries()
QUERIES = {k: ALL[k] for k in registry()}
ORACLES = oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle_or_is_declared_non_sql():
    non_sql = {"embed_chunks", "knn_approx"}
    assert set(QUERIES) - set(ORACLES) <= non_sql
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "action" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    if name not in ORACLES:
        assert df.count() > 0
        return
    problems, n = compare(df, con, ORACLES[name])
    assert not problems, problems
