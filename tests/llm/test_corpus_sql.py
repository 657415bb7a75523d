"""The corpus queries that SQL can express, against their SQL over whole tables at sf0.01."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_check import compare, duck

from tidemark.llm.queries import oracles, registry


@pytest.mark.parametrize("name", sorted(oracles()))
def test_corpus_query_matches_sql(spark, name):
    problems, n = compare(registry()[name](spark, SF01), duck(SF01), oracles()[name])
    assert not problems, problems
    assert n > 0


def test_entry_carries_every_corpus_query():
    assert set(registry()) | {"pipeline"} <= set(entry.queries())
    assert set(oracles()) <= set(entry.oracle_sql())
