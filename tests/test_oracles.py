"""Registered queries against their oracles at the smallest scale.

A few run by default; WEFT_ORACLES=all runs every one.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, open_duckdb

SF_DIR = "/root/testdata/sf0.001"
QUICK = ("parse", "cleaned_catalog", "relaxed_candidates_repeated", "tight_chunks", "term_vectors", "search_items")
NAMES = list(entry.queries()) if os.environ.get("WEFT_ORACLES") == "all" else QUICK

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
