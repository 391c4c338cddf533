"""Every registered query against its SQL check on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tuneloom.plans.catalog import all_queries
from tuneloom.plans.oracle import all_oracles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    # a learned vocabulary has no SQL; test_vocabulary.py compares it with whole texts
    assert set(all_queries()) - set(all_oracles()) == {"vocabulary_token_counts"}
    assert set(all_oracles()) <= set(all_queries())
    assert set(all_queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    assert compare(df, con, all_oracles()[name]) == ""
