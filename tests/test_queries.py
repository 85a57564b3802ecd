"""Every registered query against the SQL that says the same."""

import os

import pytest

import __spark_entry__ as entry
import check
from corpusloom.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

#: More merges than one SQL statement may nest; held against one at a time in test_vocab.
WITHOUT_SQL = {"vocab_learn_whole"}


@pytest.fixture(scope="module")
def tables():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, tables, name):
    verdict, _ = check.compare(spark, tables, FOLDER, name)
    assert verdict.endswith("no SQL") if name in WITHOUT_SQL else verdict.startswith("ok"), verdict


def test_every_query_has_its_sql():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_SQL
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_gives_a_mixture(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "row_idx", "source_no", "doc_id", "text"] and df.count() > 0
