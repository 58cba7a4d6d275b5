"""Registered queries against their SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, duck
from quitanda.functions import skew

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def connection():
    return duck(str(FOLDER))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    df = entry_points.queries()[name](spark, str(FOLDER))
    assert compare(df, connection, entry_points.oracle_sql()[name]) == []


SALTED = ("geo_top_categories", "category_review_scores")


@pytest.mark.parametrize("name", SALTED)
def test_salted_joins_equal_sql(spark, connection, monkeypatch, name):
    monkeypatch.setattr(skew, "HOT_SHARE", 50)
    df = entry_points.queries()[name](spark, str(FOLDER))
    assert compare(df, connection, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
