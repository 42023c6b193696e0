"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from langmill.plans import catalog, oracle
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(catalog.QUERIES) - set(oracle.statements()) == {"ovr_scores", "ovr_multilabel"}


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4 * 5


def test_fitted_models_recognise_languages(spark):
    rows = QUERIES["ovr_scores"](spark, FOLDER).collect()
    right = sum(r.lang == r.prediction for r in rows)
    assert len(rows) == 40 and right / len(rows) > 0.9


def test_fitted_models_recognise_several_languages(spark):
    rows = QUERIES["ovr_multilabel"](spark, FOLDER).collect()
    assert len(rows) == 40 and sum("," in r.gold for r in rows) > 5
    hits = sum(len(set(r.gold.split(",")) & set(r.pred.split(","))) for r in rows)
    assert hits / sum(len(r.gold.split(",")) for r in rows) > 0.75 and hits / sum(len([p for p in r.pred.split(",") if p]) for r in rows) > 0.9
