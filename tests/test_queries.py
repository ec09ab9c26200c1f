"""Every query of the engine beside its SQL, and the entry points."""

import pytest
from conftest import same_rows

import __spark_entry__ as entry
from docrecon.plans import queries as plans
from docrecon.plans import grid_queries, learn_queries, sheet_queries, structure_queries, page_queries, unit_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    assert same_rows(plans.QUERIES[name](spark, small), duck, plans.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_give_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_statuses_all_occur(spark, small):
    found = {r.status for r in plans.q_text_status(spark, small).select("status").distinct().collect()}
    assert found == {"AYNI", "SADECE_BİÇİM_FARKI", "METİN_FARKLI"}
