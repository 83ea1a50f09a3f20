"""Every registered query of the catalog against the other engine, at the smallest size."""

from __future__ import annotations

import pytest

import stowage.plans.backup
import stowage.plans.catalog
import stowage.plans.content
import stowage.plans.discovery
import stowage.plans.ledger
import stowage.plans.mutations
import stowage.plans.reports
import stowage.plans.scalars
import stowage.plans.streams
import stowage.plans.vault  # noqa: F401
from stowage.plans.registry import QUERIES, SQL
from tests.conftest import SMALL, values


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    said = duck.execute(SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(got.columns) == sorted(columns)
    assert values(got.collect(), got.columns) == values(said.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_works_without_the_text_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
