"""Every registered query of the subpackage runs over empty tables and over nulls, repeated rows and clashing extra columns."""

import pytest

from sedimark.llm import queries

ALL = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", ALL)
def test_empty(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", ALL)
def test_dirty(spark, dirty_dir, name):
    queries.QUERIES[name](spark, dirty_dir).collect()
