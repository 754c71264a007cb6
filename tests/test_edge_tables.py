"""Every registered core query runs over empty tables and over nulls, repeated rows and clashing extra columns."""

import pytest

from sedimark.plans import registry

ALL = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", ALL)
def test_empty(spark, empty_dir, name):
    rows = registry.QUERIES[name](spark, empty_dir).collect()
    grand_totals = {"d2_bucket_rule_rollup", "e6_failure_budget"}
    assert rows == [] or name in grand_totals


@pytest.mark.parametrize("name", ALL)
def test_dirty(spark, dirty_dir, name):
    registry.QUERIES[name](spark, dirty_dir).collect()
