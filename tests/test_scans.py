from __future__ import annotations

import re

import pytest
from cloakframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["allowlist_table", "redact_resolve_roundtrip"])
def test_findings_that_are_read_again_come_from_a_table(spark, name):
    """What is returned reads findings that are written, and doesn't scan texts for them again."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("regexp_replace", plan)


def test_bodies_of_one_small_file_are_dealt_to_all_cores(spark):
    plan = QUERIES["body_notices"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
