"""A law's table on its way to data rows is read once."""

import os

import pytest

from tallysheaf import plans

SF = "/root/testdata/sf0.001"


def test_law_rows_meet_their_chapters_without_a_join(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    plan = plans.queries()["law_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
