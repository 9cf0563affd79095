"""Tables made by parsing or from keys are exchanged for joins, not sent whole through the driver."""

import os

import pytest

from loamline.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["file_graph", "python_resolution", "unresolved_imports", "external_targets", "roots_of_repositories", "first_file_degrees", "entry_points", "import_cycles", "longest_cycles", "task_messages", "python_detectors"])
def test_nothing_is_broadcast(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
