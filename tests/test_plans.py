"""Costly values are computed once: how often the optimised plan of a query spells them."""

import re

import pytest

from offerloom.plans import catalog


@pytest.mark.parametrize("name, costly, most", [("content_relevance", r"lower\(", 4), ("detect_signals", r"https\?", 1), ("structure_offers", r"lower\(", 12)])
def test_costly_values_are_written_once(spark, name, costly, most):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(costly, plan)) <= most
