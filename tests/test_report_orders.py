"""O3: reports come in the order their readers expect."""
import os

import pytest

from flowgauge.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
ORDERS = {
    "spend_by_tool": lambda r: (-r.spend, r.source), "spend_trend": lambda r: r.month, "daily_spend": lambda r: r.day,
    "developer_allocation": lambda r: (-r.spend, r.actor_key, r.source), "investment_trend": lambda r: r.month_key,
    "investment_by_team": lambda r: r.team, "user_directory": lambda r: (r.display_name, r.id),
    "cockpit_series": lambda r: (r.metric_key, r.day),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_are_ordered(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows == sorted(rows, key=ORDERS[name])
