"""The skew paths on real data: narrow as-of slots, compared with the SQL twins
(which do not depend on the setting)."""
import dataclasses

import pytest

from flowgauge.plans import dashboards as D
from flowgauge.plans import metrics as M
from flowgauge.plans import oracle as O
from flowgauge.plans import oracle_dash as OD
from flowgauge.plans import views as V
from flowgauge.plans.params import DEFAULT
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
P = dataclasses.replace(DEFAULT, asof_slot_seconds=600)


@pytest.fixture(scope="module")
def tables(spark):
    return V.runs(spark, SF), V.prs(spark, SF), V.team_repo(spark, SF), V.reviews(spark, SF)


@pytest.mark.parametrize("key,fn", [
    ("lead_time_p50", lambda r, p, t: M.lead_time(r, p, t, P)),
    ("mttr_p50", lambda r, p, t: M.mttr(r, t, P)),
    ("pr_cycle_time_p50", lambda r, p, t: M.pr_cycle_time(p, t, P)),
    ("change_failure_rate", lambda r, p, t: M.change_failure_rate(r, t, P)),
])
def test_metrics_on_hot_paths(tables, key, fn):
    runs, prs, tr, _ = tables
    ok, msg = compare(fn(runs, prs, tr), O.metric_sql(key), SF, duck(SF))
    assert ok, msg


def test_cycle_stages_and_ai_impact_on_hot_paths(tables):
    runs, prs, tr, reviews = tables
    ok, msg = compare(D.cycle_stages(prs, reviews, tr, P), OD.cycle_stages_sql(), SF, duck(SF))
    assert ok, msg
    ok, msg = compare(D.ai_impact(prs, P), OD.impact_sql(), SF, duck(SF))
    assert ok, msg
