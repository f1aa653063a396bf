"""Hand-computed metric cases (the reference's integration suite), run through
the Spark plans on tiny state tables. ``as_of`` is pinned to mid-day."""
import datetime as dt

import pytest

from flowgauge.plans import metrics as M
from flowgauge.plans.params import Params

AS_OF = dt.datetime(2024, 3, 10, 12, 0, 0)
P = Params(as_of=AS_OF, days=90, deploy_pattern="deploy|release", hotfix_pattern="hotfix|rollback|revert")
RUNS = "repo string, run_id string, name string, conclusion string, ts timestamp"
PRS = "repo string, pr_id long, created_at timestamp, merged_at timestamp"
TR = "team_id string, repo string"


def h(hours):
    return AS_OF - dt.timedelta(hours=hours)


def rows(df, metric=None):
    return {(r["scope_id"], r["day"]): (r["value"], r["sample_size"]) for r in df.collect()}


@pytest.fixture
def empty_tr(spark):
    return spark.createDataFrame([], TR)


def test_deploy_counted_once_per_repo(spark, empty_tr):
    runs = spark.createDataFrame([
        ("o/app", "1", "Deploy prod", "success", h(5)),
        ("o/app", "2", "Deploy prod", "failure", h(4)),
        ("o/app", "3", "CI", "success", h(3)),
        ("o/lib", "4", "Release", "success", h(2)),
    ], RUNS)
    got = rows(M.deployment_frequency(runs, empty_tr, P))
    day = h(5).date()
    assert got[("o/app", day)] == (1.0, 1) and got[("o/lib", day)] == (1.0, 1) and got[("*", day)] == (2.0, 2)


def test_median_and_lead_time(spark, empty_tr):
    prs = spark.createDataFrame([
        ("o/a", 1, h(40), h(30)), ("o/a", 2, h(50), h(30)), ("o/a", 3, h(90), h(30)),
    ], PRS)
    cyc = rows(M.pr_cycle_time(prs, empty_tr, P))
    assert cyc[("o/a", h(30).date())] == (20.0, 3)
    prs2 = spark.createDataFrame([("o/a", 1, h(48), h(40))], PRS)
    runs = spark.createDataFrame([("o/a", "9", "deploy", "success", h(38))], RUNS)
    lt = rows(M.lead_time(runs, prs2, empty_tr, P))
    assert lt[("o/a", h(38).date())] == (10.0, 1)


def test_failure_rate_follows_sql_and_mttr(spark, empty_tr):
    runs = spark.createDataFrame([
        ("o/a", "1", "deploy", "success", h(5)), ("o/a", "2", "deploy", "success", h(4)),
        ("o/a", "3", "hotfix", "success", h(3)),
    ], RUNS)
    cfr = rows(M.change_failure_rate(runs, empty_tr, P))
    assert cfr[("o/a", h(5).date())] == (1.0, 2)  # one hotfix fails every deploy in the 48 h before it
    runs2 = spark.createDataFrame([("o/a", "1", "deploy", "success", h(6)), ("o/a", "2", "rollback", "success", h(3))], RUNS)
    assert rows(M.mttr(runs2, empty_tr, P))[("o/a", h(6).date())] == (3.0, 1)
    healthy = spark.createDataFrame([("o/b", "1", "deploy", "success", h(6))], RUNS)
    assert rows(M.change_failure_rate(healthy, empty_tr, P))[("o/b", h(6).date())] == (0.0, 1)
    assert M.mttr(healthy, empty_tr, P).count() == 0


def test_team_median_is_not_mean_of_repo_medians(spark):
    tr = spark.createDataFrame([("t1", "o/a"), ("t1", "o/b")], TR)
    prs = spark.createDataFrame([
        ("o/a", 1, h(20), h(10)), ("o/a", 2, h(20), h(10)), ("o/b", 3, h(110), h(10)),
        ("o/c", 4, h(15), h(10)),
    ], PRS)
    got = rows(M.pr_cycle_time(prs, tr, P))
    day = h(10).date()
    assert got[("t1", day)] == (10.0, 3)
    assert got[("o/c", day)] == (5.0, 1) and ("t2", day) not in got
    vel = rows(M.pr_velocity(prs, tr, P))
    assert vel[("t1", day)] == (3.0, 3) and vel[("*", day)] == (4.0, 4)


def test_recompute_is_idempotent(spark, empty_tr):
    runs = spark.createDataFrame([("o/a", "1", "deploy", "success", h(5))], RUNS)
    prs = spark.createDataFrame([("o/a", 1, h(9), h(6))], PRS)
    a = sorted(map(tuple, M.build_mart(runs, prs, empty_tr, P).drop("computed_at").collect()))
    b = sorted(map(tuple, M.build_mart(runs, prs, empty_tr, P).drop("computed_at").collect()))
    assert a == b and len(a) == len(set(a))


def test_chain_is_charged_to_its_earliest_deploy(spark, empty_tr):
    runs = spark.createDataFrame([
        ("o/a", "1", "deploy", "success", h(5)), ("o/a", "2", "deploy", "success", h(4)), ("o/a", "3", "hotfix", "success", h(3)),
        ("o/b", "4", "deploy rollback", "success", h(3)),  # a remediation is no failure of its own
    ], RUNS)
    got = rows(M.cfr_chain_attribution(runs, empty_tr, P))
    day = h(5).date()
    assert got[("o/a", day)] == (0.5, 2) and got[("o/b", day)] == (0.0, 1) and got[("*", day)][1] == 3


def test_lead_times_are_cut_and_counted(spark, empty_tr):
    prs = spark.createDataFrame([("o/a", 1, h(24 * 100), h(40)), ("o/a", 2, h(48), h(40))], PRS)
    runs = spark.createDataFrame([("o/a", "9", "deploy", "success", h(38))], RUNS)
    got = {r["scope_id"]: r for r in M.lead_time_percentiles(runs, prs, empty_tr, P).collect()}["o/a"]
    assert (got["n_changes"], got["n_capped"], got["p50_hours"]) == (2, 1, (10 + 24 * 90) / 2)
    assert abs(got["p90_hours"] - (10 + 0.9 * (24 * 90 - 10))) < 1e-9
