"""Golden cases of commit share, size distribution, flags, goals and scope creep."""
import dataclasses
import datetime as dt
import json

import pytest

from flowgauge.operators.extract import extract_pr_sizes
from flowgauge.plans import params as P
from flowgauge.plans import work_metrics as WM

NOW = dt.datetime(2024, 5, 1)
PARAMS = dataclasses.replace(P.DEFAULT, as_of=NOW, days=60)
ENV = "event_type string, payload string, received_at timestamp, seq long"
VERSIONS = "repo string, number long, created_at timestamp, lines long, received_at timestamp, seq long"


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b")], "team_id string, repo string")


def scoped(df, *more):
    return {tuple(r[c] for c in ("scope_type", "scope_id", *more)): r.asDict() for r in df.collect()}


def test_commit_share_counts_a_commit_once(spark, teams):
    c = lambda sha, msg, at: {"id": sha, "message": msg, "timestamp": at}
    push = lambda repo, *cs: json.dumps({"repository": {"full_name": repo}, "commits": list(cs)})
    both = "x\n\nCo-authored-by: Claude\nAssisted-by: Cursor"
    rows = [("push", push("a", c("1", both, "2024-04-02T00:00:00Z"), c("2", "y", "2024-04-07T23:00:00Z")), NOW, 1),
            ("push", push("a", c("1", both, "2024-04-02T00:00:00Z"), c("3", "z", "2024-04-08T00:00:00Z")), NOW, 2),
            ("push", push("b", c("4", both, "2023-01-01T00:00:00Z"), c("5", "late", "2024-05-02T00:00:00Z")), NOW, 3)]
    got = scoped(WM.ai_commit_share(spark.createDataFrame(rows, ENV), teams, PARAMS), "week")
    first, second = dt.date(2024, 4, 1), dt.date(2024, 4, 8)
    row = got["org", "*", first]
    assert (row["n_commits"], row["n_ai"], row["n_claude"], row["n_cursor"], row["n_copilot"], row["ai_share"]) == (2, 1, 1, 1, 0, 0.5)
    assert got["team", "t", second]["n_commits"] == 1 and ("team", "u", first) not in got


def test_sizes_come_from_the_latest_version(spark, teams):
    pr = lambda n, add, rem, repo="a": {"number": n, "additions": add, "deletions": rem, "created_at": "2024-04-02T00:00:00Z", "base": {"repo": {"full_name": repo}}}
    h = dt.timedelta(hours=1)
    rows = [("pull_request", json.dumps({"pull_request": pr(1, 900, 0)}), NOW, 1), ("pull_request.snapshot", json.dumps(pr(1, 300, 100)), NOW + h, 2),
            ("pull_request.snapshot", json.dumps(pr(2, 401, None)), NOW, 3), ("pull_request.snapshot", json.dumps(pr(3, None, None)), NOW, 4),
            ("pull_request.snapshot", json.dumps(pr(4, 0, 0, "b")), NOW, 5), ("pull_request.snapshot", json.dumps(pr(None, 5, 5)), NOW, 6), ("x", "{bad", NOW, 7)]
    daily = WM.pr_size_daily(extract_pr_sizes(spark.createDataFrame(rows, ENV)))
    got = scoped(WM.pr_size_distribution(daily, teams, PARAMS))
    org = got["org", "*"]
    assert (org["n_prs"], org["n_oversized"], org["mean_lines"], org["lines_p50"], org["lines_p90"]) == (3, 1, 267.0, 400, 400)
    assert got["team", "u"]["lines_p50"] == 0 and got["repo", "a"]["n_prs"] == 2
    # days merge without raw rows: two halves of the mart give the same figures
    assert WM.pr_size_distribution(daily.unionByName(daily.limit(0)), teams, PARAMS).count() == len(got)


def test_flags_take_the_teams_limit_before_the_default(spark, teams):
    at = lambda days: NOW - dt.timedelta(days=days)
    prs = spark.createDataFrame([("a", 1, "open", at(2)), ("b", 2, "open", at(8)), ("c", 3, "open", at(7)), ("c", 4, "closed", at(50)), ("c", 5, "open", at(1))],
                                "repo string, number long, state string, created_at timestamp")
    sizes = spark.createDataFrame([("a", 1, at(2), 50, at(2), 1), ("a", 1, at(2), 500, at(1), 2), ("b", 2, at(8), 900, at(8), 3), ("b", 2, at(8), 300, at(6), 4),
                                   ("c", 5, at(1), 401, at(1), 5), ("c", 3, at(7), 9000, NOW + dt.timedelta(days=1), 6)], VERSIONS)
    limits = spark.createDataFrame([("t", "age", 24), ("t", "age", 30), ("u", "size", 200)], "team_id string, kind string, limit long")
    got = {(r["number"], r["team_id"], r["kind"]): (r["limit"], r["value"], r["crossed_at"]) for r in WM.pr_flags(prs, sizes, limits, teams, PARAMS).collect()}
    day = dt.timedelta(days=1)
    assert got == {
        (1, "t", "age"): (24, 48, at(2) + day), (1, "t", "size"): (400, 500, at(1)),
        (2, "t", "age"): (24, 192, at(8) + day), (2, "u", "age"): (168, 192, at(8) + 7 * day),
        (2, "u", "size"): (200, 300, at(8)),    # shrunk, yet still over its limit since the first version
        (5, None, "size"): (400, 401, at(1))}   # 3: exactly at the limit, its size isn't known yet


def test_goal_status_follows_the_line(spark):
    d = lambda n: dt.date(2024, 4, 1) + dt.timedelta(days=n)
    mart = spark.createDataFrame([("m", "org", "*", d(5), 99.0), ("m", "org", "*", d(20), 14.0), ("m", "org", "*", d(31), 0.0), ("low", "org", "*", d(20), 14.0)],
                                 "metric_key string, scope_type string, scope_id string, day date, value double")
    goal = lambda i, start, end, a, b, key="m": (i, key, "org", "*", start, end, a, b)
    goals = spark.createDataFrame([
        goal(1, d(0), d(60), 10.0, 18.0),       # half the time, half the way
        goal(2, d(0), d(60), 10.0, 20.0),       # 0.4 of the way
        goal(3, d(0), d(60), 10.0, 30.0),       # 0.2
        goal(4, d(21), d(60), 10.0, 30.0),      # no value since its start
        goal(5, d(31), d(60), 10.0, 30.0),      # begins tomorrow
        goal(6, d(0), d(60), 20.0, 8.0),        # downwards: 0.5
        goal(7, d(0), d(60), 14.0, 14.0), goal(8, d(0), d(60), 13.0, 13.0, "low"),
        goal(9, d(0), d(10), 0.0, 99.0),        # over: the last value of its time
        goal(10, d(20), d(20), 0.0, 14.0)],
        "goal_id long, metric_key string, scope_type string, scope_id string, start_day date, end_day date, start_value double, target_value double")
    got = {r["goal_id"]: r["status"] for r in WM.goal_progress(goals, mart, ["low"], PARAMS).collect()}
    assert got == {1: "on-track", 2: "at-risk", 3: "off-track", 4: "no-data", 5: "not-started", 6: "on-track", 7: "on-track", 8: "off-track",
                   9: "on-track", 10: "on-track"}


def test_creep_runs_end_at_gaps(spark, teams):
    weeks = {0: (10, 1), 1: (10, 2), 2: (10, 9), 4: (10, 9), 5: (10, 1), 12: (10, 9)}  # week: items, unplanned
    rows = []
    for w, (n, bad) in weeks.items():
        at = dt.datetime(2024, 1, 1) + dt.timedelta(weeks=w, hours=5)
        rows += [("a", at, "Unplanned" if i < bad else "Planned", f"K-{w}-{i % 3}") for i in range(n)] + [("a", at, "Unclassifiable", None)]
    classified = spark.createDataFrame(rows, "repo string, created_at timestamp, category string, issue_key string")
    trend = WM.scope_creep_trend(classified, teams)
    monday = lambda w: dt.date(2024, 1, 1) + dt.timedelta(weeks=w)
    got = {r["week"]: (r["baseline"], r["above"], r["run_start"], r["run_weeks"]) for r in trend.filter("scope_type = 'org'").collect()}
    assert got == {monday(0): (None, False, None, None), monday(1): (0.1, True, monday(1), 2), monday(2): (0.15, True, monday(1), 2),
                   monday(4): (0.4, True, monday(4), 1), monday(5): (20 / 30, False, None, None), monday(12): (None, False, None, None)}
    items = WM.scope_creep_items(classified, trend, teams).filter("scope_type = 'team'").collect()
    assert sum(r["n_prs"] for r in items) == 2 + 9 + 9 and {r["run_start"] for r in items} == {monday(1), monday(4)}
