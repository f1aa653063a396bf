"""Golden cases of the stage breakdown and the lead time of tickets; extraction on literal payloads."""
import dataclasses
import datetime as dt
import json

import pytest

from flowgauge.operators.extract import extract_pr_commits, extract_transitions
from flowgauge.operators.state import latest_state
from flowgauge.plans import flow_metrics as FM
from flowgauge.plans import params as P

NOW = dt.datetime(2024, 5, 1)
PARAMS = dataclasses.replace(P.DEFAULT, as_of=NOW, days=60)


def at(hours):
    return NOW - dt.timedelta(hours=200) + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame(
        [("a", "Deploy", "success", at(50)), ("a", "Deploy", "failure", at(45)), ("b", "Release", "success", at(80)), ("b", "CI", "success", at(41))],
        "repo string, name string, conclusion string, ts timestamp")
    prs = spark.createDataFrame(
        [("a", 1, "AB-1 first", at(10), at(40)),    # all five marks
         ("a", 2, "AB-2", at(12), at(44)),          # reviewed after the merge only: no review mark
         ("a", 3, "AB-1 and AB-2", at(20), at(60)), # merged after the last deploy
         ("b", 4, "AB-3 AB-3 AB-4", at(20), at(60)),
         ("b", 5, "AB-4", at(30), None),            # open
         ("b", 6, None, at(0), at(70))],
        "repo string, number long, title string, created_at timestamp, merged_at timestamp")
    reviews = spark.createDataFrame(
        [("a", 1, at(14)), ("a", 1, at(12)), ("a", 2, at(47)), ("b", 4, at(21)), ("b", 6, at(1))], "repo string, pr_number long, submitted_at timestamp")
    commit = lambda h: ("s", at(h) if h is not None else None)
    commits = spark.createDataFrame(
        [("a", 1, [commit(8), commit(4)]), ("a", 2, [commit(3)]), ("b", 4, [commit(25), commit(None)]), ("b", 6, [commit(-24 * 100)]), ("b", 7, [])],
        "repo string, pr_number long, commits array<struct<sha:string,authored_at:timestamp>>")
    teams = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b")], "team_id string, repo string")
    return runs, prs, reviews, commits, teams


def scoped(df):
    return {(r["scope_type"], r["scope_id"]): r.asDict() for r in df.collect()}


def test_stages_are_medians_over_the_same_changes(tables):
    runs, prs, reviews, commits, teams = tables
    got = scoped(FM.lead_time_stages(runs, prs, reviews, commits, teams, PARAMS))
    a = got["repo", "a"]
    assert (a["n_deployed"], a["n_changes"], a["n_capped"]) == (2, 1, 0)
    assert [a[f"{s}_hours"] for s in FM.STAGES] == [6, 2, 28, 10, 46]
    b = got["repo", "b"]  # change 4: begun 20 (its commit is later than the opening), 6: capped at 90 days
    assert (b["n_deployed"], b["n_changes"], b["n_capped"]) == (2, 2, 1)
    assert [b[f"{s}_hours"] for s in FM.STAGES] == [(0 + 90 * 24) / 2, 1, (39 + 69) / 2, (20 + 10) / 2, (60 + 90 * 24) / 2]
    assert got["team", "t"]["n_changes"] == got["org", "*"]["n_changes"] == 3
    assert got["org", "*"]["review_wait_hours"] == 1 and got["team", "u"] | {"scope_type": 0, "scope_id": 0} == b | {"scope_type": 0, "scope_id": 0}


def test_stages_without_complete_changes(tables):
    runs, prs, reviews, commits, teams = tables
    got = scoped(FM.lead_time_stages(runs, prs, reviews.limit(0), commits, teams, PARAMS))
    assert got["org", "*"]["n_deployed"] == 4 and got["org", "*"]["n_changes"] == 0 and got["org", "*"]["lead_hours"] is None


def test_ticket_lead_time(spark, tables):
    runs, prs, _, _, teams = tables
    moves = spark.createDataFrame(
        [("AB-1", "In Progress", at(5)),                                          # PR 3 isn't deployed: pending
         ("AB-3", "In Progress", at(1)), ("AB-3", "Done", at(9)), ("AB-3", "in progress", at(16)),  # reopened: from the latest entry
         ("AB-4", "In Progress", at(2)),                                          # PR 5 is open: pending
         ("AB-9", "In Review", at(2)), ("AB-8", "Done", at(2))],                  # unlinked; never in progress
        "issue_key string, to_status string, at timestamp")
    got = scoped(FM.ticket_lead_time(runs, prs, moves, teams, PARAMS))
    org = got["org", "*"]
    assert (org["n_tickets"], org["n_pending"], org["n_unlinked"], org["lead_p50_hours"]) == (1, 2, 1, 64)
    assert got["team", "u"]["n_tickets"] == 1 and got["team", "u"]["n_unlinked"] is None
    assert (got["repo", "a"]["n_tickets"], got["repo", "a"]["n_pending"], got["repo", "a"]["lead_p50_hours"]) == (0, 1, None)
    late = spark.createDataFrame([("AB-3", "In Progress", at(90))], "issue_key string, to_status string, at timestamp")
    again = scoped(FM.ticket_lead_time(runs, prs, late, teams, PARAMS))["org", "*"]
    assert (again["n_tickets"], again["n_pending"]) == (0, 1)  # back in work after its last deploy


def test_ticket_of_several_pull_requests_ends_with_the_last_deploy(spark, tables):
    runs, _, _, _, teams = tables
    prs = spark.createDataFrame([("a", 1, "XY-1", at(1), at(40)), ("b", 2, "XY-1", at(1), at(42)), ("b", 3, "UTF-8 XY-1", at(1), at(43))],
                                "repo string, number long, title string, created_at timestamp, merged_at timestamp")
    moves = spark.createDataFrame([("XY-1", "In Progress", at(30))], "issue_key string, to_status string, at timestamp")
    got = scoped(FM.ticket_lead_time(runs, prs, moves, teams, PARAMS))
    assert {k: (v["n_tickets"], v["lead_p50_hours"]) for k, v in got.items()} == {k: (1, 50) for k in got}
    assert set(got) == {("repo", "a"), ("repo", "b"), ("team", "t"), ("team", "u"), ("org", "*")}


def events(spark, payloads):
    rows = [(json.dumps(p) if not isinstance(p, str) else p, at(k), k) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "payload string, received_at timestamp, seq long")


def test_latest_commit_list_drops_what_a_force_push_discarded(spark):
    url = "https://api.github.com/repos/acme/x/pulls/7"
    item = lambda sha, date: {"sha": sha, "commit": {"author": {"date": date}}}
    rows = extract_pr_commits(events(spark, [
        {"pull_request_url": url, "commits": [item("old", "2024-01-01T00:00:00Z"), item("kept", "2024-01-03T00:00:00Z")]},
        {"pull_request_url": url, "commits": [item("kept", "2024-01-03T00:00:00Z"), item("odd", None), item(None, "2024-01-01T00:00:00Z")]},
        {"pull_request_url": "https://example.com/none", "commits": []}, {"commits": []}, "{not json"]))
    assert rows.count() == 2
    state = latest_state(rows, ["repo", "pr_number"])
    assert [[c["sha"] for c in r["commits"]] for r in state.collect()] == [["kept", "odd"]]
    first = FM.first_commits(state).first()
    assert (first["repo"], first["number"], str(first["first_commit_at"])) == ("acme/x", 7, "2024-01-03 00:00:00")


def test_transitions_of_snapshots_and_webhooks(spark):
    status = lambda old, new: {"field": "status", "fromString": old, "toString": new}
    history = [{"created": "2024-01-02T10:00:00.000+0000", "items": [{"field": "assignee", "toString": "x"}, status("To Do", "In Progress")]},
               {"created": "2024-01-04T10:00:00.000+0000", "items": [status("In Progress", "Done")]}, {"created": None, "items": [status("a", "b")]}]
    snapshot = {"key": "AB-1", "fields": {"updated": "2024-01-05T00:00:00.000+0000"}, "changelog": {"histories": history}}
    hook = {"issue": {"key": "AB-1", "fields": {"updated": "2024-01-06T10:00:00.000+0000"}}, "changelog": {"items": [status("Done", "In Progress")]}}
    got = extract_transitions(events(spark, [snapshot, snapshot, hook, {"key": "AB-2"}, {"issue": {"fields": {}}}, "{"]))
    found = sorted((r["issue_key"], r["to_status"], str(r["at"])) for r in got.collect())
    assert found == [("AB-1", "Done", "2024-01-04 10:00:00"), ("AB-1", "In Progress", "2024-01-02 10:00:00"), ("AB-1", "In Progress", "2024-01-06 10:00:00")]
