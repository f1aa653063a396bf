"""Extraction and scalar functions on literal payloads (odd shapes included)."""
import datetime as dt
import json

from pyspark.sql import functions as F

from flowgauge.functions import columns as C
from flowgauge.operators import extract as E
from flowgauge.operators import identity as I
from flowgauge.sources import readers as R

T0 = dt.datetime(2024, 1, 1)
ENV = "source string, source_id string, event_type string, received_at timestamp, connector_version string, payload string, seq long"


def env(spark, rows):
    return spark.createDataFrame([(s, f"id{i}", et, T0, "1", json.dumps(p), i) for i, (s, et, p) in enumerate(rows)], ENV)


def test_runs_webhook_snapshot_and_fallbacks(spark):
    rows = [("github", "workflow_run", {"workflow_run": {"id": 1, "name": "Deploy", "conclusion": "success",
                                                         "updated_at": "2024-01-02T03:04:05Z"},
                                        "repository": {"full_name": "o/a"}}),
            ("github", "workflow_run.snapshot", {"id": 2, "name": "CI", "updated_at": "2024-01-02",
                                                 "repository": {"full_name": " "}}),
            ("github", "workflow_run.snapshot", {"name": "no id"})]
    got = {r["run_id"]: r for r in E.extract_runs(env(spark, rows)).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["repo"] == "o/a" and got["1"]["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["2"]["repo"] == "unknown" and got["2"]["ts"] is None  # bare date is not an instant


def test_builds_pick_first_git_action_with_urls(spark):
    actions = [{"_class": "hudson.model.CauseAction"},
               {"_class": "hudson.plugins.git.util.BuildData", "remoteUrls": []},
               {"_class": "hudson.plugins.git.util.BuildData", "remoteUrls": ["https://github.com/o/r.git"]}]
    rows = [("jenkins", "build.snapshot", {"number": 7, "result": "UNSTABLE", "timestamp": 1704067200123,
                                           "job_name": "j", "actions": actions}),
            ("jenkins", "build.snapshot", {"number": 8, "result": None, "job_name": "j",
                                           "actions": [{"_class": "x"}]}),
            ("jenkins", "build.snapshot", {"number": 9, "result": "ABORTED", "job_name": "j",
                                           "actions": [{"_class": "hudson.plugins.git.util.BuildData",
                                                        "remoteUrls": ["git@gitlab.com:o/r.git"]}]})]
    got = {r["run_id"]: r for r in E.extract_builds(env(spark, rows)).collect()}
    assert got["jenkins:j:7"]["repo"] == "o/r" and got["jenkins:j:7"]["conclusion"] == "failure"
    assert got["jenkins:j:7"]["ts"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert got["jenkins:j:8"]["repo"] == "unknown" and got["jenkins:j:8"]["conclusion"] is None
    assert got["jenkins:j:9"]["repo"] == "git@gitlab.com:o/r" and got["jenkins:j:9"]["conclusion"] == "cancelled"


def test_pull_requests_and_ai_flag(spark):
    base = {"base": {"repo": {"full_name": "o/a"}}, "user": {"login": "ann", "id": 5}}
    rows = [("github", "pull_request", {"pull_request": {**base, "id": 1, "number": "12", "title": "x",
                                                         "body": "done\n\nCo-Authored-By:  Claude <c@x>",
                                                         "requested_reviewers": [{"login": "b"}, {"login": None}]}}),
            ("github", "pull_request.snapshot", {**base, "id": 2, "number": "n/a", "title": "Generated with Claude Code"}),
            ("github", "pull_request.snapshot", {**base, "id": 3, "title": "y", "labels": [{"name": "copilot assisted"}]}),
            ("github", "pull_request.snapshot", {**base, "id": 4, "title": "plain", "body": None})]
    got = {r["pr_id"]: r for r in E.extract_pull_requests(env(spark, rows)).collect()}
    assert got[1]["number"] == 12 and got[1]["requested_reviewers"] == ["b"] and got[1]["ai_assisted"]
    assert got[2]["number"] is None and got[2]["ai_assisted"]
    assert got[3]["ai_assisted"] and not got[4]["ai_assisted"]


def test_reviews_url_parsing(spark):
    rows = [("github", "pull_request_review.snapshot",
             {"id": 9, "pull_request_url": "https://api.github.com/repos/o/a/pulls/12", "state": "APPROVED",
              "submitted_at": "2024-01-01T00:00:00Z", "user": {"login": "r"}}),
            ("github", "pull_request_review.snapshot", {"id": 10, "pull_request_url": "https://x/issues/3"}),
            ("github", "pull_request_review", {"review": {"id": 11}})]
    got = E.extract_reviews(env(spark, rows)).collect()
    assert [(r["review_id"], r["repo"], r["pr_number"]) for r in got] == [("9", "o/a", 12)]


def test_issues_and_reopen(spark):
    fields = {"issuetype": {"name": "Bug"}, "status": {"name": "Open"}, "created": "2024-01-02T03:04:05.000+0000"}
    rows = [("jira", "issue.snapshot", {"key": "P-1", "id": "1", "fields": fields,
                                        "changelog": {"histories": [{"items": [{"field": "status", "fromString": "Closed"}]}]}}),
            ("jira", "jira:issue_updated", {"issue": {"key": "P-2", "id": "2", "fields": {**fields, "project": {"key": "P"}}},
                                            "changelog": {"items": [{"field": "status", "fromString": "In Review"}]}}),
            ("jira", "issue.snapshot", {"key": "P-3", "id": "3", "fields": fields, "changelog": {"histories": None}}),
            ("jira", "issue.snapshot", {"key": "P-4", "id": "4"})]
    got = {r["issue_key"]: r for r in E.extract_issues(env(spark, rows)).collect()}
    assert set(got) == {"P-1", "P-2", "P-3"}
    assert got["P-1"]["reopened"] and not got["P-2"]["reopened"] and not got["P-3"]["reopened"]
    assert got["P-1"]["project_key"] == "unknown" and got["P-2"]["project_key"] == "P"
    assert got["P-1"]["created_at"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_usage_metered_and_seat(spark):
    metered = {"date": "2024-01-05T00:00:00Z", "actor": {"email_address": "a@x.io"},
               "core_metrics": {"num_sessions": 2, "pull_requests_by_claude_code": 1},
               "model_breakdown": [{"tokens": {"input": 10, "output": 3}, "estimated_cost": {"amount": 1.25}},
                                   {"tokens": {"input": 5}, "estimated_cost": {"amount": None}}],
               "tool_actions": {"edit": {"accepted": 3, "rejected": 1}, "write": {"accepted": 2}}}
    seat_active = {"user_login": "u", "day": "2024-01-05", "totals_by_cli": {"prompt_count": 1},
                   "totals_by_ide": [{"ide": "vscode"}, {"ide": "jb"}]}
    seat_idle = {"user_login": "v", "day": "2024-01-05", "totals_by_cli": {"session_count": 0}}
    rows = [("claude_code", "usage.snapshot", metered), ("copilot", "usage.snapshot", seat_active),
            ("copilot", "usage.snapshot", seat_idle), ("claude_code", "usage.snapshot", {"date": "2024-01-05"})]
    got = {r["actor_key"]: r for r in E.extract_usage(env(spark, rows), 19).collect()}
    assert set(got) == {"a@x.io", "u", "v"}
    a = got["a@x.io"]
    assert (float(a["cost_usd"]), a["tokens_input"], a["accepted_suggestions"], a["rejected_suggestions"], a["prs"]) == \
        (1.25, 15, 5, 1, 1)
    assert float(got["u"]["cost_usd"]) == 0.63 and got["u"]["primary_surface"] == "vscode"
    assert float(got["v"]["cost_usd"]) == 0.0 and got["v"]["prs"] is None


def test_team_snapshot_missing_arrays(spark):
    rows = [("github", "team.snapshot", {"id": "t1", "name": "Core", "repositories": [{"full_name": "o/a"}, {}],
                                         "members": [{"id": "5", "login": "a"}, {"login": "no-id"}]}),
            ("github", "team.snapshot", {"id": "t2", "name": "Empty"}),
            ("github", "team.snapshot", {"name": "no id"})]
    got = {r["team_source_id"]: r for r in I.parse_team_snapshots(env(spark, rows)).collect()}
    assert got["t1"]["repos"] == ["o/a"] and [m["id"] for m in got["t1"]["members"]] == ["5"]
    assert got["t2"]["repos"] == [] and got["t2"]["members"] == []
    assert set(got) == {"t1", "t2"}


def test_identity_observations(spark):
    rows = [("github", "commit.snapshot", {"sha": "s1", "author": {"id": 7, "login": "ann"},
                                           "commit": {"author": {"name": "Ann A", "email": "Ann@X.io"}}}),
            ("github", "commit.snapshot", {"sha": "s2", "commit": {"author": {"name": "Bob", "email": "Bob@X.io"}}}),
            ("github", "push", {"commits": [{"author": {"name": "C", "email": "c@x.io"}}, {"author": {"name": "nomail"}}]}),
            ("github", "pull_request_review.snapshot", {"id": 1, "user": {"id": 9, "login": "rev"}}),
            ("jira", "jira:issue_updated", {"issue": {"fields": {"assignee": {"accountId": "a1", "displayName": "A"},
                                                                 "reporter": {"displayName": "no account"}}},
                                            "user": {"accountId": "a2", "emailAddress": "z@x.io"}}),
            ("jenkins", "build.snapshot", {"number": 1})]
    got = sorted((r["source"], r["source_user_id"], r["name"], r["email"]) for r in
                 I.observe_identities(env(spark, rows)).collect())
    assert got == sorted([("github", "7", "Ann A", "Ann@X.io"), ("github", "email:bob@x.io", "Bob", "Bob@X.io"),
                          ("github", "email:c@x.io", "C", "c@x.io"), ("github", "9", "rev", None),
                          ("jira", "a1", "A", None), ("jira", "a2", None, "z@x.io")])


def test_scalar_functions(spark):
    df = spark.createDataFrame([("UTF-8 PROJ-12 and ABC-3", "  Platform Team!! ", " Ann@X.io ", "dependabot[bot]")],
                               "t string, n string, e string, b string")
    r = df.select(C.issue_key("t").alias("k"), C.slug("n").alias("s"), C.normalize_email("e").alias("e"),
                  C.is_bot("b", F.lit(None)).alias("bot"), C.is_bot(F.lit("Ann"), "e").alias("human"),
                  C.first_non_blank(F.lit("  "), F.lit(" x ")).alias("fnb"),
                  C.jira_instant(F.lit("2024-01-02T03:04:05.000+0100")).alias("j"),
                  C.iso_instant(F.lit("2024-01-02")).alias("bare")).head()
    assert (r["k"], r["s"], r["e"], r["bot"], r["human"], r["fnb"]) == ("UTF-8", "platform-team", "ann@x.io", True, False, " x ")
    assert r["j"] == dt.datetime(2024, 1, 2, 2, 4, 5) and r["bare"] is None


def test_webhook_key(spark):
    bodies = spark.createDataFrame([('{"webhookEvent":"jira:issue_created"}', T0), ('{"webhookEvent":" "}', T0)],
                                   "body string, received_at timestamp")
    good, bad = R.webhook_key(bodies)
    g = good.head()
    import hashlib
    assert g["source_id"] == hashlib.sha256(b'{"webhookEvent":"jira:issue_created"}').hexdigest()
    assert g["event_type"] == "jira:issue_created" and bad.count() == 1
