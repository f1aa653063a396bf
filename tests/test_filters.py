"""Filters F1-F10 on small frames."""
import datetime as dt

from flowgauge.operators import filters as FL
from flowgauge.plans.admin import windows

AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)


def test_windows_and_patterns(spark):
    df = spark.createDataFrame([("Deploy prod", dt.datetime(2024, 1, 1, 12, 0, 0), dt.date(2024, 1, 1)),
                                ("relationship sync", dt.datetime(2024, 1, 1, 11, 59, 59), dt.date(2023, 12, 31)),
                                ("CI", dt.datetime(2024, 1, 20), dt.date(2024, 1, 20))],
                               "name string, ts timestamp, day date")
    assert df.filter(FL.in_window("ts", AS_OF, 30)).count() == 2            # cut to the second
    assert df.filter(FL.in_day_window("day", AS_OF, 30)).count() == 2        # 31 calendar days
    hits = [r["name"] for r in df.filter(FL.name_matches("name", "deploy|release|ship")).collect()]
    assert hits == ["Deploy prod", "relationship sync"]                     # unanchored, case-insensitive
    ev = spark.createDataFrame([("workflow_run.snapshot",), ("deployment_status",), ("pull_request",)], "event_type string")
    assert [r[0] for r in ev.select(FL.event_class("event_type")).collect()] == ["ci", "ci", "git"]
    assert windows(0, -1, 1000) == (1, 0, 100) and FL.clamp(500, 1, 500) == 500


def test_scope_repo_like_and_disconnected(spark):
    prs = spark.createDataFrame([("o/repo-1",), ("o/repo-12",), ("o/other",)], "repo string")
    tr = spark.createDataFrame([("team-1", "o/repo-1"), ("team-1", "o/other")], "team_id string, repo string")
    names = lambda df: sorted(r["repo"] for r in df.collect())
    assert names(FL.scope_repos(prs, "*", tr)) == ["o/other", "o/repo-1", "o/repo-12"]
    assert names(FL.scope_repos(prs, "team-1", tr)) == ["o/other", "o/repo-1"]
    assert names(FL.scope_repos(prs, "team-9", tr)) == []                   # team without repos
    assert names(FL.scope_repos(prs, "o/repo-12", tr)) == ["o/repo-12"]
    assert names(prs.filter(FL.repo_like("repo", " REPO-1 "))) == ["o/repo-1", "o/repo-12"]
    assert names(prs.filter(FL.repo_like("repo", "repo_1"))) == ["o/repo-1", "o/repo-12"]  # _ is a wildcard
    assert names(prs.filter(FL.repo_like("repo", "  "))) == ["o/other", "o/repo-1", "o/repo-12"]
    gone = spark.createDataFrame([("o/other",)], "repo string")
    assert names(FL.exclude_disconnected(prs, gone)) == ["o/repo-1", "o/repo-12"]
