"""SQL twins for the source readers: the envelope keys each landed file must
yield, the place of each record in the load and what its payload says, from the
rows that went into it."""
from __future__ import annotations

import datetime as dt

from . import params as P
from .oracle_state import ENVELOPE_KEYS
from .oracle_views import with_views
from .params import Params

ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _since(p: Params) -> str:
    return (p.as_of - dt.timedelta(days=p.days)).strftime("TIMESTAMP '%Y-%m-%d %H:%M:%S'")


def land_prs_sql(p: Params = P.DEFAULT) -> str:
    return with_views(f"""
SELECT 'github' AS source, 'pr:' || CAST(pr_id AS VARCHAR) || ':' || strftime(last_received_at, {ISO}) AS source_id,
       'pull_request.snapshot' AS event_type, place, concat_ws('|', pr_id, title, state, author, repo) AS detail
FROM (SELECT *, row_number() OVER (ORDER BY pr_id) - 1 AS place FROM bench_prs) listed
WHERE last_received_at >= {_since(p)}""", "bench_prs")


def land_reviews_sql() -> str:
    return with_views("""
SELECT 'github' AS source, 'review:' || review_id AS source_id, 'pull_request_review.snapshot' AS event_type, place,
       concat_ws('|', review_id, state, reviewer_login,
                 'https://api.github.com/repos/' || repo || '/pulls/' || CAST(pr_number AS VARCHAR)) AS detail
FROM (SELECT *, row_number() OVER (ORDER BY pr_number // 100, review_id) - 1 AS place FROM bench_reviews) listed
WHERE NOT (pr_number % 13 = 0 AND state = 'COMMENTED')""", "bench_reviews")


def land_commits_sql() -> str:
    return with_views("""
SELECT 'github' AS source, 'commit:' || sha AS source_id, 'commit.snapshot' AS event_type,
       row_number() OVER (ORDER BY pr_id // 100, sha) - 1 AS place,
       concat_ws('|', sha, author, 'dev' || regexp_extract(author, '([0-9]+)$', 1) || '@acme.io') AS detail
FROM (SELECT *, md5('commit-' || CAST(pr_id AS VARCHAR)) AS sha FROM bench_prs WHERE merged_at IS NOT NULL) merged""", "bench_prs")


def land_runs_sql(p: Params = P.DEFAULT) -> str:
    return with_views(f"""
SELECT 'github' AS source, 'workflow_run:' || run_id || ':' || strftime(ts, {ISO}) AS source_id,
       'workflow_run.snapshot' AS event_type, place, concat_ws('|', run_id, name, conclusion, repo) AS detail
FROM (SELECT *, row_number() OVER (ORDER BY CAST(run_id AS BIGINT)) - 1 AS place FROM bench_runs) listed
WHERE ts >= {_since(p)}""", "bench_runs")


def land_issues_sql() -> str:
    return with_views("""
SELECT 'jira' AS source, 'issue:' || issue_id || ':' || strftime(last_received_at, '%Y-%m-%dT%H:%M:%S.%g+0000') AS source_id,
       'issue.snapshot' AS event_type, place, concat_ws('|', issue_key, summary, status, issue_type) AS detail
FROM (SELECT *, row_number() OVER (ORDER BY CAST(issue_id AS BIGINT) // 50, issue_key) - 1 AS place FROM bench_issues) listed
WHERE CAST(issue_id AS BIGINT) % 17 <> 0""", "bench_issues")


def land_builds_sql() -> str:
    return with_views("""
SELECT 'jenkins' AS source, 'jenkins:' || job || ':' || run_id AS source_id, 'build.snapshot' AS event_type,
       row_number() OVER (ORDER BY CAST(regexp_extract(job, '([0-9]+)$', 1) AS BIGINT), CAST(run_id AS BIGINT)) - 1 AS place,
       concat_ws('|', job, run_id, upper(conclusion)) AS detail
FROM (SELECT *, 'build-' || regexp_extract(repo, '([^/]+)$', 1) AS job FROM bench_runs
      WHERE name = 'CI tests' AND CAST(run_id AS BIGINT) % 13 = 0) builds""", "bench_runs")


def team_snapshots_sql() -> str:
    return with_views("""
SELECT 'team:' || t.id AS source_id,
       CAST(coalesce(r.n, 0) AS BIGINT) AS repos, CAST(coalesce(m.n, 0) AS BIGINT) AS members
FROM bench_team t
LEFT JOIN (SELECT team_id, count(*) AS n FROM bench_team_repo
           WHERE CAST(regexp_extract(repo, '([0-9]+)$', 1) AS BIGINT) % 9 <> 0 GROUP BY team_id) r ON r.team_id = t.id
LEFT JOIN (SELECT team_id, count(*) AS n FROM bench_app_users
           WHERE team_id IS NOT NULL AND CAST(id AS BIGINT) % 49 <> 0 GROUP BY team_id) m ON m.team_id = t.id""",
                      "bench_team_repo", "bench_team", "bench_app_users")


def webhook_key_sql() -> str:
    return with_views("""
SELECT 'jira' AS source,
       sha256('{"webhookEvent":"jira:issue_updated","issue":{"key":"' || issue_key || '"}}') AS source_id,
       'jira:issue_updated' AS event_type
FROM bench_issues WHERE CAST(issue_id AS BIGINT) % 23 <> 0""", "bench_issues")


def usage_report_sql() -> str:
    return with_views("""
SELECT 'claude_code' AS source, 'claude_code:' || actor_key || ':' || strftime(day, '%Y-%m-%d') AS source_id,
       'usage.snapshot' AS event_type,
       concat_ws('|', strftime(day, '%Y-%m-%d') || 'T00:00:00Z', actor_key, 'vscode', sessions) AS detail
FROM bench_ai_usage WHERE source = 'claude_code' AND sessions % 5 <> 0""", "bench_ai_usage")


def usage_ndjson_sql() -> str:
    return with_views("""
SELECT 'copilot' AS source, 'copilot:' || actor_key || ':' || strftime(day, '%Y-%m-%d') AS source_id,
       'usage.snapshot' AS event_type,
       concat_ws('|', actor_key, strftime(day, '%Y-%m-%d'), sessions) AS detail
FROM bench_ai_usage WHERE source = 'copilot'""", "bench_ai_usage")


def read_envelopes_sql() -> str:
    body = """
WITH deliveries AS (
  SELECT source, event_type, seq FROM envelope_keys
  UNION ALL
  SELECT source, event_type, ((seq // 4) + 3600000000) * 4 + 2 FROM envelope_keys WHERE seq % 7 = 0)
SELECT source, event_type, count(*) AS events FROM deliveries WHERE seq % 101 <> 0 GROUP BY source, event_type
UNION ALL
SELECT 'quarantine', 'missing: source_id', count(*) FROM deliveries WHERE seq % 101 = 0 HAVING count(*) > 0"""
    return with_views(body, "bench_runs", "bench_prs", "bench_reviews", "bench_issues", "bench_ai_usage",
                      "bench_team_repo", "bench_team", extra=[("envelope_keys", ENVELOPE_KEYS)])


def stream_quarantine_sql() -> str:
    body = """
SELECT 'missing: source_id' AS reason, source, event_type, count(*) AS events FROM (
  SELECT source, event_type, seq FROM envelope_keys
  UNION ALL
  SELECT source, event_type, ((seq // 4) + 3600000000) * 4 + 2 FROM envelope_keys WHERE seq % 7 = 0) d
WHERE seq % 101 = 0 GROUP BY source, event_type"""
    return with_views(body, "bench_runs", "bench_prs", "bench_reviews", "bench_issues", "bench_ai_usage",
                      "bench_team_repo", "bench_team", extra=[("envelope_keys", ENVELOPE_KEYS)])


def usage_quarantine_sql() -> str:
    return with_views("""
SELECT CASE WHEN sessions % 7 = 0 THEN '{not json' ELSE '{"user_login": null, "day": "2024-01-01"}' END AS record,
       'not a usage record' AS reason
FROM bench_ai_usage WHERE source = 'copilot' AND sessions % 7 IN (0, 2)""", "bench_ai_usage")


def disconnected_sql() -> str:
    return with_views("""
SELECT repo, count(*) AS prs FROM bench_prs
WHERE repo NOT IN (SELECT 'acme/repo-' || CAST(s_suppkey * 3 AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 3)
GROUP BY repo""", "bench_prs")
