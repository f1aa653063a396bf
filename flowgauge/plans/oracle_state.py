"""SQL twins for the state layer.

The expected latest state is simply the domain view the envelopes were built
from; delivery statistics are recomputed from the envelope construction rules
(key, received time and arrival number of every original envelope).
"""
from __future__ import annotations

from .oracle_views import with_views


def _rx(x: str) -> str:
    return f"(epoch_us({x}))"


ENVELOPE_KEYS = """
SELECT 'github' AS source, CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN 'workflow_run' ELSE 'workflow_run.snapshot' END AS event_type,
       'workflow_run' AS entity, ts AS received_at, epoch_us(ts) * 4 AS seq FROM bench_runs
UNION ALL
SELECT 'github', CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN 'workflow_run' ELSE 'workflow_run.snapshot' END,
       'workflow_run', ts - INTERVAL 300 SECOND,
       CASE WHEN CAST(run_id AS BIGINT) % 5 = 0 THEN epoch_us(ts) + 1 ELSE epoch_us(ts) - 300000000 END * 4 + 1
FROM bench_runs WHERE CAST(run_id AS BIGINT) % 3 = 0
UNION ALL
SELECT 'jenkins', 'build.snapshot', 'jenkins_build', ts, epoch_us(ts) * 4
FROM bench_runs WHERE name = 'CI tests' AND CAST(run_id AS BIGINT) % 13 = 0
UNION ALL
SELECT 'github', CASE WHEN pr_id % 2 = 0 THEN 'pull_request' ELSE 'pull_request.snapshot' END, 'pull_request',
       created_at, CASE WHEN merged_at IS NOT NULL AND pr_id % 5 = 0 THEN epoch_us(merged_at) + 1 ELSE epoch_us(created_at) END * 4 + 1
FROM bench_prs
UNION ALL
SELECT 'github', CASE WHEN pr_id % 2 = 0 THEN 'pull_request' ELSE 'pull_request.snapshot' END, 'pull_request',
       merged_at, epoch_us(merged_at) * 4
FROM bench_prs WHERE merged_at IS NOT NULL
UNION ALL
SELECT 'github', 'pull_request_review.snapshot', 'pull_request_review', submitted_at, epoch_us(submitted_at) * 4 FROM bench_reviews
UNION ALL
SELECT 'jira', 'issue.snapshot', 'jira_issue', last_received_at, epoch_us(last_received_at) * 4 FROM bench_issues
UNION ALL
SELECT 'jira', 'jira:issue_updated', 'jira_issue', created_at + INTERVAL 1800 SECOND,
       epoch_us(created_at + INTERVAL 1800 SECOND) * 4 + 1
FROM bench_issues WHERE reopened
UNION ALL
SELECT 'jira', 'jira:issue_updated', 'jira_issue', created_at + INTERVAL 600 SECOND,
       epoch_us(last_received_at + INTERVAL 1 SECOND) * 4 + 3
FROM bench_issues WHERE NOT reopened AND CAST(issue_id AS BIGINT) % 10 = 0
UNION ALL
SELECT source, 'usage.snapshot', 'ai_usage', last_received_at, epoch_us(last_received_at) * 4 FROM bench_ai_usage
UNION ALL
SELECT 'github', 'commit.snapshot', NULL, merged_at + INTERVAL 60 SECOND, (epoch_us(merged_at) + 60000000) * 4
FROM bench_prs WHERE merged_at IS NOT NULL
UNION ALL
SELECT 'github', 'push', NULL, merged_at + INTERVAL 120 SECOND, (epoch_us(merged_at) + 120000000) * 4
FROM bench_prs WHERE merged_at IS NOT NULL AND pr_id % 11 = 0
UNION ALL
SELECT 'github', 'team.snapshot', NULL, TIMESTAMP '2023-12-31 00:00:00' + to_seconds(page),
       epoch_us(TIMESTAMP '2023-12-31 00:00:00' + to_seconds(page)) * 4
FROM (SELECT id AS team_id, 0 AS page FROM bench_team
      UNION SELECT team_id, CAST(regexp_extract(repo, '([0-9]+)$', 1) AS BIGINT) % 4 + 1 FROM bench_team_repo) tp
"""

_ALL_VIEWS = ("bench_runs", "bench_prs", "bench_reviews", "bench_issues", "bench_ai_usage", "bench_team_repo",
              "bench_team")


def _with_keys(body: str) -> str:
    return with_views(body, *_ALL_VIEWS, extra=[("envelope_keys", ENVELOPE_KEYS)])


def dedup_counts_sql() -> str:
    return _with_keys("SELECT source, event_type, count(*) AS events FROM envelope_keys GROUP BY source, event_type")


def routed_counts_sql() -> str:
    return _with_keys("SELECT entity, count(*) AS events FROM envelope_keys GROUP BY entity")


def connector_activity_sql() -> str:
    return _with_keys("""
SELECT source, max(t) AS last_checked_at, count(*) AS deliveries FROM (
  SELECT source, received_at AS t FROM envelope_keys
  UNION ALL
  SELECT source, received_at + INTERVAL 1 HOUR FROM envelope_keys WHERE seq % 7 = 0
) d GROUP BY source""")


def late_counts_sql() -> str:
    body = """
SELECT entity, count(*) AS late_events FROM (
  SELECT 'workflow_run' AS entity FROM bench_runs WHERE CAST(run_id AS BIGINT) % 3 = 0 AND CAST(run_id AS BIGINT) % 5 = 0
  UNION ALL SELECT 'pull_request' FROM bench_prs WHERE merged_at IS NOT NULL AND pr_id % 5 = 0
  UNION ALL SELECT 'jira_issue' FROM bench_issues WHERE NOT reopened AND CAST(issue_id AS BIGINT) % 10 = 0
) l GROUP BY entity"""
    return with_views(body, "bench_runs", "bench_prs", "bench_issues")


def run_state_sql() -> str:
    body = """
SELECT repo, run_id, conclusion, name, ts, last_received_at FROM bench_runs
UNION ALL
SELECT repo, 'jenkins:build-' || regexp_extract(repo, '([^/]+)$', 1) || ':' || run_id, conclusion,
       'build-' || regexp_extract(repo, '([^/]+)$', 1), date_trunc('millisecond', ts), ts
FROM bench_runs WHERE name = 'CI tests' AND CAST(run_id AS BIGINT) % 13 = 0"""
    return with_views(body, "bench_runs")


def pr_state_sql() -> str:
    body = """
SELECT repo, pr_id, number, title, author, html_url, state, array_to_string(requested_reviewers, ',') AS requested_reviewers,
       created_at, merged_at, ai_assisted, last_received_at FROM bench_prs"""
    return with_views(body, "bench_prs")


def review_state_sql() -> str:
    return with_views("SELECT repo, pr_number, review_id, reviewer_login, state, submitted_at, last_received_at "
                      "FROM bench_reviews", "bench_reviews")


def issue_state_sql() -> str:
    return with_views("SELECT issue_key, issue_id, project_key, issue_type, status, summary, assignee, created_at, "
                      "resolved_at, reopened, last_received_at FROM bench_issues", "bench_issues")


def usage_state_sql() -> str:
    return with_views("SELECT source, actor_key, day, sessions, CAST(cost_usd AS DOUBLE) AS cost_usd, prs, tokens_input, "
                      "tokens_output, accepted_suggestions, last_received_at FROM bench_ai_usage", "bench_ai_usage")
