"""SQL twins for the setup/admin queries."""
from __future__ import annotations

from . import params as P
from .admin import CONNECTORS, STUCK_MESSAGE
from .oracle import mart_ctes
from .oracle_state import ENVELOPE_KEYS
from .oracle_views import with_views
from .params import Params

_ALL = ("bench_runs", "bench_prs", "bench_reviews", "bench_issues", "bench_ai_usage", "bench_team_repo", "bench_team")


def _ts(p: Params) -> str:
    return f"TIMESTAMP '{p.as_of_sql}'"


def setup_sql(p: Params = P.DEFAULT) -> str:
    t = P.TARGET_MINUTES
    body = f"""
WITH r AS (
  SELECT coalesce(bool_or(source = 'github' AND NOT (event_type LIKE 'workflow_run%' OR event_type LIKE 'deployment_status%')), false) AS git_connected,
         coalesce(bool_or(source = 'github' AND (event_type LIKE 'workflow_run%' OR event_type LIKE 'deployment_status%')), false) AS ci_connected,
         coalesce(bool_or(source = 'jira'), false) AS ticketing_connected,
         min(CASE WHEN source IN ('github', 'jira') THEN received_at END) AS first_connection_at
  FROM envelope_keys),
m AS (SELECT count(*) > 0 AS dashboard_ready, min(computed_at) AS first_dashboard_at FROM mart),
x AS (SELECT r.*, m.*, CAST((epoch_us(first_dashboard_at) - epoch_us(first_connection_at)) // 60000000 AS BIGINT) AS mins
      FROM r, m)
SELECT git_connected, ticketing_connected, ci_connected, dashboard_ready, first_connection_at, first_dashboard_at,
       mins AS minutes_to_value, mins <= {t} AS within_target,
       CAST((NOT git_connected)::INT + (NOT ticketing_connected)::INT + (NOT ci_connected)::INT + (NOT dashboard_ready)::INT AS BIGINT) AS remaining_items,
       CAST(least(100, floor(mins / {float(t)} * 100 + 0.5)) AS BIGINT) AS progress_pct
FROM x"""
    return with_views(body, *_ALL, extra=[("envelope_keys", ENVELOPE_KEYS)] + mart_ctes(p))


def connector_health_sql(p: Params = P.DEFAULT) -> str:
    rows = ", ".join(f"('{k}', '{n}', '{t}', '{s}')" for k, n, t, s, _ in CONNECTORS)
    body = f"""
WITH stats AS (
  SELECT CASE WHEN source = 'github' AND NOT (event_type LIKE 'workflow_run%' OR event_type LIKE 'deployment_status%') THEN 'github'
              WHEN source = 'github' THEN 'github_actions'
              WHEN source = 'jira' THEN 'jira' WHEN source = 'jenkins' THEN 'jenkins' END AS key,
         count(*) AS event_count, max(received_at) AS last_data_change_at
  FROM envelope_keys GROUP BY 1),
act AS (
  SELECT source, max(t) AS last_checked_at FROM (
    SELECT source, received_at AS t FROM envelope_keys
    UNION ALL SELECT source, received_at + INTERVAL 1 HOUR FROM envelope_keys WHERE seq % 7 = 0) d
  GROUP BY source)
SELECT c.key, c.name, c.type,
       CASE WHEN a.last_checked_at IS NULL THEN 'NOT_CONNECTED'
            WHEN epoch_us({_ts(p)}) - epoch_us(a.last_checked_at) > {P.STALE_AFTER_HOURS * 3_600_000_000} THEN 'STALE'
            ELSE 'CONNECTED' END AS status,
       s.last_data_change_at, a.last_checked_at, CAST(coalesce(s.event_count, 0) AS BIGINT) AS event_count
FROM (VALUES {rows}) c(key, name, type, activity_source)
LEFT JOIN stats s ON s.key = c.key LEFT JOIN act a ON a.source = c.activity_source"""
    return with_views(body, *_ALL, extra=[("envelope_keys", ENVELOPE_KEYS)])


def triggers_cte(p: Params) -> tuple[str, str]:
    return ("triggers", f"""
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'acme/new-repo-' || CAST(s_suppkey AS VARCHAR)
            ELSE 'acme/repo-' || CAST(s_suppkey * 3 AS VARCHAR) END AS repo,
       CASE s_suppkey % 3 WHEN 0 THEN 'IN_PROGRESS' WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS trigger_state,
       {_ts(p)} - to_minutes(CAST((s_suppkey % 4) * 20 AS BIGINT)) AS trigger_at,
       CASE WHEN s_suppkey % 3 = 1 THEN 'Backfill failed: HTTP 502' END AS trigger_error
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 = 0""")


def repo_sync_sql(p: Params = P.DEFAULT) -> str:
    stuck_us = P.STUCK_AFTER_MINUTES * 60_000_000
    body = f"""
WITH rs AS (
  SELECT repo, ts AS last_received_at FROM bench_runs
  UNION ALL
  SELECT repo, ts FROM bench_runs WHERE name = 'CI tests' AND CAST(run_id AS BIGINT) % 13 = 0),
landed AS (
  SELECT repo, max(last_received_at) AS last_sync_at, count(*) AS cnt FROM (
    SELECT repo, last_received_at FROM bench_prs UNION ALL SELECT repo, last_received_at FROM rs) u
  WHERE repo <> 'unknown' GROUP BY repo),
rt AS (SELECT tr.repo, array_to_string(list_sort(list(t.name)), ',') AS teams
       FROM bench_team_repo tr JOIN bench_team t ON t.id = tr.team_id GROUP BY tr.repo),
j AS (SELECT coalesce(l.repo, g.repo) AS repo, l.last_sync_at, l.cnt, g.trigger_state, g.trigger_at, g.trigger_error
      FROM landed l FULL OUTER JOIN triggers g ON g.repo = l.repo),
k AS (SELECT j.*, trigger_state = 'IN_PROGRESS' AND epoch_us(trigger_at) < epoch_us({_ts(p)}) - {stuck_us} AS stuck,
             trigger_state = 'FAILED' AND (last_sync_at IS NULL OR trigger_at > last_sync_at) AS failed
      FROM j)
SELECT k.repo, last_sync_at, CAST(coalesce(cnt, 0) AS BIGINT) AS event_count,
       CASE WHEN stuck THEN 'FAILED' WHEN trigger_state = 'IN_PROGRESS' THEN 'IN_PROGRESS' WHEN failed THEN 'FAILED'
            WHEN last_sync_at IS NOT NULL THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS state,
       CASE WHEN stuck THEN '{STUCK_MESSAGE}' WHEN failed THEN trigger_error END AS error,
       coalesce(rt.teams, '') AS teams
FROM k LEFT JOIN rt ON rt.repo = k.repo"""
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", "bench_team", extra=[triggers_cte(p)])


def team_list_sql() -> str:
    body = """
SELECT t.id, t.name, count(tr.repo) AS repo_count
FROM bench_team t LEFT JOIN bench_team_repo tr ON tr.team_id = t.id GROUP BY t.id, t.name"""
    return with_views(body, "bench_team_repo", "bench_team")


def audit_sql(n: int = 50) -> str:
    return with_views(f"SELECT * FROM bench_audit ORDER BY occurred_at DESC, id DESC LIMIT {n}", "bench_audit")


def user_directory_sql() -> str:
    body = """
SELECT u.id, lower(u.email) AS email, u.display_name, u.role, u.team_id, t.name AS team_name, u.github_login
FROM bench_app_users u LEFT JOIN bench_team t ON t.id = u.team_id"""
    return with_views(body, "bench_app_users", "bench_team_repo", "bench_team")


def scope_filter_sql(email: str, asked: str | None) -> str:
    asked_s = "*" if asked is None or not asked.strip() else asked
    body = f"""
SELECT email, role, CASE WHEN role IN ('ADMIN', 'FINANCE_READONLY', 'ENG_LEADER') THEN '{asked_s}'
                         ELSE coalesce(nullif(trim(team_id), ''), '*') END AS scope
FROM bench_app_users WHERE lower(email) = '{email.strip().lower()}'"""
    return with_views(body, "bench_app_users")
