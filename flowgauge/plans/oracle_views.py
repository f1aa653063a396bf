"""SQL twins of :mod:`flowgauge.plans.views`, for a second engine (DuckDB).

The correctness gate runs each query's SQL against the same parquet tables,
registered as views named after the tables. The domain views are emitted as
CTEs in front of the query body by :func:`with_views`.
"""
from __future__ import annotations

VIEW_SQL: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}


def _view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEW_SQL[name] = sql.strip()
    VIEW_DEPS[name] = deps or []


_view("bench_runs", """
SELECT 'acme/repo-' || CAST(user_id AS VARCHAR) AS repo,
       CAST(event_id AS VARCHAR) AS run_id,
       CASE event_type WHEN 'purchase' THEN 'Deploy production' WHEN 'signup' THEN 'Release'
                       WHEN 'error' THEN 'Hotfix production' WHEN 'click' THEN 'Rollback'
                       ELSE 'CI tests' END AS name,
       CASE event_id % 10 WHEN 0 THEN 'failure' WHEN 1 THEN NULL ELSE 'success' END AS conclusion,
       CAST(ts AS TIMESTAMP) AS ts,
       CAST(ts AS TIMESTAMP) AS last_received_at
FROM events
""")

_view("bench_prs", """
SELECT 'acme/repo-' || CAST(o_custkey % 150 AS VARCHAR) AS repo,
       o_orderkey AS pr_id,
       o_orderkey AS number,
       CASE o_orderkey % 4 WHEN 0 THEN 'PROJ-' || CAST(o_orderkey % 2500 AS VARCHAR) || ' fix'
                           WHEN 1 THEN 'UTF-8 PROJ-' || CAST(o_orderkey % 2500 AS VARCHAR)
                           WHEN 2 THEN 'Refactor build scripts'
                           ELSE 'Update docs' END AS title,
       'dev-' || CAST(o_custkey AS VARCHAR) AS author,
       'https://github.com/acme/repo-' || CAST(o_custkey % 150 AS VARCHAR) || '/pull/' || CAST(o_orderkey AS VARCHAR) AS html_url,
       CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
       ['rev-' || CAST(o_custkey % 10 AS VARCHAR)] AS requested_reviewers,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 37 % 40320 AS BIGINT)) AS created_at,
       CASE WHEN o_orderstatus = 'O' THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 37 % 40320 + o_orderkey * 13 % 5760 + 60 AS BIGINT))
       END AS merged_at,
       o_orderpriority = '1-URGENT' AS ai_assisted,
       CASE WHEN o_orderstatus = 'O'
            THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 37 % 40320 AS BIGINT))
            ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(o_orderkey * 37 % 40320 + o_orderkey * 13 % 5760 + 60 AS BIGINT))
       END AS last_received_at
FROM orders
""")

_view("bench_reviews", """
SELECT p.repo,
       l.l_orderkey AS pr_number,
       CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
         CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-' ||
         CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) AS review_id,
       'rev-' || CAST(l.l_suppkey AS VARCHAR) AS reviewer_login,
       CASE l.l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END AS state,
       p.created_at + to_hours(CAST(l.l_quantity AS BIGINT)) AS submitted_at,
       p.created_at + to_hours(CAST(l.l_quantity AS BIGINT)) AS last_received_at
FROM lineitem l JOIN bench_prs p ON l.l_orderkey = p.number
""", ["bench_prs"])

_view("bench_team_repo", """
SELECT 'team-' || CAST(user_id % 5 AS VARCHAR) AS team_id, 'acme/repo-' || CAST(user_id AS VARCHAR) AS repo
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 11 <> 0
UNION ALL
SELECT 'team-5' AS team_id, 'acme/repo-' || CAST(user_id AS VARCHAR) AS repo
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 7 = 0
""")

_view("bench_team", """
SELECT team_id AS id,
       CASE WHEN team_id = 'team-5' THEN 'Platform' ELSE 'Team ' || substr(team_id, 6, 10) END AS name,
       'github' AS source, team_id AS source_id
FROM (SELECT DISTINCT team_id FROM bench_team_repo) t
""", ["bench_team_repo"])

_view("bench_issues", """
SELECT 'PROJ-' || CAST(p_partkey AS VARCHAR) AS issue_key,
       CAST(p_partkey AS VARCHAR) AS issue_id,
       'PROJ' AS project_key,
       CASE WHEN p_size % 4 = 0 THEN 'Bug' ELSE 'Story' END AS issue_type,
       CASE WHEN p_size % 3 = 0 THEN 'Done' ELSE 'In Progress' END AS status,
       p_name AS summary,
       'Dev ' || CAST(p_partkey % 40 AS VARCHAR) AS assignee,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey * 11 % 40320 AS BIGINT)) AS created_at,
       CASE WHEN p_size % 3 = 0
            THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey * 11 % 40320 AS BIGINT)) + INTERVAL 1 DAY
       END AS resolved_at,
       p_size % 9 = 0 AS reopened,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey * 11 % 40320 AS BIGINT)) + INTERVAL 1 HOUR AS last_received_at
FROM part
""")

_view("bench_ai_usage", """
SELECT source, actor_key, day,
       count(*) AS sessions,
       CASE WHEN source = 'copilot' THEN CAST(round(CAST(19 AS DECIMAL(10,2)) / 30, 2) AS DECIMAL(18,2))
            ELSE CAST(sum(cost) AS DECIMAL(18,2)) END AS cost_usd,
       CASE WHEN source = 'claude_code' THEN CAST(sum(pr) AS BIGINT) END AS prs,
       CAST(sum(tok) AS BIGINT) AS tokens_input,
       CAST(trunc(sum(tok) / 4) AS BIGINT) AS tokens_output,
       CAST(sum(acc) AS BIGINT) AS accepted_suggestions,
       CAST(sum(rej) AS BIGINT) AS rejected_suggestions,
       max(ts) AS last_received_at
FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'claude_code' ELSE 'copilot' END AS source,
         CASE WHEN event_id % 2 = 0 THEN 'dev' || CAST(user_id AS VARCHAR) || '@acme.io'
              ELSE 'dev-' || CAST(user_id AS VARCHAR) END AS actor_key,
         CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day,
         CAST(value AS DECIMAL(18,2)) AS cost,
         CASE WHEN event_id % 2 = 0 AND event_type = 'purchase' THEN 1 ELSE 0 END AS pr,
         CAST(event_type = 'click' AS INTEGER) AS acc,
         CAST(event_type = 'error' AS INTEGER) AS rej,
         CAST(trunc(value * 100) AS BIGINT) AS tok,
         CAST(ts AS TIMESTAMP) AS ts
  FROM events
) e
GROUP BY source, actor_key, day
""")

_view("bench_app_users", """
SELECT CAST(c_custkey AS VARCHAR) AS id,
       'Dev' || CAST(c_custkey AS VARCHAR) || '@Acme.io' AS email,
       c_name AS display_name,
       CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' WHEN c_custkey % 7 = 0 THEN 'MANAGER' WHEN c_custkey % 11 = 0 THEN 'ENG_LEADER'
            WHEN c_custkey % 13 = 0 THEN 'FINANCE_READONLY' ELSE 'IC' END AS role,
       CASE WHEN c_custkey % 7 = 0 THEN 'team-' || CAST(c_custkey % 6 AS VARCHAR) END AS team_id,
       'dev-' || CAST(c_custkey AS VARCHAR) AS github_login
FROM customer
""")

_view("bench_audit", """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS occurred_at,
       'dev' || CAST(user_id AS VARCHAR) || '@acme.io' AS actor_email,
       'admin.' || event_type AS action,
       'acme/repo-' || CAST(user_id AS VARCHAR) AS target
FROM events
""")


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named domain views (plus ``extra``
    (name, sql) CTEs, which may reference the views)."""
    ctes = [f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in _closure(list(names))]
    ctes += [f"{n} AS (\n{s.strip()}\n)" for n, s in (extra or [])]
    body = body.strip()
    if body[:5].upper() == "WITH ":  # merge the body's own CTEs into one WITH list
        return ("WITH " + ",\n".join(ctes) + ",\n" + body[5:]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
