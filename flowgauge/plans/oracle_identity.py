"""SQL twins for identity resolution and team import.

Observations are recomputed from the envelope construction rules (who appears
in which event, and when it arrives); resolution is the same closed form as
the Spark side, written as window functions.
"""
from __future__ import annotations

from .oracle_views import with_views

_C = "CAST(regexp_extract(author, '([0-9]+)$', 1) AS BIGINT)"
_S = "CAST(regexp_extract(reviewer_login, '([0-9]+)$', 1) AS BIGINT)"
_K = "CAST(issue_id AS BIGINT)"

OBSERVATIONS = f"""
SELECT 'github' AS source, CAST(1000000 + {_C} AS VARCHAR) AS source_user_id, author AS name, CAST(NULL AS VARCHAR) AS email,
       CASE WHEN merged_at IS NOT NULL AND pr_id % 5 = 0 THEN epoch_us(merged_at) + 1 ELSE epoch_us(created_at) END * 4 + 1 AS seq
FROM bench_prs
UNION ALL
SELECT 'github', CAST(1000000 + {_C} AS VARCHAR), author, NULL, epoch_us(merged_at) * 4 FROM bench_prs WHERE merged_at IS NOT NULL
UNION ALL
SELECT 'github', CAST(2000000 + {_S} AS VARCHAR), reviewer_login, NULL, epoch_us(submitted_at) * 4 FROM bench_reviews
UNION ALL
SELECT 'github', CASE WHEN pr_id % 3 <> 0 THEN CAST(1000000 + {_C} AS VARCHAR)
                      ELSE 'email:dev' || CAST({_C} AS VARCHAR) || '@acme.io' END,
       'Dev ' || CAST({_C} AS VARCHAR), 'Dev' || CAST({_C} AS VARCHAR) || '@Acme.io', (epoch_us(merged_at) + 60000000) * 4
FROM bench_prs WHERE merged_at IS NOT NULL
UNION ALL
SELECT 'github', 'email:dev' || CAST({_C} AS VARCHAR) || '@acme.io', 'Dev ' || CAST({_C} AS VARCHAR),
       'dev' || CAST({_C} AS VARCHAR) || '@acme.io', (epoch_us(merged_at) + 120000000) * 4
FROM bench_prs WHERE merged_at IS NOT NULL AND pr_id % 11 = 0
UNION ALL
SELECT 'github', 'email:49699333+dependabot[bot]@users.noreply.github.com', 'dependabot[bot]',
       '49699333+dependabot[bot]@users.noreply.github.com', (epoch_us(merged_at) + 120000000) * 4
FROM bench_prs WHERE merged_at IS NOT NULL AND pr_id % 11 = 0
UNION ALL
SELECT 'jira', 'acct-' || CAST({_K} % 40 AS VARCHAR), assignee,
       CASE WHEN {_K} % 2 = 0 THEN 'dev' || CAST({_K} % 40 AS VARCHAR) || '@acme.io' END, s
FROM (SELECT *, epoch_us(last_received_at) * 4 AS s FROM bench_issues
      UNION ALL SELECT *, epoch_us(created_at + INTERVAL 1800 SECOND) * 4 + 1 FROM bench_issues WHERE reopened
      UNION ALL SELECT *, epoch_us(last_received_at + INTERVAL 1 SECOND) * 4 + 3 FROM bench_issues
                WHERE NOT reopened AND {_K} % 10 = 0) i
UNION ALL
SELECT 'jira', 'acct-r' || CAST({_K} % 7 AS VARCHAR), 'Reporter ' || CAST({_K} % 7 AS VARCHAR), NULL, s
FROM (SELECT *, epoch_us(last_received_at) * 4 AS s FROM bench_issues
      UNION ALL SELECT *, epoch_us(created_at + INTERVAL 1800 SECOND) * 4 + 1 FROM bench_issues WHERE reopened
      UNION ALL SELECT *, epoch_us(last_received_at + INTERVAL 1 SECOND) * 4 + 3 FROM bench_issues
                WHERE NOT reopened AND {_K} % 10 = 0) i
UNION ALL
SELECT 'github', CAST(1000000 + CAST(regexp_extract(u.github_login, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR), u.github_login, NULL,
       epoch_us(TIMESTAMP '2023-12-31 00:00:00') * 4
FROM bench_app_users u JOIN bench_team t ON t.id = u.team_id
"""

RESOLVED = [
    ("obs", OBSERVATIONS),
    ("first_obs", """
SELECT source, source_user_id, name, nullif(lower(trim(email)), '') AS email, seq AS first_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source_user_id ORDER BY seq) AS rn FROM obs) x WHERE rn = 1"""),
    ("keyed", """
SELECT *, CASE WHEN email IS NOT NULL THEN 'email:' || email ELSE 'alias:' || source || ':' || source_user_id END AS k
FROM first_obs"""),
    ("founders", """
SELECT k, source || ':' || source_user_id AS contributor_id, source AS fs, source_user_id AS fu,
       coalesce(name, source_user_id) AS canonical_name, email AS canonical_email,
       (lower(coalesce(name, '')) LIKE '%[bot]' OR lower(coalesce(name, '')) LIKE 'dependabot%'
        OR lower(coalesce(name, '')) LIKE 'renovate%' OR lower(coalesce(name, '')) LIKE 'github-actions%'
        OR lower(coalesce(name, '')) LIKE 'copilot%'
        OR (lower(coalesce(email, '')) LIKE '%noreply%' AND lower(coalesce(name, '')) LIKE '%bot%')) AS is_bot
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first_seq, source, source_user_id) AS rn FROM keyed) x
WHERE rn = 1"""),
]

_VIEWS = ("bench_prs", "bench_reviews", "bench_issues", "bench_app_users", "bench_team_repo", "bench_team")


def aliases_sql() -> str:
    body = """
SELECT f.contributor_id, k.source, k.source_user_id, k.name, k.email,
       CAST(CASE WHEN k.source = f.fs AND k.source_user_id = f.fu THEN 1.00 ELSE 0.90 END AS DOUBLE) AS match_confidence
FROM keyed k JOIN founders f ON f.k = k.k"""
    return with_views(body, *_VIEWS, extra=RESOLVED)


def contributors_sql() -> str:
    return with_views("SELECT contributor_id, canonical_name, canonical_email, is_bot FROM founders", *_VIEWS,
                      extra=RESOLVED)


def humans_sql() -> str:
    return with_views("SELECT contributor_id, canonical_name, canonical_email, is_bot FROM founders WHERE NOT is_bot",
                      *_VIEWS, extra=RESOLVED)


def team_repo_sql() -> str:
    return with_views("SELECT 'github:' || team_id AS team_id, count(DISTINCT repo) AS repos FROM bench_team_repo "
                      "GROUP BY team_id", "bench_team_repo")


def team_members_sql() -> str:
    body = """
SELECT DISTINCT 'github:' || u.team_id AS team_id, f.contributor_id
FROM bench_app_users u JOIN bench_team t ON t.id = u.team_id
JOIN keyed k ON k.source = 'github'
            AND k.source_user_id = CAST(1000000 + CAST(regexp_extract(u.github_login, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR)
JOIN founders f ON f.k = k.k"""
    return with_views(body, *_VIEWS, extra=RESOLVED)


def imported_team_sql() -> str:
    return with_views("SELECT 'github:' || id AS id, name, 'github' AS source, id AS source_id FROM bench_team",
                      "bench_team_repo", "bench_team")


def manual_teams_sql() -> str:
    body = """
WITH req AS (
  SELECT lower(n_name) || ' squad' AS name,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_nationkey * 3600) AS requested_at, n_nationkey * 10 AS seq
  FROM nation
  UNION ALL
  SELECT 'Region ' || r_name, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(100000 + r_regionkey * 60), 1000 + r_regionkey * 10
  FROM region
  UNION ALL
  SELECT '  region: ' || lower(r_name) || '!', TIMESTAMP '2024-01-01 00:00:00' + to_seconds(200000 + r_regionkey * 60),
         2000 + r_regionkey * 10
  FROM region),
s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
      FROM req)
SELECT 'manual:' || slug AS id, name, 'manual' AS source, slug AS source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY requested_at DESC, seq ASC) AS rn FROM s WHERE length(slug) > 0) x
WHERE rn = 1"""
    return with_views(body)
