"""SQL twins of :mod:`flowgauge.plans.work_metrics`."""
from __future__ import annotations

from . import params as P
from .oracle import _since, build_mart_sql
from .oracle_dash import classified_cte
from .oracle_views import with_views
from .params import Params

AUDIENCE = ("who", """
SELECT repo, unnest([{'scope_type': 'repo', 'scope_id': repo}, {'scope_type': 'org', 'scope_id': '*'}]
    || list_transform(coalesce(teams, []), lambda t: {'scope_type': 'team', 'scope_id': t}), recursive := true)
FROM (SELECT DISTINCT repo FROM bench_prs)
LEFT JOIN (SELECT repo, list(DISTINCT team_id) AS teams FROM bench_team_repo GROUP BY repo) USING (repo)""")

SIZES = ("sizes", """
SELECT p.repo, number, state, created_at, CAST(sum(l_quantity) AS BIGINT) * (number % 5 + 1) AS adds, CAST(sum(l_partkey % 50) AS BIGINT) AS dels,
       created_at + to_hours(CAST(1 + number % 48 AS BIGINT)) AS final_at
FROM lineitem JOIN bench_prs p ON l_orderkey = number GROUP BY p.repo, number, state, created_at""")


def _day(p: Params) -> str:
    return f"DATE '{p.as_of_date_sql}'"


def ai_commits_sql(p: Params = P.DEFAULT) -> str:
    body = f"""
SELECT scope_type, scope_id, CAST(date_trunc('week', written) AS DATE) AS week, count(*) AS n_commits,
       count(*) FILTER (tool <> '') AS n_ai, count(*) FILTER (tool = 'claude') AS n_claude, count(*) FILTER (tool = 'copilot') AS n_copilot,
       count(*) FILTER (tool = 'cursor') AS n_cursor, avg(CAST(tool <> '' AS INT)) AS ai_share
FROM (
  SELECT DISTINCT repo, number, l_linenumber, l_partkey,
         created_at - to_minutes(CAST((l_partkey * 7 + l_linenumber * 13) % 4000 - 200 AS BIGINT)) AS written,
         CASE l_partkey % 8 WHEN 0 THEN 'claude' WHEN 1 THEN 'copilot' WHEN 2 THEN 'cursor' ELSE '' END AS tool
  FROM lineitem JOIN bench_prs ON l_orderkey = number
) JOIN who USING (repo) WHERE written >= {_since(p)} AND written <= TIMESTAMP '{p.as_of_sql}' GROUP BY ALL"""
    return with_views(body, "bench_prs", "bench_team_repo", extra=[AUDIENCE])


def pr_sizes_sql(p: Params = P.DEFAULT) -> str:
    nth = lambda q: f"list_sort(list(bin))[(count(*) * {q} + 99) // 100]"
    body = f"""
SELECT scope_type, scope_id, count(*) AS n_prs, count(*) FILTER (lines > {P.OVERSIZED_LINES}) AS n_oversized, avg(lines) AS mean_lines,
       {nth(50)} AS lines_p50, {nth(75)} AS lines_p75, {nth(90)} AS lines_p90
FROM (SELECT repo, created_at, adds + dels AS lines,
             CASE WHEN adds + dels < 128 THEN adds + dels
                  ELSE CAST((adds + dels) - (adds + dels) % CAST(2 ** (floor(log2(adds + dels)) - 6) AS BIGINT) AS BIGINT) END AS bin FROM sizes)
JOIN who USING (repo) WHERE CAST(created_at AS DATE) >= {_day(p)} - {p.days} GROUP BY scope_type, scope_id"""
    return with_views(body, "bench_prs", "bench_team_repo", extra=[AUDIENCE, SIZES])


def pr_flags_sql(p: Params = P.DEFAULT) -> str:
    now = f"TIMESTAMP '{p.as_of_sql}'"
    body = f"""
WITH rules AS (
  SELECT 'team-' || n_nationkey AS team_id, 24 * (n_nationkey + 1) AS hours, NULL AS most FROM nation WHERE n_nationkey < 6 AND n_nationkey % 2 = 0
  UNION ALL SELECT 'team-' || n_nationkey, NULL, 100 + 50 * n_nationkey FROM nation WHERE n_nationkey < 6 AND n_nationkey % 3 = 0
), owned AS (
  SELECT b.repo, b.number, b.created_at, t.team_id, coalesce(min(hours), {P.FLAG_LIMITS['age']}) AS hours, coalesce(min(most), {P.FLAG_LIMITS['size']}) AS most
  FROM bench_prs b LEFT JOIN (SELECT DISTINCT team_id, repo FROM bench_team_repo) t USING (repo) LEFT JOIN rules r ON r.team_id = t.team_id
  WHERE b.state = 'open' GROUP BY ALL
), measured AS (
  SELECT o.*, CASE WHEN final_at <= {now} THEN adds + dels WHEN s.created_at <= {now} THEN adds // 2 END AS lines, adds, final_at
  FROM owned o LEFT JOIN sizes s USING (repo, number)
)
SELECT repo, number, team_id, 'age' AS kind, CAST(hours AS BIGINT) AS "limit",
       CAST((epoch_us({now}) - epoch_us(created_at)) // 3600000000 AS BIGINT) AS value, created_at + to_hours(CAST(hours AS BIGINT)) AS crossed_at
FROM measured WHERE {now} > created_at + to_hours(CAST(hours AS BIGINT))
UNION ALL
SELECT repo, number, team_id, 'size', CAST(most AS BIGINT), CAST(lines AS BIGINT), CASE WHEN adds // 2 > most THEN created_at ELSE final_at END
FROM measured WHERE lines > most"""
    return with_views(body, "bench_prs", "bench_team_repo", extra=[SIZES])


def goals_sql(p: Params = P.DEFAULT) -> str:
    keys = ", ".join(f"'{k}'" for k in P.GOAL_METRICS)
    worse = ", ".join(f"'{k}'" for k in P.LOWER_IS_BETTER)
    day = _day(p)
    return f"""
WITH mart AS ({build_mart_sql(p)}), goals AS (
  SELECT CAST(n_nationkey AS BIGINT) AS goal_id, [{keys}][n_nationkey % {len(P.GOAL_METRICS)} + 1] AS metric_key,
         CASE n_nationkey % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'team' ELSE 'repo' END AS scope_type,
         CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'team-' || n_nationkey % 6 ELSE 'acme/repo-' || n_nationkey END AS scope_id,
         DATE '2024-01-10' + CAST(n_nationkey AS INTEGER) AS start_day, DATE '2024-01-30' + CAST(2 * n_nationkey AS INTEGER) AS end_day, 10.0::DOUBLE AS a,
         CASE WHEN n_nationkey % 7 = 0 THEN 10.0 WHEN n_nationkey % 2 = 0 THEN 5.0 ELSE 60.0 END::DOUBLE AS b
  FROM nation
), placed AS (
  SELECT g.*, max(day) AS live_day, arg_max(value, day) AS live_value,
         greatest(0.0, least(1.0, (least(end_day, {day}) - start_day) / (end_day - start_day)))::DOUBLE AS elapsed
  FROM goals g LEFT JOIN mart m ON g.metric_key = m.metric_key AND g.scope_type = m.scope_type AND g.scope_id = m.scope_id
       AND day >= start_day AND day <= least(end_day, {day})
  GROUP BY ALL
)
SELECT goal_id, metric_key, scope_type, scope_id, live_day, live_value, elapsed, a + (b - a) * elapsed AS expected_value,
       CASE WHEN a <> b THEN (live_value - a) / (b - a) END AS progress,
       CASE WHEN start_day > {day} THEN 'not-started' WHEN live_value IS NULL THEN 'no-data'
            WHEN a = b THEN CASE WHEN (live_value <= b AND metric_key IN ({worse})) OR (live_value >= b AND metric_key NOT IN ({worse})) THEN 'on-track' ELSE 'off-track' END
            WHEN (live_value - a) / (b - a) - elapsed >= 0 THEN 'on-track' WHEN (live_value - a) / (b - a) - elapsed >= -{P.GOAL_SLACK} THEN 'at-risk' ELSE 'off-track' END AS status
FROM placed"""


def _creep_ctes(p: Params) -> list[tuple[str, str]]:
    """Runs are found by counting the breaks before each week, baselines by a self join."""
    return [AUDIENCE, *classified_cte(p), ("weeks", """
SELECT scope_type, scope_id, CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS n_items, count(*) FILTER (category = 'Unplanned') AS n_unplanned
FROM classified JOIN who USING (repo) WHERE category <> 'Unclassifiable' GROUP BY ALL"""), ("based", f"""
SELECT a.*, a.n_unplanned / a.n_items AS share, sum(b.n_unplanned) / sum(b.n_items) AS baseline
FROM weeks a LEFT JOIN weeks b ON a.scope_type = b.scope_type AND a.scope_id = b.scope_id AND b.week < a.week AND b.week >= a.week - {7 * P.CREEP_WEEKS}
GROUP BY ALL"""), ("judged", f"""
SELECT *, coalesce(share > baseline + {P.CREEP_MARGIN}, FALSE) AS above FROM based"""), ("broken", """
SELECT *, coalesce(lag(above) OVER w AND lag(week) OVER w = week - 7, FALSE) AS goes_on FROM judged WINDOW w AS (PARTITION BY scope_type, scope_id ORDER BY week)"""),
        ("numbered", "SELECT *, sum(CAST(above AND NOT goes_on AS INT)) OVER (PARTITION BY scope_type, scope_id ORDER BY week) AS run FROM broken"),
        ("runs", "SELECT scope_type, scope_id, run, min(week) AS run_start, count(*) AS run_weeks FROM numbered WHERE above GROUP BY ALL")]


def creep_sql(p: Params = P.DEFAULT) -> str:
    body = """
SELECT n.scope_type, n.scope_id, week, n_items, n_unplanned, share, baseline, above, r.run_start, r.run_weeks
FROM numbered n LEFT JOIN runs r ON above AND r.scope_type = n.scope_type AND r.scope_id = n.scope_id AND r.run = n.run"""
    return with_views(body, "bench_prs", "bench_issues", "bench_team_repo", extra=_creep_ctes(p))


def creep_items_sql(p: Params = P.DEFAULT) -> str:
    body = """
SELECT n.scope_type, n.scope_id, n.week, r.run_start, issue_key, count(*) AS n_prs
FROM numbered n JOIN runs r USING (scope_type, scope_id, run) JOIN who USING (scope_type, scope_id)
JOIN linked l ON l.repo = who.repo AND CAST(date_trunc('week', l.created_at) AS DATE) = n.week
JOIN bench_issues i USING (issue_key)
WHERE above AND NOT i.reopened AND lower(i.issue_type) = 'bug' GROUP BY ALL"""
    return with_views(body, "bench_prs", "bench_issues", "bench_team_repo", extra=_creep_ctes(p))
