"""SQL twins of the stage breakdown and of the lead time of tickets."""
from __future__ import annotations

from . import params as P
from .oracle import _since, _us, metric_ctes
from .oracle_views import with_views
from .params import Params

CAP = P.LEAD_CAP_DAYS * 86_400_000_000


def stages_sql(p: Params = P.DEFAULT) -> str:
    pairs = {"coding": "begun, created_at", "review_wait": "created_at, review_at", "review": "review_at, merged_at",
             "deploy_wait": "merged_at, ts", "lead": "begun, ts"}
    cuts = ", ".join(f"quantile_cont(least({_us(*v.split(', '))}, {CAP}), 0.5) FILTER (whole) / 3.6e9 AS {k}_hours" for k, v in pairs.items())
    body = f"""
WITH written AS (
  SELECT number, min(created_at - to_minutes(CAST((l_partkey * 7 + l_linenumber * 13) % 4000 - 200
         + CASE WHEN l_partkey % 97 = 0 THEN 144000 ELSE 0 END AS BIGINT))) AS first_at
  FROM lineitem JOIN bench_prs ON l_orderkey = number WHERE l_suppkey % 10 <> 0 GROUP BY number
), seen AS (SELECT repo, pr_number, min(submitted_at) AS first_review FROM bench_reviews GROUP BY ALL),
marked AS (
  SELECT l.repo, l.created_at, l.merged_at, r.ts, least(w.first_at, l.created_at) AS begun,
         CASE WHEN s.first_review <= l.merged_at THEN greatest(s.first_review, l.created_at) END AS review_at,
         w.first_at IS NOT NULL AND coalesce(s.first_review <= l.merged_at, FALSE) AS whole
  FROM landed l ASOF JOIN releases r ON l.repo = r.repo AND l.merged_at <= r.ts
  LEFT JOIN written w ON w.number = l.pr_id LEFT JOIN seen s ON s.repo = l.repo AND s.pr_number = l.pr_id
)
SELECT scope_type, scope_id, count(*) AS n_deployed, count(*) FILTER (whole) AS n_changes,
       count(*) FILTER (whole AND {_us('begun', 'ts')} > {CAP}) AS n_capped, {cuts}
FROM marked JOIN audience USING (repo) GROUP BY scope_type, scope_id"""
    return with_views(body, "bench_runs", "bench_prs", "bench_reviews", "bench_team_repo", extra=metric_ctes(p))


def tickets_sql(p: Params = P.DEFAULT) -> str:
    body = f"""
WITH ages AS (
  SELECT 'PROJ-' || p_partkey AS issue_key, TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey * 11 % 40320 AS BIGINT)) AS born, p_partkey, p_size FROM part
), begun AS (
  SELECT issue_key, CASE WHEN p_size % 9 = 0 THEN born + INTERVAL 100 HOUR ELSE born + to_hours(CAST(p_partkey % 7 AS BIGINT)) END AS begun_at
  FROM ages WHERE p_size % 9 = 0 OR p_size % 5 <> 0
), named AS (
  SELECT DISTINCT number, repo, merged_at, unnest(regexp_extract_all(title, '[A-Z][A-Z0-9]{{1,9}}-[0-9]+')) AS issue_key FROM bench_prs
), shipped AS (SELECT repo, ts FROM good_runs WHERE ships),
carried AS (
  SELECT n.issue_key, n.repo, n.number, r.ts FROM named n ASOF LEFT JOIN shipped r ON n.repo = r.repo AND n.merged_at <= r.ts
), tickets AS (
  SELECT b.issue_key, begun_at, count(number) AS n, count(ts) AS done, max(ts) AS last_ts FROM begun b LEFT JOIN carried USING (issue_key) GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN n = 0 THEN 'unlinked' WHEN done = n AND last_ts >= begun_at THEN 'done' ELSE 'pending' END AS state FROM tickets
), counted AS (SELECT * FROM judged WHERE state <> 'done' OR last_ts >= {_since(p)}),
viewed AS (
  SELECT DISTINCT scope_type, scope_id, issue_key FROM carried JOIN (
    SELECT repo, unnest([{{'scope_type': 'repo', 'scope_id': repo}}, {{'scope_type': 'org', 'scope_id': '*'}}]
        || list_transform(coalesce(teams, []), lambda t: {{'scope_type': 'team', 'scope_id': t}}), recursive := true)
    FROM (SELECT DISTINCT repo FROM bench_prs) LEFT JOIN (SELECT repo, list(DISTINCT team_id) AS teams FROM bench_team_repo GROUP BY repo) USING (repo)
  ) USING (repo)
  UNION SELECT 'org', '*', issue_key FROM judged WHERE state = 'unlinked'
)
SELECT scope_type, scope_id, count(*) FILTER (state = 'done') AS n_tickets, count(*) FILTER (state = 'pending') AS n_pending,
       CASE WHEN scope_type = 'org' THEN count(*) FILTER (state = 'unlinked') END AS n_unlinked,
       quantile_cont({_us('begun_at', 'last_ts')}, 0.5) FILTER (state = 'done') / 3.6e9 AS lead_p50_hours
FROM counted JOIN viewed USING (issue_key) GROUP BY scope_type, scope_id"""
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))
