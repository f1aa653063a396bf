"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Each entry is a self-contained statement over the driver's tables; the domain
views come from :mod:`flowgauge.plans.oracle_views`. Column names and rounding
match the Spark side exactly.
"""
from __future__ import annotations

import datetime as dt

from . import params as P
from .oracle_views import with_views
from .params import Params


def _since(p: Params) -> str:
    return (p.as_of - dt.timedelta(days=p.days)).strftime("TIMESTAMP '%Y-%m-%d %H:%M:%S'")


def _us(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a}))"


def metric_ctes(p: Params) -> list[tuple[str, str]]:
    """One table of facts for all metrics and one table of who sees a repository."""
    fix = f"INTERVAL {p.within_hours} HOUR"
    return [
        ("good_runs", f"""SELECT repo, run_id, ts, regexp_matches(name, '{p.deploy_pattern}', 'i') AS ships,
            regexp_matches(name, '{p.hotfix_pattern}', 'i') AS mends FROM bench_runs WHERE conclusion = 'success'"""),
        ("releases", f"SELECT repo, ts FROM good_runs WHERE ships AND ts >= {_since(p)}"),
        ("fixes", "SELECT repo, ts FROM good_runs WHERE mends"),
        ("landed", f"SELECT pr_id, repo, created_at, merged_at FROM bench_prs WHERE merged_at >= {_since(p)}"),
        ("facts", f"""
            SELECT '{P.MK_DEPLOY_FREQ}' AS metric_key, repo, CAST(ts AS DATE) AS day, NULL::BIGINT AS us, 0 AS failed FROM releases
            UNION ALL BY NAME
            SELECT '{P.MK_LEAD_TIME}' AS metric_key, l.repo, CAST(r.ts AS DATE) AS day, {_us('l.created_at', 'r.ts')} AS us
            FROM landed l ASOF JOIN releases r ON l.repo = r.repo AND l.merged_at <= r.ts
            UNION ALL BY NAME
            SELECT unnest(CASE WHEN f.ts <= r.ts + {fix} THEN ['{P.MK_CFR}', '{P.MK_MTTR}'] ELSE ['{P.MK_CFR}'] END) AS metric_key,
                   r.repo, CAST(r.ts AS DATE) AS day, {_us('r.ts', 'f.ts')} AS us, coalesce(f.ts <= r.ts + {fix}, FALSE)::INT AS failed
            FROM releases r ASOF LEFT JOIN fixes f ON r.repo = f.repo AND r.ts <= f.ts
            UNION ALL BY NAME
            SELECT unnest(['{P.MK_VELOCITY}', '{P.MK_CYCLE}']) AS metric_key, repo, CAST(merged_at AS DATE) AS day,
                   {_us('created_at', 'merged_at')} AS us FROM landed"""),
        ("audience", """
            SELECT repo, unnest([{'scope_type': 'repo', 'scope_id': repo}, {'scope_type': 'org', 'scope_id': '*'}]
                || list_transform(coalesce(teams, []), lambda t: {'scope_type': 'team', 'scope_id': t}), recursive := true)
            FROM (SELECT DISTINCT repo FROM facts)
            LEFT JOIN (SELECT repo, list(DISTINCT team_id) AS teams FROM bench_team_repo GROUP BY repo) USING (repo)"""),
    ]


METRICS = {"deployment_frequency": P.MK_DEPLOY_FREQ, "lead_time_p50": P.MK_LEAD_TIME, "change_failure_rate": P.MK_CFR,
           "mttr_p50": P.MK_MTTR, "pr_velocity": P.MK_VELOCITY, "pr_cycle_time_p50": P.MK_CYCLE}


def _daily(where: str = "TRUE") -> str:
    return f"""
SELECT metric_key, scope_type, scope_id, day,
       CAST(CASE WHEN metric_key IN ('{P.MK_DEPLOY_FREQ}', '{P.MK_VELOCITY}') THEN count(*)
                 WHEN metric_key = '{P.MK_CFR}' THEN avg(failed)
                 ELSE quantile_cont(us, 0.5) / 3.6e9 END AS DOUBLE) AS value,
       count(*) AS sample_size
FROM facts JOIN audience USING (repo) WHERE {where} GROUP BY metric_key, scope_type, scope_id, day"""


def metric_sql(key: str, p: Params = P.DEFAULT) -> str:
    return with_views(_daily(f"metric_key = '{METRICS[key]}'"), "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))


def mart_ctes(p: Params) -> list[tuple[str, str]]:
    return metric_ctes(p) + [("mart", f"""
SELECT *, '{P.METRIC_LOGIC_VERSION}' AS metric_logic_version, TIMESTAMP '{p.as_of_sql}' AS computed_at
FROM ({_daily()}) u""")]


def build_mart_sql(p: Params = P.DEFAULT) -> str:
    return with_views("SELECT * FROM mart", "bench_runs", "bench_prs", "bench_team_repo", extra=mart_ctes(p))


def first_event_after_sql(p: Params = P.DEFAULT) -> str:
    body = "SELECT l.pr_id, r.ts AS deploy_ts FROM landed l ASOF LEFT JOIN releases r ON l.repo = r.repo AND l.merged_at <= r.ts"
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))


def followed_within_sql(p: Params = P.DEFAULT) -> str:
    body = f"""
SELECT g.run_id, CAST(coalesce(f.ts <= g.ts + INTERVAL {p.within_hours} HOUR, FALSE) AS BIGINT) AS followed
FROM good_runs g ASOF LEFT JOIN fixes f ON g.repo = f.repo AND g.ts <= f.ts"""
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))


def chain_sql(p: Params = P.DEFAULT) -> str:
    body = f"""
SELECT 'change_failure_rate_chain' AS metric_key, scope_type, scope_id, day, sum(f) / sum(n)::DOUBLE AS value, CAST(sum(n) AS BIGINT) AS sample_size
FROM (SELECT repo, CAST(ts AS DATE) AS day, 0 AS f, 1 AS n FROM releases
      UNION ALL
      SELECT repo, CAST(first_ts AS DATE), 1, 0 FROM (
        SELECT r.repo, f.ts AS fix, min(r.ts) AS first_ts
        FROM (SELECT repo, ts FROM good_runs WHERE ships AND NOT mends AND ts >= {_since(p)}) r
        ASOF JOIN fixes f ON r.repo = f.repo AND r.ts <= f.ts
        WHERE f.ts <= r.ts + INTERVAL {p.within_hours} HOUR GROUP BY r.repo, f.ts) chains) x
JOIN audience USING (repo) GROUP BY scope_type, scope_id, day"""
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))


def lead_percentiles_sql(p: Params = P.DEFAULT) -> str:
    cap = P.LEAD_CAP_DAYS * 86_400_000_000
    cuts = ", ".join(f"quantile_cont(least(us, {cap}), {s / 100}) / 3.6e9 AS p{s}_hours" for s in (50, 75, 90))
    body = f"""
SELECT scope_type, scope_id, count(*) AS n_changes, CAST(sum((us > {cap})::INT) AS BIGINT) AS n_capped, {cuts}
FROM facts JOIN audience USING (repo) WHERE metric_key = '{P.MK_LEAD_TIME}' GROUP BY scope_type, scope_id"""
    return with_views(body, "bench_runs", "bench_prs", "bench_team_repo", extra=metric_ctes(p))


def open_age_sql(p: Params = P.DEFAULT) -> str:
    now = f"TIMESTAMP '{p.as_of_sql}'"
    bands = " ".join(f"WHEN {now} - created_at <= INTERVAL {d} DAY THEN 'up to {d} d'" for d in P.AGE_BANDS_DAYS)
    body = f"""
SELECT CASE {bands} ELSE 'over {P.AGE_BANDS_DAYS[-1]} d' END AS bucket, count(*) AS n_prs,
       CAST(sum(CASE WHEN {now} - created_at <= INTERVAL {P.STALE_PR_DAYS} DAY OR EXISTS (FROM bench_reviews r WHERE r.repo = b.repo
           AND r.pr_number = b.number AND submitted_at BETWEEN {now} - INTERVAL {P.STALE_PR_DAYS} DAY AND {now}) THEN 0 ELSE 1 END) AS BIGINT) AS n_stale
FROM bench_prs b WHERE state = 'open' GROUP BY 1"""
    return with_views(body, "bench_prs", "bench_reviews")
