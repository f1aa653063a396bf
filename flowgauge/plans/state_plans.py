"""Rebuilding latest-state tables from raw envelopes (D1-D8, E1-E10 end to end)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import state as S
from . import params as P

RUN_KEYS = ["repo", "run_id"]
PR_KEYS = ["repo", "pr_id"]
REVIEW_KEYS = ["repo", "review_id"]
ISSUE_KEYS = ["issue_key"]
USAGE_KEYS = ["source", "actor_key", "day"]


def _extract_all_runs(routed: dict[str, DataFrame]) -> DataFrame:
    return E.extract_runs(routed["workflow_run"]).unionByName(E.extract_builds(routed["jenkins_build"]))


def run_state(env: DataFrame, only: list[str] | None = None) -> DataFrame:
    """workflow_run_state from GitHub runs and Jenkins builds."""
    rows = S.first_rows(_extract_all_runs(S.route_events(S.deliveries(env))))
    return S.latest_state(S.narrowed(rows, RUN_KEYS, only), RUN_KEYS).drop("seq").withColumnRenamed("received_at", "last_received_at")


def pr_state(env: DataFrame, only: list[str] | None = None) -> DataFrame:
    return S.rebuild(env, "pull_request", E.extract_pull_requests, PR_KEYS, only=only)


def review_state(env: DataFrame) -> DataFrame:
    return S.rebuild(env, "pull_request_review", E.extract_reviews, REVIEW_KEYS)


def issue_state(env: DataFrame) -> DataFrame:
    """jira_issue_state with the sticky ``reopened`` flag (D3)."""
    return S.rebuild(env, "jira_issue", E.extract_issues, ISSUE_KEYS, sticky="reopened")


def usage_state(env: DataFrame, monthly_seat_usd: float = P.COPILOT_MONTHLY_SEAT_USD) -> DataFrame:
    rows = E.extract_usage(S.route_events(S.dedup_events(env))["ai_usage"], monthly_seat_usd)  # wider than their payloads
    return S.latest_state(rows, USAGE_KEYS).drop("seq").withColumnRenamed("received_at", "last_received_at")


def dedup_counts(env: DataFrame) -> DataFrame:
    """D1 observed: distinct deliveries kept per (source, event_type)."""
    return S.dedup_events(env).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("events"))


def late_event_counts(env: DataFrame) -> DataFrame:
    """D8 observed: per entity, events the latest-state guard ignored."""
    routed = S.route_events(S.deliveries(env))
    usage = S.route_events(S.dedup_events(env))["ai_usage"]
    parts = [
        S.late_events(S.first_rows(_extract_all_runs(routed)), RUN_KEYS).select(F.lit("workflow_run").alias("entity")),
        S.late_events(S.first_rows(E.extract_pull_requests(routed["pull_request"])), PR_KEYS).select(F.lit("pull_request").alias("entity")),
        S.late_events(S.first_rows(E.extract_reviews(routed["pull_request_review"])), REVIEW_KEYS).select(
            F.lit("pull_request_review").alias("entity")),
        S.late_events(S.first_rows(E.extract_issues(routed["jira_issue"])), ISSUE_KEYS).select(F.lit("jira_issue").alias("entity")),
        S.late_events(E.extract_usage(usage, P.COPILOT_MONTHLY_SEAT_USD), USAGE_KEYS).select(
            F.lit("ai_usage").alias("entity")),
    ]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.groupBy("entity").agg(F.count(F.lit(1)).alias("late_events"))


def routed_counts(env: DataFrame) -> DataFrame:
    """D6 observed: envelopes per entity after dedup (unknown types: null)."""
    d = S.dedup_events(env)
    return d.groupBy(S.entity_of(F.col("source"), F.col("event_type")).alias("entity")).agg(
        F.count(F.lit(1)).alias("events"))
