"""Setup, admin and directory queries.

Each status view is one conditional-aggregate pass over its table; small
one-row results are combined by union + aggregate rather than cross joins.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.filters import event_class
from . import params as P
from .params import Params

# --- fixed values: connector health rows (key, name, type, activity source, class)
CONNECTORS = [
    ("github", "GitHub", "Git host", "github", "git"),
    ("github_actions", "GitHub Actions", "CI/CD", "github", "ci"),
    ("jira", "Jira", "Ticketing", "jira", None),
    ("jenkins", "Jenkins", "CI/CD", "jenkins", None),
]
ORG_WIDE_ROLES = ["ADMIN", "FINANCE_READONLY", "ENG_LEADER"]
STUCK_MESSAGE = "sync_overdue"
# ------------------------------------------------------------------------------


def setup_status(raw: DataFrame, mart: DataFrame, target_minutes: int = P.TARGET_MINUTES) -> DataFrame:
    """Q27: connection checklist and time to first value, in one pass per table."""
    cls = event_class("event_type")
    gh = F.col("source") == "github"
    r = raw.groupBy().agg(
        F.coalesce(F.bool_or(gh & (cls == "git")), F.lit(False)).alias("git_connected"),
        F.coalesce(F.bool_or(gh & (cls == "ci")), F.lit(False)).alias("ci_connected"),
        F.coalesce(F.bool_or(F.col("source") == "jira"), F.lit(False)).alias("ticketing_connected"),
        F.min(F.when(F.col("source").isin("github", "jira"), F.col("received_at"))).alias("first_connection_at"))
    m = mart.groupBy().agg((F.count(F.lit(1)) > 0).alias("dashboard_ready"), F.min("computed_at").alias("first_dashboard_at"))
    both = r.unionByName(m, allowMissingColumns=True).groupBy().agg(
        *[F.max(c).alias(c) for c in ["git_connected", "ci_connected", "ticketing_connected", "first_connection_at",
                                      "dashboard_ready", "first_dashboard_at"]])
    minutes = C.whole_minutes("first_connection_at", "first_dashboard_at")
    flags = ["git_connected", "ticketing_connected", "ci_connected", "dashboard_ready"]
    remaining = sum((~F.col(f)).cast("int") for f in flags)
    return both.select(
        *flags, "first_connection_at", "first_dashboard_at", minutes.alias("minutes_to_value"),
        (minutes <= target_minutes).alias("within_target"),
        remaining.cast("long").alias("remaining_items"),
        F.least(F.lit(100), F.floor(minutes / F.lit(float(target_minutes)) * 100 + 0.5)).cast("long").alias("progress_pct"))


def connector_health(raw: DataFrame, activity: DataFrame, p: Params = P.DEFAULT,
                     stale_hours: int = P.STALE_AFTER_HOURS) -> DataFrame:
    """Q28: one row per connector: stored event count, last data change, last
    activity (D4) and status NOT_CONNECTED / STALE (> 24 h) / CONNECTED."""
    spark: SparkSession = raw.sparkSession
    key = (F.when((F.col("source") == "github") & (event_class("event_type") == "git"), "github")
           .when(F.col("source") == "github", "github_actions")
           .when(F.col("source") == "jira", "jira").when(F.col("source") == "jenkins", "jenkins"))
    stats = raw.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("event_count"),
                                              F.max("received_at").alias("last_data_change_at"))
    rows = spark.createDataFrame([c[:4] for c in CONNECTORS], "key string, name string, type string, activity_source string")
    act = activity.select(F.col("source").alias("activity_source"), "last_checked_at")
    j = rows.join(stats, "key", "left").join(act, "activity_source", "left")
    as_of = F.lit(p.as_of).cast("timestamp")
    status = (F.when(F.col("last_checked_at").isNull(), "NOT_CONNECTED")
              .when(C.micros("last_checked_at", as_of) > F.lit(stale_hours * 3_600_000_000), "STALE")
              .otherwise("CONNECTED"))
    return j.select("key", "name", "type", status.alias("status"), "last_data_change_at", "last_checked_at",
                    F.coalesce(F.col("event_count"), F.lit(0)).cast("long").alias("event_count"))


def sync_triggers(spark: SparkSession, base: str, p: Params = P.DEFAULT) -> DataFrame:
    """Backfill triggers recorded by the admin console, derived from ``supplier``:
    every even supplier triggers ``acme/repo-{3s}``; every 5th a never-landed
    ``acme/new-repo-{s}``; state by s % 3; started (s % 4) x 20 minutes ago."""
    from ..sources.tables import read_table
    s = read_table(spark, base, "supplier", "s_suppkey").filter((F.col("s_suppkey") % 2 == 0) | (F.col("s_suppkey") % 5 == 0))
    k = F.col("s_suppkey")
    repo = F.when(k % 5 == 0, F.concat(F.lit("acme/new-repo-"), k.cast("string"))).otherwise(
        F.concat(F.lit("acme/repo-"), (k * 3).cast("string")))
    state = F.when(k % 3 == 0, "IN_PROGRESS").when(k % 3 == 1, "FAILED").otherwise("COMPLETED")
    at = F.timestamp_micros(F.unix_micros(F.lit(p.as_of).cast("timestamp")) - (k % 4) * 20 * 60_000_000)
    return s.select(repo.alias("repo"), state.alias("trigger_state"), at.alias("trigger_at"),
                    F.when(k % 3 == 1, F.lit("Backfill failed: HTTP 502")).alias("trigger_error"))


def repo_teams(team_repo: DataFrame, teams: DataFrame) -> DataFrame:
    """Team names per repository (sorted; bounded by the team count)."""
    j = team_repo.join(teams.select(F.col("id").alias("team_id"), "name"), "team_id", "inner")
    return j.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("teams"))


def repo_sync_status(pr_state: DataFrame, run_state: DataFrame, triggers: DataFrame, team_repo: DataFrame,
                     teams: DataFrame, p: Params = P.DEFAULT, stuck_minutes: int = P.STUCK_AFTER_MINUTES) -> DataFrame:
    """Q29 (U1 + J10): per repository, landed rows and last sync from the PR
    and run states, merged (full outer) with admin triggers, plus team names."""
    landed = (pr_state.select("repo", "last_received_at").unionByName(run_state.select("repo", "last_received_at"))
              .filter(F.col("repo") != "unknown")
              .groupBy("repo").agg(F.max("last_received_at").alias("last_sync_at"), F.count(F.lit(1)).alias("cnt")))
    j = landed.join(triggers, "repo", "full_outer").join(repo_teams(team_repo, teams), "repo", "left")
    as_of_us = F.unix_micros(F.lit(p.as_of).cast("timestamp"))
    ts, last = F.col("trigger_state"), F.col("last_sync_at")
    stuck = (ts == "IN_PROGRESS") & (F.unix_micros("trigger_at") < as_of_us - F.lit(stuck_minutes * 60_000_000))
    failed = (ts == "FAILED") & (last.isNull() | (F.col("trigger_at") > last))
    state = (F.when(stuck, "FAILED").when(ts == "IN_PROGRESS", "IN_PROGRESS").when(failed, "FAILED")
             .when(last.isNotNull(), "COMPLETED").otherwise("IN_PROGRESS"))
    error = F.when(stuck, F.lit(STUCK_MESSAGE)).when(~stuck & failed & (ts != "IN_PROGRESS"), F.col("trigger_error"))
    return j.select("repo", "last_sync_at", F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("event_count"),
                    state.alias("state"), error.alias("error"), F.coalesce(F.col("teams"), F.lit("")).alias("teams"))


def team_list(teams: DataFrame, team_repo: DataFrame, scope: str | None = "*") -> DataFrame:
    """Q30 (J8): teams with their repository counts (0 when none), scoped."""
    t = teams if scope in (None, "*") else teams.filter(F.col("id") == scope)
    j = t.join(team_repo.select(F.col("team_id").alias("id"), "repo"), "id", "left")
    return j.groupBy("id", "name").agg(F.count("repo").alias("repo_count"))


def audit_recent(audit: DataFrame, limit: int = 50) -> DataFrame:
    """Q31 (O4): newest audit entries (limit clamped to 1..500)."""
    n = max(1, min(500, int(limit)))
    return audit.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(n)


def user_directory(users: DataFrame, teams: DataFrame) -> DataFrame:
    """Q32 (J11): users with their team's name."""
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return users.join(t, "team_id", "left").select("id", F.lower("email").alias("email"), "display_name", "role",
                                                   "team_id", "team_name", "github_login").orderBy("display_name", "id")


def find_user(users: DataFrame, email: str) -> DataFrame:
    """Case-insensitive email lookup."""
    return users.filter(F.lower(F.col("email")) == email.strip().lower())


def scope_filter(users: DataFrame, email: str, asked: str | None) -> DataFrame:
    """the scope a user may see. Org-wide roles get the asked scope (blank
    -> ``*``); other roles are pinned to their own team (none -> ``*``)."""
    asked_s = "*" if asked is None or not asked.strip() else asked
    u = find_user(users, email)
    return u.select("email", "role", F.when(F.col("role").isin(ORG_WIDE_ROLES), F.lit(asked_s))
                    .otherwise(F.coalesce(F.nullif(F.trim(F.col("team_id")), F.lit("")), F.lit("*"))).alias("scope"))


def windows(days: int, page: int, size: int) -> tuple[int, int, int]:
    """F8: clamp the request parameters (window 1..90, page >= 0, size 1..100)."""
    return max(1, min(90, days)), max(0, page), max(1, min(100, size))


def since_date(as_of: dt.datetime, days: int) -> dt.date:
    return as_of.date() - dt.timedelta(days=days)
