"""Filters and predicates.

All are Column expressions or semi/anti joins, so Catalyst can push the
range and equality parts into the parquet scan (regex and ILIKE stay as
post-scan filters, which is expected).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def since(as_of: dt.datetime, days: int) -> Column:
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp")


def in_window(ts: str | Column, as_of: dt.datetime, days: int) -> Column:
    """F1: ``ts >= as_of - days`` (second precision, not day-aligned)."""
    return _c(ts) >= since(as_of, days)


def in_day_window(day: str | Column, as_of: dt.datetime, days: int) -> Column:
    """``day >= date(as_of) - days`` (days + 1 calendar days inclusive)."""
    return _c(day) >= F.date_sub(F.lit(as_of.date()), days)


def name_matches(col: str | Column, pattern: str) -> Column:
    """case-insensitive, unanchored regex."""
    return _c(col).rlike("(?i)" + pattern)


def repo_like(col: str | Column, text: str | None) -> Column:
    """``ILIKE '%text%'``; blank means no filter; % and _ act as wildcards."""
    if text is None or not text.strip():
        return F.lit(True)
    return _c(col).ilike("%" + text.strip() + "%")


def event_class(event_type: str | Column) -> Column:
    """'ci' for workflow_run*/deployment_status* events, else 'git'."""
    et = _c(event_type)
    return F.when(et.startswith("workflow_run") | et.startswith("deployment_status"), "ci").otherwise("git")


def clamp(value: int, lo: int, hi: int) -> int:
    """F8: argument validation for window, page and size parameters."""
    return max(lo, min(hi, int(value)))


def is_team_scope(scope: str | None) -> bool:
    """Repositories are named ``owner/name``; every team id (stored, imported as
    ``<source>:<id>``, manual as ``manual:<slug>``) has no slash."""
    return bool(scope) and bool(scope.strip()) and scope != "*" and "/" not in scope


def scope_repos(df: DataFrame, scope: str | None, team_repo: DataFrame, repo_col: str = "repo") -> DataFrame:
    """``*``/blank = everything; a team id = that team's repositories (a team
    without repositories matches nothing); anything else = one repository.

    The team branch is a left-semi join against the team's repository list (a
    dimension slice), planned as a broadcast when its size allows."""
    if scope is None or scope == "*" or not scope.strip():
        return df
    if is_team_scope(scope):
        repos = team_repo.filter(F.col("team_id") == scope).select(F.col("repo").alias("_sr"))
        return df.join(repos, F.col(repo_col) == F.col("_sr"), "left_semi")
    return df.filter(F.col(repo_col) == scope)


def exclude_disconnected(df: DataFrame, excluded: DataFrame, repo_col: str = "repo") -> DataFrame:
    """hide repositories listed in ``excluded`` (column ``repo``)."""
    return df.join(excluded.select(F.col("repo").alias("_x")), F.col(repo_col) == F.col("_x"), "left_anti")
