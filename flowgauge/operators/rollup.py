"""Multi-scope daily rollups.

Every delivery metric is reported at three scopes per UTC day: each repository,
the whole organisation (``scope_id='*'``) and every team that owns the
repository (a repository in two teams counts in both; unmapped repositories
get no team row).

* Additive metrics (counts, failure sums) are pre-aggregated to (repo, day)
  first; only those small partial rows are fanned out to scopes and
  re-aggregated. The team join therefore touches repo x day rows, not events.
* Medians cannot be pre-aggregated (a team median is not a mean of repository
  medians), so raw values are fanned out once and handed to the skew-safe
  :func:`~flowgauge.operators.percentile.grouped_percentile`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .percentile import grouped_percentile

MART_KEYS = ["metric_key", "scope_type", "scope_id", "day"]


def repo_teams(team_repo: DataFrame) -> DataFrame:
    """repo -> sorted array of team ids. One row per repository; the array is
    bounded by the number of teams (a dimension), not by event volume."""
    return team_repo.groupBy("repo").agg(F.array_sort(F.collect_set("team_id")).alias("_teams"))


def scope_fanout(df: DataFrame, team_repo: DataFrame) -> DataFrame:
    """Add ``scope_type``/``scope_id``: one row per (row, scope)."""
    j = df.join(repo_teams(team_repo), "repo", "left")
    teams = F.coalesce(F.col("_teams"), F.array().cast("array<string>"))
    scopes = F.concat(
        F.array(F.struct(F.lit("repo").alias("scope_type"), F.col("repo").alias("scope_id")),
                F.struct(F.lit("org").alias("scope_type"), F.lit("*").alias("scope_id"))),
        F.transform(teams, lambda t: F.struct(F.lit("team").alias("scope_type"), t.alias("scope_id"))))
    return j.select(*[F.col(c) for c in df.columns], F.inline(scopes))


def additive_rollup(df: DataFrame, team_repo: DataFrame, metric_key: str,
                    measures: dict[str, Column], value: Column, sample: Column) -> DataFrame:
    """``df`` has ``repo`` and ``day``. ``measures`` are summable partials
    (name -> aggregate over raw rows); ``value``/``sample`` are expressions over
    the re-aggregated measure columns."""
    partial = df.groupBy("repo", "day").agg(*[agg.alias(n) for n, agg in measures.items()])
    fanned = scope_fanout(partial, team_repo)
    total = fanned.groupBy("scope_type", "scope_id", "day").agg(
        *[F.sum(n).alias(n) for n in measures])
    return total.select(F.lit(metric_key).alias("metric_key"), "scope_type", "scope_id", "day",
                        value.cast("double").alias("value"), sample.cast("long").alias("sample_size"))


def medians_rollup(vals: DataFrame, team_repo: DataFrame) -> DataFrame:
    """Several median metrics in one pass: ``vals`` has ``metric_key, repo,
    day, _us``; one fan-out and one selection serve
    every metric (the metric key is part of the group key)."""
    fanned = scope_fanout(vals, team_repo)
    med = grouped_percentile(fanned, ["metric_key", "scope_type", "scope_id", "day"], "_us", 0.5, out="value",
                             count_out="sample_size", scale=3.6e9)
    return med.select("metric_key", "scope_type", "scope_id", "day",
                      F.col("value").cast("double").alias("value"), F.col("sample_size").cast("long"))


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Exact duration in microseconds (hours = micros / 3.6e9)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.unix_micros(e) - F.unix_micros(s)
