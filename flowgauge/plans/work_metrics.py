"""AI share of commits, sizes of pull requests, flags, goals and scope creep.

All are keyed aggregations: rows are counted per repository and day or week first, and
only these counts are fanned out to the scopes that see the repository.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import commits as CM
from ..operators.filters import in_day_window, in_window
from ..operators.histogram import bin_of, bin_quantiles
from ..operators.rollup import repo_teams, scope_fanout
from ..operators.state import latest_state
from . import params as P
from .params import Params

SCOPE = ["scope_type", "scope_id"]


def _week(ts: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


# ------------------------------------------------------------- AI commits ----
def ai_commit_share(events: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Commits per scope and week (Monday, UTC) and how many credit an AI tool. ``events`` are
    push and commit envelopes; a commit that came in several counts once, in the week it
    was written (without a date: first received). A commit that credits two tools counts once
    in ``n_ai`` and once for each tool."""
    one = CM.merge_commits(CM.extract_commits(events)).withColumn("at", F.coalesce("authored_at", "first_received_at"))
    one = one.filter(in_window("at", p.as_of, p.days) & (F.col("at") <= F.lit(p.as_of)))
    counts = {"n_commits": F.lit(1), "n_ai": (F.size("tools") > 0).cast("long"),
              **{f"n_{t}": F.array_contains("tools", t).cast("long") for t in CM.AI_TOOLS}}
    weekly = one.groupBy("repo", _week("at").alias("week")).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in counts.items()])
    total = scope_fanout(weekly, team_repo).groupBy(*SCOPE, "week").agg(*[F.sum(n).alias(n) for n in counts])
    return total.withColumn("ai_share", F.col("n_ai") / F.col("n_commits"))


# ------------------------------------------------------------------ sizes ----
def pr_size_daily(versions: DataFrame) -> DataFrame:
    """Rows of the mart: per repository and day of opening a histogram of changed lines, from the
    latest size of each pull request (``extract_pr_sizes``). ``n_oversized`` is exact."""
    latest = latest_state(versions, ["repo", "number"]).filter(F.col("created_at").isNotNull())
    return latest.groupBy("repo", F.to_date("created_at").alias("day"), bin_of("lines").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("lines") > P.OVERSIZED_LINES).cast("long")).alias("n_oversized"),
        F.sum("lines").alias("lines")).select(
        F.lit(P.MK_PR_SIZE).alias("metric_key"), F.lit("repo").alias("scope_type"), F.col("repo").alias("scope_id"), "day", "bin", "n",
        "n_oversized", "lines")


def pr_size_distribution(mart: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Per scope over the window: pull requests, oversized ones, mean lines and the 50th, 75th and
    90th percentile (lower end of the bin, less than 1/64 off), merged from the stored histograms."""
    rows = mart.filter((F.col("metric_key") == P.MK_PR_SIZE) & in_day_window("day", p.as_of, p.days))
    window = rows.groupBy(F.col("scope_id").alias("repo"), "bin").agg(*[F.sum(c).alias(c) for c in ("n", "n_oversized", "lines")])
    bins = scope_fanout(window, team_repo).groupBy(*SCOPE, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "n_oversized", "lines")])
    total = bins.groupBy(*SCOPE).agg(F.sum("n").alias("n_prs"), F.sum("n_oversized").alias("n_oversized"), F.sum("lines").alias("_lines"))
    total = total.select(*SCOPE, "n_prs", "n_oversized", (F.col("_lines") / F.col("n_prs")).alias("mean_lines"))
    return total.join(bin_quantiles(bins, SCOPE, {"lines_p50": 50, "lines_p75": 75, "lines_p90": 90}), SCOPE)


# ------------------------------------------------------------------ flags ----
def pr_flags(prs: DataFrame, versions: DataFrame, thresholds: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Open pull requests beyond a limit, one row per owning team (null: no team) and kind.

    ``thresholds`` (team_id, kind, limit): a team's own limit goes before the default. ``age`` is in
    hours since the opening, ``size`` in changed lines of the latest version; ``crossed_at`` is when
    the age reached the limit, or when the first version over it was received."""
    open_prs = prs.filter((F.col("state") == "open") & F.col("number").isNotNull()).select("repo", "number", "created_at")
    default = F.create_map(*[F.lit(x) for kv in P.FLAG_LIMITS.items() for x in kv])
    asked = open_prs.join(repo_teams(team_repo), "repo", "left").select(
        "repo", "number", "created_at", F.explode_outer("_teams").alias("team_id"))
    asked = asked.select("*", F.explode(F.array(*[F.lit(k) for k in P.FLAG_LIMITS])).alias("kind"))
    own = thresholds.groupBy("team_id", "kind").agg(F.min("limit").alias("_own"))  # the strictest of several
    limited = asked.join(own, ["team_id", "kind"], "left").withColumn("limit", F.coalesce("_own", default[F.col("kind")])).drop("_own")
    as_of = F.lit(p.as_of).cast("timestamp")
    due = F.timestamp_micros(F.unix_micros("created_at") + F.col("limit") * 3_600_000_000)
    keys = ["repo", "number", "team_id", "kind", "limit"]
    old = limited.filter((F.col("kind") == "age") & (due < as_of)).select(
        *keys, C.whole_hours("created_at", as_of).alias("value"), due.alias("crossed_at"))
    known = versions.filter(F.col("received_at") <= as_of).select("repo", "number", "lines", "received_at", "seq")
    sized = limited.filter("kind = 'size'").join(known, ["repo", "number"])
    large = sized.groupBy(*keys).agg(F.max_by("lines", F.struct("received_at", -F.col("seq"))).alias("value"),
                                     F.min(F.when(F.col("lines") > F.col("limit"), F.col("received_at"))).alias("crossed_at"))
    return old.unionByName(large.filter(F.col("value") > F.col("limit")))


# ------------------------------------------------------------------ goals ----
def goal_progress(goals: DataFrame, mart: DataFrame, lower_is_better: list[str], p: Params = P.DEFAULT) -> DataFrame:
    """Each goal with its latest daily value inside its time and its place on the straight line from
    ``start_value`` to ``target_value``.

    ``progress`` and ``elapsed`` are shares of the way and of the time. on-track: progress has kept up;
    at-risk: behind by at most ``P.GOAL_SLACK``; off-track: behind by more. A goal that holds its
    start value has no way to go: it is on-track while no worse than the target, else off-track.
    no-data: no value yet; not-started: begins after ``as_of``."""
    today = F.lit(p.as_of.date())
    until = F.least("end_day", today)
    values = mart.select("metric_key", *SCOPE, F.col("day").cast("date").alias("day"), "value")
    held = goals.join(values, ["metric_key", *SCOPE]).filter(F.col("day").between(F.col("start_day"), until))
    live = held.groupBy("goal_id").agg(F.max("day").alias("live_day"), F.max_by("value", "day").alias("live_value"))
    way = F.col("target_value") - F.col("start_value")
    span = F.datediff("end_day", "start_day")
    elapsed = F.when(span <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(until, "start_day") / span)))
    rows = goals.join(live, "goal_id", "left").withColumns({
        "elapsed": elapsed, "expected_value": F.col("start_value") + way * elapsed,
        "progress": F.when(way != 0, (F.col("live_value") - F.col("start_value")) / way)})
    better = F.when(F.col("metric_key").isin(lower_is_better), F.col("live_value") <= F.col("target_value")).otherwise(
        F.col("live_value") >= F.col("target_value"))
    status = (F.when(F.col("start_day") > today, "not-started").when(F.col("live_value").isNull(), "no-data")
              .when(way == 0, F.when(better, "on-track").otherwise("off-track"))
              .when(F.col("progress") >= F.col("elapsed"), "on-track")
              .when(F.col("progress") >= F.col("elapsed") - P.GOAL_SLACK, "at-risk").otherwise("off-track"))
    return rows.select("goal_id", "metric_key", *SCOPE, "live_day", "live_value", "elapsed", "expected_value", "progress", status.alias("status"))


# ------------------------------------------------------------ scope creep ----
def scope_creep_trend(classified: DataFrame, team_repo: DataFrame) -> DataFrame:
    """Share of unplanned work per scope and week against the pooled share of the
    ``P.CREEP_WEEKS`` weeks before it (weeks without work add nothing; the first week has no
    baseline). ``above``: beyond the baseline by more than ``P.CREEP_MARGIN``; consecutive weeks
    above form a run, given by its first week and its length. Unclassifiable work isn't counted."""
    work = classified.filter(F.col("category") != "Unclassifiable")
    weekly = work.groupBy("repo", _week("created_at").alias("week")).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum((F.col("category") == "Unplanned").cast("long")).alias("n_unplanned"))
    w = scope_fanout(weekly, team_repo).groupBy(*SCOPE, "week").agg(F.sum("n_items").alias("n_items"), F.sum("n_unplanned").alias("n_unplanned"))
    w = w.withColumn("_no", (F.unix_date("week") / 7).cast("int"))
    past = Window.partitionBy(*SCOPE).orderBy("_no").rangeBetween(-P.CREEP_WEEKS, -1)
    w = w.withColumns({"share": F.col("n_unplanned") / F.col("n_items"),
                       "baseline": F.sum("n_unplanned").over(past) / F.sum("n_items").over(past)})
    w = w.withColumn("above", F.coalesce(F.col("share") > F.col("baseline") + P.CREEP_MARGIN, F.lit(False)))
    same = Window.partitionBy(*SCOPE, "above")
    w = w.withColumn("_run", F.col("_no") - F.row_number().over(same.orderBy("_no")))
    run = Window.partitionBy(*SCOPE, "above", "_run")
    return w.select(*SCOPE, "week", "n_items", "n_unplanned", "share", "baseline", "above",
                    F.when(F.col("above"), F.min("week").over(run)).alias("run_start"),
                    F.when(F.col("above"), F.count(F.lit(1)).over(run)).alias("run_weeks"))


def scope_creep_items(classified: DataFrame, trend: DataFrame, team_repo: DataFrame) -> DataFrame:
    """The unplanned tickets behind the weeks above the baseline: scope, week, run_start, ticket and its pull requests."""
    items = classified.filter(F.col("category") == "Unplanned").groupBy("repo", _week("created_at").alias("week"), "issue_key").agg(
        F.count(F.lit(1)).alias("n_prs"))
    weeks = trend.filter("above").select(*SCOPE, "week", "run_start")
    return scope_fanout(items, team_repo).join(weeks, [*SCOPE, "week"]).groupBy(*SCOPE, "week", "run_start", "issue_key").agg(
        F.sum("n_prs").alias("n_prs"))
