"""Stage breakdown of lead time and lead time of tickets.

**Lead-time stages.** A change is a merged pull request that a deploy of its
repository carried out. Its marks stand in order: first commit, opened, first
review, merged, deployed; the four stages between them are medians over the same
changes, those with all five marks. Commits are the list that stood at the merge
(the latest list received), so commits that a force-push discarded don't count; a
first commit later than the opening is set to it (a stage is never negative); a
review after the merge is no mark. Times above ``P.LEAD_CAP_DAYS`` are cut to it and
counted.

**Ticket lead time.** From a ticket's latest entry into an in-progress status to
the deploy of the last pull request that names it. A ticket is counted in the
window of that deploy, once in each scope that owns a repository of its pull
requests. Tickets with a pull request that isn't deployed yet, or that went back
to work after the last deploy, are pending; those without any pull request are
unlinked and belong to no repository, so they are counted for the organisation.

Raw values are shuffled once for all stages: the stage is part of the group key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import first_at_or_after
from ..operators.filters import in_window, name_matches
from ..operators.percentile import grouped_percentile
from ..operators.rollup import micros_between, scope_fanout
from . import params as P
from .metrics import deploys
from .params import Params

STAGES = ("coding", "review_wait", "review", "deploy_wait", "lead")
SCOPE = ["scope_type", "scope_id"]


def first_commits(commits: DataFrame) -> DataFrame:
    """``commits`` holds the latest commit list of every pull request
    (repo, pr_number, commits array<struct<sha, authored_at>>)."""
    first = F.array_min(F.transform("commits", lambda c: c["authored_at"]))  # nulls are passed over
    return commits.select("repo", F.col("pr_number").alias("number"), first.alias("first_commit_at"))


def change_marks(runs: DataFrame, prs: DataFrame, reviews: DataFrame, commits: DataFrame, p: Params) -> DataFrame:
    """One row per deployed change: repo, number and its five marks (the commit
    and review marks may be missing)."""
    merged = prs.filter(F.col("merged_at").isNotNull() & in_window("merged_at", p.as_of, p.days) & F.col("number").isNotNull())
    carried = first_at_or_after(merged.select("repo", "number", "created_at", "merged_at"), deploys(runs, p), ["repo"], "merged_at",
                                "ts", "deployed_at", p.asof_slot_seconds).filter(F.col("deployed_at").isNotNull())
    looked = reviews.groupBy("repo", F.col("pr_number").alias("number")).agg(F.min("submitted_at").alias("review_at"))
    rows = carried.join(looked, ["repo", "number"], "left").join(first_commits(commits), ["repo", "number"], "left")
    return rows.select(
        "repo", "number", F.least("first_commit_at", "created_at").alias("begun_at"), F.col("first_commit_at").isNotNull().alias("_has_commit"),
        "created_at", F.when(F.col("review_at") <= F.col("merged_at"), F.greatest("review_at", "created_at")).alias("review_at"),
        "merged_at", "deployed_at")


def lead_time_stages(runs: DataFrame, prs: DataFrame, reviews: DataFrame, commits: DataFrame, team_repo: DataFrame,
                     p: Params = P.DEFAULT) -> DataFrame:
    """scope_type, scope_id, n_deployed, n_changes, n_capped and the median hours of each stage."""
    marks = change_marks(runs, prs, reviews, commits, p)
    whole = F.col("_has_commit") & F.col("review_at").isNotNull()
    ends = {"coding": ("begun_at", "created_at"), "review_wait": ("created_at", "review_at"), "review": ("review_at", "merged_at"),
            "deploy_wait": ("merged_at", "deployed_at"), "lead": ("begun_at", "deployed_at")}
    cap = F.lit(P.LEAD_CAP_DAYS * 86_400_000_000)
    values = F.array(*[F.struct(F.lit(s).alias("stage"), F.when(whole, F.least(micros_between(*ends[s]), cap)).alias("_us")) for s in STAGES])
    cut = (whole & (micros_between("begun_at", "deployed_at") > cap)).cast("long")
    rows = marks.select("repo", whole.cast("long").alias("_whole"), cut.alias("_cut"), values.alias("_values"))
    fanned = scope_fanout(rows, team_repo)
    counts = fanned.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_deployed"), F.sum("_whole").alias("n_changes"),
                                        F.coalesce(F.sum("_cut"), F.lit(0)).alias("n_capped"))
    stages = fanned.filter("_whole = 1").select(*SCOPE, F.inline("_values"))
    medians = grouped_percentile(stages, [*SCOPE, "stage"], "_us", 0.5, out="hours", count_out=None, scale=3.6e9)
    wide = medians.groupBy(*SCOPE).agg(*[F.max(F.when(F.col("stage") == s, F.col("hours"))).alias(f"{s}_hours") for s in STAGES])
    return counts.join(wide, SCOPE, "left")


def keys_in(text: Column) -> Column:
    """Every distinct issue key of a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Z][A-Z0-9]{1,9}-[0-9]+)"), 1))


def ticket_marks(runs: DataFrame, prs: DataFrame, transitions: DataFrame, p: Params) -> DataFrame:
    """One row per ticket that entered an in-progress status: issue_key,
    begun_at (latest entry), repos, n_prs, n_waiting (not deployed) and last_deploy."""
    begun = transitions.filter(F.lower("to_status").isin(P.IN_PROGRESS_STATUSES)).groupBy("issue_key").agg(F.max("at").alias("begun_at"))
    named = prs.select("repo", "number", "merged_at", F.explode(keys_in(F.col("title"))).alias("issue_key"))
    named = named.join(begun.select("issue_key"), "issue_key", "left_semi")
    out = runs.filter((F.col("conclusion") == "success") & name_matches("name", p.deploy_pattern)).select("repo", "ts")
    done = first_at_or_after(named.filter(F.col("merged_at").isNotNull()), out, ["repo"], "merged_at", "ts", "deployed_at", p.asof_slot_seconds)
    every = done.unionByName(named.filter(F.col("merged_at").isNull()), allowMissingColumns=True)
    linked = every.groupBy("issue_key").agg(
        F.collect_set("repo").alias("repos"), F.count(F.lit(1)).alias("n_prs"),
        F.sum(F.col("deployed_at").isNull().cast("long")).alias("n_waiting"), F.max("deployed_at").alias("last_deploy"))
    return begun.join(linked, "issue_key", "left")


def ticket_lead_time(runs: DataFrame, prs: DataFrame, transitions: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """scope_type, scope_id, n_tickets, n_pending, n_unlinked (organisation only) and lead_p50_hours."""
    t = ticket_marks(runs, prs, transitions, p)
    ready = (F.col("n_waiting") == 0) & (F.col("last_deploy") >= F.col("begun_at"))
    state = F.when(F.col("n_prs").isNull(), "unlinked").when(~F.coalesce(ready, F.lit(False)), "pending").otherwise("done")
    t = t.withColumn("state", state).filter((F.col("state") != "done") | in_window("last_deploy", p.as_of, p.days))
    us = F.when(F.col("state") == "done", micros_between("begun_at", "last_deploy"))
    owned = t.filter(F.col("state") != "unlinked").select("issue_key", "state", us.alias("_us"), F.explode("repos").alias("repo"))
    # a ticket of several repositories counts once in a scope
    fanned = scope_fanout(owned, team_repo).select(*SCOPE, "issue_key", "state", "_us").distinct()
    bare = t.filter(F.col("state") == "unlinked").select(F.lit("org").alias("scope_type"), F.lit("*").alias("scope_id"), "issue_key", "state",
                                                         F.lit(None).cast("long").alias("_us"))
    rows = fanned.unionByName(bare)
    count = lambda s: F.sum((F.col("state") == s).cast("long"))
    counts = rows.groupBy(*SCOPE).agg(count("done").alias("n_tickets"), count("pending").alias("n_pending"), count("unlinked").alias("_bare"))
    medians = grouped_percentile(rows, SCOPE, "_us", 0.5, out="lead_p50_hours", count_out=None, scale=3.6e9)
    return counts.join(medians, SCOPE, "left").select(
        *SCOPE, "n_tickets", "n_pending", F.when(F.col("scope_type") == "org", F.col("_bare")).alias("n_unlinked"), "lead_p50_hours")
