"""Daily delivery metrics (Q1-Q7) and the metric mart.

Inputs are latest-state tables: ``runs`` (repo, name, conclusion, ts), ``prs``
(repo, created_at, merged_at) and ``team_repo`` (team_id, repo). Each function
returns mart rows ``metric_key, scope_type, scope_id, day, value, sample_size``.

Quirks kept on purpose (they are what the metrics mean today):
* only *successful* runs count as deploys or remediations;
* the look-back is cut at ``as_of - days`` to the second, with no upper bound;
* remediations are not windowed, deploys are;
* a run matching both patterns is its own remediation (failed, MTTR 0);
* one remediation fails every deploy in the 48 h before it;
* lead time and MTTR are booked on the deploy's day.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import first_at_or_after, first_within
from ..operators.filters import in_window, name_matches
from ..operators.percentile import grouped_percentiles
from ..operators.rollup import additive_rollup, medians_rollup, micros_between, scope_fanout
from . import params as P
from .params import Params


def deploys(runs: DataFrame, p: Params) -> DataFrame:
    return runs.filter((F.col("conclusion") == "success") & in_window("ts", p.as_of, p.days)
                       & name_matches("name", p.deploy_pattern)).select("repo", "ts")


def remediations(runs: DataFrame, p: Params) -> DataFrame:
    return runs.filter((F.col("conclusion") == "success") & name_matches("name", p.hotfix_pattern)).select("repo", "ts")


def merged_in_window(prs: DataFrame, p: Params) -> DataFrame:
    return prs.filter(F.col("merged_at").isNotNull() & in_window("merged_at", p.as_of, p.days)).select(
        "repo", "created_at", "merged_at")


def deployment_frequency(runs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q1: successful deploy runs per day."""
    d = deploys(runs, p).withColumn("day", F.to_date("ts"))
    return additive_rollup(d, team_repo, P.MK_DEPLOY_FREQ, {"n": F.count(F.lit(1))}, F.col("n"), F.col("n"))


def pr_velocity(prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q5: merged PRs per merge day."""
    m = merged_in_window(prs, p).withColumn("day", F.to_date("merged_at"))
    return additive_rollup(m, team_repo, P.MK_VELOCITY, {"n": F.count(F.lit(1))}, F.col("n"), F.col("n"))


def cycle_values(prs: DataFrame, p: Params) -> DataFrame:
    m = merged_in_window(prs, p).withColumn("day", F.to_date("merged_at"))
    return m.select(F.lit(P.MK_CYCLE).alias("metric_key"), "repo", "day",
                    micros_between("created_at", "merged_at").alias("_us"))


def pr_cycle_time(prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q6: median created -> merged hours per merge day."""
    return medians_rollup(cycle_values(prs, p), team_repo)


def lead_values(runs: DataFrame, prs: DataFrame, p: Params) -> DataFrame:
    linked = first_at_or_after(merged_in_window(prs, p), deploys(runs, p), ["repo"], "merged_at", "ts",
                               "deploy_ts", p.asof_slot_seconds)
    lt = linked.filter(F.col("deploy_ts").isNotNull()).withColumn("day", F.to_date("deploy_ts"))
    return lt.select(F.lit(P.MK_LEAD_TIME).alias("metric_key"), "repo", "day",
                     micros_between("created_at", "deploy_ts").alias("_us"))


def lead_time(runs: DataFrame, prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q2: for each PR merged in the window, the first (windowed) deploy of the
    same repo at or after the merge; hours from PR *creation* to that deploy,
    booked on the deploy's day. Undeployed PRs are dropped."""
    return medians_rollup(lead_values(runs, prs, p), team_repo)


def deploys_with_restore(runs: DataFrame, p: Params) -> DataFrame:
    """J2 over deploys: ``restore_ts`` = first remediation within the bound."""
    return first_within(deploys(runs, p), remediations(runs, p), ["repo"], "ts", "ts", "restore_ts",
                        p.within_hours * 3600, p.asof_slot_seconds).withColumn("day", F.to_date("ts"))


def change_failure_rate(runs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT,
                        marked: DataFrame | None = None) -> DataFrame:
    """Q3: share of windowed deploys followed by a remediation within 48 h."""
    m = marked if marked is not None else deploys_with_restore(runs, p)
    m = m.withColumn("failed", F.col("restore_ts").isNotNull().cast("long"))
    return additive_rollup(m, team_repo, P.MK_CFR, {"f": F.sum("failed"), "n": F.count(F.lit(1))},
                           F.col("f").cast("double") / F.col("n"), F.col("n"))


def mttr_values(marked: DataFrame) -> DataFrame:
    f = marked.filter(F.col("restore_ts").isNotNull())
    return f.select(F.lit(P.MK_MTTR).alias("metric_key"), "repo", "day", micros_between("ts", "restore_ts").alias("_us"))


def mttr(runs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT, marked: DataFrame | None = None) -> DataFrame:
    """Q4: median deploy -> first remediation hours (<= 48 h), deploy's day."""
    m = marked if marked is not None else deploys_with_restore(runs, p)
    return medians_rollup(mttr_values(m), team_repo)


def cfr_chain_attribution(runs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Change failure rate with one failure per remediation: deploys whose first
    remediation within the bound is the same form a chain, which is charged to its
    earliest deploy (on that deploy's day). A deploy that is itself a remediation
    counts as a deploy but never as a failure."""
    out = runs.filter((F.col("conclusion") == "success") & in_window("ts", p.as_of, p.days) & name_matches("name", p.deploy_pattern))
    plain = out.filter(~name_matches("name", p.hotfix_pattern)).select("repo", "ts")
    marked = first_within(plain, remediations(runs, p), ["repo"], "ts", "ts", "restore_ts", p.within_hours * 3600, p.asof_slot_seconds)
    charged = marked.filter(F.col("restore_ts").isNotNull()).groupBy("repo", "restore_ts").agg(F.min("ts").alias("ts"))
    rows = out.select("repo", "ts", F.lit(0).alias("f"), F.lit(1).alias("n")).unionByName(
        charged.select("repo", "ts", F.lit(1).alias("f"), F.lit(0).alias("n"))).withColumn("day", F.to_date("ts"))
    return additive_rollup(rows, team_repo, "change_failure_rate_chain", {"f": F.sum("f"), "n": F.sum("n")},
                           F.col("f").cast("double") / F.col("n"), F.col("n"))


def lead_time_percentiles(runs: DataFrame, prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """p50, p75 and p90 of the lead time of each scope over the window, in hours;
    longer times than ``P.LEAD_CAP_DAYS`` are cut to it and counted in ``n_capped``."""
    keys = ["scope_type", "scope_id"]
    cap = F.lit(P.LEAD_CAP_DAYS * 86_400_000_000)
    vals = lead_values(runs, prs, p).select("repo", F.least("_us", cap).alias("_us"), (F.col("_us") > cap).cast("long").alias("_cut"))
    fanned = scope_fanout(vals, team_repo)
    out = fanned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changes"), F.sum("_cut").alias("n_capped"))
    shares = {f"p{share}_hours": share / 100 for share in (50, 75, 90)}
    return out.join(grouped_percentiles(fanned, keys, "_us", shares, scale=3.6e9), keys)


def open_pr_age_buckets(prs: DataFrame, reviews: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Open PRs by age at ``as_of``; stale ones had no activity (opening or review, not the
    time at which an envelope came in) for more than ``P.STALE_PR_DAYS``."""
    as_of = F.lit(p.as_of).cast("timestamp")
    age = micros_between("created_at", as_of) / 86_400_000_000
    names = F.lit(f"over {P.AGE_BANDS_DAYS[-1]} d")
    for days in reversed(P.AGE_BANDS_DAYS):
        names = F.when(age <= days, F.lit(f"up to {days} d")).otherwise(names)
    seen = reviews.filter(F.col("submitted_at") <= as_of).groupBy("repo", F.col("pr_number").alias("number")).agg(F.max("submitted_at").alias("_seen"))
    stale = micros_between(F.greatest("created_at", "_seen"), as_of) > P.STALE_PR_DAYS * 86_400_000_000
    return prs.filter(F.col("state") == "open").join(seen, ["repo", "number"], "left").groupBy(names.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_prs"), F.sum(stale.cast("long")).alias("n_stale"))


def build_mart(runs: DataFrame, prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q7: all six metrics as one plan, stamped with logic version and
    ``computed_at`` (= ``as_of``). The J2 result is shared by Q3 and Q4 as one
    subtree, so Spark's exchange reuse computes it once."""
    marked = deploys_with_restore(runs, p)
    # the three median metrics share one fan-out, hot-group check and aggregate
    medians = medians_rollup(lead_values(runs, prs, p).unionByName(mttr_values(marked))
                             .unionByName(cycle_values(prs, p)), team_repo)
    parts = [
        deployment_frequency(runs, team_repo, p),
        change_failure_rate(runs, team_repo, p, marked),
        pr_velocity(prs, team_repo, p),
        medians,
    ]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.select(*u.columns, F.lit(P.METRIC_LOGIC_VERSION).alias("metric_logic_version"),
                    F.lit(p.as_of).cast("timestamp").alias("computed_at"))
