"""End-user queries (Q8-Q26): cockpit, code review, investment, AI cost,
personal views. Each is a DataFrame function over state tables or the mart.

Scale notes:
* Tile, stage and KPI outputs are a handful of rows, but their inputs are not:
  every whole-org median goes through the skew-safe ``grouped_percentile``
  (a single global group is the hottest group there is).
* Top-N and paging use ``orderBy(...).limit``/``offset`` (a per-partition
  top-K then a merge), never a sort of everything on one task.
* The PR -> issue join sends rows without an issue key around the join (they
  can never match), so null keys never pile onto one reducer.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.paging import page_of
from ..operators.filters import in_day_window, in_window, repo_like, scope_repos
from ..operators.percentile import grouped_percentile
from . import params as P
from .params import Params

# --- fixed values: cockpit tiles (metric key, label, unit, aggregation) -------
TILES = [
    ("deployment_frequency", "Deployment frequency", "deploys", "sum"),
    ("lead_time_p50_hours", "Lead time for changes", "hours (median)", "latest"),
    ("change_failure_rate", "Change failure rate", "%", "rate"),
    ("mttr_p50_hours", "Time to restore", "hours (median)", "latest"),
    ("pr_velocity", "PR velocity", "merged PRs", "sum"),
    ("pr_cycle_time_p50_hours", "PR cycle time", "hours (median)", "latest"),
]
# Metrics whose falling value is good; the others should rise.
LOWER_IS_BETTER = ["lead_time_p50_hours", "change_failure_rate", "mttr_p50_hours", "pr_cycle_time_p50_hours"]
# Review stages in display order.
STAGES = ["open_to_first_review", "first_review_to_approval", "approval_to_merge"]
# Aging PR sort keys accepted (anything else falls back to age).
SORT_KEYS = ["age", "repo", "size"]
PAGE_ROWS_MAX = 100
PERSONAL_ROWS = 20
# ------------------------------------------------------------------------------


def _lit_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- cockpit ----
def cockpit_tiles(mart: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q8 (+W3, A10-A12): one row per tile for ``p.scope`` over the last
    ``p.days`` + 1 calendar days (the window includes both end days)."""
    spark = mart.sparkSession
    p = p.asked()
    m = mart.filter(F.col("metric_key").isin([t[0] for t in TILES]) & (F.col("scope_id") == p.scope)
                    & in_day_window("day", p.as_of, p.days))
    agg = m.groupBy("metric_key").agg(
        F.sum("value").alias("_sum"),
        F.sum("sample_size").alias("_n"),
        F.sum(F.col("value") * F.col("sample_size")).alias("_wn"),
        F.max_by("value", "day").alias("_latest"),
        F.min_by("value", "day").alias("_first"),
        F.count(F.lit(1)).alias("n_days"),
        F.max("computed_at").alias("_computed"),
    )
    tiles = _lit_table(spark, TILES, "metric_key string, label string, unit string, aggregation string")
    j = tiles.join(agg, "metric_key", "left")
    agg_col = F.col("aggregation")
    value = (F.when(agg_col == "sum", F.col("_sum"))
             .when(agg_col == "rate", F.when(F.col("_n") > 0, F.round(F.col("_wn") / F.col("_n"), 4)))
             .otherwise(F.col("_latest")))
    has_trend = (F.col("n_days") >= 2) & (F.col("_first") != 0)
    trend = F.when(has_trend, F.round((F.col("_latest") - F.col("_first")) / F.abs(F.col("_first")) * 100, 4))
    good = F.when(F.col("metric_key").isin(LOWER_IS_BETTER), F.col("_latest") <= F.col("_first")).otherwise(
        F.col("_latest") >= F.col("_first"))
    return j.select("metric_key", "label", "unit", "aggregation",
                    F.round(value, 6).alias("value"),
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("sample_size"),
                    F.coalesce(F.col("n_days"), F.lit(0)).cast("long").alias("n_days"),
                    trend.alias("trend_pct"), F.when(has_trend, good).alias("trend_is_good"),
                    F.col("_computed").alias("computed_at"))


def cockpit_series(mart: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Each tile's daily series (one row per metric and day), in order."""
    p = p.asked()
    return mart.filter(F.col("metric_key").isin([t[0] for t in TILES]) & (F.col("scope_id") == p.scope)
                       & in_day_window("day", p.as_of, p.days)).select(
                           "metric_key", "day", "value", "sample_size").orderBy("metric_key", "day")


def dora_tiers(tiles: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q9: DORA band and score of the four core tiles (no value -> score 0)."""
    core = tiles.filter(F.col("metric_key").isin("deployment_frequency", "lead_time_p50_hours",
                                                 "change_failure_rate", "mttr_p50_hours"))
    tier = C.dora_tier("metric_key", "value", "sample_size", p.asked().days)
    return core.select("metric_key", tier.alias("tier"), C.tier_score(tier).alias("score"))


def deployment_outcomes(tiles: DataFrame) -> DataFrame:
    """Q10: successful vs failed deploys from the frequency sample and the
    failure rate (failed = round(total x rate), half up)."""
    t = tiles.groupBy().agg(
        F.max(F.when(F.col("metric_key") == "deployment_frequency", F.col("sample_size"))).alias("total"),
        F.max(F.when(F.col("metric_key") == "change_failure_rate", F.col("value"))).alias("rate"))
    total = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    failed = F.floor(total * F.coalesce(F.col("rate"), F.lit(0.0)) + 0.5).cast("long")
    return t.select(total.alias("total_deploys"), failed.alias("failed"), (total - failed).alias("successful"))


# ------------------------------------------------------------ code review ----
def first_reviews(reviews: DataFrame) -> DataFrame:
    """First review and first approval per PR in one aggregation."""
    return reviews.groupBy("repo", "pr_number").agg(
        F.min("submitted_at").alias("first_review_at"),
        F.min(F.when(F.col("state") == "APPROVED", F.col("submitted_at"))).alias("first_approval_at"))


def cycle_stages(prs: DataFrame, reviews: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q11: org/team/repo-scoped median hours of three review stages, each over
    its own non-null set, 1 dp; negatives and self-reviews kept."""
    p = p.asked()
    pr = scope_repos(prs.filter(F.col("number").isNotNull() & in_window("created_at", p.as_of, p.days)),
                     p.scope, team_repo).select("repo", "number", "created_at", "merged_at")
    fr = first_reviews(reviews).withColumnRenamed("pr_number", "number")
    j = pr.join(fr, ["repo", "number"], "left")
    fa, frv = F.col("first_approval_at"), F.col("first_review_at")
    stages = F.array(
        F.struct(F.lit(STAGES[0]).alias("stage"), C.micros("created_at", frv).alias("us")),
        F.struct(F.lit(STAGES[1]).alias("stage"), F.when(frv.isNotNull(), C.micros(frv, fa)).alias("us")),
        F.struct(F.lit(STAGES[2]).alias("stage"), C.micros(fa, "merged_at").alias("us")))
    long_form = j.select(F.inline(stages))
    med = grouped_percentile(long_form, ["stage"], "us", 0.5, out="h", count_out=None, nonnull_out="prs",
                             scale=3.6e9)
    names = _lit_table(prs.sparkSession, [(s, i) for i, s in enumerate(STAGES)], "stage string, ord int")
    return (names.join(med, "stage", "left")
            .select("stage", F.round("h", 1).alias("hours_p50"),
                    F.coalesce(F.col("prs"), F.lit(0)).cast("long").alias("prs")))


def reviewer_load(reviews: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT, n: int = 10) -> DataFrame:
    """Q12 (O1): top reviewers by reviews submitted in the window."""
    p = p.asked()
    r = scope_repos(reviews.filter(F.col("reviewer_login").isNotNull()
                                   & in_window("submitted_at", p.as_of, p.days)), p.scope, team_repo)
    return (r.groupBy("reviewer_login").agg(F.count(F.lit(1)).alias("reviews"))
            .orderBy(F.col("reviews").desc(), F.col("reviewer_login").asc()).limit(n))


def _aging_base(prs: DataFrame, team_repo: DataFrame, p: Params, repo_filter: str | None) -> DataFrame:
    p = p.asked()
    pr = prs.filter((F.col("state") == "open") & F.col("number").isNotNull()
                    & in_window("created_at", p.as_of, p.days) & repo_like("repo", repo_filter))
    return scope_repos(pr, p.scope, team_repo)


def aging_prs_page(prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT, repo_filter: str | None = None,
                   sort_by: str = "age", sort_dir: str = "desc", page: int = 0, size: int = 20) -> DataFrame:
    """Q13 (O2): one page of open PRs. Sort keys come from an allow-list; ties
    are broken by (repo, number) so pages are stable. Deep pages are found by counts
    (:func:`~flowgauge.operators.paging.page_of`)."""
    size = max(1, min(PAGE_ROWS_MAX, int(size)))
    page = max(0, int(page))
    key = sort_by if sort_by in SORT_KEYS else "age"
    desc = sort_dir.lower() != "asc"
    if key == "repo":
        order, cells = [F.col("repo").desc() if desc else F.col("repo").asc(), F.col("created_at").asc()], (F.col("repo"), F.unix_seconds("created_at"), desc, False)
    else:  # no line counts are stored, so "size" falls back to age
        order, cells = [F.col("created_at").asc() if desc else F.col("created_at").desc()], (F.to_date("created_at"), F.unix_seconds("created_at"), not desc, not desc)
    order += [F.col("repo").asc(), F.col("number").asc()]
    as_of = F.lit(p.as_of).cast("timestamp")
    base = _aging_base(prs, team_repo, p, repo_filter)
    age = C.whole_hours("created_at", as_of)
    band = F.when(age >= P.LATE_HOURS, "late").when(age >= P.AGING_HOURS, "aging").otherwise("fresh")
    return (page_of(base, order, *cells, page, size)
            .select(F.concat(F.lit("#"), F.col("number").cast("string")).alias("id"), "title", "repo", "author",
                    age.alias("age_hours"), band.alias("age_band"),
                    F.array_join("requested_reviewers", ",").alias("reviewers"),
                    F.lit(None).cast("long").alias("size_lines")))


def aging_prs_total(prs: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT, repo_filter: str | None = None,
                    size: int = 20) -> DataFrame:
    """Q13 paging totals: matching rows and page count (at least 1)."""
    size = max(1, min(PAGE_ROWS_MAX, int(size)))
    t = _aging_base(prs, team_repo, p, repo_filter).groupBy().agg(F.count(F.lit(1)).alias("total"))
    return t.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long").alias("pages"))


# ------------------------------------------------------------- investment ----
def classify(prs: DataFrame, issues: DataFrame, team_repo: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """C8 + J6: category per PR created in the window. Precedence: no key or no
    matching issue -> Unclassifiable; reopened -> Rework; bug -> Unplanned;
    else Planned."""
    p = p.asked(P.MAX_DAYS_INVESTMENT)
    pr = scope_repos(prs.filter(in_window("created_at", p.as_of, p.days)), p.scope, team_repo).select(
        "repo", "created_at", C.issue_key("title").alias("issue_key"))
    iss = issues.select("issue_key", "issue_type", "reopened")
    keyed = pr.filter(F.col("issue_key").isNotNull()).join(iss, "issue_key", "left")
    unkeyed = pr.filter(F.col("issue_key").isNull()).select(
        "issue_key", "repo", "created_at", F.lit(None).cast("string").alias("issue_type"),
        F.lit(None).cast("boolean").alias("reopened"))
    both = keyed.unionByName(unkeyed)
    matched = F.col("issue_type").isNotNull() | F.col("reopened").isNotNull()
    cat = (F.when(F.col("issue_key").isNull() | ~matched, "Unclassifiable")
           .when(F.col("reopened"), "Rework")
           .when(F.lower(F.col("issue_type")) == "bug", "Unplanned")
           .otherwise("Planned"))
    return both.select("repo", "created_at", cat.alias("category"), "issue_key")


def _category_counts():
    return [F.sum((F.col("category") == c).cast("long")).alias(c.lower()) for c in P.CATEGORIES]


def investment_breakdown(classified: DataFrame) -> DataFrame:
    """Q14 (A9): count per category, all four present."""
    spark = classified.sparkSession
    cats = _lit_table(spark, [(c, i) for i, c in enumerate(P.CATEGORIES)], "category string, ord int")
    n = classified.groupBy("category").agg(F.count(F.lit(1)).alias("prs"))
    return cats.join(n, "category", "left").select(
        "category", F.coalesce(F.col("prs"), F.lit(0)).cast("long").alias("prs"))


def investment_trend(classified: DataFrame) -> DataFrame:
    """Q15 (A8): categories per month of PR creation, zero-filled."""
    return classified.groupBy(C.month_key("created_at").alias("month_key"),
                              C.month_label("created_at").alias("month_label")).agg(*_category_counts()).orderBy("month_key")


def investment_by_team(classified: DataFrame, team_repo: DataFrame, teams: DataFrame) -> DataFrame:
    """Q16 (J7): categories per team *name* (same-named teams merge)."""
    j = (classified.join(team_repo, "repo", "inner")
         .join(teams.select(F.col("id").alias("team_id"), F.col("name").alias("team")), "team_id", "inner"))
    return j.groupBy("team").agg(*_category_counts()).orderBy("team")


def unclassifiable_share(breakdown: DataFrame) -> DataFrame:
    """Q17: share of Unclassifiable in all classified PRs (0 when none)."""
    t = breakdown.groupBy().agg(F.sum("prs").alias("total"),
                                F.sum(F.when(F.col("category") == "Unclassifiable", F.col("prs"))).alias("unc"))
    total = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    unc = F.coalesce(F.col("unc"), F.lit(0)).cast("long")
    return t.select(total.alias("total"), unc.alias("unclassifiable"),
                    (C.ratio_half_up(unc, total, 4) / F.lit(10000.0)).alias("share"))


# ---------------------------------------------------------------- AI cost ----
def _usage_window(usage: DataFrame, p: Params) -> DataFrame:
    return usage.filter(in_day_window("day", p.as_of, p.asked().days))


def _cents(x) -> F.Column:
    return (F.col(x) * 100).cast("long") if isinstance(x, str) else (x * 100).cast("long")


def ai_spend_kpis(usage: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q18: total spend, cost per PR, cost per active user-day (zero-activity
    rows count), adoption = distinct actors / seats (4 dp, capped at 1)."""
    u = _usage_window(usage, p)
    k = u.groupBy().agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0).cast("decimal(28,2)")).alias("spend"),
        F.coalesce(F.sum("prs"), F.lit(0)).cast("long").alias("total_prs"),
        F.count(F.lit(1)).alias("active_user_days"),
        F.countDistinct("actor_key").alias("active_users"))
    cents = _cents(F.col("spend"))
    adoption = (C.cap_one(C.ratio_half_up(F.col("active_users"), F.lit(p.seats), 4) / F.lit(10000.0))
                if p.seats else F.lit(0.0))
    return k.select(F.col("spend").cast("double").alias("total_spend"), "total_prs", "active_user_days",
                    "active_users",
                    (C.ratio_half_up(cents, F.col("total_prs"), 0) / F.lit(100.0)).alias("cost_per_pr"),
                    (C.ratio_half_up(cents, F.col("active_user_days"), 0) / F.lit(100.0)).alias("cost_per_dev_day"),
                    adoption.cast("double").alias("adoption_rate"))


def spend_by_tool(usage: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q19: spend per tool, with its share of the total (the result has one row
    per tool, so the share's window holds a handful of rows)."""
    s = _usage_window(usage, p).groupBy("source").agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"))
    total = F.sum(_cents(F.col("spend"))).over(Window.partitionBy())
    return s.select(C.tool_label("source").alias("tool"), "source", F.col("spend").cast("double").alias("spend"),
                    (C.ratio_half_up(_cents(F.col("spend")), total, 4) / F.lit(10000.0)).alias("share")
                    ).orderBy(F.desc("spend"), "source")


def spend_trend(usage: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q20: spend and PRs per month, with cost per PR."""
    g = _usage_window(usage, p).groupBy(C.month_start("day").alias("month")).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"),
        F.coalesce(F.sum("prs"), F.lit(0)).cast("long").alias("prs"))
    return g.select("month", C.month_label("month").alias("month_label"), F.col("spend").cast("double").alias("spend"),
                    "prs", (C.ratio_half_up(_cents(F.col("spend")), F.col("prs"), 0) / F.lit(100.0)).alias("cost_per_pr")
                    ).orderBy("month")


def daily_spend(usage: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q21: one spend column per tool, zero-filled; no connector yet for the
    third tool, so its column is a constant 0."""
    g = _usage_window(usage, p).groupBy("day").agg(
        F.sum(F.when(F.col("source") == "claude_code", F.col("cost_usd")).otherwise(0)).alias("cc"),
        F.sum(F.when(F.col("source") == "copilot", F.col("cost_usd")).otherwise(0)).alias("cp"))
    return g.select("day", F.col("cc").cast("double").alias("claude_code"), F.col("cp").cast("double").alias("copilot"),
                    F.lit(0.0).alias("cursor")).orderBy("day")


def developer_allocation(usage: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q22: spend and PRs per (tool, actor)."""
    g = _usage_window(usage, p).groupBy("source", "actor_key").agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"),
        F.coalesce(F.sum("prs"), F.lit(0)).cast("long").alias("prs"))
    return g.select("actor_key", C.tool_label("source").alias("tool"), "source",
                    F.col("spend").cast("double").alias("spend"), "prs").orderBy(F.desc("spend"), "actor_key", "source")


def ai_impact(prs: DataFrame, p: Params = P.DEFAULT, min_prs: int = P.MIN_PRS_PER_BUCKET) -> DataFrame:
    """Q23: median created -> merged hours of AI-assisted vs other PRs merged
    since the window's first day (1 dp before use); null when a side has fewer
    than ``min_prs`` PRs; AI share 4 dp; few AI-assisted PRs are flagged."""
    p = p.asked()
    start = dt.datetime.combine(p.as_of.date() - dt.timedelta(days=p.days), dt.time())
    m = prs.filter(F.col("merged_at").isNotNull() & F.col("created_at").isNotNull()
                   & (F.col("merged_at") >= F.lit(start).cast("timestamp")))
    m = m.select(F.coalesce(F.col("ai_assisted"), F.lit(False)).alias("ai"), C.micros("created_at", "merged_at").alias("us"))
    med = grouped_percentile(m, ["ai"], "us", 0.5, out="h", count_out="n", scale=3.6e9)
    w = med.groupBy().agg(
        F.max(F.when(F.col("ai"), F.round("h", 1))).alias("ai_h"),
        F.max(F.when(~F.col("ai"), F.round("h", 1))).alias("other_h"),
        F.coalesce(F.max(F.when(F.col("ai"), F.col("n"))), F.lit(0)).cast("long").alias("ai_prs"),
        F.coalesce(F.max(F.when(~F.col("ai"), F.col("n"))), F.lit(0)).cast("long").alias("other_prs"))
    ok = (F.col("ai_prs") >= min_prs) & (F.col("other_prs") >= min_prs)
    share = C.ratio_half_up(F.col("ai_prs"), F.col("ai_prs") + F.col("other_prs"), 4) / F.lit(10000.0)
    return w.select(F.when(ok, F.col("ai_h")).alias("ai_median_hours"),
                    F.when(ok, F.col("other_h")).alias("other_median_hours"),
                    "ai_prs", "other_prs", F.when(ok, share).alias("ai_share"), ok.alias("enough_data"),
                    F.when(ok, F.col("ai_prs") < P.SMALL_SAMPLE_PRS).alias("small_sample"))


def ai_roi(impact: DataFrame, kpis: DataFrame, p: Params = P.DEFAULT) -> DataFrame:
    """Q24: hours saved = (other - ai median) x AI PRs (1 dp); value = hours x
    hourly rate (2 dp); multiple = value / spend (2 dp). Null without impact or
    spend. Exact decimal arithmetic; negatives kept."""
    imp = impact.groupBy().agg(F.max("ai_median_hours").alias("a"), F.max("other_median_hours").alias("o"),
                               F.max("ai_prs").alias("n"), F.max(F.col("enough_data").cast("int")).alias("ok"))
    kp = kpis.groupBy().agg(F.max("total_spend").alias("spend"))
    both = imp.unionByName(kp, allowMissingColumns=True).groupBy().agg(
        *[F.max(c).alias(c) for c in ("a", "o", "n", "ok", "spend")])
    delta = (F.col("o").cast("decimal(20,1)") - F.col("a").cast("decimal(20,1)"))
    hours = F.round(delta * F.col("n").cast("decimal(20,0)"), 1)
    value = F.round(hours * F.lit(p.hourly_rate).cast("decimal(18,4)"), 2)
    spend_c = (F.col("spend").cast("decimal(28,2)") * 100).cast("long")
    value_c = (value * 100).cast("long")
    sign = F.when(value_c < 0, -1).otherwise(1)
    mult = sign * C.ratio_half_up(F.abs(value_c), spend_c, 2) / F.lit(100.0)
    ok = (F.col("ok") == 1) & (F.col("spend") > 0)
    return both.select(F.when(ok, hours.cast("double")).alias("hours_saved"),
                       F.when(ok, value.cast("double")).alias("value_recovered"),
                       F.when(ok, mult).alias("roi_multiple"),
                       F.lit(float(p.hourly_rate)).alias("hourly_rate"))


# --------------------------------------------------------------- personal ----
def personal_open_prs(prs: DataFrame, login: str, p: Params = P.DEFAULT, n: int = PERSONAL_ROWS) -> DataFrame:
    """Q25: the user's open PRs, oldest first."""
    as_of = F.lit(p.as_of).cast("timestamp")
    own = prs.filter((F.col("state") == "open") & F.col("number").isNotNull() & (F.col("author") == login))
    return (own.orderBy(F.col("created_at").asc(), F.col("repo").asc(), F.col("number").asc()).limit(n)
            .select(F.concat(F.lit("#"), F.col("number").cast("string")).alias("id"), "title", "repo",
                    C.whole_hours("created_at", as_of).alias("age_hours")))


def personal_reviews(reviews: DataFrame, login: str, n: int = PERSONAL_ROWS) -> DataFrame:
    """Q26: the user's reviews, newest first, unknown times first."""
    own = reviews.filter(F.col("reviewer_login") == login)
    return (own.orderBy(F.col("submitted_at").desc_nulls_first(), F.col("review_id").asc()).limit(n)
            .select("repo", F.concat(F.lit("#"), F.col("pr_number").cast("string")).alias("pr"), "state",
                    "submitted_at"))
