"""Registry of runnable queries over the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``. The
SQL twins are independent formulations (correlated subqueries, plain GROUP BY
unions) of the same semantics, used as a correctness oracle.
"""
from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.sinks import _exists, move_folder, table_root, write_folders, write_mart, write_raw
from . import metrics as M
from . import oracle as O
from . import params as P
from . import views as V
from .params import DEFAULT, Params


LAYOUT_VERSION = "10"


def input_mark(spark: SparkSession, base: str) -> str:
    """Names, times, sizes and file counts of the tables of a folder, as one text."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder):
        held = fs.getContentSummary(status.getPath())
        found.append(f"{status.getPath().getName()}:{status.getModificationTime()}:{held.getLength()}:{held.getFileCount()}")
    return ",".join(sorted(found))


class Domain:
    """Lazily built domain views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, base: str, p: Params = DEFAULT, mark: str | None = None):
        self.spark, self.base, self.p = prepare(spark), base, p
        self.mark = mark or input_mark(spark, base)

    @cached_property
    def runs(self) -> DataFrame:
        return V.runs(self.spark, self.base)

    @cached_property
    def prs(self) -> DataFrame:
        return V.prs(self.spark, self.base)

    @cached_property
    def reviews(self) -> DataFrame:
        return V.reviews(self.spark, self.base, self.prs)

    @cached_property
    def team_repo(self) -> DataFrame:
        return V.team_repo(self.spark, self.base)

    @cached_property
    def teams(self) -> DataFrame:
        return V.teams(self.spark, self.base, self.team_repo)

    @cached_property
    def issues(self) -> DataFrame:
        return V.issues(self.spark, self.base)

    @cached_property
    def ai_usage(self) -> DataFrame:
        return V.ai_usage(self.spark, self.base)

    @cached_property
    def users(self) -> DataFrame:
        return V.app_users(self.spark, self.base)

    @cached_property
    def audit(self) -> DataFrame:
        return V.audit_log(self.spark, self.base)

    def _table(self, name: str) -> str:
        # The tag covers the input folder, the sizes and times of its tables and
        # the layout version of the derived tables, so neither a changed builder
        # nor changed input reuses stale output.
        tag = hashlib.sha1(f"{LAYOUT_VERSION}:{os.path.abspath(self.base)}:{self.mark}".encode()).hexdigest()[:12]
        return table_root(self.spark, f"domain-{tag}", name)

    @cached_property
    def raw(self) -> DataFrame:
        """The delivery stream as landed by the connectors (redeliveries
        included), rebuilt from the views. It isn't stored: routing filters reach
        the views, so a query builds the kinds of envelopes that it reads."""
        from .raw_events import raw_envelopes
        return raw_envelopes(self.runs, self.prs, self.reviews, self.issues, self.ai_usage, self.team_repo,
                             self.teams, self.users)

    @cached_property
    def raw_stored(self) -> DataFrame:
        """``staging.raw_event``: first delivery of every natural key (K1)."""
        path = self._table("raw_event")
        write_raw(self.raw, path)
        return self.spark.read.parquet(path)

    @cached_property
    def mart(self) -> DataFrame:
        """The recomputed mart (Q7) as a plan."""
        return M.build_mart(self.runs, self.prs, self.team_repo, self.p)

    @cached_property
    def stored_mart(self) -> DataFrame:
        """The mart as dashboards read it: written once (K3), then scanned
        with partition pruning on metric_key."""
        path = self._table("metric_daily")
        last = self.p.as_of.date()
        write_mart(self.mart, path, ((self.p.as_of - datetime.timedelta(days=self.p.days)).date(), last))
        m = self.spark.read.parquet(path)
        return m.select(*self.mart.columns)


QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


_DOMAINS: dict[tuple, Domain] = {}


def domain(spark: SparkSession, base: str) -> Domain:
    """One lazily built set of views per (session, folder, state of its tables):
    the DataFrame definitions are shared between queries; nothing is cached as data."""
    mark = input_mark(spark, base)
    key = (id(spark), spark.sparkContext.applicationId, base, mark)
    if key not in _DOMAINS:
        _DOMAINS[key] = Domain(spark, base, mark=mark)
    return _DOMAINS[key]


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, base, _f=fn: _f(domain(prepare(spark), base))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- Q1-Q7: daily metric mart ------------------------------------------------
register("deployment_frequency", O.metric_sql("deployment_frequency"))(
    lambda d: M.deployment_frequency(d.runs, d.team_repo, d.p))
register("lead_time_p50", O.metric_sql("lead_time_p50"))(
    lambda d: M.lead_time(d.runs, d.prs, d.team_repo, d.p))
register("change_failure_rate", O.metric_sql("change_failure_rate"))(
    lambda d: M.change_failure_rate(d.runs, d.team_repo, d.p))
register("mttr_p50", O.metric_sql("mttr_p50"))(
    lambda d: M.mttr(d.runs, d.team_repo, d.p))
register("pr_velocity", O.metric_sql("pr_velocity"))(
    lambda d: M.pr_velocity(d.prs, d.team_repo, d.p))
register("pr_cycle_time_p50", O.metric_sql("pr_cycle_time_p50"))(
    lambda d: M.pr_cycle_time(d.prs, d.team_repo, d.p))
register("cfr_chain_attribution", O.chain_sql())(lambda d: M.cfr_chain_attribution(d.runs, d.team_repo, d.p))
register("lead_time_percentiles", O.lead_percentiles_sql())(
    lambda d: M.lead_time_percentiles(d.runs, d.prs, d.team_repo, d.p))
register("open_pr_age_buckets", O.open_age_sql())(lambda d: M.open_pr_age_buckets(d.prs, d.reviews, d.p))
register("build_mart", O.build_mart_sql())(lambda d: d.mart)

# --- stages of a change, tickets -----------------------------------
from . import flow_metrics as FM  # noqa: E402
from . import oracle_flow as OF  # noqa: E402

register("lead_time_stages", OF.stages_sql())(
    lambda d: FM.lead_time_stages(d.runs, d.prs, d.reviews, V.pr_commits(d.spark, d.base, d.prs), d.team_repo, d.p))
register("ticket_lead_time", OF.tickets_sql())(
    lambda d: FM.ticket_lead_time(d.runs, d.prs, V.transitions(d.spark, d.base), d.team_repo, d.p))

# --- commits, sizes, flags, goals, scope creep ------------------------
from ..operators.extract import extract_pr_sizes  # noqa: E402
from . import dashboards as D  # noqa: E402
from . import oracle_work as OW  # noqa: E402
from . import work_metrics as WM  # noqa: E402


def _sizes(d: Domain) -> DataFrame:
    return extract_pr_sizes(V.size_events(d.spark, d.base, d.prs))


def _stored_sizes(d: Domain) -> DataFrame:
    """Size histograms as the mart keeps them, written once."""
    path = d._table("pr_size_daily")
    write_mart(WM.pr_size_daily(_sizes(d)), path)
    return d.spark.read.parquet(path)


def _classified(d: Domain) -> DataFrame:
    return D.classify(d.prs, d.issues, d.team_repo, d.p)


register("ai_commit_share", OW.ai_commits_sql())(
    lambda d: WM.ai_commit_share(V.commit_events(d.spark, d.base, d.prs), d.team_repo, d.p))
register("pr_size_distribution", OW.pr_sizes_sql())(lambda d: WM.pr_size_distribution(_stored_sizes(d), d.team_repo, d.p))
register("pr_flags", OW.pr_flags_sql())(
    lambda d: WM.pr_flags(d.prs, _sizes(d), V.flag_limits(d.spark, d.base), d.team_repo, d.p))
register("goal_progress", OW.goals_sql())(
    lambda d: WM.goal_progress(V.goals(d.spark, d.base), d.stored_mart, list(P.LOWER_IS_BETTER), d.p))
register("scope_creep_trend", OW.creep_sql())(lambda d: WM.scope_creep_trend(_classified(d), d.team_repo))
register("scope_creep_items", OW.creep_items_sql())(
    lambda d: WM.scope_creep_items(_classified(d), WM.scope_creep_trend(_classified(d), d.team_repo), d.team_repo))

# --- Q8-Q26: dashboards -------------------------------------------------------
from . import oracle_dash as OD  # noqa: E402

PERSONAL_LOGIN = "dev-7"
PERSONAL_REVIEWER = "rev-3"

register("cockpit_tiles", OD.cockpit_sql())(lambda d: D.cockpit_tiles(d.stored_mart, d.p))
register("dora_tiers", OD.dora_sql())(lambda d: D.dora_tiers(D.cockpit_tiles(d.stored_mart, d.p), d.p))
register("deployment_outcomes", OD.outcomes_sql())(
    lambda d: D.deployment_outcomes(D.cockpit_tiles(d.stored_mart, d.p)))
register("cycle_stages", OD.cycle_stages_sql())(lambda d: D.cycle_stages(d.prs, d.reviews, d.team_repo, d.p))
register("reviewer_load", OD.reviewer_load_sql())(lambda d: D.reviewer_load(d.reviews, d.team_repo, d.p))
register("aging_prs_page", OD.aging_page_sql())(lambda d: D.aging_prs_page(d.prs, d.team_repo, d.p))
register("aging_prs_total", OD.aging_total_sql())(lambda d: D.aging_prs_total(d.prs, d.team_repo, d.p))
register("investment_breakdown", OD.breakdown_sql())(
    lambda d: D.investment_breakdown(D.classify(d.prs, d.issues, d.team_repo, d.p)))
register("investment_trend", OD.trend_sql())(
    lambda d: D.investment_trend(D.classify(d.prs, d.issues, d.team_repo, d.p)))
register("investment_by_team", OD.by_team_sql())(
    lambda d: D.investment_by_team(D.classify(d.prs, d.issues, d.team_repo, d.p), d.team_repo, d.teams))
register("unclassifiable_share", OD.unclassifiable_sql())(
    lambda d: D.unclassifiable_share(D.investment_breakdown(D.classify(d.prs, d.issues, d.team_repo, d.p))))
register("ai_spend_kpis", OD.kpis_sql())(lambda d: D.ai_spend_kpis(d.ai_usage, d.p))
register("spend_by_tool", OD.spend_by_tool_sql())(lambda d: D.spend_by_tool(d.ai_usage, d.p))
register("spend_trend", OD.spend_trend_sql())(lambda d: D.spend_trend(d.ai_usage, d.p))
register("daily_spend", OD.daily_spend_sql())(lambda d: D.daily_spend(d.ai_usage, d.p))
register("developer_allocation", OD.allocation_sql())(lambda d: D.developer_allocation(d.ai_usage, d.p))
register("ai_impact", OD.impact_sql())(lambda d: D.ai_impact(d.prs, d.p))
register("ai_roi", OD.roi_sql())(lambda d: D.ai_roi(D.ai_impact(d.prs, d.p), D.ai_spend_kpis(d.ai_usage, d.p), d.p))
register("personal_open_prs", OD.personal_prs_sql(PERSONAL_LOGIN))(
    lambda d: D.personal_open_prs(d.prs, PERSONAL_LOGIN, d.p))
register("personal_reviews", OD.personal_reviews_sql(PERSONAL_REVIEWER))(
    lambda d: D.personal_reviews(d.reviews, PERSONAL_REVIEWER))

# --- D1-D8, E1-E10: raw envelopes -> latest state --------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..operators import state as S  # noqa: E402
from . import oracle_state as OS  # noqa: E402
from . import state_plans as SP  # noqa: E402

register("dedup_events", OS.dedup_counts_sql())(lambda d: SP.dedup_counts(d.raw))
register("route_events", OS.routed_counts_sql())(lambda d: SP.routed_counts(d.raw))
register("connector_activity", OS.connector_activity_sql())(lambda d: S.connector_activity(d.raw))
register("late_guard_report", OS.late_counts_sql())(lambda d: SP.late_event_counts(d.raw))
register("rebuild_run_state", OS.run_state_sql())(
    lambda d: SP.run_state(d.raw).select("repo", "run_id", "conclusion", "name", "ts", "last_received_at"))
register("rebuild_pr_state", OS.pr_state_sql())(
    lambda d: SP.pr_state(d.raw).select("repo", "pr_id", "number", "title", "author", "html_url", "state",
                                        F.array_join("requested_reviewers", ",").alias("requested_reviewers"),
                                        "created_at", "merged_at", "ai_assisted", "last_received_at"))
register("rebuild_review_state", OS.review_state_sql())(
    lambda d: SP.review_state(d.raw).select("repo", "pr_number", "review_id", "reviewer_login", "state",
                                            "submitted_at", "last_received_at"))
register("rebuild_issue_state", OS.issue_state_sql())(
    lambda d: SP.issue_state(d.raw).select("issue_key", "issue_id", "project_key", "issue_type", "status", "summary",
                                           "assignee", "created_at", "resolved_at", "reopened", "last_received_at"))
register("rebuild_usage_state", OS.usage_state_sql())(
    lambda d: SP.usage_state(d.raw).select("source", "actor_key", "day", "sessions",
                                           F.col("cost_usd").cast("double").alias("cost_usd"), "prs", "tokens_input",
                                           "tokens_output", "accepted_suggestions", "last_received_at"))

# --- Q27-Q32, F9: setup, admin, directory ---------------------------------------
from . import admin as A  # noqa: E402
from . import oracle_admin as OA  # noqa: E402

SCOPE_USERS = [("dev7@acme.io", "team-3"), ("DEV50@acme.io", "acme/repo-4"), ("dev22@acme.io", None)]

register("setup_status", OA.setup_sql())(lambda d: A.setup_status(d.raw_stored, d.stored_mart))
register("connector_health", OA.connector_health_sql())(
    lambda d: A.connector_health(d.raw_stored, S.connector_activity(d.raw), d.p))
register("repo_sync_status", OA.repo_sync_sql())(
    lambda d: A.repo_sync_status(SP.pr_state(d.raw_stored, only=[]), SP.run_state(d.raw_stored, only=[]),
                                 A.sync_triggers(d.spark, d.base, d.p), d.team_repo, d.teams, d.p))
register("team_list", OA.team_list_sql())(lambda d: A.team_list(d.teams, d.team_repo))
register("audit_recent", OA.audit_sql())(lambda d: A.audit_recent(d.audit))
register("user_directory", OA.user_directory_sql())(lambda d: A.user_directory(d.users, d.teams))
for _i, (_email, _asked) in enumerate(SCOPE_USERS):
    register(f"scope_filter_{_i}", OA.scope_filter_sql(_email, _asked))(
        lambda d, _e=_email, _a=_asked: A.scope_filter(d.users, _e, _a))

# --- I1-I5: identities and teams --------------------------------------------------
from ..operators import identity as I  # noqa: E402
from . import identity_plans as IP  # noqa: E402
from . import oracle_identity as OI  # noqa: E402

register("resolve_identities", OI.aliases_sql())(
    lambda d: IP.resolved(d.raw)[1].withColumn("match_confidence", F.col("match_confidence").cast("double")))
register("contributors", OI.contributors_sql())(lambda d: IP.resolved(d.raw)[0])
register("bot_filter", OI.humans_sql())(
    lambda d: I.bot_filter(IP.resolved(d.raw)[0], IP.resolved(d.raw)[0]))
register("import_teams", OI.imported_team_sql())(lambda d: IP.imported_teams(d.raw)[0])
register("import_team_repos", OI.team_repo_sql())(
    lambda d: IP.imported_teams(d.raw)[1].groupBy("team_id").agg(F.countDistinct("repo").alias("repos")))
register("import_team_members", OI.team_members_sql())(lambda d: IP.imported_teams(d.raw)[2])
register("manual_teams", OI.manual_teams_sql())(lambda d: I.manual_teams(IP.team_requests(d.spark, d.base)))

# --- S1-S11: landed vendor files -> envelopes ------------------------------------
import datetime as _dt  # noqa: E402

from ..sources import readers as R  # noqa: E402
from . import oracle_sources as OSRC  # noqa: E402
from . import source_plans as SRC  # noqa: E402


def _since(d: Domain) -> _dt.datetime:
    return d.p.as_of - _dt.timedelta(days=d.p.days)


register("land_pull_requests", OSRC.land_prs_sql())(
    lambda d: SRC.keys(R.land_pull_requests(SRC.pr_pages(d.prs), _since(d), d.p.as_of)[0], *SRC.PR_DETAIL))
register("land_reviews", OSRC.land_reviews_sql())(
    lambda d: SRC.keys(R.land_reviews(SRC.review_pages(d.reviews), d.p.as_of)[0], *SRC.REVIEW_DETAIL))
register("land_commits", OSRC.land_commits_sql())(
    lambda d: SRC.keys(R.land_commits(SRC.commit_pages(d.prs), d.p.as_of)[0], *SRC.COMMIT_DETAIL))
register("land_workflow_runs", OSRC.land_runs_sql())(
    lambda d: SRC.keys(R.land_workflow_runs(SRC.run_pages(d.runs), _since(d), d.p.as_of)[0], *SRC.RUN_DETAIL))
register("land_issues", OSRC.land_issues_sql())(
    lambda d: SRC.keys(R.land_issues(SRC.issue_pages(d.issues), d.p.as_of)[0], *SRC.ISSUE_DETAIL))
register("land_builds", OSRC.land_builds_sql())(
    lambda d: SRC.keys(R.land_builds(SRC.build_pages(d.runs), d.p.as_of)[0], *SRC.BUILD_DETAIL))
register("assemble_team_snapshots", OSRC.team_snapshots_sql())(
    lambda d: SRC.team_snapshot_stats(R.assemble_team_snapshots(
        d.teams.withColumn("slug", F.col("id")),
        d.team_repo.select("team_id", F.when(F.regexp_extract("repo", "([0-9]+)$", 1).cast("long") % 9 != 0,
                                             F.col("repo")).alias("full_name")),
        d.users.filter(F.col("team_id").isNotNull()).select(
            "team_id", F.col("id"), F.when(F.col("id").cast("long") % 49 != 0, F.col("github_login")).alias("login")),
        d.p.as_of)))
register("webhook_key", OSRC.webhook_key_sql())(
    lambda d: R.webhook_key(SRC.webhook_bodies(d.issues, d.p.as_of))[0].select("source", "source_id", "event_type"))
register("read_usage_report", OSRC.usage_report_sql())(
    lambda d: SRC.landed_usage_report(d.spark, d.ai_usage, d._table("landed_usage_report"), d.p.as_of))
register("read_usage_ndjson", OSRC.usage_ndjson_sql())(
    lambda d: SRC.landed_usage_ndjson(d.spark, d.ai_usage, d._table("landed_usage_ndjson"), d.p.as_of))
register("read_envelopes", OSRC.read_envelopes_sql())(
    lambda d: SRC.landed_envelopes(d.spark, d.raw, d._table("landed_envelopes_json")))

# --- D7: streaming ingest, checked equal to the batch rebuild --------------------
from ..sources.sinks import read_state  # noqa: E402
from ..streaming import stream_state as ST  # noqa: E402


def _streamed(d: Domain) -> str:
    """Land the delivery stream in arrival order as JSON, slice by slice, and run
    the ingest stream after each; every 101st delivery comes a second time without
    its ``source_id``. Returns the folder holding the state tables. All slices are
    written in one pass beside the landing folder and moved there one at a time; a
    pass that was cut off is run anew, a slice that was processed is not read again."""
    src, root = d._table("landing_ordered"), d._table("stream")
    if _exists(d.spark, src + "_done/_SUCCESS"):
        return root
    if not _exists(d.spark, src + "_slices/_SUCCESS"):
        ids = F.array("source_id")
        faulty = F.when(F.col("seq") % 101 == 0, F.array(F.col("source_id"), F.lit(None).cast("string"))).otherwise(ids)
        sent = ST.arrival_slices(d.raw.withColumn("source_id", F.explode(faulty)))
        write_folders(sent, ["slice"], src + "_slices", "json", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    for i in range(ST.SLICES):
        move_folder(d.spark, f"{src}_slices/slice={i}", f"{src}/slice-{i}")
        ST.stream_state(d.spark, src + "/slice-*", root, root + "/_checkpoint")
    d.spark.createDataFrame([("done",)], "v string").write.mode("overwrite").parquet(src + "_done")
    return root


register("stream_pr_state", OS.pr_state_sql())(
    lambda d: read_state(d.spark, _streamed(d) + "/pull_request_state").select(
        "repo", "pr_id", "number", "title", "author", "html_url", "state",
        F.array_join("requested_reviewers", ",").alias("requested_reviewers"),
        "created_at", "merged_at", "ai_assisted", "last_received_at"))
register("stream_issue_state", OS.issue_state_sql())(
    lambda d: read_state(d.spark, _streamed(d) + "/jira_issue_state").select(
        "issue_key", "issue_id", "project_key", "issue_type", "status", "summary",
        "assignee", "created_at", "resolved_at", "reopened", "last_received_at"))
register("stream_run_state", OS.run_state_sql())(
    lambda d: read_state(d.spark, _streamed(d) + "/workflow_run_state").select(
        "repo", "run_id", "conclusion", "name", "ts", "last_received_at"))
register("stream_review_state", OS.review_state_sql())(
    lambda d: read_state(d.spark, _streamed(d) + "/pull_request_review_state").select(
        "repo", "pr_number", "review_id", "reviewer_login", "state", "submitted_at", "last_received_at"))
register("stream_usage_state", OS.usage_state_sql())(
    lambda d: read_state(d.spark, _streamed(d) + "/ai_usage_state").select(
        "source", "actor_key", "day", "sessions", F.col("cost_usd").cast("double").alias("cost_usd"), "prs", "tokens_input",
        "tokens_output", "accepted_suggestions", "last_received_at"))
register("stream_quarantine", OSRC.stream_quarantine_sql())(
    lambda d: ST.quarantine_table(d.spark, _streamed(d)).groupBy("reason", "source", "event_type").agg(
        F.count(F.lit(1)).alias("events")))
register("stream_connector_activity", OS.connector_activity_sql())(
    lambda d: ST.connector_activity_table(d.spark, _streamed(d)))

# --- J1/J3 and A12 as standalone queries ------------------------------------------
from ..operators import asof as AS  # noqa: E402
from ..operators.filters import in_window  # noqa: E402

register("first_event_after", O.first_event_after_sql())(
    lambda d: AS.first_at_or_after(
        d.prs.filter(F.col("merged_at").isNotNull() & in_window("merged_at", d.p.as_of, d.p.days))
        .select("repo", "pr_id", "merged_at"),
        M.deploys(d.runs, d.p), ["repo"], "merged_at", "ts", "deploy_ts", d.p.asof_slot_seconds)
    .select("pr_id", "deploy_ts"))
register("followed_within", O.followed_within_sql())(
    lambda d: AS.followed_within(d.runs.filter(F.col("conclusion") == "success").select("repo", "run_id", "ts"),
                                 M.remediations(d.runs, d.p), ["repo"], "ts", "ts", "followed",
                                 d.p.within_hours * 3600, d.p.asof_slot_seconds).select("run_id", "followed"))
register("cockpit_series", OD.series_sql())(lambda d: D.cockpit_series(d.stored_mart, d.p))


# --- K4, F10 ------------------------------------------------------------------------
from ..operators.filters import exclude_disconnected  # noqa: E402
from ..sources.tables import read_table  # noqa: E402


def _quarantine(d: Domain) -> DataFrame:
    import uuid as _uuid
    q = d._table(f"quarantine/usage-{_uuid.uuid4().hex}")
    return SRC.quarantined_usage_lines(d.spark, d.ai_usage, d._table("landed_usage_ndjson_q"), q, d.p.as_of)


def _disconnected(d: Domain) -> DataFrame:
    """Repositories an admin disconnected: every 4th supplier's ``acme/repo-{3s}``."""
    s = read_table(d.spark, d.base, "supplier", "s_suppkey").filter(F.col("s_suppkey") % 4 == 3)
    return s.select(F.concat(F.lit("acme/repo-"), (F.col("s_suppkey") * 3).cast("string")).alias("repo"))


register("usage_quarantine", OSRC.usage_quarantine_sql())(_quarantine)
register("exclude_disconnected", OSRC.disconnected_sql())(
    lambda d: exclude_disconnected(d.prs, _disconnected(d)).groupBy("repo").agg(F.count(F.lit(1)).alias("prs")))

# --- scoped and sorted variants (F4, F5, O2) ---------------------------------------
import dataclasses as _dc  # noqa: E402

_TEAM2 = _dc.replace(DEFAULT, scope="team-2")
_TEAM1 = _dc.replace(DEFAULT, scope="team-1")
_TEAM0 = _dc.replace(DEFAULT, scope="team-0")
_REPO3 = _dc.replace(DEFAULT, scope="acme/repo-3")

register("cockpit_tiles_team", OD.cockpit_sql(_TEAM2))(lambda d: D.cockpit_tiles(d.stored_mart, _TEAM2))
register("cycle_stages_team", OD.cycle_stages_sql(_TEAM1))(
    lambda d: D.cycle_stages(d.prs, d.reviews, d.team_repo, _TEAM1))
register("reviewer_load_repo", OD.reviewer_load_sql(_REPO3))(lambda d: D.reviewer_load(d.reviews, d.team_repo, _REPO3))
register("aging_prs_by_repo", OD.aging_page_sql(DEFAULT, page=1, size=15, repo_filter="REPO-1", sort_by="repo",
                                                sort_dir="desc"))(
    lambda d: D.aging_prs_page(d.prs, d.team_repo, d.p, repo_filter="REPO-1", sort_by="repo", sort_dir="desc",
                               page=1, size=15))
register("aging_prs_total_filtered", OD.aging_total_sql(DEFAULT, size=15, repo_filter="repo-1"))(
    lambda d: D.aging_prs_total(d.prs, d.team_repo, d.p, repo_filter="repo-1", size=15))
register("investment_breakdown_team", OD.breakdown_sql(_TEAM0))(
    lambda d: D.investment_breakdown(D.classify(d.prs, d.issues, d.team_repo, _TEAM0)))

# --- K5: cockpit report export, read back ------------------------------------------
from ..sources.sinks import export_report_csv  # noqa: E402

_REPORT_BLOCKS = {
    "about": "name string, value string",
    "summary": "metric string, label string, aggregate double, unit string, sample_size long, tier string",
    "series": "metric string, day date, value double",
}


def _exported_report(d: Domain, block: str) -> DataFrame:
    folder = d._table(f"report_csv-{block}")
    tiles = D.cockpit_tiles(d.stored_mart, d.p)
    export_report_csv(tiles, D.cockpit_series(d.stored_mart, d.p), folder, d.p.scope, d.p.days)
    return d.spark.read.schema(_REPORT_BLOCKS[block]).option("header", True).option("escape", '"').csv(f"{folder}/{block}")


register("export_report_csv", OD.report_csv_sql())(lambda d: _exported_report(d, "summary"))
register("export_report_series", OD.report_series_sql())(
    lambda d: _exported_report(d, "series").withColumn("value", F.round("value", 6)))
register("export_report_about", OD.report_about_sql())(lambda d: _exported_report(d, "about"))

# --- F8: requests for a window wider than allowed get the widest one -----------------
_WIDE = _dc.replace(DEFAULT, days=4000)
register("aging_prs_wide", OD.aging_page_sql(_dc.replace(DEFAULT, days=90), size=100))(
    lambda d: D.aging_prs_page(d.prs, d.team_repo, _WIDE, size=5000))
register("investment_breakdown_wide", OD.breakdown_sql(_dc.replace(DEFAULT, days=180)))(
    lambda d: D.investment_breakdown(D.classify(d.prs, d.issues, d.team_repo, _WIDE)))
register("ai_spend_kpis_wide", OD.kpis_sql(_dc.replace(DEFAULT, days=90)))(
    lambda d: D.ai_spend_kpis(d.ai_usage, _WIDE))
