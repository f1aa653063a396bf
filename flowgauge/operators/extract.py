"""JSON extraction into typed entity rows.

Payloads are parsed with ``from_json`` against explicit schemas (schema on
read; Spark reads only the fields named). Webhook bodies nest the entity under a
wrapper field while snapshots *are* the entity, so each extractor reads both
shapes and picks the wrapper when it is present. Every extractor keeps the
envelope's ``received_at`` and ``seq`` for the latest-state guard and drops
rows it cannot key (rather than guessing a key).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# --- fixed values that must equal the reference's -----------------------------
# AI attribution trailers, matched case-insensitively over title + body + labels.
AI_ATTRIBUTION = (r"(?i)(co-authored-by:\s*(claude|copilot|cursor)"
                  r"|generated (with|by)\s*(claude( code)?|copilot|cursor)"
                  r"|claude[- ]assisted|copilot[- ]assisted)")
# Jira status names that count as terminal (a transition away from one = reopen).
TERMINAL_STATUSES = ["done", "closed", "resolved"]
JENKINS_GIT_BUILD_DATA = "hudson.plugins.git.util.BuildData"
DAYS_PER_MONTH = 30
# ------------------------------------------------------------------------------

RUN = "id string, name string, conclusion string, updated_at string, repository struct<full_name:string>"
PR = ("id string, number string, title string, body string, state string, html_url string, created_at string, "
      "merged_at string, user struct<login:string,id:string,email:string>, base struct<repo:struct<full_name:string>>, "
      "labels array<struct<name:string>>, requested_reviewers array<struct<login:string>>")
REVIEW = "id string, pull_request_url string, state string, submitted_at string, user struct<login:string,id:string>"
_PERSON = "struct<accountId:string,displayName:string,emailAddress:string>"
_ITEMS = "array<struct<field:string,fromString:string,toString:string>>"
ISSUE = (f"key string, id string, fields struct<project:struct<key:string>, issuetype:struct<name:string>, "
         f"status:struct<name:string>, summary:string, assignee:{_PERSON}, reporter:{_PERSON}, created:string, "
         f"resolutiondate:string, updated:string>, changelog struct<items:{_ITEMS}, histories:array<struct<items:{_ITEMS}>>>")
BUILD = ("number string, result string, timestamp string, job_name string, "
         "actions array<struct<_class:string, remoteUrls:array<string>>>")
METERED = ("date string, actor struct<email_address:string>, terminal_type string, "
           "core_metrics struct<num_sessions:int, lines_of_code:struct<added:int,removed:int>, "
           "commits_by_claude_code:int, pull_requests_by_claude_code:int>, "
           "model_breakdown array<struct<tokens:struct<input:bigint,output:bigint>, estimated_cost:struct<amount:double>>>, "
           "tool_actions map<string, struct<accepted:int,rejected:int>>")
SEAT = ("user_login string, day string, loc_added_sum int, loc_deleted_sum int, code_acceptance_activity_count int, "
        "totals_by_cli struct<session_count:int, prompt_count:int, request_count:int, "
        "token_usage:struct<prompt_tokens_sum:bigint, output_tokens_sum:bigint>>, totals_by_ide array<struct<ide:string>>")
TEAM = "id string, name string, slug string, repositories array<struct<full_name:string>>, members array<struct<id:string,login:string>>"

PR_COMMITS = "pull_request_url string, commits array<struct<sha:string, commit:struct<author:struct<date:string>>>>"
PR_SIZE = ("number string, additions bigint, deletions bigint, created_at string, base struct<repo:struct<full_name:string>>")
HISTORY = (f"key string, fields struct<updated:string>, "
           f"changelog struct<items:{_ITEMS}, histories:array<struct<created:string, items:{_ITEMS}>>>")

_ENV = ["received_at", "seq"]
#: Optional struct column of envelopes (state.deliveries): their natural key, for a dedup of extracted rows.
DELIVERY = "_delivery"


def _env(events: DataFrame) -> list[str]:
    return [*_ENV, DELIVERY] if DELIVERY in events.columns else _ENV


def _keyed(rows: DataFrame, keyed: Column) -> DataFrame:
    """Rows that can be keyed. Rows with a delivery all stay, marked, because one that
    can't be keyed may be the first of its delivery."""
    if DELIVERY not in rows.columns:
        return rows.filter(keyed)
    return rows.withColumn(DELIVERY, F.col(DELIVERY).withField("keyed", F.coalesce(keyed, F.lit(False))))


def _parsed(events: DataFrame, **parsers: Column) -> DataFrame:
    """Evaluate each JSON parse exactly once per row. The parse sits under a
    one-element ``inline``; without that boundary the optimizer inlines the
    parsed struct into every field access and into pushed-down filters, and
    the payload would be parsed once per reference."""
    row = F.struct(*[c.alias(n) for n, c in parsers.items()], *[F.col(c) for c in _env(events)])
    return events.select(F.inline(F.array(row)))


def _wrapped_schema(wrapper: str, inner_ddl: str) -> str:
    """One schema for both shapes: the wrapper field plus the entity's own
    top-level fields."""
    return f"{wrapper} struct<{_ddl_to_struct_fields(inner_ddl)}>, {inner_ddl}"


def _pick(j: str, wrapper: str, inner_ddl: str) -> Column:
    """The wrapper's struct when the payload has it, else the payload itself."""
    flat = F.struct(*[F.col(j)[n].alias(n) for n in _top_names(inner_ddl)])
    return F.when(F.col(j)[wrapper].isNotNull(), F.col(j)[wrapper]).otherwise(flat)


def _top_names(ddl: str) -> list[str]:
    return [f.split(":", 1)[0] for f in _split_top(_ddl_to_struct_fields(ddl))]


def _split_top(fields: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in fields:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return out


def _ddl_to_struct_fields(ddl: str) -> str:
    """'a string, b struct<...>' -> 'a:string, b:struct<...>' (top level only)."""
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return ", ".join(f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in out)


def extract_runs(events: DataFrame) -> DataFrame:
    """Workflow runs. Repo from the run, else the payload, else 'unknown'."""
    r = _parsed(events, j=F.from_json(F.col("payload"), _wrapped_schema("workflow_run", RUN)))
    r = r.select(_pick("j", "workflow_run", RUN).alias("r"), F.col("j.repository").alias("t"), *_env(events))
    return _keyed(r, F.col("r.id").isNotNull()).select(
        C.first_non_blank(F.col("r.repository.full_name"), F.col("t.full_name"), F.lit("unknown")).alias("repo"),
        F.col("r.id").alias("run_id"), F.col("r.conclusion").alias("conclusion"), F.col("r.name").alias("name"),
        C.iso_instant(F.col("r.updated_at")).alias("ts"), *_env(events))


def extract_builds(events: DataFrame) -> DataFrame:
    """Jenkins builds as runs: run_id ``jenkins:{job}:{number}``; repo from
    the first git BuildData action with remote URLs; result mapped (C7); time
    from epoch milliseconds."""
    b = _keyed(_parsed(events, b=F.from_json(F.col("payload"), BUILD)),
               F.col("b.number").isNotNull() & F.col("b.job_name").isNotNull())
    git = F.filter(F.col("b.actions"), lambda a: (a["_class"] == JENKINS_GIT_BUILD_DATA) & (F.size(a["remoteUrls"]) > 0))
    url = F.get(F.get(git, 0)["remoteUrls"], 0)
    return b.select(
        F.coalesce(C.repo_from_git_url(url), F.lit("unknown")).alias("repo"),
        F.concat(F.lit("jenkins:"), F.col("b.job_name"), F.lit(":"), F.col("b.number")).alias("run_id"),
        C.build_conclusion(F.col("b.result")).alias("conclusion"),
        F.col("b.job_name").alias("name"),
        F.timestamp_millis(C.long_or_null(F.col("b.timestamp"))).alias("ts"), *_env(events))


def ai_assisted_flag(title, body, labels) -> Column:
    """AI co-author / generated-with trailer anywhere in title, body or labels."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")),
                       F.array_join(F.transform(F.coalesce(labels, F.array()), lambda x: x["name"]), " "))
    return text.rlike(AI_ATTRIBUTION)


def extract_pull_requests(events: DataFrame) -> DataFrame:
    """Pull requests."""
    r = _parsed(events, j=F.from_json(F.col("payload"), _wrapped_schema("pull_request", PR)))
    r = _keyed(r.select(_pick("j", "pull_request", PR).alias("p"), *_env(events)), F.col("p.id").isNotNull())
    return r.select(
        C.first_non_blank(F.col("p.base.repo.full_name"), F.lit("unknown")).alias("repo"),
        C.long_or_null(F.col("p.id")).alias("pr_id"),
        C.long_or_null(F.col("p.number")).alias("number"),
        F.col("p.title").alias("title"), F.col("p.user.login").alias("author"), F.col("p.html_url").alias("html_url"),
        F.col("p.state").alias("state"),
        F.filter(F.transform(F.coalesce(F.col("p.requested_reviewers"), F.array()), lambda x: x["login"]),
                 lambda x: x.isNotNull()).alias("requested_reviewers"),
        C.iso_instant(F.col("p.created_at")).alias("created_at"),
        C.iso_instant(F.col("p.merged_at")).alias("merged_at"),
        ai_assisted_flag(F.col("p.title"), F.col("p.body"), F.col("p.labels")).alias("ai_assisted"), *_env(events))


def extract_reviews(events: DataFrame) -> DataFrame:
    """E5: reviews; repo and PR number come from ``pull_request_url``."""
    r = _parsed(events, v=F.from_json(F.col("payload"), REVIEW))
    url = F.col("v.pull_request_url")
    repo = F.nullif(F.regexp_extract(url, r"/repos/(.+?)/pulls/(\d+)$", 1), F.lit(""))
    num = F.nullif(F.regexp_extract(url, r"/repos/(.+?)/pulls/(\d+)$", 2), F.lit(""))
    return _keyed(r, F.col("v.id").isNotNull() & url.isNotNull() & repo.isNotNull() & num.isNotNull()).select(
        repo.alias("repo"), num.cast("long").alias("pr_number"), F.col("v.id").alias("review_id"),
        F.col("v.user.login").alias("reviewer_login"), F.col("v.state").alias("state"),
        C.iso_instant(F.col("v.submitted_at")).alias("submitted_at"), *_env(events))


def extract_pr_commits(events: DataFrame) -> DataFrame:
    """Commit lists of pull requests: one row per received list, so that
    ``latest_state`` over (repo, pr_number) keeps the commits that stand and drops
    what a force-push discarded. Commits without an author date keep a null one."""
    r = _parsed(events, v=F.from_json(F.col("payload"), PR_COMMITS)).filter(F.col("v.pull_request_url").isNotNull() & F.col("v.commits").isNotNull())
    url = F.col("v.pull_request_url")
    repo = F.nullif(F.regexp_extract(url, r"/repos/(.+?)/pulls/(\d+)$", 1), F.lit(""))
    num = F.nullif(F.regexp_extract(url, r"/repos/(.+?)/pulls/(\d+)$", 2), F.lit(""))
    kept = F.filter("v.commits", lambda c: c["sha"].isNotNull())
    commits = F.transform(kept, lambda c: F.struct(c["sha"].alias("sha"), C.iso_instant(c["commit"]["author"]["date"]).alias("authored_at")))
    return r.filter(repo.isNotNull() & num.isNotNull()).select(repo.alias("repo"), num.cast("long").alias("pr_number"), commits.alias("commits"), *_ENV)


def extract_pr_sizes(events: DataFrame) -> DataFrame:
    """Changed lines (additions + deletions) of every received version of a pull request.
    Listings carry no line counts: versions without any are left out, not counted as empty."""
    r = _parsed(events, j=F.from_json(F.col("payload"), _wrapped_schema("pull_request", PR_SIZE)))
    r = r.select(_pick("j", "pull_request", PR_SIZE).alias("p"), *_ENV)
    lines = F.coalesce(F.col("p.additions"), F.lit(0)) + F.coalesce(F.col("p.deletions"), F.lit(0))
    return r.filter(F.coalesce("p.additions", "p.deletions").isNotNull() & F.col("p.base.repo.full_name").isNotNull()).select(
        F.col("p.base.repo.full_name").alias("repo"), C.long_or_null(F.col("p.number")).alias("number"),
        C.iso_instant(F.col("p.created_at")).alias("created_at"), lines.alias("lines"), *_ENV).filter(F.col("number").isNotNull())


def extract_transitions(events: DataFrame) -> DataFrame:
    """Status changes (issue_key, to_status, at) of ticket envelopes: every entry of a
    changelog history, or the single change of a webhook, dated by the update.
    The same change in several envelopes is one row."""
    r = _parsed(events, j=F.from_json(F.col("payload"), _wrapped_schema("issue", HISTORY)))
    issue = _pick("j", "issue", HISTORY)
    changelog = F.coalesce(F.col("j.changelog"), F.col("j.issue.changelog"))
    r = r.select(issue.alias("i"), changelog.alias("cl")).filter(F.col("i.key").isNotNull())
    single = F.array(F.struct(F.col("i.fields.updated").alias("created"), F.col("cl.items").alias("items")))
    listed = r.select(F.col("i.key").alias("issue_key"), F.explode(F.coalesce("cl.histories", single)).alias("h"))
    moved = listed.select("issue_key", C.jira_instant(F.col("h.created")).alias("at"), F.explode("h.items").alias("item"))
    kept = moved.filter((F.col("item.field") == "status") & F.col("at").isNotNull() & F.col("item.toString").isNotNull())
    return kept.select("issue_key", F.col("item.toString").alias("to_status"), "at").distinct()


def reopened_flag(changelog: Column) -> Column:
    """A status change away from a terminal status; full ``histories`` when
    present, else the single ``items`` delta."""
    def reopen(items):
        return F.exists(F.coalesce(items, F.array()),
                        lambda i: (i["field"] == "status") & F.lower(i["fromString"]).isin(TERMINAL_STATUSES))
    hist = changelog["histories"]
    return F.coalesce(F.when(hist.isNotNull(), F.exists(hist, lambda h: reopen(h["items"])))
                      .otherwise(reopen(changelog["items"])), F.lit(False))


def extract_issues(events: DataFrame) -> DataFrame:
    """E6 (+E7): Jira issues; key, id and fields are required."""
    r = _parsed(events, j=F.from_json(F.col("payload"), _wrapped_schema("issue", ISSUE)))
    issue = _pick("j", "issue", ISSUE)
    # a webhook's changelog is the issue's sibling, a snapshot's is its own
    changelog = F.coalesce(F.col("j.changelog"), F.col("j.issue.changelog"))
    r = _keyed(r.select(issue.alias("i"), changelog.alias("cl"), *_env(events)),
               F.col("i.key").isNotNull() & F.col("i.id").isNotNull() & F.col("i.fields").isNotNull())
    return r.select(
        F.col("i.key").alias("issue_key"), F.col("i.id").alias("issue_id"),
        C.first_non_blank(F.col("i.fields.project.key"), F.lit("unknown")).alias("project_key"),
        F.col("i.fields.issuetype.name").alias("issue_type"), F.col("i.fields.status.name").alias("status"),
        F.col("i.fields.summary").alias("summary"), F.col("i.fields.assignee.displayName").alias("assignee"),
        C.jira_instant(F.col("i.fields.created")).alias("created_at"),
        C.jira_instant(F.col("i.fields.resolutiondate")).alias("resolved_at"),
        F.when(F.col("cl").isNull(), F.lit(False)).otherwise(reopened_flag(F.col("cl"))).alias("reopened"), *_env(events))


def seat_cost(sessions, prompts, requests, monthly) -> Column:
    """The seat price spread over 30 days, charged on active days only."""
    active = (F.coalesce(sessions, F.lit(0)) > 0) | (F.coalesce(prompts, F.lit(0)) > 0) | (F.coalesce(requests, F.lit(0)) > 0)
    per_day = F.round(F.lit(monthly).cast("decimal(10,2)") / F.lit(DAYS_PER_MONTH), 2)
    return F.when(active, per_day).otherwise(F.lit(0)).cast("decimal(18,2)")


_USAGE_COLS = ["source", "actor_key", "day", "sessions", "loc_added", "loc_removed", "commits", "prs", "cost_usd",
               "tokens_input", "tokens_output", "prompts", "requests", "accepted_suggestions",
               "rejected_suggestions", "primary_surface"]


def extract_usage_metered(events: DataFrame) -> DataFrame:
    """Per-day metered usage; tokens and cost summed over the model
    breakdown (null cost -> 0; unrounded, reports round), accepted/rejected
    summed over every tool."""
    u = _parsed(events, u=F.from_json(F.col("payload"), METERED)).filter(
        F.col("u.actor.email_address").isNotNull() & F.col("u.date").isNotNull())
    mb = F.coalesce(F.col("u.model_breakdown"), F.array())
    acts = F.map_values(F.coalesce(F.col("u.tool_actions"), F.create_map().cast("map<string,struct<accepted:int,rejected:int>>")))
    return u.select(
        F.lit("claude_code").alias("source"), F.col("u.actor.email_address").alias("actor_key"),
        F.to_date(F.substring(F.col("u.date"), 1, 10)).alias("day"),
        F.col("u.core_metrics.num_sessions").cast("long").alias("sessions"),
        F.col("u.core_metrics.lines_of_code.added").cast("long").alias("loc_added"),
        F.col("u.core_metrics.lines_of_code.removed").cast("long").alias("loc_removed"),
        F.col("u.core_metrics.commits_by_claude_code").cast("long").alias("commits"),
        F.col("u.core_metrics.pull_requests_by_claude_code").cast("long").alias("prs"),
        F.aggregate(mb, F.lit(0).cast("decimal(38,10)"),
                    lambda acc, m: (acc + F.coalesce(m["estimated_cost"]["amount"].cast("decimal(28,10)"),
                                                     F.lit(0).cast("decimal(28,10)"))).cast("decimal(38,10)"))
        .alias("cost_usd"),
        F.aggregate(mb, F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(m["tokens"]["input"], F.lit(0))).alias("tokens_input"),
        F.aggregate(mb, F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(m["tokens"]["output"], F.lit(0))).alias("tokens_output"),
        F.lit(None).cast("long").alias("prompts"), F.lit(None).cast("long").alias("requests"),
        F.aggregate(acts, F.lit(0).cast("long"), lambda acc, a: acc + F.coalesce(a["accepted"], F.lit(0))).alias("accepted_suggestions"),
        F.aggregate(acts, F.lit(0).cast("long"), lambda acc, a: acc + F.coalesce(a["rejected"], F.lit(0))).alias("rejected_suggestions"),
        F.col("u.terminal_type").alias("primary_surface"), *_ENV)


def extract_usage_seat(events: DataFrame, monthly_seat_usd: float) -> DataFrame:
    """E9 (+E10): per-day seat-priced usage; surface = first IDE listed."""
    u = _parsed(events, u=F.from_json(F.col("payload"), SEAT)).filter(
        F.col("u.user_login").isNotNull() & F.col("u.day").isNotNull())
    cli = F.col("u.totals_by_cli")
    return u.select(
        F.lit("copilot").alias("source"), F.col("u.user_login").alias("actor_key"), F.to_date(F.col("u.day")).alias("day"),
        cli["session_count"].cast("long").alias("sessions"),
        F.col("u.loc_added_sum").cast("long").alias("loc_added"),
        F.col("u.loc_deleted_sum").cast("long").alias("loc_removed"),
        F.lit(None).cast("long").alias("commits"), F.lit(None).cast("long").alias("prs"),
        seat_cost(cli["session_count"], cli["prompt_count"], cli["request_count"], monthly_seat_usd).alias("cost_usd"),
        cli["token_usage"]["prompt_tokens_sum"].alias("tokens_input"),
        cli["token_usage"]["output_tokens_sum"].alias("tokens_output"),
        cli["prompt_count"].cast("long").alias("prompts"), cli["request_count"].cast("long").alias("requests"),
        F.col("u.code_acceptance_activity_count").cast("long").alias("accepted_suggestions"),
        F.lit(None).cast("long").alias("rejected_suggestions"),
        F.get(F.col("u.totals_by_ide"), 0)["ide"].alias("primary_surface"), *_ENV)


def extract_usage(events: DataFrame, monthly_seat_usd: float) -> DataFrame:
    return (extract_usage_metered(events.filter(F.col("source") == "claude_code"))
            .unionByName(extract_usage_seat(events.filter(F.col("source") == "copilot"), monthly_seat_usd)))


def extract_team_snapshot(snapshots: DataFrame, payload: str = "payload") -> DataFrame:
    """Team id and name required; repositories need a full name, members
    an id; missing arrays are empty."""
    t = snapshots.select(F.from_json(F.col(payload), TEAM).alias("t"), *[c for c in _ENV if c in snapshots.columns])
    t = t.filter(F.col("t.id").isNotNull() & F.col("t.name").isNotNull())
    repos = F.filter(F.coalesce(F.col("t.repositories"), F.array()), lambda r: r["full_name"].isNotNull())
    members = F.filter(F.coalesce(F.col("t.members"), F.array()), lambda m: m["id"].isNotNull())
    return t.select(F.col("t.id").alias("team_source_id"), F.col("t.name").alias("name"), F.col("t.slug").alias("slug"),
                    F.transform(repos, lambda r: r["full_name"]).alias("repos"),
                    members.alias("members"), *[c for c in _ENV if c in snapshots.columns])
