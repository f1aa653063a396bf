"""Raw event envelopes rebuilt from the domain views.

This is the ingest side of the pipeline as the connectors would land it: one
JSON envelope per tool event, in the payload shapes of the source tools
(webhook bodies nest the entity, snapshots are the entity), with the delivery
faults a queue produces:

* an older version of many entities (an in-progress run, an opened PR) and, for
  every 5th of those, the older version *arrives after* the newer one;
* every 7th envelope is delivered a second time, an hour later;
* a stale issue update that carries a reopen is delivered late for every 10th
  issue that was never reopened (the sticky flag must ignore it).

Replaying these envelopes through dedup -> latest state -> extraction must give
back exactly the views they were built from (plus the Jenkins builds below).
``seq`` is the arrival order: arrival time in microseconds x 4 + a tag.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONNECTOR_VERSION = "1.0.0"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
JIRA = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"
GIT_BUILD_DATA = "hudson.plugins.git.util.BuildData"


def iso(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, ISO)


def _plus_seconds(ts, secs) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.unix_micros(c) + F.lit(int(secs * 1_000_000)))


def _env(df: DataFrame, source, source_id: Column, event_type, received: Column, payload: Column,
         arrival: Column | None = None, tag: int = 0) -> DataFrame:
    arrival = received if arrival is None else arrival
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        source_id.alias("source_id"),
        (F.lit(event_type) if isinstance(event_type, str) else event_type).alias("event_type"),
        received.alias("received_at"),
        F.lit(CONNECTOR_VERSION).alias("connector_version"),
        payload.alias("payload"),
        (F.unix_micros(arrival) * 4 + tag).alias("seq"),
    )


def run_envelopes(runs: DataFrame) -> DataFrame:
    rid = F.col("run_id").cast("long")
    repo_s = F.struct(F.col("repo").alias("full_name"))

    def run_struct(conclusion: Column, updated: Column, with_repo: Column) -> Column:
        return F.struct(rid.alias("id"), F.col("name"), conclusion.alias("conclusion"), iso(updated).alias("updated_at"),
                        F.when(with_repo, repo_s).alias("repository"))

    def build(conclusion, updated, received, arrival, tag):
        webhook = rid % 2 == 0
        inner = run_struct(conclusion, updated, ~(webhook & (rid % 4 == 0)))
        payload = F.when(webhook, F.to_json(F.struct(F.lit("completed").alias("action"), inner.alias("workflow_run"),
                                                      repo_s.alias("repository"))))\
            .otherwise(F.to_json(inner))
        et = F.when(webhook, F.lit("workflow_run")).otherwise(F.lit("workflow_run.snapshot"))
        sid = F.concat(F.lit("workflow_run:"), F.col("run_id"), F.lit(":"), iso(updated))
        return _env(runs, "github", sid, et, received, payload, arrival, tag)

    final = build(F.col("conclusion"), F.col("ts"), F.col("ts"), None, 0)
    older = runs.filter(rid % 3 == 0)
    early = _plus_seconds("ts", -300)
    late_arrival = F.when(rid % 5 == 0, _plus_seconds("ts", 0.000001)).otherwise(early)
    old = _env(older, "github",
               F.concat(F.lit("workflow_run:"), F.col("run_id"), F.lit(":"), iso(early)),
               F.when(rid % 2 == 0, F.lit("workflow_run")).otherwise(F.lit("workflow_run.snapshot")),
               early,
               F.when(rid % 2 == 0, F.to_json(F.struct(F.lit("in_progress").alias("action"),
                                                        run_struct(F.lit(None).cast("string"), early, F.lit(True))
                                                        .alias("workflow_run"), repo_s.alias("repository"))))
               .otherwise(F.to_json(run_struct(F.lit(None).cast("string"), early, F.lit(True)))),
               late_arrival, 1)
    return final.unionByName(old)


def jenkins_envelopes(runs: DataFrame) -> DataFrame:
    """Jenkins builds for the "CI tests" runs of every 13th run id."""
    rid = F.col("run_id").cast("long")
    b = runs.filter((F.col("name") == "CI tests") & (rid % 13 == 0))
    job = F.concat(F.lit("build-"), F.regexp_extract("repo", r"([^/]+)$", 1))
    result = (F.when(F.col("conclusion") == "success", "SUCCESS").when(F.col("conclusion") == "failure", "FAILURE"))
    actions = F.array(
        F.struct(F.lit("hudson.model.CauseAction").alias("_class"), F.lit(None).cast("array<string>").alias("remoteUrls")),
        F.struct(F.lit(GIT_BUILD_DATA).alias("_class"),
                 F.array(F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit(".git"))).alias("remoteUrls")))
    payload = F.to_json(F.struct(rid.alias("number"), result.alias("result"),
                                 (F.unix_micros("ts") / 1000).cast("long").alias("timestamp"),
                                 job.alias("job_name"), actions.alias("actions")))
    sid = F.concat(F.lit("jenkins:"), job, F.lit(":"), F.col("run_id"))
    return _env(b, "jenkins", sid, "build.snapshot", F.col("ts"), payload)


def pr_envelopes(prs: DataFrame) -> DataFrame:
    pid = F.col("pr_id")
    ai = F.col("ai_assisted")
    body = F.when(ai & (pid % 2 == 0), F.lit("Adds retries.\n\nCo-authored-by: Claude <noreply@example.com>"))\
        .otherwise(F.lit("Routine change."))
    labels = F.when(ai & (pid % 2 == 1), F.array(F.struct(F.lit("copilot-assisted").alias("name"))))\
        .otherwise(F.array(F.struct(F.lit("chore").alias("name"))))

    def pr_struct(state: Column, merged: Column) -> Column:
        return F.struct(pid.alias("id"), F.col("number"), F.col("title"), body.alias("body"), state.alias("state"),
                        F.col("html_url"), iso("created_at").alias("created_at"), iso(merged).alias("merged_at"),
                        F.struct(F.col("author").alias("login"), user_id("author", 1_000_000).alias("id")).alias("user"),
                        F.struct(F.struct(F.col("repo").alias("full_name")).alias("repo")).alias("base"),
                        labels.alias("labels"),
                        F.transform("requested_reviewers", lambda x: F.struct(x.alias("login"))).alias("requested_reviewers"))

    def wrap(inner: Column, action: str) -> Column:
        return F.when(pid % 2 == 0, F.to_json(F.struct(F.lit(action).alias("action"), inner.alias("pull_request"))))\
            .otherwise(F.to_json(inner))

    et = F.when(pid % 2 == 0, F.lit("pull_request")).otherwise(F.lit("pull_request.snapshot"))
    closed = prs.filter(F.col("merged_at").isNotNull())
    opened_arrival = F.when(F.col("merged_at").isNotNull() & (pid % 5 == 0),
                            _plus_seconds("merged_at", 0.000001)).otherwise(F.col("created_at"))
    opened = _env(prs, "github", F.concat(F.lit("pr:"), pid.cast("string"), F.lit(":"), iso("created_at")), et,
                  F.col("created_at"), wrap(pr_struct(F.lit("open"), F.lit(None).cast("timestamp")), "opened"),
                  opened_arrival, 1)
    final = _env(closed, "github", F.concat(F.lit("pr:"), pid.cast("string"), F.lit(":"), iso("merged_at")), et,
                 F.col("merged_at"), wrap(pr_struct(F.col("state"), F.col("merged_at")), "closed"))
    return opened.unionByName(final)


def review_envelopes(reviews: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(
        F.col("review_id").alias("id"),
        F.concat(F.lit("https://api.github.com/repos/"), F.col("repo"), F.lit("/pulls/"),
                 F.col("pr_number").cast("string")).alias("pull_request_url"),
        F.col("state"), iso("submitted_at").alias("submitted_at"),
        F.struct(F.col("reviewer_login").alias("login"), user_id("reviewer_login", 2_000_000).alias("id")).alias("user")))
    return _env(reviews, "github", F.concat(F.lit("review:"), F.col("review_id")), "pull_request_review.snapshot",
                F.col("submitted_at"), payload)


def issue_envelopes(issues: DataFrame) -> DataFrame:
    key_n = F.col("issue_id").cast("long")
    fields = F.struct(
        F.struct(F.col("project_key").alias("key")).alias("project"),
        F.struct(F.col("issue_type").alias("name")).alias("issuetype"),
        F.struct(F.col("status").alias("name")).alias("status"),
        F.col("summary"),
        F.struct(F.col("assignee").alias("displayName"),
                 F.concat(F.lit("acct-"), (key_n % 40).cast("string")).alias("accountId"),
                 F.when(key_n % 2 == 0, F.concat(F.lit("dev"), (key_n % 40).cast("string"), F.lit("@acme.io")))
                 .alias("emailAddress")).alias("assignee"),
        F.struct(F.concat(F.lit("Reporter "), (key_n % 7).cast("string")).alias("displayName"),
                 F.concat(F.lit("acct-r"), (key_n % 7).cast("string")).alias("accountId")).alias("reporter"),
        F.date_format("created_at", JIRA).alias("created"),
        F.date_format("resolved_at", JIRA).alias("resolutiondate"),
        F.date_format("last_received_at", JIRA).alias("updated"))
    issue = F.struct(F.col("issue_key").alias("key"), F.col("issue_id").alias("id"), fields.alias("fields"))
    reopen_items = F.array(F.struct(F.lit("status").alias("field"), F.lit("Done").alias("fromString"),
                                    F.lit("In Progress").alias("toString")))
    final = _env(issues, "jira", F.concat(F.lit("issue:"), F.col("issue_id"), F.lit(":"), iso("last_received_at")),
                 "issue.snapshot", F.col("last_received_at"), F.to_json(issue))

    def update(df, received, arrival, tag):
        payload = F.to_json(F.struct(F.lit("jira:issue_updated").alias("webhookEvent"), issue.alias("issue"),
                                     F.struct(reopen_items.alias("items")).alias("changelog")))
        return _env(df, "jira", F.concat(F.lit("issue:"), F.col("issue_id"), F.lit(":"), iso(received)),
                    "jira:issue_updated", received, payload, arrival, tag)

    reopened = update(issues.filter("reopened"), _plus_seconds("created_at", 1800), None, 1)
    stale = update(issues.filter(~F.col("reopened") & (key_n % 10 == 0)), _plus_seconds("created_at", 600),
                   _plus_seconds("last_received_at", 1), 3)
    return final.unionByName(reopened).unionByName(stale)


def usage_envelopes(usage: DataFrame) -> DataFrame:
    cc = usage.filter(F.col("source") == "claude_code")
    cp = usage.filter(F.col("source") == "copilot")
    day_s = F.date_format("day", "yyyy-MM-dd")
    cc_payload = F.to_json(F.struct(
        F.concat(day_s, F.lit("T00:00:00Z")).alias("date"),
        F.struct(F.col("actor_key").alias("email_address")).alias("actor"),
        F.lit("vscode").alias("terminal_type"),
        F.struct(F.col("sessions").alias("num_sessions"),
                 F.struct(F.col("accepted_suggestions").alias("added"), F.col("rejected_suggestions").alias("removed"))
                 .alias("lines_of_code"),
                 F.lit(0).alias("commits_by_claude_code"),
                 F.col("prs").alias("pull_requests_by_claude_code")).alias("core_metrics"),
        F.array(F.struct(F.struct(F.col("tokens_input").alias("input"), F.col("tokens_output").alias("output")).alias("tokens"),
                         F.struct(F.col("cost_usd").cast("double").alias("amount")).alias("estimated_cost")),
                F.struct(F.struct(F.lit(0).cast("long").alias("input"), F.lit(0).cast("long").alias("output")).alias("tokens"),
                         F.struct(F.lit(None).cast("double").alias("amount")).alias("estimated_cost"))).alias("model_breakdown"),
        F.create_map(F.lit("edit_tool"), F.struct(F.col("accepted_suggestions").alias("accepted"),
                                                  F.col("rejected_suggestions").alias("rejected")),
                     F.lit("write_tool"), F.struct(F.lit(0).cast("long").alias("accepted"),
                                                   F.lit(0).cast("long").alias("rejected"))).alias("tool_actions")))
    cc_env = _env(cc, "claude_code", F.concat(F.lit("claude_code:"), F.col("actor_key"), F.lit(":"), day_s),
                  "usage.snapshot", F.col("last_received_at"), cc_payload)
    cp_payload = F.to_json(F.struct(
        F.col("actor_key").alias("user_login"), day_s.alias("day"),
        F.col("accepted_suggestions").alias("loc_added_sum"), F.col("rejected_suggestions").alias("loc_deleted_sum"),
        F.col("accepted_suggestions").alias("code_acceptance_activity_count"),
        F.struct(F.col("sessions").alias("session_count"), F.col("sessions").alias("prompt_count"),
                 F.col("sessions").alias("request_count"),
                 F.struct(F.col("tokens_input").alias("prompt_tokens_sum"),
                          F.col("tokens_output").alias("output_tokens_sum")).alias("token_usage")).alias("totals_by_cli"),
        F.array(F.struct(F.lit("vscode").alias("ide")), F.struct(F.lit("jetbrains").alias("ide"))).alias("totals_by_ide")))
    cp_env = _env(cp, "copilot", F.concat(F.lit("copilot:"), F.col("actor_key"), F.lit(":"), day_s),
                  "usage.snapshot", F.col("last_received_at"), cp_payload)
    return cc_env.unionByName(cp_env)


def user_id(login: str, offset: int) -> Column:
    """Platform user id of ``dev-<n>``/``rev-<n>``: offset + n."""
    return F.regexp_extract(F.col(login), r"([0-9]+)$", 1).cast("long") + F.lit(offset)


def commit_envelopes(prs: DataFrame) -> DataFrame:
    """One commit per merged PR, a minute after the merge. Every 3rd commit has
    no platform author (only the git signature); the signature's email is the
    author's, in mixed case."""
    m = prs.filter(F.col("merged_at").isNotNull())
    n = F.regexp_extract("author", r"([0-9]+)$", 1)
    sig = F.struct(F.concat(F.lit("Dev "), n).alias("name"), F.concat(F.lit("Dev"), n, F.lit("@Acme.io")).alias("email"))
    gh = F.when(F.col("pr_id") % 3 != 0, F.struct(user_id("author", 1_000_000).cast("string").alias("id"),
                                                  F.col("author").alias("login")))
    sha = F.sha1(F.concat(F.lit("commit-"), F.col("pr_id").cast("string")))
    payload = F.to_json(F.struct(sha.alias("sha"), gh.alias("author"), F.struct(sig.alias("author")).alias("commit")))
    recv = _plus_seconds("merged_at", 60)
    return _env(m, "github", F.concat(F.lit("commit:"), sha), "commit.snapshot", recv, payload)


def push_envelopes(prs: DataFrame) -> DataFrame:
    """A push for every 11th merged PR: the author's commit plus a bot commit."""
    m = prs.filter(F.col("merged_at").isNotNull() & (F.col("pr_id") % 11 == 0))
    n = F.regexp_extract("author", r"([0-9]+)$", 1)
    commits = F.array(
        F.struct(F.struct(F.concat(F.lit("Dev "), n).alias("name"),
                          F.concat(F.lit("dev"), n, F.lit("@acme.io")).alias("email")).alias("author")),
        F.struct(F.struct(F.lit("dependabot[bot]").alias("name"),
                          F.lit("49699333+dependabot[bot]@users.noreply.github.com").alias("email")).alias("author")))
    payload = F.to_json(F.struct(F.concat(F.lit("refs/heads/main")).alias("ref"), commits.alias("commits")))
    recv = _plus_seconds("merged_at", 120)
    return _env(m, "github", F.concat(F.lit("push:"), F.col("pr_id").cast("string")), "push", recv, payload)


TEAM_SNAPSHOT_AT = 1703980800  # 2023-12-31T00:00:00Z, before any other event


def team_envelopes(team_repo: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """Team snapshots as the GitHub team API pages them: page 0 lists the
    members (users pinned to the team) and no repositories; pages 1-4 list the
    repositories (split by repo number % 4) and no members. Received before
    every other event."""
    num = F.regexp_extract("repo", r"([0-9]+)$", 1).cast("long")
    pages = team_repo.select("team_id", "repo", (num % 4 + 1).alias("page"))
    per_page = pages.groupBy("team_id", "page").agg(F.array_sort(F.collect_list("repo")).alias("repos"))
    mem = users.filter(F.col("team_id").isNotNull()).select(
        "team_id", F.struct(user_id("github_login", 1_000_000).cast("string").alias("id"),
                            F.col("github_login").alias("login")).alias("m"))
    members = mem.groupBy("team_id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    names = teams.select(F.col("id").alias("team_id"), "name")
    member_pages = names.join(members, "team_id", "left").select(
        "team_id", "name", F.lit(0).cast("long").alias("page"), F.lit(None).cast("array<string>").alias("repos"),
        F.coalesce(F.col("members"), F.array().cast(members.schema["members"].dataType)).alias("members"))
    repo_pages = per_page.join(names, "team_id", "inner").select(
        "team_id", "name", "page", "repos", F.lit(None).cast(members.schema["members"].dataType).alias("members"))
    j = member_pages.unionByName(repo_pages)
    payload = F.to_json(F.struct(
        F.col("team_id").alias("id"), F.col("name"), F.col("team_id").alias("slug"),
        F.transform("repos", lambda r: F.struct(r.alias("full_name"))).alias("repositories"),
        F.col("members")))
    recv = F.timestamp_seconds(F.lit(TEAM_SNAPSHOT_AT) + F.col("page"))
    return _env(j, "github", F.concat(F.lit("team:"), F.col("team_id"), F.lit(":"), F.col("page").cast("string")),
                "team.snapshot", recv, payload)


def with_redeliveries(env: DataFrame) -> DataFrame:
    """Every 7th envelope (by arrival number) arrives twice; the copy is
    received an hour later. One pass: each envelope explodes into itself and,
    when redelivered, its copy."""
    seq = F.col("seq")
    orig = F.struct(F.col("received_at").alias("received_at"), seq.alias("seq"))
    copy = F.struct(_plus_seconds("received_at", 3600).alias("received_at"),
                    ((seq / 4).cast("long") * 4 + F.lit(3600 * 1_000_000 * 4) + 2).alias("seq"))
    versions = F.when(F.pmod(seq, F.lit(7)) == 0, F.array(orig, copy)).otherwise(F.array(orig))
    return env.select("source", "source_id", "event_type", "connector_version", "payload",
                      F.explode(versions).alias("_d")).select(
        "source", "source_id", "event_type", "_d.received_at", "connector_version", "payload", "_d.seq")


def raw_envelopes(runs, prs, reviews, issues, usage, team_repo, teams, users) -> DataFrame:
    """All envelopes, redeliveries included."""
    env = (run_envelopes(runs).unionByName(jenkins_envelopes(runs)).unionByName(pr_envelopes(prs))
           .unionByName(review_envelopes(reviews)).unionByName(issue_envelopes(issues))
           .unionByName(usage_envelopes(usage)).unionByName(commit_envelopes(prs))
           .unionByName(push_envelopes(prs)).unionByName(team_envelopes(team_repo, teams, users)))
    return with_redeliveries(env)
