"""Landed vendor files built from the domain views, read back through the
source readers (S1-S11). The "API pages" hold at most ``PAGE`` records each,
as the vendor APIs page them."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources.sinks import FILE_RECORDS
from .raw_events import iso, user_id

PAGE = 100


def _pages(df: DataFrame, page_of: Column, item: Column, wrap=None, extra: list[str] | None = None) -> DataFrame:
    """One JSON page per ``page_of``; its elements come in the order of their first field."""
    keys = [page_of.alias("page")] + [F.col(c) for c in (extra or [])]
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.to_json(wrap(F.col("items")) if wrap else F.col("items"))
    return g.select(*(extra or []), "page", body.alias("body"))


def pr_pages(prs: DataFrame) -> DataFrame:
    item = F.struct(F.col("pr_id").alias("id"), "number", "title", "state", "html_url",
                    iso("created_at").alias("created_at"), iso("last_received_at").alias("updated_at"),
                    iso("merged_at").alias("merged_at"),
                    F.struct(user_id("author", 1_000_000).alias("id"), F.col("author").alias("login")).alias("user"),
                    F.struct(F.struct(F.col("repo").alias("full_name")).alias("repo")).alias("base"))
    return _pages(prs, F.floor(F.col("pr_id") / PAGE), item)


def review_pages(reviews: DataFrame) -> DataFrame:
    pending = (F.col("pr_number") % 13 == 0) & (F.col("state") == "COMMENTED")
    item = F.struct(F.col("review_id").alias("id"),
                    F.concat(F.lit("https://api.github.com/repos/"), F.col("repo"), F.lit("/pulls/"),
                             F.col("pr_number").cast("string")).alias("pull_request_url"),
                    F.when(pending, F.lit("PENDING")).otherwise(F.col("state")).alias("state"),
                    F.when(~pending, iso("submitted_at")).alias("submitted_at"),
                    F.struct(user_id("reviewer_login", 2_000_000).alias("id"), F.col("reviewer_login").alias("login"))
                    .alias("user"))
    return _pages(reviews, F.floor(F.col("pr_number") / PAGE), item)


def commit_pages(prs: DataFrame) -> DataFrame:
    m = prs.filter(F.col("merged_at").isNotNull())
    n = F.regexp_extract("author", r"([0-9]+)$", 1)
    item = F.struct(F.md5(F.concat(F.lit("commit-"), F.col("pr_id").cast("string"))).alias("sha"),
                    F.struct(user_id("author", 1_000_000).alias("id"), F.col("author").alias("login")).alias("author"),
                    F.struct(F.struct(F.concat(F.lit("Dev "), n).alias("name"),
                                      F.concat(F.lit("dev"), n, F.lit("@acme.io")).alias("email")).alias("author"))
                    .alias("commit"))
    return _pages(m, F.floor(F.col("pr_id") / PAGE), item)


def run_pages(runs: DataFrame) -> DataFrame:
    rid = F.col("run_id").cast("long")
    item = F.struct(rid.alias("id"), "name", "conclusion", iso("ts").alias("updated_at"),
                    F.struct(F.col("repo").alias("full_name")).alias("repository"))
    return _pages(runs, F.floor(rid / PAGE), item,
                  wrap=lambda items: F.struct(F.size(items).cast("long").alias("total_count"), items.alias("workflow_runs")))


def issue_pages(issues: DataFrame) -> DataFrame:
    k = F.col("issue_id").cast("long")
    jira = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"
    fields = F.struct(F.struct(F.col("project_key").alias("key")).alias("project"),
                      F.struct(F.col("issue_type").alias("name")).alias("issuetype"),
                      F.struct(F.col("status").alias("name")).alias("status"), "summary",
                      F.date_format("created_at", jira).alias("created"),
                      F.date_format("resolved_at", jira).alias("resolutiondate"),
                      F.when(k % 17 != 0, F.date_format("last_received_at", jira)).alias("updated"))
    item = F.struct(F.col("issue_key").alias("key"), F.col("issue_id").alias("id"), fields.alias("fields"))
    return _pages(issues, F.floor(k / 50), item, wrap=lambda items: F.struct(items.alias("issues")))


def build_pages(runs: DataFrame) -> DataFrame:
    rid = F.col("run_id").cast("long")
    b = runs.filter((F.col("name") == "CI tests") & (rid % 13 == 0)).withColumn(
        "job_name", F.concat(F.lit("build-"), F.regexp_extract("repo", r"([^/]+)$", 1)))
    item = F.struct(rid.alias("number"),
                    F.when(F.col("conclusion") == "success", "SUCCESS").when(F.col("conclusion") == "failure", "FAILURE")
                    .alias("result"), (F.unix_micros("ts") / 1000).cast("long").alias("timestamp"),
                    F.array(F.struct(F.lit("hudson.plugins.git.util.BuildData").alias("_class"),
                                     F.array(F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit(".git")))
                                     .alias("remoteUrls"))).alias("actions"))
    # one job after the other: job number in the upper bits of the page number
    job = F.regexp_extract("repo", r"([0-9]+)$", 1).cast("long")
    return _pages(b, F.shiftleft(job, 32) + F.floor(rid / (PAGE * 13)), item, wrap=lambda items: F.struct(items.alias("builds")),
                  extra=["job_name"])


def keys(env: DataFrame, *paths: str) -> DataFrame:
    """What identifies an envelope, its place in the load, and the payload's values at
    ``paths`` joined by ``|`` (absent ones left out)."""
    detail = F.concat_ws("|", *[F.get_json_object("payload", f"$.{p}") for p in paths])
    place = F.col("seq") - F.shiftleft(F.unix_millis("received_at"), R.PLACE_BITS)
    return env.select("source", "source_id", "event_type", place.alias("place"), detail.alias("detail"))


# What each kind of payload is compared by, in the order of the SQL twins.
PR_DETAIL = ("id", "title", "state", "user.login", "base.repo.full_name")
REVIEW_DETAIL = ("id", "state", "user.login", "pull_request_url")
COMMIT_DETAIL = ("sha", "author.login", "commit.author.email")
RUN_DETAIL = ("id", "name", "conclusion", "repository.full_name")
ISSUE_DETAIL = ("key", "fields.summary", "fields.status.name", "fields.issuetype.name")
BUILD_DETAIL = ("job_name", "number", "result")
REPORT_DETAIL = ("date", "actor.email_address", "terminal_type", "core_metrics.num_sessions")
SEAT_DETAIL = ("user_login", "day", "totals_by_cli.session_count")


def landed_usage_report(spark, usage: DataFrame, folder: str, received_at: dt.datetime) -> DataFrame:
    """Write the metered tool's usage as one report document per day (every
    5th record lacks the actor) and read it back (S1)."""
    cc = usage.filter(F.col("source") == "claude_code")
    rec = F.struct(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("date"),
                   F.when(F.col("sessions") % 5 != 0, F.struct(F.col("actor_key").alias("email_address"))).alias("actor"),
                   F.lit("vscode").alias("terminal_type"),
                   F.struct(F.col("sessions").cast("int").alias("num_sessions")).alias("core_metrics"))
    # One report document per (day, actor shard): a report never holds more
    # than a shard of one day's actors.
    shard = F.pmod(F.crc32(F.col("actor_key")), F.lit(8)).alias("b")
    docs = cc.groupBy(F.date_format("day", "yyyy-MM-dd").alias("d"), shard).agg(F.collect_list(rec).alias("data"))
    docs.repartition("d", "b").write.mode("overwrite").partitionBy("d", "b").json(folder)
    good, bad = R.read_usage_report(spark, folder, received_at)
    return keys(good, *REPORT_DETAIL).drop("place")


def landed_usage_ndjson(spark, usage: DataFrame, folder: str, received_at: dt.datetime) -> DataFrame:
    """Write the seat tool's usage as NDJSON with junk lines mixed in and read
    it back (S2)."""
    cp = usage.filter(F.col("source") == "copilot")
    line = F.to_json(F.struct(F.col("actor_key").alias("user_login"), F.date_format("day", "yyyy-MM-dd").alias("day"),
                              F.struct(F.col("sessions").cast("int").alias("session_count")).alias("totals_by_cli")))
    junk = (F.when(F.col("sessions") % 7 == 0, F.lit("{not json"))
            .when(F.col("sessions") % 7 == 1, F.lit("   "))
            .when(F.col("sessions") % 7 == 2, F.lit('{"user_login": null, "day": "2024-01-01"}')))
    lines = cp.select(line.alias("value")).unionByName(cp.select(junk.alias("value")).filter(F.col("value").isNotNull()))
    lines.write.mode("overwrite").text(folder)
    good, bad = R.read_usage_ndjson(spark, folder, received_at)
    return keys(good, *SEAT_DETAIL).drop("place")


def quarantined_usage_lines(spark, usage: DataFrame, folder: str, quarantine: str, received_at: dt.datetime) -> DataFrame:
    """K4 behind S2: the NDJSON lines the reader rejects, kept with a reason."""
    from ..sources.sinks import write_quarantine
    landed_usage_ndjson(spark, usage, folder, received_at)
    _, bad = R.read_usage_ndjson(spark, folder, received_at)
    write_quarantine(bad, "not a usage record", quarantine)
    return spark.read.parquet(quarantine).select("record", "reason")


def landed_envelopes(spark, env: DataFrame, folder: str) -> DataFrame:
    """Write envelopes as JSON files, every 101st arrival missing its
    ``source_id``, and read them back through the typed scan (S3)."""
    out = env.select("source", F.when(F.col("seq") % 101 != 0, F.col("source_id")).alias("source_id"), "event_type",
                     "received_at", "connector_version", "payload")
    out.write.mode("overwrite").options(compression="gzip", maxRecordsPerFile=FILE_RECORDS).json(folder)
    good, bad = R.read_envelopes(spark, folder)
    return (good.groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("events"))
            .unionByName(bad.groupBy(F.lit("quarantine").alias("source"), F.col("reason").alias("event_type"))
                         .agg(F.count(F.lit(1)).alias("events"))))


def team_snapshot_stats(env: DataFrame) -> DataFrame:
    p = F.from_json("payload", "id string, repositories array<struct<full_name:string>>, members array<struct<id:string>>")
    return env.select("source_id", F.size(p["repositories"]).cast("long").alias("repos"),
                      F.size(p["members"]).cast("long").alias("members"))


def webhook_bodies(issues: DataFrame, received_at: dt.datetime) -> DataFrame:
    k = F.col("issue_id").cast("long")
    et = F.when(k % 23 == 0, F.lit("")).otherwise(F.lit("jira:issue_updated"))
    body = F.concat(F.lit('{"webhookEvent":"'), et, F.lit('","issue":{"key":"'), F.col("issue_key"), F.lit('"}}'))
    return issues.select(body.alias("body"), F.lit(received_at).cast("timestamp").alias("received_at"))
