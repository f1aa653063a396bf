"""Sources (S1-S11): landed vendor files -> event envelopes.

Connectors land what the vendor APIs return (pages of JSON, usage exports,
webhook bodies) as files; these readers turn them into the common envelope
``(source, source_id, event_type, received_at, connector_version, payload,
seq)``. Everything is a DataFrame scan with an explicit schema; a page or a
report is exploded into one envelope per record, so no record list is ever
held by the driver. A payload is the record's own JSON text, whole. Records that
cannot be keyed and pages that cannot be read are returned separately, with
their text, for the quarantine sink.

Every record has its own arrival number ``seq``: the time of the load, then the
record's place in it (page, then place in the page; line; webhook body). The same
load read again gives the same numbers, so first arrivals, ties of latest states
and late events are decided alike on every run.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

CONNECTOR_VERSION = "1.0.0"
ENVELOPE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("connector_version", T.StringType()),
    T.StructField("payload", T.StringType()),
])
REQUIRED = [f.name for f in ENVELOPE.fields]


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


# Arrival numbers: time of the load in milliseconds, then the place of the record in
# it. A place that needs more bits runs on into the next millisecond's numbers.
PLACE_BITS = 22
# pages whose counts are added up by one task before the sums of all such runs are
PAGE_RUN_BITS = 12


def _running_starts(counted: DataFrame, order: list[str]) -> DataFrame:
    """``order + [_start]``: the sum of ``_n`` over the rows before. ``order`` begins
    with a non-negative long. Sums are run inside stretches of ``2 ** PAGE_RUN_BITS``
    numbers and over the stretches, so one task sorts stretches, never all rows."""
    within = Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.withColumn("_run", F.shiftright(order[0], PAGE_RUN_BITS))
    totals = runs.groupBy("_run").agg(F.sum("_n").alias("_n")).select(
        "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return runs.withColumn("_upto", F.sum("_n").over(within)).join(totals, "_run").select(
        *order, (F.col("_base") + F.col("_upto") - F.col("_n")).alias("_start"))


def envelope(df: DataFrame, source, source_id: Column, event_type, payload: Column,
             received_at: dt.datetime | Column) -> DataFrame:
    """Envelopes of ``df``, whose column ``place`` is the record's place in the load."""
    rec = _ts(received_at)
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        source_id.alias("source_id"),
        (F.lit(event_type) if isinstance(event_type, str) else event_type).alias("event_type"),
        rec.alias("received_at"), F.lit(CONNECTOR_VERSION).alias("connector_version"),
        payload.alias("payload"), (F.shiftleft(F.unix_millis(rec), PLACE_BITS) + F.col("place")).alias("seq"))


def _scan_text(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Rows of text with the place they were read from, as :func:`scan_envelopes` gives it."""
    return spark.read.text(path, wholetext=wholetext).select(
        "value", F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("landed_file"), F.col("_metadata.file_block_start").alias("landed_block"))


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed pages as ``(body, page)``: each file, or with ``lines`` each line, is one
    page; pages are numbered by landing time, file and line, so the page order is
    the order of the load."""
    scanned = _scan_text(spark, path, not lines).withColumn("seq", F.lit(None).cast("long"))
    return _numbered(scanned, F.lit(0)).select(F.col("value").alias("body"), F.col("seq").alias("page"))


# ---------------------------------------------------------------- S1 / S2 ----
USAGE_RECORD = ("date string, actor struct<email_address:string>, terminal_type string, "
                "core_metrics struct<num_sessions:int, lines_of_code:struct<added:int,removed:int>, "
                "commits_by_claude_code:int, pull_requests_by_claude_code:int>, "
                "model_breakdown array<struct<tokens:struct<input:bigint,output:bigint>, estimated_cost:struct<amount:double>>>, "
                "tool_actions map<string, struct<accepted:int,rejected:int>>")


def _elements(pages: DataFrame, schema: str, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per element of each page: ``record`` is the element's whole JSON
    text (the payload; nothing is cut to a schema), ``r`` the parsed side struct
    for keys and filters, ``place`` its place in the load. Second frame:
    pages that are no such document, with their text.

    Pages come in the order of their ``page`` number (a long; null first), then of a
    hash of the page with its other columns. A frame without that column is
    numbered as its rows are read, which only repeats for a plain scan of files.
    A page that comes twice gives its records the same numbers twice."""
    listed = F.from_json("body", f"struct<{field}:array<string>>" if field else "array<string>")
    keep = [c for c in pages.columns if c not in ("body", "page")]
    page = F.coalesce(F.col("page").cast("long") + 1, F.lit(0)) if "page" in pages.columns else F.monotonically_increasing_id()
    marked = pages.select(*keep, "body", page.alias("_page"), F.xxhash64("body", *keep).alias("_hash"))
    opened = marked.select("*", F.inline(F.array(F.struct((listed[field] if field else listed).alias("_list")))))
    bad = opened.filter(F.col("_list").isNull()).select(F.col("body").alias("record"), F.lit("unreadable page").alias("reason"))
    order = ["_page", "_hash"]
    counted = opened.filter(F.size("_list") > 0).groupBy(*order).agg(F.max(F.size("_list")).cast("long").alias("_n"))
    # pages meet their starts before they are opened into records
    opened = opened.filter(F.size("_list") > 0).join(_running_starts(counted, order), order)
    rows = opened.select(*keep, "_start", F.posexplode("_list").alias("position", "record"))
    rows = rows.select(*keep, "record", (F.col("_start") + F.col("position")).alias("place"))
    parsed = rows.select("*", F.inline(F.array(F.struct(F.from_json("record", schema).alias("r")))))
    return parsed, bad


def _split(rows: DataFrame, key: Column, bad: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and the bad pages together with the rows without one."""
    rows = rows.withColumn("_key", key)
    lost = rows.filter(F.col("_key").isNull()).select("record", F.lit(reason).alias("reason"))
    return rows.filter(F.col("_key").isNotNull()), bad.unionByName(lost)


def read_usage_report(spark: SparkSession, path: str, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Usage reports, one JSON document ``{"data": [...]}`` per file. One
    envelope per record with the record's whole text; records without an email
    or a date, and files that are no such document, are the second frame. A
    report file is one document, so it is parsed by one task; parallelism comes
    from many report files. Records are numbered by file and place in the file."""
    doc = read_pages(spark, path)
    rows, bad = _elements(doc, f"struct<{_fields(USAGE_RECORD)}>", "data")
    day = F.substring(F.col("r.date"), 1, 10)
    key = F.concat(F.lit("claude_code:"), F.col("r.actor.email_address"), F.lit(":"), day)
    rows, bad = _split(rows, key, bad, "no email or date")
    return envelope(rows, "claude_code", F.col("_key"), "usage.snapshot", F.col("record"), received_at), bad


SEAT_RECORD = ("user_login string, day string, loc_added_sum int, loc_deleted_sum int, code_acceptance_activity_count int, "
               "totals_by_cli struct<session_count:int, prompt_count:int, request_count:int, "
               "token_usage:struct<prompt_tokens_sum:bigint, output_tokens_sum:bigint>>, totals_by_ide array<struct<ide:string>>")


def read_usage_ndjson(spark: SparkSession, path: str, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Seat-tool usage as NDJSON (splittable, one record per line). Blank
    lines are skipped; lines that are not a JSON object with a login and a day
    are returned (with the line) for the quarantine sink. Records are numbered by
    landing time, file and line; blank and rejected lines keep their numbers."""
    scanned = _scan_text(spark, path).withColumn("seq", F.lit(None).cast("long"))
    lines = _numbered(scanned, F.lit(0)).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.col("seq").alias("place"), F.from_json("value", SEAT_RECORD).alias("r"),
                          F.try_parse_json("value").alias("_v"))
    ok = F.col("_v").isNotNull() & F.col("r.user_login").isNotNull() & F.col("r.day").isNotNull()
    good = envelope(parsed.filter(ok), "copilot",
                    F.concat(F.lit("copilot:"), F.col("r.user_login"), F.lit(":"), F.col("r.day")),
                    "usage.snapshot", F.col("value"), received_at)
    bad = parsed.filter(~ok).select(F.col("value").alias("record"))
    return good, bad


def _fields(ddl: str) -> str:
    from ..operators.extract import _ddl_to_struct_fields
    return _ddl_to_struct_fields(ddl)


# --------------------------------------------------------------------- S3 ----
# Arrival numbers of landed files: landing time in milliseconds, then the place of
# the row among all that landed then. A place that needs more bits runs on into the
# next millisecond's numbers, and later rows are numbered after it.
PLACE_BITS = 22
# monotonically_increasing_id: row of the task in the lower bits
ROW_BITS = 33
SPLIT = ["landed_at", "landed_file", "landed_block"]


def scan_envelopes(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json") -> DataFrame:
    """S3, first half: the typed scan of landed envelopes (batch or stream), with
    the broker's own arrival number ``seq`` where the files carry one, the time
    the file landed, and the text of a line that is no JSON (``record``)."""
    reader = spark.readStream if streaming else spark.read
    fields = [*ENVELOPE.fields, T.StructField("seq", T.LongType())]
    if fmt == "json":
        schema = T.StructType([*fields, T.StructField("record", T.StringType())])
        df = reader.schema(schema).option("columnNameOfCorruptRecord", "record").json(path)
    else:
        df = reader.schema(T.StructType(fields)).format(fmt).load(path).withColumn("record", F.lit(None).cast("string"))
    return df.select("*", F.col("_metadata.file_modification_time").alias("landed_at"),
                     F.col("_metadata.file_path").alias("landed_file"),
                     F.col("_metadata.file_block_start").alias("landed_block"))


def _numbered(good: DataFrame, at: Column | None = None) -> DataFrame:
    """Arrival numbers for rows without one, in the order of landing time, file, split of
    the file and row in the split. A number is the landing time in milliseconds, then
    the place among all that landed then; where a place needs more bits, later rows are
    numbered after it. ``at`` sets another start in milliseconds. Splits are counted
    first; only one row per split is put in order by a single task, and whether
    these rows are broadcast is left to their measured size."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    rows = good.withColumn("_row", row)
    splits = rows.filter(F.col("seq").isNull()).groupBy(*SPLIT).agg(
        F.min("_row").alias("_first"), (F.max("_row") - F.min("_row") + 1).alias("_n"))
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # each split starts at its landing time or behind its predecessor, whichever is later
    splits = splits.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    ahead = F.shiftleft(F.unix_millis("landed_at") if at is None else at.cast("long"), PLACE_BITS) - F.col("_before")
    splits = splits.withColumn("_start", F.col("_before") + F.max(ahead).over(order))
    joined = rows.join(splits.select(*SPLIT, "_start", "_first"), SPLIT, "left")
    seq = F.coalesce("seq", F.col("_start") + F.col("_row") - F.col("_first"))
    return joined.select(*[seq.alias("seq") if c == "seq" else F.col(c) for c in good.columns])


def split_envelopes(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3, second half: ``(good, bad)``. All six fields are required; ``bad`` has a
    reason for the quarantine. A good envelope without an arrival number gets one
    from its file's landing time and its place in the load, so a load keeps its order."""
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    reason = F.when(F.col("record").isNotNull(), F.lit("unreadable line")).when(lacks != "", F.concat(F.lit("missing: "), lacks))
    marked = scanned.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull())
    if not scanned.isStreaming:  # a stream is numbered batch by batch
        good = _numbered(good)
    return good.drop("reason", "record", *SPLIT), marked.filter(F.col("reason").isNotNull()).drop(*SPLIT)


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json"):
    """S3: typed envelope scan (batch or stream) as ``(good, bad)``."""
    return split_envelopes(scan_envelopes(spark, path, streaming, fmt))


# ---------------------------------------------------------------- S4 - S9 ----
# Side structs: only what keys and filters need; the payload is the element itself.
PR_SIDE = "struct<id:bigint, updated_at:string>"
REVIEW_SIDE = "struct<id:string, submitted_at:string>"
COMMIT_SIDE = "struct<sha:string>"
RUN_SIDE = "struct<id:bigint, updated_at:string>"
ISSUE_SIDE = "struct<id:string, fields:struct<updated:string>>"
BUILD_SIDE = "struct<number:bigint>"


def _versioned(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col("r.id").cast("string"), F.lit(":"), F.col("r.updated_at"))


def land_pull_requests(pages: DataFrame, since: dt.datetime, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """PR list pages -> envelopes for PRs updated at/after ``since``; second
    frame: unreadable pages and PRs without an id or an update time."""
    rows, bad = _elements(pages, PR_SIDE)
    rows, bad = _split(rows, _versioned("pr"), bad, "no id or update time")
    rows = rows.filter(C.iso_instant(F.col("r.updated_at")) >= F.lit(since).cast("timestamp"))
    return envelope(rows, "github", F.col("_key"), "pull_request.snapshot", F.col("record"), received_at), bad


def land_reviews(pages: DataFrame, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Review pages; pending drafts (no ``submitted_at``) are skipped."""
    rows, bad = _elements(pages, REVIEW_SIDE)
    rows, bad = _split(rows, F.concat(F.lit("review:"), F.col("r.id")), bad, "no id")
    rows = rows.filter(F.col("r.submitted_at").isNotNull())
    return envelope(rows, "github", F.col("_key"), "pull_request_review.snapshot", F.col("record"), received_at), bad


def land_commits(pages: DataFrame, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Commit pages."""
    rows, bad = _elements(pages, COMMIT_SIDE)
    rows, bad = _split(rows, F.concat(F.lit("commit:"), F.col("r.sha")), bad, "no sha")
    return envelope(rows, "github", F.col("_key"), "commit.snapshot", F.col("record"), received_at), bad


def land_workflow_runs(pages: DataFrame, since: dt.datetime, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Workflow-run pages (``workflow_runs[]``), updated at/after ``since``."""
    rows, bad = _elements(pages, RUN_SIDE, "workflow_runs")
    rows, bad = _split(rows, _versioned("workflow_run"), bad, "no id or update time")
    rows = rows.filter(C.iso_instant(F.col("r.updated_at")) >= F.lit(since).cast("timestamp"))
    return envelope(rows, "github", F.col("_key"), "workflow_run.snapshot", F.col("record"), received_at), bad


def land_issues(pages: DataFrame, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Jira search pages (``issues[]`` with changelog); issues without
    ``fields.updated`` are skipped."""
    rows, bad = _elements(pages, ISSUE_SIDE, "issues")
    lost = rows.filter(F.col("r.id").isNull()).select("record", F.lit("no id").alias("reason"))
    rows = rows.filter(F.col("r.id").isNotNull() & F.col("r.fields.updated").isNotNull())
    key = F.concat(F.lit("issue:"), F.col("r.id"), F.lit(":"), F.col("r.fields.updated"))
    return envelope(rows, "jira", key, "issue.snapshot", F.col("record"), received_at), bad.unionByName(lost)


def land_builds(pages: DataFrame, received_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Jenkins job pages (``builds[]``, job name beside the page); the job
    name is put in front of each build's own fields."""
    rows, bad = _elements(pages, BUILD_SIDE, "builds")
    key = F.concat(F.lit("jenkins:"), F.col("job_name"), F.lit(":"), F.col("r.number").cast("string"))
    rows, bad = _split(rows, key, bad, "no build number")
    name = F.regexp_replace(F.to_json(F.struct("job_name")), r"\}$", "")
    payload = F.concat(name, F.lit(","), F.substring("record", 2, 2**31 - 1))
    return envelope(rows, "jenkins", F.col("_key"), "build.snapshot", payload, received_at), bad


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``place`` each, in the order of a hash of ``_key`` and then of
    ``_key``; rows that repeat a key and its body share a place."""
    order = ["_hash", "_name", "_text"]
    named = rows.withColumns({
        "_hash": F.shiftrightunsigned(F.xxhash64("_key"), 64 - 2 * PAGE_RUN_BITS),
        "_name": F.coalesce("_key", F.lit("")), "_text": F.coalesce("_body", F.lit(""))})
    counted = named.select(*order).distinct().withColumn("_n", F.lit(1).cast("long"))
    return named.join(_running_starts(counted, order), order).select(*rows.columns, F.col("_start").alias("place"))


# -------------------------------------------------------------------- S10 ----
def assemble_team_snapshots(teams: DataFrame, repos: DataFrame, members: DataFrame, received_at: dt.datetime) -> DataFrame:
    """One snapshot per team (id, name, slug) with its repositories and
    members nested; repos without a full name and members without a login are
    dropped. The nested lists are bounded by one team's size (a dimension).
    Snapshots are numbered in the order of a hash of the team id."""
    rp = (repos.filter(F.col("full_name").isNotNull()).groupBy("team_id")
          .agg(F.array_sort(F.collect_list(F.struct("full_name"))).alias("repositories")))
    mb = (members.filter(F.col("login").isNotNull()).groupBy("team_id")
          .agg(F.array_sort(F.collect_list(F.struct("id", "login"))).alias("members")))
    j = teams.join(rp, F.col("id") == rp.team_id, "left").drop("team_id").join(
        mb, F.col("id") == mb.team_id, "left").drop("team_id")
    snap = F.struct("id", "name", "slug", F.coalesce("repositories", F.array()).alias("repositories"),
                    F.coalesce("members", F.array()).alias("members"))
    rows = j.select(F.concat(F.lit("team:"), F.col("id")).alias("_key"), F.to_json(snap).alias("_body"))
    return envelope(_placed(rows), "github", F.col("_key"), "team.snapshot", F.col("_body"), received_at)


# -------------------------------------------------------------------- S11 ----
# Bodies of one millisecond are told apart by their key's hash; this many bits are left
# for those that share its upper bits, enough for 100,000 bodies in a millisecond.
RANK_BITS = 4


def webhook_key(bodies: DataFrame, received_at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Webhook bodies without a delivery id are keyed by the SHA-256 of
    the raw body; the event type comes from ``webhookEvent`` and a blank one is
    rejected (second frame). A body's arrival number is its receive time, then
    its place in the order of the keys' hashes; a body delivered twice at one time
    keeps its number."""
    et = F.get_json_object("body", "$.webhookEvent")
    ok = F.length(F.trim(F.coalesce(et, F.lit("")))) > 0
    rec = F.col("received_at") if received_at is None else received_at
    rows = bodies.filter(ok).select(C.sha256_hex("body").alias("_key"), "body", et.alias("_type"), _ts(rec).alias("_at"))
    if received_at is None:
        low = F.shiftrightunsigned(F.xxhash64("_key"), 64 - PLACE_BITS + RANK_BITS)
        order = Window.partitionBy(F.unix_millis("_at"), "_low").orderBy("_key")
        rows = rows.withColumn("_low", low).withColumn("place", F.shiftleft("_low", RANK_BITS) + F.dense_rank().over(order) - 1)
    else:
        rows = _placed(rows.withColumnRenamed("body", "_body")).withColumnRenamed("_body", "body")
    good = envelope(rows, "jira", F.col("_key"), F.col("_type"), F.col("body"), F.col("_at"))
    bad = bodies.filter(~ok).withColumn("reason", F.lit("blank webhookEvent"))
    return good, bad
