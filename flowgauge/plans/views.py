"""Domain tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables plus an ``events`` stream. These builders map
them onto the delivery domain (workflow runs, pull requests, reviews, teams,
issues, AI usage) with plain integer arithmetic, so that the same rows can be
rebuilt in any SQL engine (see :mod:`flowgauge.plans.oracle`). Each builder only
reads the columns it needs, so the parquet scan is pruned.

Mapping rules (fixed; the SQL twins must agree):

* runs    <- events: repo ``acme/repo-{user_id}``, run_id = event_id, name by
  event_type (purchase: "Deploy production", signup: "Release", error:
  "Hotfix production", click: "Rollback", other: "CI tests"), conclusion by
  event_id % 10 (0 failure, 1 null, else success).
* prs     <- orders: repo ``acme/repo-{o_custkey % 150}``, pr_id = number =
  o_orderkey, title by o_orderkey % 4, open iff o_orderstatus = 'O',
  ai_assisted iff priority '1-URGENT', created 2024-01-01 + (k*37 % 40320) min,
  merged (closed only) created + (k*13 % 5760 + 60) min.
* reviews <- lineitem joined to prs on the order key.
* team_repo <- distinct event users: ``team-{u % 5}`` unless u % 11 = 0, plus
  ``team-5`` when u % 7 = 0.
* issues  <- part: ``PROJ-{p_partkey}``, Bug iff p_size % 4 = 0, reopened iff
  p_size % 9 = 0.
* ai_usage <- events grouped by (tool, user, day), tool by event_id % 2; the
  metered tool's cost is the sum of ``value``, the seat tool's is the seat price
  spread over 30 days.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import params as P
from ..sources.tables import read_table

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
PR_REPOS = 150
ISSUE_KEYS = 2500


def _ts(c: str) -> Column:
    """Driver parquet stores naive timestamps; read them as UTC instants."""
    return F.col(c).cast("timestamp")


def _minutes_after_2024(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + minutes.cast("long") * 60)


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def runs(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    ev = read_table(spark, base, "events", "event_id", "user_id", "event_type", "ts")
    et = F.col("event_type")
    name = (F.when(et == "purchase", "Deploy production").when(et == "signup", "Release")
            .when(et == "error", "Hotfix production").when(et == "click", "Rollback")
            .otherwise("CI tests"))
    m = F.col("event_id") % 10
    conclusion = F.when(m == 0, F.lit("failure")).when(m == 1, F.lit(None).cast("string")).otherwise("success")
    return ev.select(
        F.concat(F.lit("acme/repo-"), _s("user_id")).alias("repo"),
        _s("event_id").alias("run_id"),
        name.alias("name"),
        conclusion.alias("conclusion"),
        _ts("ts").alias("ts"),
        _ts("ts").alias("last_received_at"),
    )


def prs(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    o = read_table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    key = F.concat(F.lit("PROJ-"), _s(k % ISSUE_KEYS))
    title = (F.when(k % 4 == 0, F.concat(key, F.lit(" fix")))
             .when(k % 4 == 1, F.concat(F.lit("UTF-8 "), key))
             .when(k % 4 == 2, F.lit("Refactor build scripts"))
             .otherwise(F.lit("Update docs")))
    ai = F.col("o_orderpriority") == "1-URGENT"
    is_open = F.col("o_orderstatus") == "O"
    created = _minutes_after_2024(k * 37 % 40320)
    merged = F.when(~is_open, F.timestamp_seconds(
        F.unix_seconds(created) + ((k * 13 % 5760) + 60) * 60))
    repo = F.concat(F.lit("acme/repo-"), _s(F.col("o_custkey") % PR_REPOS))
    return o.select(
        repo.alias("repo"),
        k.alias("pr_id"),
        k.alias("number"),
        title.alias("title"),
        F.concat(F.lit("dev-"), _s("o_custkey")).alias("author"),
        F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/"), _s(k)).alias("html_url"),
        F.when(is_open, "open").otherwise("closed").alias("state"),
        F.array(F.concat(F.lit("rev-"), _s(F.col("o_custkey") % 10))).alias("requested_reviewers"),
        created.alias("created_at"),
        merged.alias("merged_at"),
        ai.alias("ai_assisted"),
        F.coalesce(merged, created).alias("last_received_at"),
    )


def reviews(spark: SparkSession, base: str, pr_df: DataFrame | None = None) -> DataFrame:
    prepare(spark)
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_suppkey", "l_returnflag", "l_quantity")
    p = (pr_df if pr_df is not None else prs(spark, base)).select("repo", "number", "created_at")
    j = li.join(p, li.l_orderkey == p.number, "inner")
    rf = F.col("l_returnflag")
    state = F.when(rf == "A", "APPROVED").when(rf == "R", "CHANGES_REQUESTED").otherwise("COMMENTED")
    submitted = F.timestamp_seconds(F.unix_seconds("created_at") + F.col("l_quantity").cast("long") * 3600)
    return j.select(
        F.col("repo"),
        F.col("l_orderkey").alias("pr_number"),
        F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"),
                    _s(F.col("l_quantity").cast("long"))).alias("review_id"),
        F.concat(F.lit("rev-"), _s("l_suppkey")).alias("reviewer_login"),
        state.alias("state"),
        submitted.alias("submitted_at"),
        submitted.alias("last_received_at"),
    )


def pr_commits(spark: SparkSession, base: str, pr_df: DataFrame | None = None) -> DataFrame:
    """The commit list of each pull request as it stood last: one commit per line
    item, every 10th supplier's discarded by a force-push, some written after the
    opening, some carrying dates 100 days old."""
    prepare(spark)
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").filter(F.col("l_suppkey") % 10 != 0)
    p = (pr_df if pr_df is not None else prs(spark, base)).select("repo", "number", "created_at")
    back = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 4000 - 200 + F.when(F.col("l_partkey") % 97 == 0, 144000).otherwise(0)
    authored = F.timestamp_seconds(F.unix_seconds("created_at") - back.cast("long") * 60)
    sha = F.sha1(F.concat_ws("-", F.lit("commit"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey")))
    commit = F.struct(sha.alias("sha"), authored.alias("authored_at"))
    return li.join(p, li.l_orderkey == p.number, "inner").groupBy("repo", F.col("number").alias("pr_number")).agg(F.collect_list(commit).alias("commits"))


def transitions(spark: SparkSession, base: str) -> DataFrame:
    """Status changes of the issues: taken up (all but every 5th size), done, and
    taken up again where the issue was reopened."""
    prepare(spark)
    part = read_table(spark, base, "part", "p_partkey", "p_size")
    k, z = F.col("p_partkey"), F.col("p_size")
    created = (k * 11 % 40320).cast("long")
    change = lambda to, hours: F.struct(F.lit(to).alias("to_status"), _minutes_after_2024(created + hours * 60).alias("at"))
    rows = F.array_compact(F.array(F.when(z % 5 != 0, change("In Progress", k % 7)), change("Done", F.lit(30)),
                                   F.when(z % 9 == 0, change("In Progress", F.lit(100)))))
    return part.select(F.concat(F.lit("PROJ-"), _s("p_partkey")).alias("issue_key"), F.inline(rows))


def commit_events(spark: SparkSession, base: str, pr_df: DataFrame | None = None) -> DataFrame:
    """Push and commit envelopes: one commit per line item, the first four of a pull request in its
    push (sent twice for every 5th), those from the third on as snapshots too. The part number
    decides what the message credits."""
    prepare(spark)
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    p = (pr_df if pr_df is not None else prs(spark, base)).select("repo", "number", "created_at")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    authored = F.timestamp_seconds(F.unix_seconds("created_at") - ((k * 7 + n * 13) % 4000 - 200).cast("long") * 60)
    texts = ["Fix parser\n\nCo-authored-by: Claude <bot@example.com>",
             "Fix parser\n\nLonger text.\n\nSigned-off-by: Dev <d@acme.io>\nCo-Authored-By: GitHub Copilot <bot@example.com>",
             "Tidy up\n\nGenerated with Cursor", "Docs\n\nExplain Co-authored-by: Claude trailers\nin prose", "Co-authored-by: Claude"]
    message = F.coalesce(F.get(F.array(*[F.lit(t) for t in texts]), (k % 8).cast("int")), F.lit("Routine change"))
    stamp = F.date_format(authored, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = li.join(p, li.l_orderkey == p.number).select(
        "repo", "number", "created_at", n.alias("n"), F.sha1(F.concat_ws("-", F.lit("commit"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"))).alias("sha"),
        message.alias("message"), stamp.alias("stamp"))
    pushed = F.struct(F.col("sha").alias("id"), "message", F.col("stamp").alias("timestamp"))
    pushes = rows.filter("n <= 4").groupBy("repo", "number", "created_at").agg(F.collect_list(pushed).alias("commits")).select(
        F.lit("push").alias("event_type"), F.to_json(F.struct(F.struct(F.col("repo").alias("full_name")).alias("repository"), "commits")).alias("payload"),
        "created_at", F.explode(F.sequence(F.lit(0), (F.col("number") % 5 == 0).cast("int"))).alias("tag"), "number")
    body = F.struct("sha", F.concat(F.lit("https://api.github.com/repos/"), "repo", F.lit("/commits/"), "sha").alias("url"),
                    F.struct("message", F.struct(F.col("stamp").alias("date")).alias("author")).alias("commit"))
    snaps = rows.filter("n >= 3").select(F.lit("commit.snapshot").alias("event_type"), F.to_json(body).alias("payload"), "created_at", F.lit(2).alias("tag"), "number")
    return pushes.unionByName(snaps).select("event_type", "payload", F.col("created_at").alias("received_at"), (F.col("number") * 4 + F.col("tag")).alias("seq"))


def size_events(spark: SparkSession, base: str, pr_df: DataFrame | None = None) -> DataFrame:
    """Two versions of every pull request that has line items: half of the additions when
    opened, all lines some hours later; every second one in a webhook body."""
    prepare(spark)
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_quantity", "l_partkey")
    p = (pr_df if pr_df is not None else prs(spark, base)).select("repo", "number", "created_at")
    k = F.col("number")
    rows = li.join(p, li.l_orderkey == p.number).groupBy("repo", "number", "created_at").agg(
        (F.sum("l_quantity").cast("long") * (k % 5 + 1)).alias("adds"), F.sum(F.col("l_partkey") % 50).cast("long").alias("dels"))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def version(adds: Column, dels: Column, at: Column, tag: int) -> Column:
        inner = F.struct(k.alias("number"), adds.alias("additions"), dels.alias("deletions"), stamp.alias("created_at"),
                         F.struct(F.struct(F.col("repo").alias("full_name")).alias("repo")).alias("base"))
        payload = F.when(k % 2 == 0, F.to_json(F.struct(inner.alias("pull_request")))).otherwise(F.to_json(inner))
        return F.struct(payload.alias("payload"), at.alias("received_at"), (k * 2 + tag).alias("seq"))

    later = F.timestamp_seconds(F.unix_seconds("created_at") + (k % 48 + 1) * 3600)
    both = F.array(version(F.floor(F.col("adds") / 2), F.lit(0).cast("long"), F.col("created_at"), 0), version(F.col("adds"), F.col("dels"), later, 1))
    return rows.select(F.inline(both))


def flag_limits(spark: SparkSession, base: str) -> DataFrame:
    """Limits that teams set for themselves, from the first six nations."""
    n = read_table(spark, base, "nation", "n_nationkey").filter("n_nationkey < 6")
    k = F.col("n_nationkey").cast("long")
    limit = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("limit"))
    return n.select(F.concat(F.lit("team-"), _s("n_nationkey")).alias("team_id"),
                    F.inline(F.array_compact(F.array(F.when(k % 2 == 0, limit("age", 24 * (k + 1))), F.when(k % 3 == 0, limit("size", 100 + 50 * k))))))


def goals(spark: SparkSession, base: str) -> DataFrame:
    """One goal per nation: a metric, a scope, its time and the values it goes from and to."""
    k = F.col("n_nationkey").cast("int")
    scope = F.when(k % 3 == 0, "*").when(k % 3 == 1, F.concat(F.lit("team-"), _s(k % 6))).otherwise(F.concat(F.lit("acme/repo-"), _s("n_nationkey")))
    return read_table(spark, base, "nation", "n_nationkey").select(
        k.cast("long").alias("goal_id"), F.get(F.array(*[F.lit(m) for m in P.GOAL_METRICS]), k % len(P.GOAL_METRICS)).alias("metric_key"),
        F.when(k % 3 == 0, "org").when(k % 3 == 1, "team").otherwise("repo").alias("scope_type"), scope.alias("scope_id"),
        F.date_add(F.lit("2024-01-10").cast("date"), k).alias("start_day"), F.date_add(F.lit("2024-01-30").cast("date"), 2 * k).alias("end_day"),
        F.lit(10.0).alias("start_value"), F.when(k % 7 == 0, 10.0).when(k % 2 == 0, 5.0).otherwise(60.0).alias("target_value"))


def team_repo(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    u = read_table(spark, base, "events", "user_id").distinct()
    uid = F.col("user_id")
    teams = F.array_compact(F.array(
        F.when(uid % 11 != 0, F.concat(F.lit("team-"), _s(uid % 5))),
        F.when(uid % 7 == 0, F.lit("team-5"))))
    return u.select(F.explode(teams).alias("team_id"), F.concat(F.lit("acme/repo-"), _s(uid)).alias("repo"))


def team_name(team_id: Column) -> Column:
    return F.when(team_id == "team-5", F.lit("Platform")).otherwise(
        F.concat(F.lit("Team "), F.substring(team_id, 6, 10)))


def teams(spark: SparkSession, base: str, tr: DataFrame | None = None) -> DataFrame:
    tr = tr if tr is not None else team_repo(spark, base)
    ids = tr.select("team_id").distinct()
    return ids.select(
        F.col("team_id").alias("id"),
        team_name(F.col("team_id")).alias("name"),
        F.lit("github").alias("source"),
        F.col("team_id").alias("source_id"),
    )


def issues(spark: SparkSession, base: str) -> DataFrame:
    prepare(spark)
    p = read_table(spark, base, "part", "p_partkey", "p_name", "p_size")
    size = F.col("p_size")
    created = _minutes_after_2024(F.col("p_partkey") * 11 % 40320)
    done = size % 3 == 0
    return p.select(
        F.concat(F.lit("PROJ-"), _s("p_partkey")).alias("issue_key"),
        _s("p_partkey").alias("issue_id"),
        F.lit("PROJ").alias("project_key"),
        F.when(size % 4 == 0, "Bug").otherwise("Story").alias("issue_type"),
        F.when(done, "Done").otherwise("In Progress").alias("status"),
        F.col("p_name").alias("summary"),
        F.concat(F.lit("Dev "), _s(F.col("p_partkey") % 40)).alias("assignee"),
        created.alias("created_at"),
        F.when(done, F.timestamp_seconds(F.unix_seconds(created) + 86400)).alias("resolved_at"),
        (size % 9 == 0).alias("reopened"),
        F.timestamp_seconds(F.unix_seconds(created) + 3600).alias("last_received_at"),
    )


def ai_usage(spark: SparkSession, base: str) -> DataFrame:
    """Per (tool, actor, UTC day) usage. Money is summed as DECIMAL."""
    prepare(spark)
    ev = read_table(spark, base, "events", "event_id", "user_id", "event_type", "ts", "value")
    metered = F.col("event_id") % 2 == 0
    src = F.when(metered, "claude_code").otherwise("copilot")
    actor = F.when(metered, F.concat(F.lit("dev"), _s("user_id"), F.lit("@acme.io"))).otherwise(
        F.concat(F.lit("dev-"), _s("user_id")))
    pre = ev.select(
        src.alias("source"), actor.alias("actor_key"), F.to_date(_ts("ts")).alias("day"),
        F.col("value").cast("decimal(18,2)").alias("cost"),
        F.when(metered & (F.col("event_type") == "purchase"), 1).otherwise(0).alias("pr"),
        (F.col("event_type") == "click").cast("int").alias("acc"),
        (F.col("event_type") == "error").cast("int").alias("rej"),
        (F.col("value") * 100).cast("long").alias("tok"),
        _ts("ts").alias("ts"),
    )
    g = pre.groupBy("source", "actor_key", "day").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("cost").cast("decimal(18,2)").alias("cost_usd"),
        F.sum("pr").alias("_prs"),
        F.sum("tok").alias("tokens_input"),
        F.sum("acc").alias("accepted_suggestions"),
        F.sum("rej").alias("rejected_suggestions"),
        F.max("ts").alias("last_received_at"),
    )
    # The seat-priced tool has no per-use cost: its monthly seat price is spread
    # over active days (every row here has at least one session).
    seat_day = F.round(F.lit(P.COPILOT_MONTHLY_SEAT_USD).cast("decimal(10,2)") / 30, 2).cast("decimal(18,2)")
    cost = F.when(F.col("source") == "copilot", seat_day).otherwise(F.col("cost_usd"))
    return g.select(
        "source", "actor_key", "day", "sessions", cost.alias("cost_usd"),
        F.when(F.col("source") == "claude_code", F.col("_prs")).alias("prs"),
        "tokens_input",
        (F.col("tokens_input") / 4).cast("long").alias("tokens_output"),
        "accepted_suggestions", "rejected_suggestions", "last_received_at",
    )


def app_users(spark: SparkSession, base: str) -> DataFrame:
    """Dashboard users from ``customer``: every 50th customer is an admin, every
    7th a manager pinned to ``team-{c % 6}``, every 11th an engineering leader,
    every 13th finance (read-only), the rest individual contributors."""
    prepare(spark)
    c = read_table(spark, base, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey")
    role = (F.when(k % 50 == 0, "ADMIN").when(k % 7 == 0, "MANAGER").when(k % 11 == 0, "ENG_LEADER")
            .when(k % 13 == 0, "FINANCE_READONLY").otherwise("IC"))
    return c.select(
        _s(k).alias("id"),
        F.concat(F.lit("Dev"), _s(k), F.lit("@Acme.io")).alias("email"),
        F.col("c_name").alias("display_name"),
        role.alias("role"),
        F.when(k % 7 == 0, F.concat(F.lit("team-"), _s(k % 6))).alias("team_id"),
        F.concat(F.lit("dev-"), _s(k)).alias("github_login"),
    )


def audit_log(spark: SparkSession, base: str) -> DataFrame:
    """Admin audit trail from ``events``: each event is one recorded action."""
    prepare(spark)
    ev = read_table(spark, base, "events", "event_id", "user_id", "event_type", "ts")
    return ev.select(
        F.col("event_id").alias("id"),
        _ts("ts").alias("occurred_at"),
        F.concat(F.lit("dev"), _s("user_id"), F.lit("@acme.io")).alias("actor_email"),
        F.concat(F.lit("admin."), F.col("event_type")).alias("action"),
        F.concat(F.lit("acme/repo-"), _s("user_id")).alias("target"),
    )
