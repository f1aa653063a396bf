"""Readers keep whole payloads and hand back what they cannot read or key; fixes of money, scope, order and mart."""
import datetime as dt
import json
import os
import tempfile

from flowgauge.operators import filters as FL
from flowgauge.operators import identity as I
from flowgauge.operators.extract import extract_usage_metered
from flowgauge.sources import readers as R
from flowgauge.sources import sinks as K

T0 = dt.datetime(2024, 1, 5)
SINCE = dt.datetime(2024, 1, 1)


def _pages(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_pull_request_pages(spark):
    whole = {"id": 5, "updated_at": "2024-01-02T00:00:00Z", "draft": True, "additions": 7, "user": {"email": None, "login": "x"}}
    page = json.dumps([whole, {"id": "abc", "updated_at": "2024-01-02T00:00:00Z"}, {"id": 6}, {"id": 7, "updated_at": "2023-01-02T00:00:00Z"}])
    good, bad = R.land_pull_requests(_pages(spark, page, "{not json", "[]"), SINCE, T0)
    rows = good.collect()
    assert [r.source_id for r in rows] == ["pr:5:2024-01-02T00:00:00Z"]
    assert json.loads(rows[0].payload) == whole
    lost = {(r.record, r.reason) for r in bad.collect()}
    assert ("{not json", "unreadable page") in lost and len(lost) == 3


def test_issue_run_build_commit_and_review_pages(spark):
    issue = {"id": "9", "fields": {"updated": "2024-01-02T00:00:00.000+0000", "reporter": {"accountId": "z"}}, "extra": [1, {"a": None}]}
    good, bad = R.land_issues(_pages(spark, json.dumps({"issues": [issue, {"id": "10", "fields": {}}, {"fields": {}}]}), "oops"), T0)
    assert [json.loads(r.payload) for r in good.collect()] == [issue]
    assert sorted(r.reason for r in bad.collect()) == ["no id", "unreadable page"]
    run = {"id": 4, "updated_at": "2024-01-03T00:00:00Z", "attempt": 2}
    good, bad = R.land_workflow_runs(_pages(spark, json.dumps({"workflow_runs": [run]}), json.dumps({"total": 0})), SINCE, T0)
    assert json.loads(good.head().payload) == run and bad.count() == 1
    builds = spark.createDataFrame([(json.dumps({"builds": [{"number": 3, "result": "SUCCESS", "culprits": []}, {"result": "X"}]}), 'job "a"')], "body string, job_name string")
    good, bad = R.land_builds(builds, T0)
    assert json.loads(good.head().payload) == {"job_name": 'job "a"', "number": 3, "result": "SUCCESS", "culprits": []}
    assert bad.count() == 1
    commit = {"sha": "f0", "commit": {"message": "whole text", "author": {"name": "n", "email": "e"}}}
    good, bad = R.land_commits(_pages(spark, json.dumps([commit, {}])), T0)
    assert json.loads(good.head().payload) == commit and bad.head().reason == "no sha"
    good, bad = R.land_reviews(_pages(spark, json.dumps([{"id": "1", "submitted_at": "t", "body": "b"}, {"id": "2"}])), T0)
    assert [json.loads(r.payload)["body"] for r in good.collect()] == ["b"] and bad.count() == 0


def test_usage_report_and_envelopes(spark):
    root = tempfile.mkdtemp(prefix="fg-read-", dir="/tmp")
    record = {"date": "2024-01-02", "actor": {"email_address": "a@b.c"}, "unknown": {"x": 1}}
    os.makedirs(f"{root}/usage")
    with open(f"{root}/usage/a.json", "w") as f:
        f.write(json.dumps({"data": [record, {"date": "2024-01-02"}]}, indent=1))
    with open(f"{root}/usage/b.json", "w") as f:
        f.write("{broken")
    good, bad = R.read_usage_report(spark, f"{root}/usage", T0)
    assert [json.loads(r.payload) for r in good.collect()] == [record]
    assert sorted(r.reason for r in bad.collect()) == ["no email or date", "unreadable page"]
    os.makedirs(f"{root}/env")
    with open(f"{root}/env/a.json", "w") as f:
        f.write(json.dumps({"source": "s", "source_id": "1", "event_type": "e", "received_at": "2024-01-01T00:00:00Z", "connector_version": "1", "payload": "{}"}) + "\n")
        f.write(json.dumps({"source": "s"}) + "\n{half a line\n")
    good, bad = R.read_envelopes(spark, f"{root}/env")
    assert good.count() == 1
    lost = {r.reason: r.record for r in bad.collect()}
    assert lost["unreadable line"] == "{half a line" and len(lost) == 2


def test_large_files_keep_their_order(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="fg-read-", dir="/tmp")
    row = {"source": "s", "event_type": "e", "received_at": "2024-01-01T00:00:00Z", "connector_version": "1", "payload": "{}"}
    for k in range(2):
        with open(f"{root}/{k}.json", "w") as f:
            f.writelines(json.dumps({**row, "source_id": str(10_000 * k + n)}) + "\n" for n in range(1000))
        os.utime(f"{root}/{k}.json", (1_700_000_000, 1_700_000_000))
    monkeypatch.setattr(R, "PLACE_BITS", 8)  # fewer than the rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        good, _ = R.read_envelopes(spark, root)
        assert good.rdd.getNumPartitions() > 4
        got = sorted((r.seq, int(r.source_id)) for r in good.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({n for n, _ in got}) == 2000
    assert [k for _, k in got] == [*range(1000), *range(10_000, 11_000)]


def test_small_amounts_are_summed_before_rounding(spark):
    entry = {"estimated_cost": {"amount": 0.004}, "tokens": {"input": 1, "output": 1}}
    payload = json.dumps({"date": "2024-01-02", "actor": {"email_address": "a@b.c"}, "model_breakdown": [entry] * 10})
    env = spark.createDataFrame([("claude_code", "1", "usage.snapshot", T0, "1", payload, 1)], "source string, source_id string, event_type string, received_at timestamp, connector_version string, payload string, seq long")
    assert float(extract_usage_metered(env).head().cost_usd) == 0.04


def test_order_inside_an_envelope_founds(spark):
    payload = json.dumps({"fields": {"assignee": {"accountId": "z9", "displayName": "Z", "emailAddress": "one@x.y"}, "reporter": {"accountId": "a1", "displayName": "A", "emailAddress": "one@x.y"}}})
    env = spark.createDataFrame([("jira", "issue.snapshot", payload, 1)], "source string, event_type string, payload string, seq long")
    contributors, aliases = I.resolve_identities(I.observe_identities(env))
    assert [r.contributor_id for r in contributors.collect()] == ["jira:z9"]
    assert {r.source_user_id for r in aliases.collect()} == {"z9", "a1"}


def test_scope_of_imported_and_manual_teams(spark):
    prs = spark.createDataFrame([("o/a",), ("o/b",)], "repo string")
    teams = spark.createDataFrame([("github:7", "o/a"), ("manual:core", "o/b")], "team_id string, repo string")
    assert [r.repo for r in FL.scope_repos(prs, "github:7", teams).collect()] == ["o/a"]
    assert [r.repo for r in FL.scope_repos(prs, "manual:core", teams).collect()] == ["o/b"]
    assert [r.repo for r in FL.scope_repos(prs, "o/b", teams).collect()] == ["o/b"]


def test_mart_drops_days_without_rows(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fg-mart-", dir="/tmp"), "mart")
    schema = "metric_key string, scope_type string, scope_id string, day date, value double, sample_size long"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    K.write_mart(spark.createDataFrame([("m", "repo", "r", d, 1.0, 1) for d in days], schema), path)
    K.write_mart(spark.createDataFrame([("m", "repo", "r", days[2], 2.0, 1)], schema), path, (days[1], days[2]))
    assert sorted((str(r.day), r.value) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1.0), ("2024-01-03", 2.0)]


def test_records_of_a_load_are_numbered(spark):
    """Place in the load: pages by number, then place in the page; unreadable and empty pages take none."""
    bodies = [(json.dumps([{"sha": f"{p}-{k}"} for k in range(3 + p % 2)]), p) for p in (9000, 7, 4099, 8, 4096)]
    pages = spark.createDataFrame([*bodies, ("oops", 8000), ("[]", 10)], "body string, page long").repartition(3)
    good, _ = R.land_commits(pages, T0)
    got = sorted((r.seq, r.source_id) for r in good.collect())
    start = got[0][0]
    assert start == int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) << R.PLACE_BITS
    assert got == [(start + n, f"commit:{p}-{k}") for n, (p, k) in
                   enumerate((p, k) for p in (7, 8, 4096, 4099, 9000) for k in range(3 + p % 2))]
    unnumbered, _ = R.land_commits(spark.createDataFrame([(b,) for b, _ in bodies], "body string"), T0)
    assert [r.source_id for r in unnumbered.orderBy("seq").collect()] == [
        f"commit:{p}-{k}" for p in (9000, 7, 4099, 8, 4096) for k in range(3 + p % 2)]
    later, _ = R.land_commits(pages, T0 + dt.timedelta(milliseconds=1))
    assert later.agg({"seq": "min"}).head()[0] > got[-1][0]
    empty, _ = R.land_commits(pages.limit(0), T0)
    assert empty.collect() == []


def test_report_and_line_files_are_numbered(spark):
    root = tempfile.mkdtemp(prefix="fg-read-", dir="/tmp")
    for n, name in enumerate("ba"):  # b lands first
        with open(f"{root}/{name}.json", "w") as f:
            f.write(json.dumps({"data": [{"date": "2024-01-02", "actor": {"email_address": f"{name}{k}"}} for k in range(12)]}))
        os.utime(f"{root}/{name}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    good, _ = R.read_usage_report(spark, root, T0)
    rows = good.orderBy("seq").collect()
    assert [r.source_id.split(":")[1] for r in rows] == [f"{f}{k}" for f in "ba" for k in range(12)]
    assert len({r.seq for r in rows}) == 24
    lines = tempfile.mkdtemp(prefix="fg-read-", dir="/tmp")
    with open(f"{lines}/x.json", "w") as f:
        f.writelines(json.dumps({"user_login": f"u{k}", "day": "2024-01-02"}) + ("\n\n{bad\n" if k % 9 == 0 else "\n") for k in range(900))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        good, _ = R.read_usage_ndjson(spark, lines, T0)
        assert [r.source_id.split(":")[1] for r in good.orderBy("seq").collect()] == [f"u{k}" for k in range(900)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_webhooks_and_team_snapshots_are_numbered(spark):
    body = '{"webhookEvent":"jira:issue_updated","n":%d}'
    at = [T0 + dt.timedelta(milliseconds=k // 1500) for k in range(3000)]
    bodies = spark.createDataFrame([(body % k, at[k]) for k in range(3000)] + [(body % 5, at[5])], "body string, received_at timestamp")
    good, _ = R.webhook_key(bodies)
    rows = good.collect()
    assert len(rows) == 3001 and len({r.seq for r in rows}) == 3000
    assert max(r.seq for r in rows if r.received_at == at[0]) < min(r.seq for r in rows if r.received_at == at[-1])
    loaded, _ = R.webhook_key(bodies.select("body"), T0)
    assert loaded.select("seq").distinct().count() == 3000 and loaded.count() == 3001
    teams = spark.createDataFrame([(f"t{k}", f"T{k}", f"t{k}") for k in range(50)], "id string, name string, slug string")
    repos = spark.createDataFrame([("t1", "o/a")], "team_id string, full_name string")
    members = spark.createDataFrame([("t1", "1", "x")], "team_id string, id string, login string")
    snaps = R.assemble_team_snapshots(teams, repos, members, T0)
    first, again = [{r.source_id: r.seq for r in s.collect()} for s in (snaps, R.assemble_team_snapshots(teams.repartition(5), repos, members, T0))]
    assert len(set(first.values())) == 50 and first == again
