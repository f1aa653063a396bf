"""Streaming: bounded (watermark) dedup and the micro-batch ingest on a
small landed folder."""
import datetime as dt
import os
import shutil
import tempfile

from flowgauge.sources import readers as R
from flowgauge.sources.sinks import read_state
from flowgauge.streaming import stream_state as ST

T0 = dt.datetime(2024, 1, 1)
ENV = "source string, source_id string, event_type string, received_at timestamp, connector_version string, payload string, seq long"


def _land(spark, folder, rows):
    spark.createDataFrame(rows, ENV).coalesce(1).write.mode("append").parquet(folder)


def test_bounded_dedup_drops_redeliveries_within_watermark(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    _land(spark, src, [("github", "a", "push", T0, "1", "{}", 1),
                       ("github", "a", "push", T0 + dt.timedelta(minutes=30), "1", "{}", 2),
                       ("github", "b", "push", T0 + dt.timedelta(minutes=5), "1", "{}", 3)])
    stream = spark.readStream.schema(ENV).parquet(src)
    q = (ST.bounded_dedup(stream, "2 hours").writeStream.format("memory").queryName("dedup_out")
         .option("checkpointLocation", os.path.join(root, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r["source_id"] for r in spark.sql("SELECT source_id FROM dedup_out").collect())
    assert got == ["a", "b"]


def test_stream_ingest_keeps_first_delivery_and_latest_state(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    pr = '{"id": 7, "number": 7, "title": "t", "state": "%s", "created_at": "2024-01-01T00:00:00Z", "base": {"repo": {"full_name": "o/a"}}}'
    # batch 1: the opened PR; batch 2: a redelivery of it (later) and the closed version
    _land(spark, src, [("github", "pr:7:a", "pull_request.snapshot", T0, "1", pr % "open", 4)])
    _land(spark, src, [("github", "pr:7:a", "pull_request.snapshot", T0 + dt.timedelta(hours=5), "1", pr % "open", 8),
                       ("github", "pr:7:b", "pull_request.snapshot", T0 + dt.timedelta(hours=2), "1", pr % "closed", 9)])
    out = os.path.join(root, "tables")
    ST.stream_state(spark, src, out, os.path.join(root, "ck"), fmt="parquet")
    st = read_state(spark, out + "/pull_request_state").head()
    assert (st["state"], st["last_received_at"]) == ("closed", T0 + dt.timedelta(hours=2))
    raw = spark.read.parquet(out + "/raw_event")
    assert raw.count() == 2 and raw.filter("source_id = 'pr:7:a'").head()["seq"] == 4


def test_stream_reads_landed_json_and_keeps_dead_letters(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "tables")
    os.makedirs(src)
    pr = '{\\"id\\": 7, \\"number\\": 7, \\"state\\": \\"%s\\", \\"base\\": {\\"repo\\": {\\"full_name\\": \\"o/a\\"}}}'
    line = '{"source": "github", %s"event_type": "pull_request.snapshot", "received_at": "2024-01-01T00:00:00Z", "connector_version": "1", "payload": "%s"}'
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join([line % ('"source_id": "pr:7:a", ', pr % "open"), line % ('"source_id": "pr:7:b", ', pr % "closed"), line % ("", "{}"), "{no json"]))
    ST.stream_state(spark, src, out, os.path.join(root, "ck"))
    # equal times: the earlier line stays
    assert [r["state"] for r in read_state(spark, out + "/pull_request_state").collect()] == ["open"]
    bad = {r["reason"]: r["record"] for r in ST.quarantine_table(spark, out).collect()}
    assert bad == {"missing: source_id": None, "unreadable line": "{no json"}


def _pr(state):
    return '{"id": 7, "number": 7, "state": "%s", "created_at": "2024-01-01T00:00:00Z", "base": {"repo": {"full_name": "o/a"}}}' % state


def test_seen_keys_are_state_not_a_read_of_the_raw_table(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src, out, ck = (os.path.join(root, n) for n in ("in", "tables", "ck"))
    first = [("github", f"pr:{i}", "pull_request.snapshot", T0, "1", _pr("open"), i) for i in range(50)]
    _land(spark, src, first)
    ST.stream_state(spark, src, out, ck, fmt="parquet")
    assert spark.read.parquet(out + "/raw_event").count() == 50
    # the raw rows of the first run are out of reach; its keys are still known
    shutil.move(os.path.join(out, "raw_event", "epoch=0"), os.path.join(root, "aside"))
    later = T0 + dt.timedelta(hours=1)
    _land(spark, src, [("github", f"pr:{i}", "pull_request.snapshot", later, "1", _pr("open"), 100 + i) for i in range(48, 52)])
    ST.stream_state(spark, src, out, ck, fmt="parquet")
    assert sorted(r["source_id"] for r in spark.read.parquet(out + "/raw_event").collect()) == ["pr:50", "pr:51"]
    activity = ST.connector_activity_table(spark, out).head()
    assert (activity["deliveries"], activity["last_checked_at"]) == (54, later)


def test_whole_envelopes_without_an_entity_are_dead_letters(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "tables")
    _land(spark, src, [("github", "a", "pull_request.snapshot", T0, "1", _pr("open"), 1),
                       ("github", "b", "pull_request.snapshot", T0, "1", '{"number": 8}', 2),
                       ("jira", "b", "issue.snapshot", T0, "1", "{broken", 3),
                       ("github", "c", "push", T0, "1", "{}", 4)])  # not projected: raw only
    ST.stream_state(spark, src, out, os.path.join(root, "ck"), fmt="parquet")
    lost = {(r["source_id"], r["reason"], r["payload"]) for r in ST.quarantine_table(spark, out).collect()}
    assert lost == {("b", "no key: pull_request", '{"number": 8}'), ("b", "no key: jira_issue", "{broken")}
    assert spark.read.parquet(out + "/raw_event").count() == 4 and read_state(spark, out + "/pull_request_state").count() == 1


def test_replayed_landing_batch_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "tables")
    _land(spark, src, [("github", "a", "pull_request.snapshot", T0, "1", _pr("open"), 1),
                       ("github", "a", "pull_request.snapshot", T0, "1", _pr("closed"), 2),
                       ("github", "b", "pull_request.snapshot", T0 + dt.timedelta(hours=1), "1", _pr("closed"), 3)])
    batch = R.scan_envelopes(spark, src, fmt="parquet")
    tables = []
    for _ in range(2):  # the same epoch twice, as after a crash before its commit
        ST.land_batch(spark, batch, 0, out)
        raw = sorted((r["source_id"], r["seq"]) for r in spark.read.parquet(out + "/raw_event").collect())
        tables.append((raw, [tuple(r) for r in read_state(spark, out + "/pull_request_state").select("state", "last_received_at").collect()]))
    assert tables[0] == tables[1] == ([("a", 1), ("b", 3)], [("closed", T0 + dt.timedelta(hours=1))])
