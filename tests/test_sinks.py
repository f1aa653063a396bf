"""Sinks: raw append idempotence, guarded copy-on-write state merge, mart
overwrite, quarantine and CSV export."""
import datetime as dt
import os
import tempfile

from flowgauge.sources import sinks as K

T0 = dt.datetime(2024, 1, 1)
ENV = "source string, source_id string, event_type string, received_at timestamp, connector_version string, payload string, seq long"


def _tmp():
    return tempfile.mkdtemp(prefix="fg-sink-", dir="/tmp")


def test_write_raw_first_delivery_wins_and_is_idempotent(spark):
    path = os.path.join(_tmp(), "raw")
    rows = [("github", "a", "push", T0, "1", "{}", 1), ("github", "a", "push", T0 + dt.timedelta(hours=1), "1", "{}", 5),
            ("github", "a", "commit", T0, "1", "{}", 2), ("jira", "b", "issue.snapshot", T0, "1", "{}", 3)]
    env = spark.createDataFrame(rows, ENV)
    K.write_raw(env, path)
    K.write_raw(env, path)  # redelivery of the whole batch
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert got.filter("source_id = 'a' AND event_type = 'push'").head()["seq"] == 1


def test_write_state_guard_and_sticky(spark):
    path = os.path.join(_tmp(), "issue_state")
    schema = "issue_key string, status string, reopened boolean, received_at timestamp, seq long"

    def batch(*rows):
        K.write_state(spark.createDataFrame(list(rows), schema), ["issue_key"], path, sticky="reopened", buckets=4)

    batch(("P-1", "Done", False, T0 + dt.timedelta(hours=2), 1), ("P-2", "Open", False, T0, 1))
    # an older event carrying a reopen is ignored; an equal-time update does not replace
    batch(("P-1", "Open", True, T0 + dt.timedelta(hours=1), 2), ("P-1", "Other", False, T0 + dt.timedelta(hours=2), 3))
    r = K.read_state(spark, path).filter("issue_key = 'P-1'").head()
    assert (r["status"], r["reopened"]) == ("Done", False)
    # a newer reopen sets the flag and it stays set afterwards
    batch(("P-1", "In Progress", True, T0 + dt.timedelta(hours=3), 4))
    last = ("P-1", "Done", False, T0 + dt.timedelta(hours=4), 5)
    batch(last)
    r = K.read_state(spark, path).filter("issue_key = 'P-1'").head()
    assert (r["status"], r["reopened"], r["last_received_at"]) == ("Done", True, T0 + dt.timedelta(hours=4))
    # replaying a micro-batch is idempotent; untouched keys keep their rows
    batch(last)
    rows = sorted(tuple(x) for x in K.read_state(spark, path).select("issue_key", "status", "reopened").collect())
    assert rows == [("P-1", "Done", True), ("P-2", "Open", False)]


def _bucket_sizes(path):
    current = max((n for n in os.listdir(path)), key=lambda n: int(n.partition("=")[2]))
    folder = os.path.join(path, current)
    return [sum(os.path.getsize(os.path.join(folder, b, f)) for f in os.listdir(os.path.join(folder, b)) if f.endswith(".parquet"))
            for b in os.listdir(folder) if b.startswith("bucket=")]


def test_state_table_splits_as_it_grows(spark):
    path = os.path.join(_tmp(), "state")
    limit = 20_000

    def merge(lo, hi, hour):
        rows = spark.range(lo, hi, 1, 4).selectExpr(
            "cast(id AS string) AS k", "sha2(cast(id AS string), 256) AS v", f"timestamp_seconds(1704067200 + {hour} * 3600) AS received_at", "id AS seq")
        K.write_state(rows, ["k"], path, buckets=2, bucket_bytes=limit)

    merge(0, 100, 0)
    assert os.listdir(path) == ["buckets=2"]
    merge(100, 10_000, 1)    # 100 times the rows: more buckets, none of them large
    assert max(_bucket_sizes(path)) <= limit
    merge(5_000, 5_010, 2)
    merge(0, 10, -1)         # older than what is stored
    got = K.read_state(spark, path)
    assert got.count() == got.select("k").distinct().count() == 10_000
    assert got.filter("v <> sha2(k, 256)").count() == 0
    assert {r["k"] for r in got.filter("last_received_at > timestamp'2024-01-01 01:30:00'").collect()} == {str(i) for i in range(5_000, 5_010)}
    merge(10_000, 60_000, 3)
    assert max(_bucket_sizes(path)) <= limit and K.read_state(spark, path).count() == 60_000
    assert len(os.listdir(path)) == 2  # the layout before stays for readers that hold it


def test_split_that_was_cut_off_leaves_the_old_layout(spark):
    path = os.path.join(_tmp(), "state")
    rows = spark.createDataFrame([("a", T0, 1), ("b", T0, 2)], "k string, received_at timestamp, seq long")
    K.write_state(rows, ["k"], path, buckets=2)
    os.makedirs(os.path.join(path, "buckets=16", "bucket=3"))  # no _SUCCESS
    assert K.read_state(spark, path).count() == 2
    K.write_state(rows, ["k"], path, buckets=2)
    assert K.read_state(spark, path).count() == 2


def test_write_mart_replaces_window(spark):
    path = os.path.join(_tmp(), "mart")
    schema = "metric_key string, scope_type string, scope_id string, day date, value double, sample_size long"
    d0, d1 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    K.write_mart(spark.createDataFrame([("m1", "repo", "r1", d0, 1.0, 1), ("m1", "repo", "r1", d1, 1.0, 1),
                                        ("m2", "repo", "r1", d1, 2.0, 2)], schema), path)
    # a recompute of m1 over day 2 only: r1 stopped being produced, r2 appeared
    K.write_mart(spark.createDataFrame([("m1", "repo", "r2", d1, 3.0, 3)], schema), path)
    got = sorted((r["metric_key"], str(r["day"]), r["scope_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("m1", "2024-01-01", "r1"), ("m1", "2024-01-02", "r2"), ("m2", "2024-01-02", "r1")]


def test_quarantine_and_csv(spark):
    root = _tmp()
    bad = spark.createDataFrame([("{broken",)], "record string")
    K.write_quarantine(bad, "unparseable", os.path.join(root, "q"))
    q = spark.read.parquet(os.path.join(root, "q")).head()
    assert q["reason"] == "unparseable" and q["record"] == "{broken"
    tiles = spark.createDataFrame([("mttr_p50_hours", 'Lead "time", p50', "h", "latest", 1.5, 3, dt.datetime(2024, 1, 3))],
                                  "metric_key string, label string, unit string, aggregation string, value double, "
                                  "sample_size long, computed_at timestamp")
    series = spark.createDataFrame([("m", dt.date(2024, 1, 2), 1.5)], "metric_key string, day date, value double")
    K.export_report_csv(tiles, series, os.path.join(root, "csv"), "team-1", 7)
    back = spark.read.option("header", True).option("escape", '"').csv(os.path.join(root, "csv", "summary")).head()
    assert back["label"] == 'Lead "time", p50' and back["tier"] == "High"
    about = spark.read.option("header", True).csv(os.path.join(root, "csv", "about")).collect()
    assert {r["name"]: r["value"] for r in about} == {"scope": "team-1", "window_days": "7", "as_of": "2024-01-03T00:00:00Z"}
