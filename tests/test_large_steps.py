"""What large tables need: steps that store, sort or open whole envelopes no oftener than they must."""
import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from flowgauge.operators import identity as I
from flowgauge.operators import state as S
from flowgauge.operators.recurring import Recurring, counted, mark
from flowgauge.operators.state import NATURAL_KEY, dedup_events
from flowgauge.plans import registry, source_plans
from flowgauge.plans import state_plans as SP
from flowgauge.sources import sinks as K
from flowgauge.streaming import stream_state as ST

T0 = dt.datetime(2024, 1, 1)
ENV = "source string, source_id string, event_type string, received_at timestamp, connector_version string, payload string, seq long"
BASE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _env(spark, n=404):
    return spark.createDataFrame([("github", f"push:{i}", "push", T0 + dt.timedelta(seconds=i), "1", "{}", i) for i in range(n)], ENV)


def test_dedup_sorts_envelopes_once_behind_the_shuffle(spark):
    plan = _plan(dedup_events(_env(spark)))
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan
    assert plan.index("Sort [") < plan.index("Exchange hashpartitioning")  # printed from the result down


def test_dedup_keeps_the_key_of_arrivals_without_number(spark):
    rows = [("s", "a", "t", T0, "1", "first", 1), ("s", "a", "t", T0, "1", "second", 2), ("s", "a", "t", T0, "1", "none", None),
            ("s", "b", "t", T0, "1", "none", None), ("s", None, "t", T0, "1", "x", 5), ("s", None, "t", T0, "1", "y", 4)]
    got = {r["source_id"]: (r["payload"], r["seq"]) for r in dedup_events(spark.createDataFrame(rows, ENV)).collect()}
    assert got == {"a": ("first", 1), "b": (None, None), None: ("y", 4)}


def test_envelopes_are_landed_packed(spark):
    folder = tempfile.mkdtemp(prefix="fg-land-", dir="/tmp") + "/json"
    got = {tuple(r) for r in source_plans.landed_envelopes(spark, _env(spark), folder).collect()}
    assert got == {("github", "push", 400), ("quarantine", "missing: source_id", 4)}
    data = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert data and all(f.endswith(".json.gz") for f in data)


def test_routed_queries_build_only_the_envelopes_they_read(spark):
    plan = _plan(registry.QUERIES["rebuild_issue_state"](spark, BASE))
    assert "part.parquet" in plan and "lineitem.parquet" not in plan and "events.parquet" not in plan


def test_aliases_open_each_kind_of_payload_once(spark):
    payloads = [("github", "commit.snapshot", '{"sha": "1", "author": {"id": "%d"}, "commit": {"author": {"name": "n", "email": "e@x"}}}' % i) for i in (3, 2)]
    rows = [(s, str(i), t, T0, "1", p, i) for i, (s, t, p) in enumerate(payloads)]
    _, aliases = I.resolve_identities(I.observe_identities(spark.createDataFrame(rows, ENV)))
    assert _plan(aliases).count("from_json(") == 4
    got = {(r["contributor_id"], r["source_user_id"], float(r["match_confidence"])) for r in aliases.collect()}
    assert got == {("github:3", "3", 1.0), ("github:3", "2", 0.9)}


def test_state_merge_leaves_only_the_table(spark):
    path = tempfile.mkdtemp(prefix="fg-state-", dir="/tmp") + "/state"
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(kept))
    for n in (1, 2):
        K.write_state(spark.createDataFrame([("a", n, T0 + dt.timedelta(hours=n), n)], "k string, v int, received_at timestamp, seq long"), ["k"], path)
    assert [r["v"] for r in K.read_state(spark, path).collect()] == [2]
    assert os.listdir(path) == ["buckets=8"] and set(os.listdir(kept)) == before


def test_arrivals_are_sliced_in_one_pass_without_a_sort(spark):
    root = tempfile.mkdtemp(prefix="fg-slices-", dir="/tmp")
    sliced = ST.arrival_slices(_env(spark))
    assert {r["slice"]: r["n"] for r in sliced.groupBy("slice").agg(F.count("*").alias("n")).collect()}.keys() == {0, 1, 2, 3}
    bounds = sorted((r["slice"], r["low"], r["high"]) for r in sliced.groupBy("slice").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect())
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))
    K.write_folders(sliced, ["slice"], root + "/all", "json")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    for _ in range(2):  # a second move does nothing
        K.move_folder(spark, root + "/all/slice=1", root + "/in/slice-1")
    assert spark.read.json(root + "/in/slice-1").count() == bounds[1][2] - bounds[1][1] + 1
    assert all(f.endswith(".json.gz") for f in os.listdir(root + "/in/slice-1") if f.startswith("part-"))
    K.move_folder(spark, root + "/all/slice=9", root + "/in/slice-9")
    assert os.listdir(root + "/in/slice-9") == []


def test_stream_leaves_no_staged_updates(spark):
    root = tempfile.mkdtemp(prefix="fg-stream-", dir="/tmp")
    pr = '{"id": 7, "number": 7, "state": "open", "base": {"repo": {"full_name": "o/a"}}}'
    rows = [("github", "pr:7", "pull_request.snapshot", T0, "1", pr, 1), ("github", "pr:8", "pull_request.snapshot", T0, "1", "{}", 2)]
    spark.createDataFrame(rows, ENV).write.parquet(root + "/in")
    ST.stream_state(spark, root + "/in", root + "/tables", root + "/ck", fmt="parquet")
    assert not os.path.exists(root + "/tables/_updates")
    lost = ST.quarantine_table(spark, root + "/tables").collect()
    assert [(r["source_id"], r["reason"], r["payload"]) for r in lost] == [("pr:8", "no key: pull_request", "{}")]


def test_state_is_rebuilt_without_moving_payloads(spark):
    for name in ("rebuild_run_state", "rebuild_pr_state", "rebuild_review_state", "rebuild_issue_state"):
        plan = _plan(registry.QUERIES[name](spark, BASE))  # printed from the result down
        assert plan.index("lag(1") < plan.index("from_json("), name
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"


def test_rows_of_the_first_delivery_only(spark):
    run = '{"id": "%s", "name": "n", "conclusion": "%s", "repository": {"full_name": "o/a"}}'
    job = '{"number": "%s", "job_name": "j", "result": "%s"}'
    rows = [("github", "r:1", "workflow_run.snapshot", T0, "1", run % (1, "first"), 1),
            ("github", "r:1", "workflow_run.snapshot", T0 + dt.timedelta(hours=1), "1", run % (1, "again"), 2),
            ("github", "r:1", "workflow_run", T0 - dt.timedelta(hours=1), "1", run % (1, "older"), 3),
            ("github", "r:2", "workflow_run.snapshot", T0, "1", "{}", 1),  # no run: hides the one delivered later
            ("github", "r:2", "workflow_run.snapshot", T0, "1", run % (2, "later"), 2),
            ("github", "r:3", "workflow_run.snapshot", T0, "1", run % (3, "no number"), None),
            ("github", "r:4", "workflow_run.snapshot", T0, "1", run % (4, "numbered"), 9),
            ("github", "r:4", "workflow_run.snapshot", T0, "1", run % (4, "no number"), None),
            ("github", None, "workflow_run.snapshot", T0, "1", run % (5, "y"), 4),
            ("github", None, "workflow_run.snapshot", T0, "1", run % (6, "x"), 5),
            ("jenkins", "b:1", "build.snapshot", T0, "1", job % (7, "SUCCESS"), 1),
            ("jenkins", "b:1", "build.snapshot", T0 + dt.timedelta(hours=1), "1", job % (7, "FAILURE"), 2)]
    env = spark.createDataFrame(rows, ENV)
    got = {r["run_id"]: r["conclusion"] for r in SP.run_state(env).collect()}
    assert got == {"1": "first", "4": "numbered", "5": "y", "jenkins:j:7": "success"}
    narrow = SP.run_state(env, only=[])
    assert narrow.columns == ["repo", "run_id", "last_received_at"]
    assert {(r["run_id"], r["last_received_at"]) for r in narrow.collect()} == {(r["run_id"], r["last_received_at"]) for r in SP.run_state(env).collect()}


def test_raw_envelopes_are_shuffled_only_where_their_key_recurs(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="fg-raw-", dir="/tmp") + "/raw"
    given = []
    monkeypatch.setattr(K, "dedup_events", lambda rows: (given.append(rows.count()), dedup_events(rows))[1])
    again = spark.createDataFrame([("github", f"push:{i}", "push", T0, "2", "late", 10_000 + i) for i in (7, 8, 8)], ENV)
    conf = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    K.write_raw(_env(spark).unionByName(again), path)
    assert min(given) < 40  # of 407: those of two keys, and some whose bit another one set
    got = spark.read.parquet(path)
    assert got.count() == 404 and got.filter("payload = 'late'").count() == 0
    assert conf == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
    assert not [f for f in os.listdir(K.table_root(spark).removeprefix("file:")) if f.startswith("recurring")]


def test_raw_table_holds_what_the_dedup_gives(spark):
    path = tempfile.mkdtemp(prefix="fg-raw-", dir="/tmp") + "/raw"
    rows = [("s", "a", "t", T0, "1", "first", 1), ("s", "a", "t", T0, "1", "second", 2), ("s", "a", "t", T0, "1", "none", None),
            ("s", "b", "t", T0, "1", "none", None), ("s", None, "t", T0, "1", "x", 5), ("s", None, "t", T0, "1", "y", 4),
            ("s", "c", None, T0, "1", "alone", 3), (None, "c", None, T0, "1", None, 3), ("s", "d", "t", T0, "1", "none", None), ("s", "d", "t", T0, "1", "none", None)]
    env = spark.createDataFrame(rows, ENV)
    K.write_raw(env, path)
    columns = env.columns
    order = lambda r: str(r)
    stored = sorted(map(tuple, spark.read.parquet(path).select(*columns).collect()), key=order)
    assert stored == sorted(map(tuple, dedup_events(env).select(*columns).collect()), key=order) and len(stored) == 6


def test_recurring_marks(spark):
    rows = spark.range(3000).selectExpr("id % 2000 AS k", "id AS n")  # 0 to 999 twice
    marks, key = rows.select(mark("k").alias("mark")), mark("k")

    def told(found):
        again, once = found.again(rows, key), found.once(rows, key)
        assert sorted(r["n"] for r in again.unionByName(once).collect()) == list(range(3000))  # every row on one side
        assert once.filter("k < 1000").count() == 0 and again.filter("k >= 1000").count() < 300

    told(Recurring.planned(marks))
    with counted(marks) as found:
        told(found)
    with counted(rows.filter("n < 2000").select(key.alias("mark"))) as none:
        assert none.again(rows, key).count() == 0 and none.once(rows, key).count() == 3000


def test_only_keys_with_several_events_are_guarded(spark, monkeypatch):
    given, guard = [], S.with_record_high
    monkeypatch.setattr(S, "with_record_high", lambda rows, *a: (given.append(rows.count()), guard(rows, *a))[1])
    hour = lambda n: None if n is None else T0 + dt.timedelta(hours=n)
    rows = [("once", i, hour(i), i) for i in range(400)]
    rows += [("late", 1, hour(5), 1), ("late", 1, hour(4), 2), ("late", 1, hour(5), 3), ("late", 1, hour(6), 4),
             ("untimed", 1, None, 1), ("untimed", 1, hour(1), 2), ("untimed", 1, None, 3), ("untimed", 1, hour(1), 4),
             (None, 1, hour(2), 1), (None, 1, hour(1), 2)]
    df = spark.createDataFrame(rows, "k string, n int, received_at timestamp, seq long")
    got = sorted((str(r["k"]), r["seq"]) for r in S.late_events(df, ["k", "n"]).collect())
    assert got == [("None", 2), ("late", 2), ("late", 3), ("untimed", 4)]
    assert len(given) == 1 and given[0] < 20  # of 410


def test_first_of_its_delivery_still_hides_the_later_ones(spark):
    pr = '{"id": %d, "number": 1, "state": "open", "base": {"repo": {"full_name": "o/a"}}}'
    hour = lambda n: T0 + dt.timedelta(hours=n)
    rows = [("github", "a", "pull_request", hour(9), "1", pr % 7, 1),  # alone in its entity, first of its delivery
            ("github", "a", "pull_request", hour(1), "1", pr % 8, 5),  # hidden, so not late
            ("github", "b", "pull_request", hour(3), "1", pr % 8, 2),
            ("github", "c", "pull_request", hour(2), "1", pr % 8, 3)]  # late
    got = {r["entity"]: r["late_events"] for r in SP.late_event_counts(spark.createDataFrame(rows, ENV)).collect()}
    assert got == {"pull_request": 1}


def test_stored_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = shuffled()
    K.write_raw(_env(spark).unionByName(_env(spark, 50)), tempfile.mkdtemp(prefix="fg-raw-", dir="/tmp") + "/raw")
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not left
