"""Commit trailers and merge, histograms and pages against brute force."""
import datetime as dt
import json
import random

from pyspark.sql import functions as F

from flowgauge.operators import commits as CM
from flowgauge.operators import histogram as H
from flowgauge.operators import paging as PG

T0 = dt.datetime(2024, 1, 1)
ENV = "event_type string, payload string, received_at timestamp, seq long"


def test_tools_come_from_trailers_not_from_prose(spark):
    cases = [
        ("Fix\n\nCo-authored-by: Claude <a@b.c>", ["claude"]),
        ("Fix\r\n\r\nBody.\r\n\r\nSigned-off-by: D <d@x>\r\nCo-Authored-By: GitHub Copilot <c@x>\r\n\r\n", ["copilot"]),
        ("Fix\n\nAssisted-by: Cursor\n\twith edits\nCo-authored-by: Claude", ["claude", "cursor"]),
        ("Fix\n\nBody\n\n\U0001f916 Generated with [Claude Code](x)", ["claude"]),
        ("Fix\n\nGenerated by Cursor\n\nSigned-off-by: D <d@x>", ["cursor"]),
        ("Co-authored-by: Claude", []),                                     # a subject
        ("Fix\n\nCo-authored-by: Claude\nis what we parse now", []),        # prose in the last paragraph
        ("Fix\n\nCo-authored-by: Claude\n\nMore prose below.", []),         # not the last paragraph
        ("Fix\n\nCo-authored-by: Ann Cursor <a@b>", []),
        ("Fix\n\nReviewed-by: Claude", []),
        ("Fix\n\nCo-authored-by: Claudette <a@b>", []),
        ("", []), (None, []), ("Fix", []), ("\n\n", []),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string").select("i", CM.ai_tools("m").alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {i: t for i, (_, t) in enumerate(cases)}


def test_commit_is_one_row_of_pushes_and_snapshot(spark):
    push = lambda repo, *cs: json.dumps({"repository": {"full_name": repo}, "commits": list(cs)})
    c = lambda sha, msg, at, who=None: {"id": sha, "message": msg, "timestamp": at, "author": {"username": who}}
    snap = json.dumps({"sha": "s1", "url": "https://api.github.com/repos/o/a/commits/s1", "author": {"login": "ann"},
                       "commit": {"message": "x\n\nCo-authored-by: Claude", "author": {"date": "2024-01-02T00:00:00Z"}}})
    rows = [("push", push("o/a", c("s1", "x", "2024-01-09T00:00:00Z", "bob"), c("s2", "y\n\nAssisted-by: Copilot", "2024-01-03T00:00:00Z")), T0, 1),
            ("commit.snapshot", snap, T0 + dt.timedelta(hours=1), 2),
            ("push", push("o/a", c("s2", "y", "2024-01-08T00:00:00Z", "eve"), c(None, "z", "2024-01-03T00:00:00Z")), T0 + dt.timedelta(hours=2), 3),
            ("push", push("o/b", c("s1", "x", None)), T0, 4), ("push", "{broken", T0, 5), ("push", "{}", T0, 6), ("other", snap, T0, 7)]
    got = CM.merge_commits(CM.extract_commits(spark.createDataFrame(rows, ENV))).collect()
    found = {(r["repo"], r["sha"]): (r["author"], r["authored_at"], r["tools"], r["first_received_at"]) for r in got}
    assert found == {("o/a", "s1"): ("ann", dt.datetime(2024, 1, 2), ["claude"], T0),
                     ("o/a", "s2"): ("eve", dt.datetime(2024, 1, 3), ["copilot"], T0),
                     ("o/b", "s1"): (None, None, [], T0)}


def test_histogram_quantiles_merge_and_stay_within_their_error(spark):
    rng = random.Random(3)
    values = [(g, rng.choice([rng.randrange(5), rng.randrange(300), rng.randrange(10**6)])) for g in "ab" for _ in range(1500)] + [("c", 7), ("d", 0), ("d", -4), ("e", 2**40 + 5)]
    df = spark.createDataFrame(values, "g string, v long").select("g", H.bin_of("v").alias("bin"), "v")
    wrong = df.filter((F.col("bin") > F.greatest("v", F.lit(0))) | (F.col("v") - F.col("bin") >= F.greatest(F.col("v") / 64, F.lit(1))))
    assert wrong.filter("v >= 0").count() == 0 and df.filter("v < 128 AND v >= 0 AND bin <> v").count() == 0
    # two halves merged by adding counts
    halves = df.groupBy("g", "bin", (F.col("v") % 2).alias("h")).count().groupBy("g", "bin").agg(F.sum("count").alias("n"))
    got = {r["g"]: (r["p50"], r["p75"], r["p90"]) for r in H.bin_quantiles(halves, ["g"], {"p50": 50, "p75": 75, "p90": 90}).collect()}
    bins = {}
    for r in df.collect():
        bins.setdefault(r["g"], []).append(r["bin"])
    rank = lambda b, q: sorted(b)[-(-len(b) * q // 100) - 1]
    assert got == {g: tuple(rank(b, q) for q in (50, 75, 90)) for g, b in bins.items()}
    assert spark.createDataFrame([(None,)], "v long").select(H.bin_of("v")).head()[0] is None


def test_pages_equal_the_sorted_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "r1", "r2", "hot", "hot", "hot"]), T0 + dt.timedelta(seconds=rng.choice([0, 1, 90_000, rng.randrange(300_000)])))
            for i in range(700)] + [(9000 + i, "hot", None) for i in range(5)]
    df = spark.createDataFrame(rows, "n long, repo string, at timestamp").repartition(5)
    day, second = F.to_date("at"), F.unix_seconds("at")
    plans = [([F.col("at").asc(), F.col("repo").asc(), F.col("n").asc()], day, second, False, False),
             ([F.col("at").desc(), F.col("repo").asc(), F.col("n").asc()], day, second, True, True),
             ([F.col("repo").desc(), F.col("at").asc(), F.col("n").asc()], F.col("repo"), second, True, False)]
    for order, coarse, fine, cd, fd in plans:
        whole = [r["n"] for r in df.orderBy(*order).collect()]
        for page, size in ((0, 50), (3, 100), (7, 100), (20, 1), (1, 353), (99, 100)):
            got = [r["n"] for r in PG.page_of(df, order, coarse, fine, cd, fd, page, size, direct_rows=0).collect()]
            assert got == whole[page * size:(page + 1) * size]
    order, coarse, fine, cd, fd = plans[0]
    assert PG.page_of(df.limit(0), order, coarse, fine, cd, fd, 2, 10, direct_rows=0).count() == 0


def test_deep_page_does_not_sort_or_offset_all_rows(spark):
    df = spark.range(1000).selectExpr("id AS n", "timestamp_seconds(id) AS at")
    got = PG.page_of(df, [F.col("at").asc(), F.col("n").asc()], F.to_date("at"), F.unix_seconds("at"), False, False, 5_000, 100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "Limit" not in plan.replace("WindowGroupLimit", "")
