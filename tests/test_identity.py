"""Identity resolution: closed form vs a serial replay of the resolution loop."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.operators.identity import manual_teams, observe_identities, resolve_identities
from flowgauge.plans.identity_plans import observations


def serial_resolve(observations):
    """Arrival-order loop: alias seen -> same contributor; email match -> attach
    at 0.90; else found a new contributor at 1.00."""
    alias_of, contributors, alias_rows = {}, {}, {}
    email_to_contrib = {}
    for src, uid, name, email, _seq in sorted(observations, key=lambda o: o[4]):
        if (src, uid) in alias_of:
            continue
        e = email.strip().lower() if email and email.strip() else None
        if e and e in email_to_contrib:
            cid = email_to_contrib[e]
            alias_of[(src, uid)] = cid
            alias_rows[(src, uid)] = (cid, 0.90)
            continue
        cid = f"{src}:{uid}"
        contributors[cid] = (name if name is not None else uid, e)
        if e:
            email_to_contrib[e] = cid
        alias_of[(src, uid)] = cid
        alias_rows[(src, uid)] = (cid, 1.00)
    return contributors, alias_rows


obs_strategy = st.lists(
    st.tuples(st.sampled_from(["github", "jira"]), st.sampled_from([f"u{i}" for i in range(8)]),
              st.sampled_from([None, "Ann", "Bob", "dependabot[bot]"]),
              st.sampled_from([None, "", "a@x.io", " A@X.io", "b@x.io", "c@x.io"])),
    min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(obs_strategy, st.randoms(use_true_random=False))
def test_closed_form_equals_serial_loop(spark, obs, rnd):
    seqs = list(range(len(obs)))
    rnd.shuffle(seqs)  # arrival order independent of list order
    rows = [(s, u, n, e, q) for (s, u, n, e), q in zip(obs, seqs)]
    want_c, want_a = serial_resolve(rows)
    df = spark.createDataFrame(rows, "source string, source_user_id string, name string, email string, seq long")
    contributors, aliases = resolve_identities(df)
    got_a = {(r["source"], r["source_user_id"]): (r["contributor_id"], float(r["match_confidence"]))
             for r in aliases.collect()}
    got_c = {r["contributor_id"]: (r["canonical_name"], r["canonical_email"]) for r in contributors.collect()}
    assert got_a == want_a
    assert got_c == want_c


def test_reference_cases(spark):
    rows = [
        ("github", "1", "Ann", "ann@x.io", 1),
        ("github", "1", "Ann", "ann@x.io", 5),            # same alias again: one alias
        ("jira", "acc-1", "Ann A", "ANN@x.io ", 2),        # email differs in case: merges at 0.90
        ("jira", "acc-2", "Bob", None, 3),                 # no email never merges
        ("github", "2", "Bob", None, 4),
        ("github", "3", "dependabot[bot]", None, 6),       # bot
        ("github", "email:x@noreply.io", "ci-bot", "x@noreply.io", 7),
    ]
    df = spark.createDataFrame(rows, "source string, source_user_id string, name string, email string, seq long")
    contributors, aliases = resolve_identities(df)
    a = {(r["source"], r["source_user_id"]): (r["contributor_id"], float(r["match_confidence"])) for r in aliases.collect()}
    assert a[("jira", "acc-1")] == ("github:1", 0.90)
    assert a[("github", "1")] == ("github:1", 1.00)
    assert a[("jira", "acc-2")][0] != a[("github", "2")][0]
    bots = {r["contributor_id"] for r in contributors.collect() if r["is_bot"]}
    assert bots == {"github:3", "github:email:x@noreply.io"}
    assert len(a) == 6


def test_manual_teams_last_write_wins(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([("Platform Team", t, 1), ("  platform   team!! ", t + dt.timedelta(hours=1), 2),
                                 ("Data", t, 3)], "name string, requested_at timestamp, seq long")
    got = {r["source_id"]: r["name"] for r in manual_teams(req).collect()}
    assert got == {"platform-team": "  platform   team!! ", "data": "Data"}
    assert random is not None


ENV = "source string, event_type string, payload string, received_at timestamp, seq long"


def test_each_kind_of_envelope_is_parsed_once(spark):
    import datetime as dt
    env = spark.createDataFrame([("github", "push", "{}", dt.datetime(2024, 1, 1), 1)], ENV)
    plan = observations(env)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 5  # pull requests, commits, pushes, Jira, teams


def test_what_each_envelope_reveals(spark):
    import datetime as dt
    import json
    ann = {"id": "1", "login": "ann", "email": "a@x.io"}
    jane = {"accountId": "j1", "displayName": "Jane", "emailAddress": "j@x.io"}
    sent = [
        ("github", "pull_request", {"pull_request": {"user": ann}, "user": {"id": "9", "login": "sender"}}),
        ("github", "pull_request.snapshot", {"user": ann, "commits": 3}),
        ("github", "pull_request_review.snapshot", {"user": None}),
        ("github", "commit.snapshot", {"author": {"id": "2", "login": "bob"}, "commit": {"author": {"email": "b@x.io"}}}),
        ("github", "commit.snapshot", {"commit": {"author": {"name": "C", "email": "C@x.io"}}}),
        ("github", "commit.snapshot", {"commit": {"author": {"name": "nobody"}}}),
        ("github", "push", {"commits": [{"author": {"name": "D"}}, {"author": {"name": "E", "email": "e@x.io"}}]}),
        ("github", "push", {}),
        ("jira", "jira:issue_updated", {"issue": {"fields": {"assignee": None, "reporter": jane}}, "user": jane}),
        ("jira", "issue.snapshot", {"fields": {"assignee": jane}}),
        ("jenkins", "build.snapshot", {"user": ann}),
        ("github", "workflow_run", {"user": ann}),
    ]
    rows = [(s, e, json.dumps(p), dt.datetime(2024, 1, 1), n) for n, (s, e, p) in enumerate(sent)]
    rows += [("jira", "issue.snapshot", "{broken", dt.datetime(2024, 1, 1), 98), ("github", "push", None, dt.datetime(2024, 1, 1), 99)]
    got = sorted(tuple(r) for r in observe_identities(spark.createDataFrame(rows, ENV)).select(
        "seq", "pos", "source_user_id", "name", "email").collect())
    assert got == [
        (0, 0, "1", "ann", "a@x.io"), (1, 0, "1", "ann", "a@x.io"), (3, 0, "2", "bob", "b@x.io"),
        (4, 0, "email:c@x.io", "C", "C@x.io"), (6, 0, "email:e@x.io", "E", "e@x.io"),
        (8, 0, "j1", "Jane", "j@x.io"), (8, 1, "j1", "Jane", "j@x.io"), (9, 0, "j1", "Jane", "j@x.io")]
