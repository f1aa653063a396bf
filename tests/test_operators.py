"""Operator tests against brute force on small fixtures."""
import datetime as dt
import random

from pyspark.sql import functions as F

from flowgauge.operators.asof import first_at_or_after, first_within, followed_within
from flowgauge.operators.percentile import grouped_percentile


def _brute_percentile(vals, p):
    v = sorted(vals)
    if not v:
        return None
    pos = (len(v) - 1) * p
    lo, hi = int(pos // 1), int(-(-pos // 1))
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


def test_percentile_hot_path_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    # one hot group (a third of the rows, many duplicates, negatives), many small ones
    for i in range(3000):
        rows.append(("hot", rnd.choice([0, 5, 5, 7, -3, rnd.randint(-10**12, 10**12)])))
    for g in range(200):
        for _ in range(rnd.randint(1, 30)):
            rows.append((f"g{g}", rnd.randint(0, 10**9)))
    rows.append(("nulls", None))
    df = spark.createDataFrame(rows, "k string, v long")
    for p, bits in ((0.5, 22), (0.25, 1), (0.9, 40), (0.5, 0)):
        got = {r["k"]: (r["value"], r["sample_size"])
               for r in grouped_percentile(df, ["k"], "v", p, bucket_bits=bits).collect()}
        groups = {}
        for k, v in rows:
            groups.setdefault(k, []).append(v)
        for k, vs in groups.items():
            want = _brute_percentile([x for x in vs if x is not None], p)
            val, n = got[k]
            assert n == len(vs)
            if want is None:
                assert val is None
            else:
                assert abs(val - want) <= 1e-6 * max(1.0, abs(want)), (k, p, val, want)


def _t(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=h)


def test_asof_forward_matches_brute_force(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice(["a", "b", "c"]), _t(rnd.randint(0, 3000))) for i in range(400)]
    right = [(rnd.choice(["a", "b", "d"]), _t(rnd.randint(0, 3000))) for _ in range(300)]
    right += [(k, t) for _, k, t in left[:20]]  # exact ties count
    L = spark.createDataFrame(left, "id int, repo string, t timestamp")
    R = spark.createDataFrame(right, "repo string, rt timestamp")
    for slot in (60, 3600, 86400 * 10):
        got = {r["id"]: r["m"] for r in first_at_or_after(L, R, ["repo"], "t", "rt", "m", slot).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            cands = [rt for rk, rt in right if rk == k and rt >= t]
            assert got[i] == (min(cands) if cands else None), (i, slot)
    within = {r["id"]: r["m"] for r in first_within(L, R, ["repo"], "t", "rt", "m", 3600 * 2).collect()}
    flags = {r["id"]: r["f"] for r in followed_within(L, R, ["repo"], "t", "rt", "f", 3600 * 2).collect()}
    for i, k, t in left:
        cands = [rt for rk, rt in right if rk == k and t <= rt <= t + dt.timedelta(hours=2)]
        assert within[i] == (min(cands) if cands else None)
        assert flags[i] == (1 if cands else 0)


def test_scope_fanout_counts_repo_in_two_teams(spark):
    from flowgauge.operators.rollup import scope_fanout
    df = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "repo string, x int")
    tr = spark.createDataFrame([("t1", "r1"), ("t2", "r1"), ("t1", "r2")], "team_id string, repo string")
    got = sorted((r["x"], r["scope_type"], r["scope_id"]) for r in scope_fanout(df, tr).collect())
    assert got == sorted([(1, "repo", "r1"), (1, "org", "*"), (1, "team", "t1"), (1, "team", "t2"),
                          (2, "repo", "r2"), (2, "org", "*"), (2, "team", "t1"),
                          (3, "repo", "r3"), (3, "org", "*")])
    assert F is not None


def test_record_high_guard_matches_serial_loop(spark):
    import datetime as dt
    import random as rnd_mod
    from flowgauge.operators.state import with_record_high
    rnd = rnd_mod.Random(11)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{i % 7}"
        rows.append((key, i * (1 << 30) + rnd.randint(0, 5), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 50))))
    df = spark.createDataFrame(rows, "k string, seq long, received_at timestamp")
    for shift in (0, 31, 34, 60):
        got = {r["seq"]: r["_high"] for r in with_record_high(df, ["k"], chunk_shift=shift).collect()}
        best = {}
        for k, seq, ts in sorted(rows, key=lambda r: r[1]):
            want = k not in best or ts > best[k]
            assert got[seq] == want, (shift, k, seq)
            best[k] = max(best.get(k, ts), ts)


def test_several_percentiles_in_one_pass(spark):
    """All ``p`` of a group from one count equal those taken alone and numpy's; a group of nulls has none."""
    import numpy as np
    from flowgauge.operators.percentile import grouped_percentile, grouped_percentiles
    rnd = np.random.default_rng(3)
    groups = {"even": rnd.integers(0, 10**9, 400), "ties": np.repeat([5, 5, 7_000_000_000], 50), "one": np.array([42])}
    rows = [(g, int(v)) for g, vals in groups.items() for v in vals] + [("none", None), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    wanted = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in grouped_percentiles(df, ["g"], "v", wanted, count_out="n", nonnull_out="known").collect()}
    for g, vals in groups.items():
        assert np.allclose([got[g][name] for name in wanted], np.quantile(vals, list(wanted.values())))
    assert (got["ties"].n, got["ties"].known) == (151, 150)
    assert got["none"].p50 is None and (got["none"].n, got["none"].known) == (1, 0)
    alone = {r.g: r.value for r in grouped_percentile(df, ["g"], "v", 0.99).collect()}
    assert alone == {g: r.p99 for g, r in got.items()}
