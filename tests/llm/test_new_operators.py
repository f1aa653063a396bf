"""Operators 11 to 13 against brute force, and cases that earlier versions got wrong."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowgauge.llm import jaccard, merkle, substring, urlfilter, whitening
from flowgauge.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# ------------------------------------------------------------------ 11: Merkle manifest
def folded(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return folded(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([folded(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def way(tree, i):
    found = []
    for level in tree[:-1]:
        found.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 0))
        i >>= 1
    return found


def brute_merkle(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: levels([leaf(r) for r in members[x]]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, r in enumerate(members[x]):
            path, now = way(trees[x], i) + way(top, k), leaf(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf((*r[:3], r[3] + 1, r[4]))
            for sibling, left in path:
                now = folded(now) if sibling is None else folded(now, sibling) if left else folded(sibling, now)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], folded(*[s for s, _ in path if s]), now, now == top[-1][0]))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, node string, tree long"
ODD = [(None, None, None, None, None), (1, "a", "é", 3, "q"), (1, "a", "é", 3, "q"), (7, "a", "b", None, ""), (None, "s", "b", 2, "z" * 10), (3, "", "", 1, None), (12, "s", "b", 9, "long " * 50_000)]


@pytest.mark.parametrize("shared", [1 << 16, 6])
def test_merkle_against_brute_force(spark, shared):
    rows = [(d, "s", ("en", "de", None)[d % 3 if d < 30 else 0], d % 90, f"text {d}") for d in range(60)] + ODD
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS)
    got = [tuple(r)[:7] for r in merkle.checked(docs, shared_nodes=shared).collect()]
    assert ordered(got) == ordered(brute_merkle(rows))
    assert any(not r[6] for r in got)


@pytest.mark.parametrize("shared", [1 << 14, 9, 0])
def test_merkle_climb_of_many_steps(spark, monkeypatch, shared):
    """Rows that span two levels: climbs of several steps below and above the shared nodes."""
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(d, "s", ("en", "de", None, "fr", "ja")[d % 5 if d < 40 else 0], d, f"text {d}") for d in range(110)]
    got = [tuple(r)[:7] for r in merkle.checked(spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS), shared_nodes=shared).collect()]
    assert ordered(got) == ordered(brute_merkle(rows))


def test_merkle_small_tables(spark):
    for n in (0, 1, 3):
        docs = spark.createDataFrame([(*r, "x", 1) for r in ODD[:n]], FIELDS)
        got = [tuple(r)[:7] for r in merkle.checked(docs).collect()]
        assert ordered(got) == (ordered(brute_merkle(ODD[:n])) if n else [])


def test_merkle_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert ordered(tuple(r)[:7] for r in QUERIES["op11_merkle"](spark, SF).collect()) == ordered(brute_merkle(rows))


# ------------------------------------------------------------------ 12: whitening
def brute_whitening(rows):
    kept = [(k, [int(np.floor(256 * float(c))) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=object)
    fit = np.array([list(v) for v in {tuple(v) for v in x.tolist()}], dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit * n - total).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [k for k, _ in kept], x, n, total, values[::-1], axes[:, ::-1]


def check_whitening(got, rows):
    ids, x, n, total, values, axes = brute_whitening(rows)
    deviations = {k: int(((n * v - total) ** 2).sum()) for k, v in zip(ids, x, strict=True)}
    place = {k: i for i, k in enumerate(ids)}
    assert len(got) == len(ids) * 4 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    for c in range(4):
        mine = [r for r in got if r.component == c + 1]
        assert all(r.deviation == deviations[r.vec_id] for r in mine)
        expected = ((x * n - total).astype(float) / n @ axes[:, c] / np.sqrt(values[c]))[[place[r.vec_id] for r in mine]]
        found = np.array([r.whitened for r in mine])
        assert min(np.abs(found - expected).max(), np.abs(found + expected).max()) < 1e-6
        assert all(abs(r.explained - values[c] / values.sum()) <= 1e-9 for r in mine)


def test_whitening_against_eigenvectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 12)) @ np.diag(10.0 ** -np.arange(12) * 50 + 0.2) + 1000
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)] + [(1000, base[3].tolist()), (1001, None), (1002, [1.0, None] * 6), (1003, [float("inf")] * 12)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, n long")
    check_whitening(whitening.whiten(docs).collect(), rows)


def test_whitening_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_whitening_degenerate_tables(spark):
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert whiten([]) == [] and whiten([(1, None)]) == [] and whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and whiten([(1, [])]) == []
    flat = whiten([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 3.0]), (4, [9.0])])  # one dimension varies; another width is left out
    assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9)) for r in flat) == [("1", 1, 1), ("2", 1, 1), ("None", 1, 1)]
    rows = [(k, [float(k % 7), 2.0 * (k % 7), 5.0, float(k % 3)]) for k in range(40)]  # rank 2
    got = whiten(rows)
    assert {r.component for r in got} == {1, 2} and len(got) == 80 and got[0].identity_error < 1e-9


# ------------------------------------------------------------------ 13: Jaccard join
def brute_jaccard(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset([tuple(words)]) if 0 < len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(i)
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def changed(rng, words, times, vocabulary):
    words = list(words)
    for _ in range(times):
        i, kind = rng.randrange(len(words)), rng.random()
        words[i : i + (kind < 0.7)] = [rng.choice(vocabulary)] * (kind < 0.4 or kind >= 0.7)
    return words


def jaccard_rows():
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(400)]
    common, rows = [rng.choice(vocabulary) for _ in range(40)], []
    for b in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 30, 70, 90, 200]))] + common * (b % 3 == 0)
        rows += [" ".join(changed(rng, base, rng.choice([0, 1, 1, 2, 3]), vocabulary)) for _ in range(rng.choice([1, 3, 12]))]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows += [" ".join(changed(rng, base, rng.choice([0, 1, 2, 4]), vocabulary)) for _ in range(400)]  # a hot group, links near the limit
    rows += ["word " * 3000, "WORD " * 3000, "X", "x", None, "", " \t", "A b", "a  B"]
    return [(k, t) for k, t in enumerate(rows)] + [(None, rows[5]), (5, "y z"), (None, "nobody else")]


@pytest.mark.parametrize("hot", [32, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT_LOCAL", hot)
    monkeypatch.setattr(jaccard, "GROUP", 32 if hot == 4 else jaccard.GROUP)
    rows = jaccard_rows()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string")
    assert ordered(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == ordered(brute_jaccard(rows))


def test_jaccard_crowded_tokens_join_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "GROUP", 32)
    made = {}
    keep = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, tag: made.setdefault(tag, keep(df, tag)) if tag in ("met", "matrix-rows") else keep(df, tag))
    rows = jaccard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == ordered(brute_jaccard(rows))
    crowded = made["matrix-rows"].where("crowded")
    assert crowded.count() > 0 and made["met"].count() <= crowded.select("run").distinct().count() ** 2


def test_jaccard_small_tables(spark):
    for rows in ([], [(1, None)], [(1, "a b c d e f")], [(None, "a"), (None, "a")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert ordered(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == ordered(brute_jaccard(rows))


def test_jaccard_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(tuple(r) for r in QUERIES["op13_jaccard"](spark, SF).collect()) == ordered(brute_jaccard(rows))


# ------------------------------------------------------------------ 2 and 8
def test_words_with_equal_polynomials_are_no_repeat(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    start = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{start} {word}"), (2, f"{start} {other}")], "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_repeats(docs).collect()} == {0}


def test_urls_are_judged_whole(spark):
    ruled = [(k, f"https://{'good' if k % 2 else 'bad'}{k}.{'org/fr' if k % 2 else 'net'}/{'library-of-books' if k % 2 else 'casino-win-free'}?q={'reading' if k % 2 else 'bets'}") for k in range(60)]
    probes = [(101, "https://c.info/out?to=casino-win-free-bets"), (102, "https://c.info/out?to=library-of-books"), (103, "casino-win-free"), (104, "library-of-books"),
              (105, None), (106, ""), (107, "https://c.info/" + "casino-win-free" * 20_000)]
    got = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(ruled + probes, "page_id long, url string")).collect()}
    assert [got[k].verdict for k in (101, 102, 103, 104, 107)] == ["block", "allow", "block", "allow", "block"]
    assert got[105].verdict == got[106].verdict and got[105].host == got[105].path == ""
    assert "op8_url_filter" in ORACLE
