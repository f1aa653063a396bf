"""Each operator against a brute-force version on small rows that hold every odd case."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowgauge.llm import bpe, decontam, exact, langid, pii, quality, queries, simhash, substring, toxicity, urlfilter
from flowgauge.llm.queries import tokenizer_path

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, extra=True):
    """(doc_id, text) rows as documents, with columns whose names clash with the operators' own."""
    schema = "doc_id long, text string"
    df = spark.createDataFrame(rows, schema)
    if extra:
        for name in ("uid", "kept", "score", "fp", "component_id", "n", "found", "lang_pred", "at", "h", "base", "spans", "stats", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


def odd_rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "naïve", "日本", "a.b", "x́", "İstanbul"]
    long_text = " ".join(rng.choice(words) for _ in range(9000))
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = [
        (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "one two"), (6, "One Two"), (7, "one two"), (7, "one two"),
        (8, long_text), (9, long_text.upper()), (10, "head " + passage + " tail"), (11, passage), (12, "other start " + passage),
        (None, "one two"), (None, passage), (13, "same " * 130), (14, "x " + "same " * 90), (15, "ab cd " * 60), (16, "cd " + "ab cd " * 55), (16, passage + " twice"),
        (17, "\u000b\u000cé É"), (18, "é é"), (19, "<|endoftext|> a<|startoftext|>b"), (20, "don't we'll x y"),
    ]
    for k in range(21, 60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 160))]
        if k % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split()[rng.randint(0, 15) : rng.randint(52, 70)]
        rows.append((k, " ".join(body)))
    return rows


ROWS = odd_rows()


def test_exact_against_brute_force(spark):
    got = exact.exact_duplicates(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for d, t in ROWS:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_separates_collisions(spark):
    """With one tiny prime almost everything collides; the chunkwise comparison still tells texts apart."""
    rows = [(k, t) for k, t in enumerate(["ab", "ba", "cd", "AB", "dc", "ab", "", None, "zz" * 9000, "zz" * 9000, "zy" + "zz" * 8999])]
    weak = {r.doc_id: r for r in exact.exact_duplicates(frame(spark, rows), primes=(3,)).collect()}
    strong = {r.doc_id: r for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    for k in weak:
        assert (weak[k].keep_id, weak[k].group_size, weak[k].kept) == (strong[k].keep_id, strong[k].group_size, strong[k].kept)
    assert weak[0].keep_id == 5 and weak[8].keep_id == 9 and weak[10].group_size == 1 and weak[6].keep_id == 7


def test_polynomial_composes():
    poly = exact.polynomial(exact.PRIMES)
    data = bytes(np.random.default_rng(1).integers(0, 256, 50_001, dtype=np.uint8))
    for p, b, column in zip(poly.primes, poly.bases, range(4), strict=True):
        direct = 0
        for byte in data[:20_000]:
            direct = (direct * b + byte) % p
        hashes = poly.chunk_hashes(data[:20_000])
        total = [0] * 4
        for h, n in hashes:
            total = poly.compose(total, h, n)
        assert total[column] == direct
    assert poly(data[:3]) != poly(data[:4]) and poly(b"") == (0, 0)


def test_drop_duplicates_keeps_columns(spark):
    out = exact.drop_duplicates(frame(spark, ROWS))
    assert out.columns == frame(spark, ROWS).columns
    assert out.count() == len({(t or "").translate(LOWER) for _, t in ROWS})


def brute_simhash(text, k=3):
    words = SPACES.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(values))]


def test_simhash_against_brute_force(spark):
    got = simhash.near_duplicates(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    prints = [brute_simhash(t) for _, t in ROWS]
    roots = brute_components(prints, 2)
    smallest = {}
    for (d, _), r in zip(ROWS, roots, strict=True):
        if d is not None:
            smallest[r] = min(d, smallest.get(r, d))
    expected = sorted((str(d), p, str(smallest.get(r))) for (d, _), p, r in zip(ROWS, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == expected


@pytest.mark.parametrize("limit", [20_000, 5])
def test_simhash_links_in_dense_cells(spark, limit):
    """Chains and balls of close fingerprints, also when every cell must be dealt again."""
    rng = random.Random(limit)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for _ in range(150):
        v = centre
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        values.add(chain)
        chain ^= 3 << b
    values = sorted(values)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.links(fps, 2, limit)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    expected = brute_components(values, 2)
    groups = {}
    for v, r in zip(values, expected, strict=True):
        groups.setdefault(r, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def brute_substring(rows, window):
    docs = [(d, SPACES.findall(t or "")) for d, t in rows]
    low = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                low[key] = min(d, low.get(key, d))
    out = []
    for d, w in docs:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substring_against_brute_force(spark, window):
    got = substring.remove_repeats(frame(spark, ROWS), window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(ROWS, window)


def test_word_names_tell_words_apart(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\u000bé") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["x" * 5000]
    blobs = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, blobs)])
    words = [b.split() for b in blobs]
    for size in (1 << 20, 64):
        monkeypatch.setattr(substring, "BYTES", size)
        names, bounds = substring.word_names(data, offsets)
        assert np.diff(bounds).tolist() == [len(w) for w in words]
        flat = [w for part in words for w in part]
        assert len(set(zip(flat, names.tolist(), strict=True))) == len(set(flat)) == len(set(names.tolist()))


def test_equal_windows_have_equal_symbols():
    """The representative of a window depends on its words alone."""
    rng = random.Random(9)
    common = [rng.choice("abc") for _ in range(80)]
    seen = {}
    for _ in range(60):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 40))] + common + [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]
        data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        names, _ = substring.word_names(data, np.array([0, len(data)]))
        symbol, first, n = substring.representatives(names, np.zeros(len(words), dtype=int), np.full(len(words), len(words)), 50)
        for s, f, count in zip(symbol.tolist(), first.tolist(), n.tolist(), strict=True):
            for p in range(f, f + count):
                assert seen.setdefault(tuple(words[p : p + 50]), s) == s


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [*ROWS, (90, "x" * 5000), (91, "éÉ́  <|endoftext|>" * 300), (92, "a　b\x85c"), (93, "\U0001f600🇩🇪 ﬁ Ⅷ ½")]
    got = bpe.encode(frame(spark, rows), tokenizer_path()).collect()
    expected = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((str(d), len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in got) == sorted(expected)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = {(str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(frame(spark, rows), tokenizer_path()), tokenizer_path()).collect()}
    assert back == {(x[0], x[3]) for x in expected}


def test_bpe_store_forgets_without_effect(monkeypatch):
    work = bpe.ChunkEncoder(tokenizer_path())
    texts = [t or "" for _, t in ROWS]
    first = [x.tolist() for x in work.encode(texts)]
    work.words.limit = work.chunks.limit = 1
    again = [[x.tolist() for x in work.encode([t])][0] for t in texts * 2]
    assert again == first * 2


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def brute_base(text):
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text or ""):
            number = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(number) <= 19 and luhn(number), "phone": 8 <= len(number) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
            "+1 (017) 555-7713", "+49 30 1234567", "+1", "++12 34 5678", "12", "0000.0.0.000", "é", "日本", "\n", " ", ",", "a@b.c+d@e.f", "5 5 5", "-", "(", "\U0001f600", "call me at", "phone", "john at mail dot com", "(030) 555-1234", "2001:db8::1:2:3:4", "visa 4111 1111 1111 1111 0"]
    rows = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    rows += [(400, None), (401, ""), (None, "a@b.c"), (402, "9" * 30_000), (403, "a" * 30_000 + "@"), (404, "1 " * 20_000), (404, "1.2.3.4 " * 500), (405, "+1" + "(" * 20_000), (406, "a@" * 5000)]
    got = pii.personal_data(frame(spark, rows)).collect()
    expected = {}
    for d, t in rows:
        expected.setdefault(str(d), []).append(brute_base(t))
    assert len(got) == len(rows)
    for r in got:
        options = [b for b in expected[str(r.doc_id)] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256]
        assert options, r
        base = options[0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added


def test_pii_adds_what_the_labelers_support(spark):
    rows = [(k, f"please call phone (030) 555-{1000 + k} or mail jane{k} at example dot com now, host 10.0.{k % 200}.7, tel +1 (555) 555-{1000 + k}") for k in range(60)]
    rows += [(100 + k, "plain words at home. nothing here, version 3.1 of order 12") for k in range(60)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[k].n_added >= 1 for k in range(60))
    assert all(got[100 + k].spans == "" for k in range(60))


def test_pii_classifier_is_plain_arithmetic():
    counts = {(0, 1, 1, 1, 1, 1, 3): 50, (0, 0, 1, -1, 0, 1, 1): 5, (0, 0, -1, -1, -1, -1, 0): 40}
    posterior, right = pii.expectation_maximisation(counts)
    assert posterior[(0, 1, 1, 1, 1, 1, 3)] > 0.9 and posterior[(0, 0, -1, -1, -1, -1, 0)] < 0.1
    assert all(0 < p < 1 for pair in right.values() for p in pair)
    assert pii.expectation_maximisation({}) == ({}, {})


def test_urls_against_rules(spark):
    rows = [
        (1, "https://Www.A.example.net/en/1?x=1"), (2, "http://net/"), (3, "http://net"), (4, "http://x.net#y"), (5, "http://example.com/de/"), (6, "http://b.example.com/de"),
        (7, "https://foo.org/fr/z#t"), (8, None), (9, ""), (10, "no scheme"), (11, "http://badexample.net/en/"), (12, "ftp://u:p@h.org:80/fr/?q=://b.net/"), (12, "http://x.com/e\nn/"), (None, "http://x.com/e"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("uid", F.lit(1)).withColumn("rule", F.lit("r")).withColumn("gram", F.lit("g"))
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urlfilter.judged(df).collect()}
    assert len(got) == len(rows)
    assert got[1, "www.a.example.net", "/en/1"] == ("example.net/en/", "allow")
    assert got[2, "net", "/"] == ("net/", "block")
    assert got[3, "net", ""][0] is None and got[4, "x.net", ""][0] is None
    assert got[5, "example.com", "/de/"] == ("example.com/de/", "block")
    assert got[6, "b.example.com", "/de"][0] is None
    assert got[7, "foo.org", "/fr/z"] == ("org/fr/", "allow")
    assert got[8, "", ""][0] is None and got[10, "", ""][0] is None
    assert got[11, "badexample.net", "/en/"] == ("net/", "block")
    assert got[12, "u:p@h.org:80", "/fr/"][0] is None
    assert got[12, "x.com", "/e\nn/"][0] is None
    assert {v for _, v in got.values()} <= {"allow", "block"}


def test_urls_follow_the_models(spark):
    rules = (urlfilter.Rule("good.test", "/", "allow"), urlfilter.Rule("bad.test", "/", "block"))
    rows = [(k, f"http://good.test/garden/roses{k}") for k in range(40)] + [(100 + k, f"http://bad.test/casino/jackpot{k}") for k in range(40)]
    rows += [(200, "http://new.site/garden/roses"), (201, "http://new.site/casino/jackpot")]
    got = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[200] == "allow" and got[201] == "block"


QUESTION = "A train with 12 wagons leaves at dawn, and Maria pays 30 euros for 4 tickets while Peter walks 7 km beside the river"


def test_decontamination_finds_templates(spark):
    other = "an honest farmer counts all his sheep before night falls over the quiet hills of the north"
    short = "seven grey cats sleep"
    bench = spark.createDataFrame([(1, QUESTION), (2, other), (3, short), (4, None), (5, ""), (6, "12 13 14 15 16 17 18 19 20 21")], "item_id long, text string").withColumn("uid", F.lit(0))
    changed = QUESTION.replace("12", "99").replace("Maria", "Olga").replace("30", "55").replace("4 tickets", "8 tickets").replace("7 km", "3 km").replace("Peter", "Ivan")
    mixed = QUESTION.replace("Maria", "Peter")
    words = other.split()
    rows = [
        (1, "intro words. " + QUESTION + " and more."), (2, changed), (3, mixed), (4, "x | " + other.upper() + " | y"), (5, "they say seven grey cats sleep there"),
        (6, None), (7, ""), (8, " ".join(words[:5]) + " something else " + " ".join(words[9:12])), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (10, "plain clean text without any of it"), (1, other), (None, other),
        (11, "word " * 20_000 + other),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (5, 3), (1, 2), (None, 2), (11, 2)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 6
    assert got[4, 2].n_matched == got[4, 2].n_windows
    kept = decontam.drop_leaks(frame(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "6", "7", "8", "9", "10"])
    assert kept.columns == frame(spark, rows).columns
    assert decontam.leaks(frame(spark, rows), bench.limit(0)).count() == 0
    by_shuffle = decontam.BROADCAST_WINDOWS
    decontam.BROADCAST_WINDOWS = 0
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), bench).collect()} == set(got)
    finally:
        decontam.BROADCAST_WINDOWS = by_shuffle


def test_decontamination_of_names_anywhere(spark):
    tom = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now?"
    bench = spark.createDataFrame([(1, tom), (2, QUESTION)], "item_id long, text string")
    ann = tom.replace("Tom", "Ann").replace("3", "4").replace("5", "7")
    wrapped = re.sub(r" (?=[A-Z])", "\n", QUESTION)
    rows = [
        (1, ann), (2, "seen: \"" + ann + "\""), (3, tom.lower().replace("3", "4")), (4, tom.upper()), (5, wrapped), (6, QUESTION.lower()), (7, wrapped.lower()),
        (8, wrapped.replace("Maria", "Olga").replace("Peter", "Ivan")), (9, ann.replace("Ann buys", "Bob buys")), (10, "Clean Text. With Names. Of All. Kinds And. No Question. At All."),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2)}
    assert all(r.n_matched == r.n_windows for r in got.values())
    assert got[1, 1].n_changed == 5 and got[3, 1].n_changed == 1 and got[4, 1].n_changed == got[7, 2].n_changed == 0 and got[8, 2].n_changed == 2


def test_decontamination_of_items_full_of_slots(spark):
    numbers, names, sums, refrain = "12 13 14 15 16 17 18 19 20 21", "Anna, Berta, Carl, Dora, Emil, Frida, Gustav, Hanna, Ida", "2 + 3 = 5, 4 + 9 = 13, 5 + 6 = 11 and 7 + 8 = 15", "la la la la la la la la la la"
    mostly = "add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 then tell all your very good friends about them"
    bench = spark.createDataFrame(list(enumerate([numbers, names, sums, refrain, mostly], 1)), "item_id long, text string")
    rows = [
        (1, "row: " + numbers.replace(" ", "\n") + " end"), (2, "Present were " + names), (3, sums.replace(" + ", "+")), (4, "sing " + refrain), (5, mostly),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (7, "12 13 14 15 16 17 18 99 20 21"), (8, "3 + 2 = 5, 9 + 4 = 13, 6 + 5 = 11 and 8 + 7 = 15"), (9, "do re do re do re do re do re"), (10, "Otto, Paul, Rita, Sara, Toni, Ulla, Vera, Willi, Xaver"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)}
    assert all(r.n_matched == r.n_windows and r.n_changed == 0 for r in got.values())
    assert got[1, 1].n_windows == 3 and got[5, 5].n_windows == 18


def test_segments_against_recursion():
    rng = np.random.default_rng(0)

    def slow(x, lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += x[j]
                if total > 0 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        return [] if best is None else slow(x, lo, best[0]) + [best] + slow(x, best[1], hi)

    for _ in range(200):
        x = rng.normal(-0.2, 1, rng.integers(0, 25))
        assert [s[:2] for s in toxicity.segments(x)] == [s[:2] for s in slow(x, 0, len(x))]


def labelled(seed=3, n=600):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = k % 8 == 0
        if bad:
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(["nasty", "awful", "vile"]) for _ in range(4)]
        docs.append((k, " ".join(body)))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_tokens_of_any_script():
    words = lambda text: [w.decode() for w in toxicity.tokens(text)]
    assert words("You \u201cIdiot\u201d\u2014go\u00a0away\uff01 snake_case don't x2") == ["you", "idiot", "go", "away", "snake", "case", "don", "t", "x2"]
    assert words("naïve Ünder cafe\u0301s, हिन्दी") == ["naïve", "ünder", "cafe\u0301s", "हिन्दी"]
    assert words("你好，世界abc。カナ") == ["你", "好", "世", "界", "abc", "カ", "ナ"]
    assert words(None) == words("") == words("\u2014 !") == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    given = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, label int")
    df = frame(spark, [*docs, (1000, None), (1001, ""), (None, "nasty vile awful nasty"), (1002, "word1 " * 30_000 + "vile awful nasty vile")])
    model = toxicity.train(df, given)
    out = df.select("doc_id", toxicity.judge(F.col("text"), model, df).alias("t")).collect()
    scores = {r.doc_id: r.t.score for r in out}
    assert len(out) == len(docs) + 4 and all(0 <= r.t.score <= 1 for r in out)
    right = [(scores[k] >= 0.3) == bool(y) for k, y in labels if k % 3 == 0]
    assert sum(right) / len(right) > 0.97
    assert scores[None] > 0.3 and scores[1002] > 0.3 and scores[1000] == scores[1001] < 0.3
    assert [r.t.n_passages for r in out if r.doc_id == 1002] == [1]


def test_toxicity_counts_cover_rows_beyond_the_sample(spark, monkeypatch):
    docs, labels = labelled(n=2400)
    docs = [(k, text + " seldom" * 3 if k % 120 == 0 else text) for k, text in docs]  # toxic texts only
    docs.append((5000, "word1 " * 20 + "seldom seldom seldom seldom"))
    tables = {"documents": frame(spark, docs), "labels": spark.createDataFrame(labels, "doc_id long, toxic int")}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: tables[name])
    monkeypatch.setattr(toxicity, "LABELS", 200)
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, "").collect()}
    assert len(got) == len(docs) and got[5000].passages == "20-24" and got[5000].predicted == 1
    right = [got[k].predicted == y for k, y in labels if got[k].held_out]
    assert sum(right) / len(right) > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_classifiers_without_both_kinds(spark, labels):
    docs = frame(spark, ROWS)
    given = spark.createDataFrame(labels, "doc_id long, label int")
    share = sum(y for _, y in labels) / len(labels) if labels else 0.5
    model = toxicity.train(docs, given)
    assert {r.t.score for r in docs.select(toxicity.judge(F.col("text"), model, docs).alias("t")).collect()} == {share}
    stats = quality.with_statistics(docs)
    fitted = quality.train(stats, given)
    assert {r.s for r in stats.select(quality.score(F.col("stats"), fitted, stats).alias("s")).collect()} == {share}


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    words = ["the", "of", "and", "river", "house", "walking", "evening", "quiet", "letters", "garden"]
    docs, labels = [], []
    for k in range(800):
        body = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        bad = k % 4 == 0
        text = "".join(w + rng.choice(["### ", "&&& ", " | "]) for w in body) if bad else " ".join(body) + "."
        docs.append((k, text))
        labels.append((k, int(not bad)))
    df = frame(spark, [*docs, (1000, None), (1001, ""), (1002, "a" * 100_000)])
    stats = quality.with_statistics(df)
    model = quality.train(stats, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, label int"))
    scores = {r.doc_id: r.s for r in stats.select("doc_id", quality.score(F.col("stats"), model, stats).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1000] == scores[1001]
    right = [(scores[k] >= 0.7) == bool(y) for k, y in labels if k % 3 == 0]
    assert sum(right) / len(right) > 0.97


def test_isotonic_fit_is_monotone():
    fitted = quality.isotonic(np.array([0.3, 0.1, 0.2, 0.4]), np.array([1.0, 2.0, 0.0, 3.0]), np.array([4.0, 4.0, 4.0, 4.0]))
    assert fitted[[1, 2, 0, 3]].tolist() == [0.25, 0.25, 0.25, 0.75]


def test_language_on_held_out_rows(spark):
    texts = {"en": "the quick brown fox thinks that there is nothing better than another morning with tea", "de": "der schnelle braune Fuchs glaubt dass es nichts Schöneres gibt als einen Morgen", "fr": "le renard brun pense que rien ne vaut une autre matinée avec du thé à la maison"}
    rng = random.Random(6)
    rows = []
    for k in range(600):
        lang = rng.choice(sorted(texts))
        words = texts[lang].split()
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))), lang))
    rows += [(700, None, "en"), (701, "", "de"), (702, "12 !! 34", "fr"), (703, "the morning", None), (None, "the morning with tea", "en"), (704, "the tea " * 60_000, "en"), (705, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("pick", F.lit(1))
    model = langid.train(df.where("doc_id % 4 != 0 or doc_id is null"))
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict(F.col("text"), model, df).alias("p")).collect()}
    held = [(k, lang) for k, _, lang in rows[:600] if k % 4 == 0]
    assert sum(got[k].lang_pred == lang for k, lang in held) / len(held) > 0.97
    assert [got[k].lang_pred for k in (700, 701, 702)] == ["und"] * 3 and got[700].score == 0
    assert got[703].lang_pred == "en" and got[704].lang_pred == "en" and got[705].lang_pred in texts
    assert all(0 <= p.score <= 1 for p in got.values())
    empty = langid.train(df.limit(0))
    assert {r.p.lang_pred for r in df.select(langid.predict(F.col("text"), empty, df).alias("p")).collect()} == {"und"}


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Äpfel und Birnen, " * 40
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.gram_counts(text) == whole).all()


def test_empty_tables(spark):
    docs = frame(spark, ROWS).limit(0)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert exact.exact_duplicates(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0
    assert bpe.encode(docs, tokenizer_path()).count() == 0
    assert pii.personal_data(docs).count() == 0
    assert decontam.leaks(docs, spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).count() == 0
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert docs.select(toxicity.judge(F.col("text"), toxicity.train(docs, none), docs)).count() == 0
    stats = quality.with_statistics(docs)
    assert stats.select(quality.score(F.col("stats"), quality.train(stats, none), stats)).count() == 0
