"""Personal data by weak supervision (operator 4, native).

Base spans are found by fixed patterns, leftmost and non-overlapping for each
kind, then checked (parts of an ip at most 255, Luhn digit of a card, number of
digits); matches that fail are dropped without a retry. They are always kept.

Looser patterns give further candidates: e-mail addresses with spelled-out signs,
national phone numbers, grouped card numbers, ip addresses with a port or of the
longer form. Labelers vote on every candidate, base spans included: the strict
pattern, a check of digits or parts, a gazetteer (top-level domains, card
issuers, country codes, reserved networks), the words before it, and its borders.
Votes are +1, -1 or 0 (no opinion). Expectation-maximisation over the counted
vote patterns estimates each labeler's reliability and the share of true spans
of each kind; its posteriors train a logistic span classifier over votes and
shape. Both see only the table of distinct patterns, which is bounded
(4 kinds * 3^5 votes * 8 shapes). Candidates at ``ACCEPT`` or more are added if
they do not touch a base span or an earlier addition of their kind.

A null text counts as empty. Rows are judged one by one, so ties and repeated
rows change nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of, stored

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
BEFORE = 40
#: Voters and their opinion before any data: chance to be right if they speak.
LABELERS = ("strict", "check", "gazetteer", "context", "border")

# A run of local-part characters is entered at its start or where the last match
# ended; possessive loops give the same matches as plain ones and never go back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}+:){3,7}+:?[0-9a-f]{1,4}+(?![0-9a-f:.])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20.\xA0-]{1,2}[0-9]{4}){2,3}+(?:[\x20.\xA0-]{1,2}[0-9]{1,3})?+(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:00[0-9]{1,3}[\x20.-])?+(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9.-])",
}
# Cheap test that a text can hold the pattern at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
LOOSE_NEEDS = {"email": "(?i)(?:\\x20|\\[|\\()at(?:\\x20|\\]|\\))", "ip": "(?i)[0-9a-f]:[0-9a-f]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}

# Gazetteers and cue words (fixed values).
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|us|ca|au|ch|at|be|se|no|dk|pl|pt|ru|jp|cn|in|br|mx|co|me|dev|app"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
COUNTRIES = r"^\+?(?:00)?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|correo|courriel|kontakt)[^\n]{0,30}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|from|adresse|direcci)[^\n]{0,30}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|karte|carte|tarjeta)[^\n]{0,30}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon|téléphone|teléfono)[^\n]{0,30}$",
}
DOUBTS = r"(?i)(?:version|release|build|isbn|order|invoice|serial|hash|commit|part no|sku|article|section|figure)[^\n]{0,20}$"


def spans(text: Column, pattern: str, needs: str, valid) -> Column:
    """Array of (start, end, value) of the matches that pass ``valid``, in code points.

    Pieces between matches and matches alternate, so their lengths add up to
    the positions in one pass.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    possible = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        found = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), z["hit"].alias("value"))
        good = z["hit"].isNotNull() & F.coalesce(valid(z["hit"]), F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(good, F.array_append(state["found"], found)).otherwise(state["found"]).alias("found"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))
    return F.when(possible, F.aggregate(pieces, first, step, lambda s: s["found"])).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn."""
    mirrored = F.split(F.reverse(number), "")
    places = F.transform(mirrored, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def ip_parts(value: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    # leading zeros may eat a part that is zero; those parts are matched by 0++
    part = f"(?:0++(?![0-9])|{part})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _count_between(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": ip_parts,
    "card": lambda v: F.when(_count_between(v, 16, 19), luhn(digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: _count_between(v, 8, 15),
}


def _vote(yes: Column, no: Column | None = None) -> Column:
    found = F.when(F.coalesce(yes, F.lit(False)), 1)
    if no is not None:
        found = found.when(F.coalesce(no, F.lit(False)), -1)
    return found.otherwise(0)


def votes(kind: str, text: Column, span: Column, strict: bool) -> Column:
    """Struct of the labelers' votes and the shape number of a candidate."""
    value = span["value"]
    from_ = F.greatest(span["start"] - BEFORE, F.lit(0))
    before = F.substring(text, (from_ + 1).cast("int"), (span["start"] - from_).cast("int"))
    ahead = F.substring(text, (span["end"] + 1).cast("int"), F.lit(1))
    number = digits(value)
    if kind == "email":
        check = _vote(value.rlike(r"(?i)[a-z]") & (F.length(value) <= 254), F.length(value) > 254)
        gazetteer = _vote(value.rlike(rf"(?i)(?:\.|dot\)?\]?\x20?)(?:{DOMAINS})$"), F.lit(True))
        shape = F.when(value.rlike("[0-9]"), 1).otherwise(0) + F.when(value.rlike(r"[._%+-].*(?:@|at)"), 2).otherwise(0)
    elif kind == "ip":
        check = _vote(ip_parts(value) | value.rlike("^[0-9a-fA-F:]{8,39}$"), F.lit(True))
        gazetteer = _vote(~value.rlike(r"^(?:0|127|255)\."), F.lit(True))
        shape = F.when(value.contains(":"), 1).otherwise(0) + F.when(F.length(value) > 9, 2).otherwise(0)
    elif kind == "card":
        check = _vote(_count_between(value, 13, 19) & luhn(number), F.lit(True))
        gazetteer = _vote(number.rlike(ISSUERS), F.lit(True))
        shape = F.when(value.rlike("[^0-9]"), 1).otherwise(0) + F.when(F.length(number) == 16, 2).otherwise(0)
    else:
        check = _vote(_count_between(value, 8, 15), F.lit(True))
        gazetteer = _vote(value.rlike(COUNTRIES), F.lit(None).cast("boolean"))
        shape = F.when(value.startswith("+"), 1).otherwise(0) + F.when(value.contains("("), 2).otherwise(0) + F.when(F.length(number) >= 10, 4).otherwise(0)
    context = _vote(before.rlike(CUES[kind]), before.rlike(DOUBTS))
    border = _vote((~before.rlike(r"[\p{L}\p{N}]$")) & (~ahead.rlike(r"^[\p{L}\p{N}]")), F.lit(True))
    return F.struct(F.lit(1 if strict else 0).alias("strict"), check.alias("check"), gazetteer.alias("gazetteer"), context.alias("context"), border.alias("border"), shape.alias("shape"))


def _voted(kind: str, strict: bool):
    def run(s: Column) -> Column:
        place = [F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")]
        return F.struct(*place, F.lit(strict).alias("base"), votes(kind, F.col("text"), s, strict).alias("votes"))

    return run


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): base and loose spans of every row with kind, votes and shape."""
    rows = documents_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    columns = []
    for kind in KINDS:
        rows = rows.withColumn(f"base_{kind}", spans(F.col("text"), PATTERNS[kind], NEEDS[kind], VALID[kind]))
        rows = rows.withColumn(f"loose_{kind}", spans(F.col("text"), LOOSE[kind], LOOSE_NEEDS[kind], lambda v: F.lit(True)))
        for part in ("base", "loose"):
            columns.append(F.transform(f"{part}_{kind}", _voted(kind, part == "base")))
    return rows.select("doc_id", F.concat(*columns).alias("found"))


FIELDS = (*LABELERS, "shape")
Pattern = tuple[int, ...]


def expectation_maximisation(counts: dict[Pattern, int], rounds: int = 60) -> tuple[dict[Pattern, float], dict[tuple[int, int], tuple[float, float]]]:
    """Posterior of each vote pattern (kind, votes..., shape), and reliabilities.

    Reliabilities are, for each kind and labeler, the chances to be right about true
    and about false candidates when it speaks; they start from a labeler that is
    right in 8 of 10 cases, with the weight of ten candidates.
    """
    kinds = {p[0] for p in counts}
    prior = {k: 0.5 for k in kinds}
    right = {(k, j): (0.8, 0.8) for k in kinds for j in range(len(LABELERS))}
    posterior: dict[Pattern, float] = {}
    for _ in range(rounds):
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]]))
            for j in range(len(LABELERS)):
                yes, no = right[p[0], j]
                if p[1 + j] > 0:
                    odds += math.log(yes / (1 - no))
                elif p[1 + j] < 0:
                    odds += math.log((1 - yes) / no)
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in kinds:
            mine = [p for p in counts if p[0] == k]
            total = sum(counts[p] for p in mine)
            prior[k] = (sum(counts[p] * posterior[p] for p in mine) + 5) / (total + 10)
            for j in range(len(LABELERS)):
                said = [(p[1 + j], counts[p] * posterior[p], counts[p] * (1 - posterior[p])) for p in mine if p[1 + j]]
                yes = (8 + sum(t for v, t, _ in said if v > 0)) / (10 + sum(t for _, t, _ in said))
                no = (8 + sum(f for v, _, f in said if v < 0)) / (10 + sum(f for *_, f in said))
                right[k, j] = (yes, no)
    return posterior, right


def features(pattern: Pattern) -> list[float]:
    """Constant, then for / against of each labeler, then shape bits."""
    out = [1.0]
    for v in pattern[1 : 1 + len(LABELERS)]:
        out += [float(v > 0), float(v < 0)]
    return out + [float(pattern[-1] >> b & 1) for b in range(3)]


def span_classifier(counts: dict[Pattern, int], posterior: dict[Pattern, float], kind: int, rounds: int = 400) -> list[float]:
    """Logistic weights on the posteriors of one kind, by gradient steps over its distinct patterns."""
    rows = [(features(p), posterior[p], counts[p]) for p in counts if p[0] == kind]
    size = 1 + 2 * len(LABELERS) + 3
    weights = [0.0] * size
    total = sum(n for *_, n in rows) or 1
    for step in range(rounds):
        slope = [0.02 * w for w in weights]
        slope[0] = 0.0
        for x, y, n in rows:
            miss = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - y)
            for k, a in enumerate(x):
                if a:
                    slope[k] += miss * a
        rate = 4.0 / (1 + step / 100)
        weights = [w - rate * g for w, g in zip(weights, slope, strict=True)]
    return weights


def _probability(vote: Column, weights: list[float]) -> Column:
    terms = [F.lit(weights[0])]
    for j, name in enumerate(LABELERS):
        terms += [F.when(vote[name] > 0, weights[1 + 2 * j]).otherwise(0.0), F.when(vote[name] < 0, weights[2 + 2 * j]).otherwise(0.0)]
    first = 1 + 2 * len(LABELERS)
    for b in range(3):
        terms.append(F.when(vote["shape"].bitwiseAND(1 << b) > 0, weights[first + b]).otherwise(0.0))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def _listed(found: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    texts = F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per row of ``docs``.

    The counts are those of the base spans.
    """
    found = stored(candidates(docs), "candidates")
    every = found.select(F.explode("found").alias("s")).groupBy(F.col("s.kind").alias("kind"), *[F.col(f"s.votes.{f}").alias(f) for f in FIELDS]).agg(F.count("*").alias("n"))
    counts = {tuple(r[f] for f in ("kind", *FIELDS)): r["n"] for r in every.collect()}  # distinct patterns only
    posterior, _ = expectation_maximisation(counts)
    weights = [span_classifier(counts, posterior, k) for k in range(len(KINDS))]

    def chance(s: Column) -> Column:
        found = F.lit(0.0)
        for k, w in enumerate(weights):
            found = F.when(s["kind"] == k, _probability(s["votes"], w)).otherwise(found)
        return found

    base = F.filter("found", lambda s: s["base"])
    sure = F.filter("found", lambda s: (~s["base"]) & (chance(s) >= accept))
    rows = found.select("doc_id", base.alias("base"), F.array_sort(sure).alias("sure"))

    def touches(s: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["kind"] == s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]))

    added = F.filter("sure", lambda s: ~touches(s, F.col("base")))
    rows = rows.select("doc_id", "base", added.alias("added"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
