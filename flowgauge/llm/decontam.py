"""Benchmark decontamination by template canonicalisation (operator 1, native).

Texts become tokens (runs of letters and digits; a decimal point or comma
between digits belongs to the number), lower-cased. Templates replace numbers,
numbers with a unit and units after a number by typed placeholders. Names are
judged in three forms, since no one form fits both copies and originals: names as
they are (a copy in another case, or wrapped at other places, has the same words),
capitalised words inside a sentence as slots, and all capitalised words as slots,
wherever they stand (a question with other names). Windows of ``window`` template
tokens of all documents are hash-joined with those of the benchmark, form by
form; a match must agree token by token. For each document, item and alignment
the values in the slots must map one to one: an item's value stands for the same
value of the document wherever it occurs, and different values stay different
(case aside). Alignments are judged with and without the third form, as the first
word of a sentence may be changed where it is no name. A document leaks an item if
consistent matches cover at least ``coverage`` of the item's windows.

An item of fewer tokens than a window is one window of its own length. Windows
with fewer than ``literals`` ordinary or different tokens (but whole short items)
say nothing as templates; they are joined on their values, so rows of numbers and
repeated words match copies word for word only. The benchmark side is broadcast up to
``BROADCAST_WINDOWS`` windows, counted first; beyond that both sides are shuffled
by the hash. A copy that changes names and drops their capitals at once is found
only by its windows without names.

Null texts and empty ones have no tokens; repeated rows are judged each for
itself; extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of, stored, with_row_id

WINDOW = 8
COVERAGE = 0.5
LITERALS = 4
BROADCAST_WINDOWS = 200_000

# Placeholders; letters of no script in use, so no token of a text equals one.
NUMBER, QUANTITY, UNIT, NAME = "\u0002d", "\u0002q", "\u0002u", "\u0002n"
_MARK, _CAPITAL = "\u0001", "\u0003"  # before a name inside a sentence; before any other capitalised word
#: Units (fixed values).
UNITS = "mm|cm|dm|m|km|mg|g|kg|t|ml|cl|l|s|ms|min|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?|usd|eur|gbp|dollars?|euros?|pounds?|percent|inch|inches|ft|feet|miles?|mph|kmh|kw|kwh|w|v|a|hz|khz|mhz|ghz|kb|mb|gb|tb"


def _if_it_has(text: Column, part: str, changed: Column) -> Column:
    """``changed`` where the text holds ``part``; a plain search spares most texts the pattern."""
    return F.when(text.contains(part), changed).otherwise(text)


def cleaned(text: Column, digits: Column) -> Column:
    """Tokens with their values, separated by spaces; capitalised words carry a mark."""
    named = F.regexp_replace(text, r" (?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", " " + _MARK)
    numbers = r"(?:[^\p{L}\p{N}" + _MARK + r".,]|[.,](?![0-9])|(?<![0-9])[.,])++"
    plain = r"[^\p{L}\p{N}" + _MARK + "]+"
    words = F.trim(F.when(digits, F.regexp_replace(named, numbers, " ")).otherwise(F.regexp_replace(named, plain, " ")))
    return F.lower(F.regexp_replace(words, r"(?=\p{Lu})(?<![^ ])", _CAPITAL))


def template(clean: Column, digits: Column) -> Column:
    """The tokens of ``clean`` with placeholders for numbers and units, one for one; marks stay."""
    n = F.regexp_replace(clean, r"(?<![^ ])[0-9][0-9.,]*+(?![^ ])", NUMBER)
    n = F.regexp_replace(n, r"(?<![^ ])[0-9][0-9.,]*+(?:" + UNITS + r")(?![^ ])", QUANTITY)
    n = F.regexp_replace(n, "(?<=" + NUMBER + " )" + _CAPITAL + "?(?:" + UNITS + ")(?![^ ])", UNIT)
    return F.when(digits, n).otherwise(clean)


def _bare(marked: Column, marks: str = _MARK + _CAPITAL) -> Column:
    return F.translate(marked, marks, "")


def _slots(marked: Column, marks: str) -> Column:
    """Words with one of ``marks`` as slots, other words bare."""
    return _bare(F.regexp_replace(marked, "[" + marks + "][^ ]*+", NAME))


def _once(rows: DataFrame, drop: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: a one-row ``inline`` keeps later
    filters and projections from repeating the patterns below it."""
    kept = [c for c in rows.columns if c not in drop]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _forms(rows: DataFrame) -> DataFrame:
    """Adds a text's tokens, separated by spaces: ``values``, and its templates ``words`` (names
    are words), ``inner`` (names inside sentences are slots) and ``wide`` (all capitalised words
    are slots). One that equals its predecessor is null; an empty text has one empty token."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for sign in ("\u0001", "\u0002"):
        text = _if_it_has(text, sign, F.replace(text, F.lit(sign), F.lit(" ")))
    digits, filled = F.col("digits"), F.col("filled")
    rows = _once(rows.withColumn("text", text), digits=F.col("text").rlike("[0-9]"))
    rows = _once(rows, ("text",), clean=cleaned(F.col("text"), digits))
    rows = _once(rows, filled=template(F.col("clean"), digits))
    return _once(
        rows,
        ("clean", "filled", "digits"),
        values=_bare(F.col("clean")),
        words=F.when(digits, _bare(filled)),
        inner=F.when(filled.contains(_MARK), _slots(filled, _MARK)),
        wide=F.when(filled.contains(_CAPITAL), _slots(filled, _MARK + _CAPITAL)),
    )


def tokenised(rows: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``n``: the ``n`` values of a text, then its templates, each of ``n`` tokens."""
    four = ("values", "words", "inner", "wide")
    parts = sum((F.col(c).isNotNull().cast("int") for c in four[1:]), F.lit(1))
    rows = _once(_forms(rows), four, tokens=F.split(F.concat_ws(" ", *four), " "), parts=parts)
    return _once(rows, ("parts",), n=(F.size("tokens") / F.col("parts")).cast("int"))


def windows(rows: DataFrame, length: int) -> DataFrame:
    """One row per window of ``length`` tokens of each form: ``place`` in ``tokens``, ``at`` in the text (both from 0), its hash ``h``."""
    open_ = rows.where(F.col("n") >= length)
    place = open_.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("tokens") - length)))
    at = place.withColumn("at", F.col("place") % F.col("n")).where(F.col("at") <= F.col("n") - length)
    return at.withColumn("h", F.xxhash64(*[F.get("tokens", F.col("place") + k) for k in range(length)]))


def _sliced(rows: DataFrame, length: int) -> DataFrame:
    part = {"doc_tokens": F.slice("tokens", F.col("place") + 1, length), "doc_values": F.slice("tokens", F.col("at") + 1, length)}
    return rows.select(*[c for c in rows.columns if c not in ("tokens", "n", "place")], *[x.alias(c) for c, x in part.items()])


def item_windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """(item_row, item_id, n_windows, n_plain, length, item_at, h, wide, plain, item_tokens, item_values, item_slots) of all items.

    ``item_slots`` has 2 for numbers and names inside sentences, 1 for other
    capitalised words, 0 for the rest. ``plain`` windows (``n_plain`` of them) say
    enough with the names inside sentences as slots; ``wide`` ones come from the
    form with all capitalised words as slots.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = _forms(with_row_id(items, "item_row")).where("values != ''")
    four = ("values", "words", "inner", "wide")
    filled = {c: F.split(F.coalesce(*[F.col(x) for x in reversed(four[: k + 1])]), " ") for k, c in enumerate(four)}
    items = _once(items, four, **{"all_" + c: x for c, x in filled.items()}).withColumn("n", F.size("all_values"))
    length = F.least(F.col("n"), F.lit(window))
    items = items.withColumn("length", length).withColumn("item_at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))))
    items = items.select("item_row", "item_id", "length", "item_at", *[F.slice("all_" + c, F.col("item_at") + 1, F.col("length")).alias(c) for c in four])
    slot = lambda t: t.startswith("\u0002")
    says = {c: (F.size(F.filter(c, lambda t: ~slot(t))) >= literals) & (F.size(F.array_distinct(c)) >= literals) for c in four}
    whole = F.col("length") < window
    items = items.withColumn("item_slots", F.zip_with("inner", "wide", lambda i, w: F.when(slot(i), 2).when(slot(w), 1).otherwise(0)))
    form = lambda c, kept: F.when(kept, F.struct(F.lit(c == "wide").alias("wide"), F.col(c).alias("item_tokens")))
    forms = F.array(
        form("words", whole | says["words"]),
        form("values", ~whole & ~says["words"]),
        form("inner", (F.col("inner") != F.col("words")) & (whole | says["inner"])),
        form("wide", (F.col("wide") != F.col("inner")) & says["wide"]),
    )
    items = items.withColumn("plain", whole | says["inner"])
    every = items.select("item_row", "item_id", "length", "item_at", "plain", "item_slots", F.col("values").alias("item_values"), F.inline(F.array_compact(forms)))
    h = reduce(lambda rest, k: F.when(F.col("length") == k, F.xxhash64(*[F.get("item_tokens", F.lit(j)) for j in range(k)])).otherwise(rest), range(1, window + 1), F.lit(None).cast("long"))
    sizes = every.groupBy("item_row").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(F.col("plain"), F.col("item_at"))).alias("n_plain"))
    return every.withColumn("h", h).join(sizes, "item_row")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS, row_id: str | None = None) -> DataFrame:
    """(uid, doc_id, item_id, n_matched, n_windows, coverage, n_slots, n_changed) of leaked items.

    ``uid`` numbers the rows of ``docs`` (or is their column ``row_id``);
    ``n_changed`` counts slots whose value in the document differs from the item's.
    """
    if row_id is None:
        source = with_row_id(documents_of(docs))
    else:
        source = docs.select(F.col(row_id).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stored(item_windows(benchmark, window, literals), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most ``window`` numbers
    small = items.count() <= BROADCAST_WINDOWS
    rows = tokenised(source)
    found = None
    for length in lengths or [window]:
        side = items.where(F.col("length") == length).drop("length")
        if small:
            joined = _sliced(windows(rows, length).join(F.broadcast(side), "h"), length)
        else:  # a window travels with its own tokens only, never with its whole text
            joined = _sliced(windows(rows, length), length).join(side, "h")
        part = joined.where("doc_tokens = item_tokens").drop("doc_tokens")
        found = part if found is None else found.unionByName(part)
    matched = found.where(F.col("uid").isNotNull()).withColumn("broad", F.explode(F.when(F.col("wide"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    slots = F.filter(
        F.transform(
            F.arrays_zip("item_slots", "item_values", "doc_values"),
            lambda z, k: F.struct((F.col("item_at") + k).alias("place"), (z["item_slots"] >= F.when(F.col("broad"), 1).otherwise(2)).alias("open"), z["item_values"].alias("item"), z["doc_values"].alias("doc")),
        ),
        lambda s: s["open"],
    )
    keys = ["uid", "doc_id", "item_row", "item_id", "n_windows", "n_plain"]
    matched = matched.select(*keys, "item_at", "plain", "broad", (F.col("at") - F.col("item_at")).alias("offset"), slots.alias("slots"))
    aligned = matched.groupBy(*keys, "offset", "broad").agg(
        F.collect_set("item_at").alias("places"),
        F.collect_set(F.when(F.col("plain"), F.col("item_at"))).alias("plain_places"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )  # bounded by the item's length
    pairs = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["item"], s["doc"]))))
    one_way = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    other_way = F.size(F.array_distinct(F.transform("slots", lambda s: s["doc"])))
    consistent = aligned.where((pairs == one_way) & (pairs == other_way))
    best = F.max_by(F.struct("places", "plain_places", "slots"), F.struct(F.size("places"), ~F.col("broad")))
    consistent = consistent.groupBy(*keys, "offset").agg(best.alias("best")).select(*keys, "best.*")
    changed = F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))
    result = consistent.groupBy(*keys).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_list("plain_places")))).cast("long").alias("n_plain_matched"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.min(changed).cast("long").alias("n_changed"),
    )
    # a copy with other names can match plain windows only
    share = F.greatest(F.col("n_matched") / F.col("n_windows"), F.when(F.col("n_plain") > 0, F.col("n_plain_matched") / F.col("n_plain")))
    return result.where(share >= coverage).select("uid", "doc_id", "item_id", "n_matched", "n_windows", share.alias("coverage"), "n_slots", "n_changed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without rows that leak an item."""
    name = "__row_of_input"
    numbered = with_row_id(docs, name)
    found = leaks(numbered, benchmark, row_id=name).select(F.col("uid").alias(name)).distinct()
    return numbered.join(found, name, "left_anti").drop(name)
