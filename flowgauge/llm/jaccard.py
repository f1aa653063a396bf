"""N-gram Jaccard join over a token-group matrix (operator 13).

A document's set holds the distinct shingles of ``SHINGLE`` words (A-Z lower-cased,
words ``[^\\x20\\x09-\\x0D]+``); a shorter text is one shingle, one without words
has no set and no links. Sets link when |A n B| / |A u B| >= NUMERATOR / DENOMINATOR.

1. Equal sets form a class; only classes go on.
2. *Rare tokens first.* In any fixed order of all tokens, two linked sets share one
   of their first ``n - ceil(0.8 n) + 1`` tokens (the prefix). The order here: sampled
   tokens (one in ``SAMPLE``) by the number of classes that hold them, then the
   others, then a bounded list of the hottest tokens. Sampled tokens are counted over
   all classes (small sets have all their tokens counted), so a set whose prefix
   is full of tokens that no other class holds has no link and is done. The order,
   the sample and the list only decide how much is left to do, never what links.
3. *Groups.* The sets left over are dealt to groups by their least common token under
   a hash, and by a salt to groups of about ``GROUP``, so a group never grows with a hot
   cluster. Members are compared with the leaders of their group; rounds with
   other hashes connect more of a cluster, and give its first components.
4. *Token-group matrix.* (token, group) rows of the members' prefixes (the shorter ones
   that suffice towards sets that aren't smaller) are joined with the prefixes of
   sets of other components. A group qualifies for a set if their
   sizes can fit and the set's overlap with the union of the group's tokens
   is large enough for a link; only then its members are opened and compared.
   Under a crowded token groups are joined with groups, once for all such tokens, and their sets ask after that:
   joining every set under every token it has in common with the group would grow with the square of a cluster.
5. Components over all links, and one row per document.

No pairs inside a component are emitted, no link between components is lost.
Shingles are named by 64 bits of a seeded hash; a false link would need
collisions in a fifth of a set. Rows are independent: repeated rows are copies, a
null doc_id is linked but names no component, extra columns are ignored, an empty
table gives no rows. A text of any length is one row's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import components, documents_of, stored

SHINGLE = 5
#: Sets link from this similarity on.
NUMERATOR, DENOMINATOR = 80, 100
SAMPLE = 3
#: Sets up to SMALL tokens are judged by all their tokens, so those of any size that can link with them count all, too.
SMALL = 64
COUNTED = SMALL * DENOMINATOR // NUMERATOR
#: Tokens in this many sets of one stretch of rows are candidates for the list of hot tokens, which has HOT_LIST rows at most.
HOT_LOCAL, HOT_LIST = 32, 1 << 18
STRETCH = 2_000_000
#: Bits of the filter that spares the sets of most finished documents a shuffle; a full filter passes all.
FILTER_BITS = 1 << 27
GROUP, LEADERS = 512, 16
ROUNDS = 2
#: Sets compared with one copy of a group.
ASKED = 512
#: Prefix rows of a token beyond which groups, not sets, look for groups under it.
CROWD = 64
#: Rows counted in one task.
COUNT_ROWS = 4_000_000
SEED = 0x5BD1E995
MIX = [np.uint64(x | 1) for x in np.random.default_rng(13).integers(1 << 62, 1 << 63, SHINGLE + ROUNDS, dtype=np.uint64)]


def tokens_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted names of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    named = np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=SEED), words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    found = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        found = (found ^ named[k : k + len(found)]) * MIX[k % SHINGLE]
        found ^= found >> np.uint64(31)
    return np.unique(found)


def key_of(tokens: np.ndarray) -> bytes | None:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def class_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def short_prefix(n: int) -> int:
    """Of the prefix, the first tokens that must hold a common one with any linked set that isn't smaller."""
    return n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * DENOMINATOR < len(large) * NUMERATOR:
        return False
    both = overlap(small, large)
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def overlap(some: np.ndarray, among: np.ndarray) -> int:
    """How many of ``some`` are in ``among``; both sorted, without repeats."""
    at = np.searchsorted(among, some)
    at[at == len(among)] = 0
    return int((among[at] == some).sum())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def batch_of(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, key, counted): per document its set's size and name, and the tokens that take part in the counts."""
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("counted", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(start, 1000), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = tokens_of(text, shingle)
                    counted = tokens if len(tokens) <= COUNTED else tokens[tokens % SAMPLE == 0]
                    rows.append((doc_id, len(tokens), key_of(tokens), counted.tobytes()))
                yield batch_of(kinds, rows)

    return documents_of(docs).mapInArrow(run, "doc_id long, n long, key binary, counted binary")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list[np.ndarray]]]:
    """(keys, sizes, counted tokens) of consecutive rows, STRETCH tokens or a little more; a class once in all of them."""
    seen: set[bytes] = set()
    keys, sizes, counted, total = [], [], [], 0
    for batch in batches:
        for n, key, data in zip(*(batch.column(c).to_pylist() for c in ("n", "key", "counted")), strict=True):
            if key is None or key in seen:
                continue
            seen.add(key)
            keys.append(key)
            sizes.append(n)
            counted.append(unpacked(data))
            total += len(counted[-1])
            if total >= STRETCH:
                yield keys, sizes, counted
                keys, sizes, counted, total = [], [], [], 0
    if keys:
        yield keys, sizes, counted


def hot_tokens(light: DataFrame) -> np.ndarray:
    """The hottest tokens, hottest last (HOT_LIST at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, counted in stretches(batches):
            tokens, counts = np.unique(np.concatenate(counted), return_counts=True)
            often = counts >= HOT_LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "sets"])

    rows = light.select("n", "key", "counted").mapInArrow(run, "token long, sets long")
    rows = rows.groupBy("token").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "token").limit(HOT_LIST).collect()
    return np.array([r["token"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def counted_tokens(light: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(classes (cls, key, n, rare), shared (cls, token, sets)).

    rare: sampled tokens of a class outside the hot list; shared: its counted
    tokens that other classes hold, too, with the number of classes.
    """
    spread = light.sparkSession.sparkContext.broadcast(np.sort(hot))

    def kept(tokens: np.ndarray) -> np.ndarray:
        return tokens[~np.isin(tokens, spread.value)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, counted in stretches(batches):
            lengths = np.fromiter(map(len, counted), dtype=np.int64, count=len(counted))
            owners = np.repeat(np.array([class_of(k) for k in keys], dtype=np.int64), lengths)
            tokens = np.concatenate(counted)
            free = ~np.isin(tokens, spread.value)
            tokens, owners = tokens[free].view(np.int64), owners[free]
            for start in range(0, len(tokens), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[start : start + 100_000]), pa.array(owners[start : start + 100_000])], names=["token", "cls"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("token").to_numpy(), b.column("cls").to_numpy()) for b in batches]
        if not parts:
            return
        tokens, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
        tokens, owners = tokens[fresh], owners[fresh]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        sizes = np.diff(np.r_[starts, len(tokens)])
        sets = np.repeat(sizes, sizes)
        some = sets > 1
        for start in range(0, int(some.sum()), 100_000):
            cut = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(owners[some][cut]), pa.array(tokens[some][cut]), pa.array(sets[some][cut].astype(np.int64))], names=["cls", "token", "sets"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, key, data in zip(*(batch.column(c).to_pylist() for c in ("n", "key", "counted")), strict=True):
                tokens = unpacked(data)
                rows.append((class_of(key), key, n, len(kept(tokens[tokens % SAMPLE == 0]))))
            yield batch_of([("cls", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("rare", pa.int64())], rows)

    named = light.where("key is not null").select("n", "key", "counted")
    spark = light.sparkSession
    total = named.agg(F.sum(F.octet_length("counted") / 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / COUNT_ROWS) + 1)
    shared = named.mapInArrow(emit, "token long, cls long").repartition(parts, "token").mapInArrow(count, "cls long, token long, sets long")
    classes = named.mapInArrow(rare, "cls long, key binary, n long, rare long").groupBy("key").agg(*[F.first(c).alias(c) for c in ("cls", "n", "rare")])
    return classes, stored(shared, "shared")


def open_classes(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, cls) of the classes whose prefix isn't full of tokens of their own."""
    sampled = F.expr(f"CASE WHEN token >= 0 THEN token % {SAMPLE} ELSE pmod(token + {2**64 % SAMPLE}, {SAMPLE}) END") == 0  # of the unsigned number
    mine = shared.where(sampled).groupBy("cls").agg(F.count("*").alias("mates"))
    own = F.col("rare") - F.coalesce("mates", F.lit(0))
    prefix = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    return classes.join(mine, "cls", "left").where(own < prefix).select("key", "cls")


def passing(opened: DataFrame) -> np.ndarray:
    """Bits of the open classes' names, at most FILTER_BITS of them."""
    slot = F.col("cls").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = opened.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast((cls & {FILTER_BITS - 1}) & 63 as int))").alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["word"]] = r["bits"]
    return bits.view(np.uint64)


def sets_of(docs: DataFrame, opened: DataFrame, shingle: int) -> DataFrame:
    """(key, cls, n, tokens): the whole sets of the open classes, each once."""
    spread = docs.sparkSession.sparkContext.broadcast(passing(opened))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        kinds = [("key", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary())]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = []
                for text in batch.column("text").slice(start, 1000).to_pylist():
                    tokens = tokens_of(text, shingle)
                    key = key_of(tokens)
                    if key is None or key in seen:
                        continue
                    at = class_of(key) & (FILTER_BITS - 1)
                    if int(spread.value[at >> 6]) >> (at & 63) & 1:
                        seen.add(key)
                        rows.append((key, len(tokens), tokens.tobytes()))
                yield batch_of(kinds, rows)

    found = documents_of(docs).select("text").mapInArrow(run, "key binary, n long, tokens binary")
    return found.join(opened, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("cls", "n", "tokens")])


def with_prefix(sets: DataFrame, shared: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, n, tokens, prefix, a0, ...): the prefix without tokens no other class holds, and the least common token of each round."""
    spread = sets.sparkSession.sparkContext.broadcast(hot)
    names = [f"a{k}" for k in range(ROUNDS)]
    kinds = [("key", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.struct([("token", pa.int64()), ("near", pa.bool_())]))), *[(c, pa.int64()) for c in names]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.argsort(spread.value)
        ordered = spread.value[place]
        for batch in batches:
            rows = []
            for key, data, mates in zip(*(batch.column(c).to_pylist() for c in ("key", "tokens", "mates")), strict=True):
                tokens = unpacked(data)
                mates = sorted((m["token"] & (2**64 - 1), m["sets"]) for m in mates or [])
                known = np.array([m[0] for m in mates], dtype=np.uint64)
                sets = np.ones(len(tokens), dtype=np.int64)  # classes that hold a token, of the counted ones
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    sets = np.where(known[at] == tokens, np.array([m[1] for m in mates])[at], 1)
                heat = np.full(len(tokens), -1)
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, tokens), len(ordered) - 1)
                    heat = np.where(ordered[at] == tokens, place[at], -1)
                sampled = tokens % SAMPLE == 0
                tier = np.where(heat >= 0, 2, np.where(sampled, 0, 1))
                weight = np.where(tier == 0, sets, np.where(tier == 2, heat, 0))
                first = np.lexsort((tokens, weight, tier))[: prefix_size(len(tokens))]
                counted = (tier == 0) | ((tier == 1) & (len(tokens) <= SMALL))
                common = tokens[(sets > 1) | (heat >= 0)]
                least = []
                for k in range(ROUNDS):
                    turned = (common if len(common) else tokens) * MIX[SHINGLE + k]
                    least.append(int((turned ^ (turned >> np.uint64(33))).min() >> np.uint64(1)))
                near = np.arange(len(first)) < short_prefix(len(tokens))
                first, near = (x[~(counted & (sets == 1))[first]] for x in (first, near))
                rows.append((key, len(tokens), data, [{"token": t, "near": v} for t, v in zip(tokens[first].view(np.int64).tolist(), near.tolist(), strict=True)], *least))
            yield batch_of(kinds, rows)

    mates = shared.groupBy("cls").agg(F.collect_list(F.struct("token", "sets")).alias("mates"))  # a set's tokens at most
    schema = "key binary, n long, tokens binary, prefix array<struct<token:long,near:boolean>>, " + ", ".join(f"{c} long" for c in names)
    return sets.join(mates, "cls", "left").select("key", "tokens", "mates").mapInArrow(run, schema)


def grouped(sets: DataFrame, round_no: int) -> DataFrame:
    """(key, run, leader): the group of each set, and every leader in it that the set links with (null: none).

    Sets with the same least token make a group; a larger number of them is dealt to
    groups of about GROUP by a hash. Sets that link with no leader become leaders.
    """
    least = F.col(f"a{round_no}")

    def lead(block: pa.Table) -> pa.Table:
        rows, leaders = [], []
        columns = block.sort_by("key").select(["key", "tokens"]).to_pydict()
        name = columns["key"][0]
        for key, data in zip(columns["key"], columns["tokens"], strict=True):
            tokens = unpacked(data)
            found = [k for k, other in leaders if linked(tokens, other)]
            if not found and len(leaders) < LEADERS:
                leaders.append((key, tokens))
            rows += [(key, name, k) for k in found or [None]]
        return pa.table([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names=["key", "run", "leader"])

    sizes = sets.groupBy(least.alias("least")).agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    dealt = sets.select(least.alias("least"), "key", "tokens").join(sizes, "least").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")))
    return dealt.select("least", "salt", "key", "tokens").groupBy("least", "salt").applyInArrow(lead, "key binary, run binary, leader binary")


def compared(block: pa.Table) -> pa.Table:
    """Links (a, b) between components, of sets that pass the bound with the members of a group.

    The group's union is the list of its tokens, with the members that hold each.
    Of the links only those that connect something new within the block are given.
    """
    rows = block.select(["label", "tokens", "asked"]).to_pydict()
    members = [(label, unpacked(d)) for label, d, asked in zip(rows["label"], rows["tokens"], rows["asked"], strict=True) if not asked]
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    found: list[tuple[bytes, bytes]] = []
    if members:
        sizes = np.array([len(m) for _, m in members])
        tokens, owners = np.concatenate([m for _, m in members]), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        union, starts = np.unique(tokens, return_index=True)
        ends = np.r_[starts[1:], len(tokens)]
        for label, data, asked in zip(rows["label"], rows["tokens"], rows["asked"], strict=True):
            if not asked:
                continue
            mine = unpacked(data)
            at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            at = at[union[at] == mine]
            if DENOMINATOR * len(at) < NUMERATOR * len(mine):
                continue
            held = ends[at] - starts[at]
            places = np.repeat(starts[at] - np.r_[0, np.cumsum(held)[:-1]], held) + np.arange(held.sum())
            both = np.bincount(owners[places], minlength=len(members))
            for k in np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (len(mine) + sizes - both)):
                x, y = find(label), find(members[k][0])
                if x != y:
                    root[x] = y
                    found.append((label, members[k][0]))
    return pa.table([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def crowd_pairs(rows: DataFrame, matrix: DataFrame, ends: list[Column]) -> DataFrame:
    """(key, run): sets and the groups that theirs meets under a crowded token, if labels and sizes of some of them can fit."""
    groups = rows.groupBy("token", "run").agg(*ends).select("token", F.col("run").alias("own"), *[F.col(c).alias(f"own_{c}") for c in ("least", "most", "first", "last")])
    other = (F.col("own_first") != F.col("own_last")) | (F.col("first") != F.col("last")) | (F.col("own_first") != F.col("first"))
    fits = other & (F.col("own_most") >= F.col("least")) & (F.col("own_least") * NUMERATOR <= F.col("most") * DENOMINATOR)
    met = stored(groups.join(matrix.drop("crowded"), "token").where(fits).groupBy("own", "run").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("first").alias("first"), F.max("last").alias("last")), "met")
    sets = rows.select("key", "n", "label", F.col("run").alias("own")).distinct()
    differs = (F.col("label") != F.col("first")) | (F.col("label") != F.col("last"))
    sized = (F.col("n") >= F.col("least")) & (F.col("n") * NUMERATOR <= F.col("most") * DENOMINATOR)
    return sets.join(met, "own").where(differs & sized).select("key", "run")


def matrix_links(sets: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): components with linked sets, of which one is in a group that qualifies for the other."""
    placed = sets.select("key", "n", "prefix").join(runs, "key").join(labels, "key")
    rows = stored(placed.select("key", "n", "run", "label", F.explode("prefix")).select("key", "n", "run", "label", "col.*"), "prefix-rows")
    ends = [F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("first"), F.max("label").alias("last")]
    crowded = rows.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > CROWD).select("token", F.lit(True).alias("crowded"))
    rows = stored(rows.join(crowded, "token", "left").withColumn("crowded", F.col("crowded").isNotNull()), "matrix-rows")
    matrix = rows.where("near").groupBy("token", "run", "crowded").agg(*ends)
    other = (F.col("label") != F.col("first")) | (F.col("label") != F.col("last"))
    fits = other & (F.col("n") >= F.col("least")) & (F.col("n") * NUMERATOR <= F.col("most") * DENOMINATOR)
    asking = rows.where("not crowded").select("token", "key", "n", "label")
    alone = asking.join(matrix.where("not crowded").drop("crowded"), "token").where(fits).select("key", "run")
    pairs = stored(alone.unionByName(crowd_pairs(rows.where("crowded"), matrix.where("crowded"), ends)).distinct(), "candidates")
    salts = pairs.groupBy("run").agg(F.ceil(F.count("*") / ASKED).alias("salts"))
    body = sets.select("key", "tokens").join(labels, "key")
    asked = pairs.join(salts, "run").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts"))).join(body, "key")
    held = runs.join(salts, "run").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).join(body, "key")
    both = asked.withColumn("asked", F.lit(True)).unionByName(held.withColumn("asked", F.lit(False)))
    return both.select("run", "salt", "label", "tokens", "asked").groupBy("run", "salt").applyInArrow(compared, "a binary, b binary")


def link_classes(docs: DataFrame, light: DataFrame, shingle: int) -> DataFrame:
    """(key, root): classes that are linked with others, with one name per component."""
    hot = hot_tokens(light)
    classes, shared = counted_tokens(light, hot)
    opened = stored(open_classes(classes, shared), "open")
    sets = stored(with_prefix(sets_of(docs, opened, shingle), shared, hot), "sets")
    rounds = [stored(grouped(sets, k), "groups") for k in range(ROUNDS)]
    edges = rounds[0]
    for more in rounds[1:]:
        edges = edges.unionByName(more)
    edges = edges.where("leader is not null").select(F.col("key").alias("a"), F.col("leader").alias("b"))
    near = stored(components(edges), "near")
    labels = sets.select("key").join(near, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("label"))
    labels = stored(labels, "labels")
    far = components(matrix_links(sets, rounds[0].select("key", "run").distinct(), labels))
    found = labels.join(far, F.col("label") == F.col("node"), "left").select("key", F.coalesce("root", "label").alias("root"))
    return stored(found, "roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    light = stored(signatures(docs, shingle), "signatures")
    roots = link_classes(docs, light, shingle)
    least = stored(light.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")), "least")
    linked_rows = roots.join(least, "key")
    names = stored(linked_rows.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = linked_rows.join(names, "root").select("key", "component_id")
    final = stored(least.join(named, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "final")
    with_set = light.where("key is not null").select("doc_id", "n", "key").join(final, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = light.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without)
