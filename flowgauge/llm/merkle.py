"""Merkle manifest of a table and a recursive climb that checks its leaves (operator 11).

Every row is a leaf, the sha256 of its fields; leaves of a language ascend by
doc_id and are folded two by two to a subroot, the subroots (ordered by
language, null first) likewise to the root. Digests are hashed as lower-case
hex text. The built levels are stored as parent-linked node rows: (node, parent,
siblings, sides). A row covers the BLOCK levels that one task folds: its parent is
the node that many levels up (or the root of the tree), ``siblings`` holds the
digests met on the way, one after the other, and ``sides`` one letter a level: L or
R for the side the climber stands on, ``-`` where it has no sibling.

Node numbers are ``level * SPAN + left``, where ``left`` is the position of the
leftmost leaf below the node in the order of all leaves and the levels of the
upper tree start at ``TOP``; so numbers rise on the way up.

A Spark recursive query (``WITH RECURSIVE``) climbs from every leaf: each step
joins the node row, appends its siblings, folds the digest with them and moves to
the parent. Rows that span levels keep the steps few: Spark shuffles every step's
rows once, so a step a level would cost the leaves times the levels.
The climb has two parts. Nodes high up are shared by many leaves and few in
number: the highest levels, SHARED_NODES rows at most, are broadcast. Below
them a node has at most 2 ** BLOCK leaves a level: the leaves' rows are shuffled by
node number to a table in buckets by node, so no task gets the leaves of a hot node.

Defined results: a null field counts as ``-``; rows that share a doc_id, or lack
one (first in order, never tampered), are leaves of their own, ordered by digest
among themselves; a language with one row is its own subroot; a table of one row
has the leaf as root and an empty proof; an empty table gives no rows; extra
columns are ignored. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import TABLE_FOLDER, shared_folder, stored

#: Levels of a block that one task folds and a node row spans: 2 ** BLOCK leaves at most.
BLOCK = 12
SPAN = 1 << 50
TOP = 64
#: Rows of the upper part of the trees that are broadcast, about 450 bytes each.
SHARED_NODES = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

FOLDED = "node long, parent long, siblings binary, sides string, tree long, n long, idx long, left long, hash binary, done boolean"
ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
FOLDED_ARROW = pa.schema([(c, ARROW[kind]) for c, kind in (x.split() for x in FOLDED.split(", "))])


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves_of(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, lang, leaf, changed): the digest of every row, and that of its tampered copy where it has one.

    Tampering adds 1 to n_chars of the rows whose unsigned crc32 of the decimal
    doc_id is divisible by ``every``.
    """
    kind = dict(docs.dtypes)
    if "n_chars" not in kind:
        raise ValueError("documents need a column n_chars")
    values = {c: F.col(c).cast("string") for c in FIELDS}
    longer = (F.col("n_chars").cast("decimal(20,0)") + F.lit(1)).cast("string")
    hit = F.coalesce(F.crc32(values["doc_id"].cast("binary")) % F.lit(every) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(hit, leaf_of([longer if c == "n_chars" else values[c] for c in FIELDS]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), values["lang"].alias("lang"), leaf_of([values[c] for c in FIELDS]).alias("leaf"), changed.alias("changed"))


def placed(leaves: DataFrame) -> DataFrame:
    """Adds ``place`` (position in the order of language, doc_id, digest), ``tree`` (place of the language's first leaf) and ``n``.

    Rows are dealt out by range; only one row per partition and language is
    summed over all of them.
    """
    keyed = leaves.withColumn("tongue", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")))  # "-" sorts before "="
    ranged = stored(keyed.repartitionByRange("tongue", "doc_id", "leaf").withColumn("part", F.spark_partition_id()), "ranged")
    pieces = ranged.groupBy("part", "tongue").agg(F.count("*").alias("size"))
    before = Window.orderBy("tongue", "part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = Window.partitionBy("tongue")
    pieces = pieces.select("part", "tongue", "start", F.min("start").over(same).alias("tree"), F.sum("size").over(same).alias("n"))
    row = F.row_number().over(Window.partitionBy("part", "tongue").orderBy("doc_id", "leaf"))
    found = ranged.join(pieces, ["part", "tongue"]).withColumn("place", F.col("start") + row - 1)
    return found.select("doc_id", "lang", "leaf", "changed", "place", "tree", "n")


def digest(*parts: bytes) -> bytes:
    """sha256 of digests as hex text."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in parts)).digest()


def folder(level: int, first: int, last: int | None) -> Callable[[pa.Table], pa.Table]:
    """Folds the rows of a block: a node row for each, up to BLOCK levels high, and one row of what remains.

    ``first`` is the number of the tree's lowest level; ``last``, where given, is
    the level under which the root of a tree is known.
    """

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx").to_pydict()
        tree, n, left = block["tree"][0], block["n"][0], block["left"]
        remain = -(-n // (1 << level))
        tiers = [block["hash"]]
        while remain > 1 and len(tiers) <= BLOCK:
            remain, now = -(-remain // 2), tiers[-1]
            tiers.append([digest(*now[k : k + 2]) for k in range(0, len(now), 2)])
        height = len(tiers) - 1
        above = last if remain == 1 and last is not None else first + level + height
        rows = []
        for k in range(len(left) if height else 0):
            met, sides, at = [], [], k
            for tier in tiers[:-1]:
                paired = at ^ 1 < len(tier)
                if paired:
                    met.append(tier[at ^ 1])
                sides.append("RL"[at % 2 == 0] if paired else "-")
                at >>= 1
            rows.append(((first + level) * SPAN + left[k], above * SPAN + left[0], b"".join(met), "".join(sides), *[None] * 6))
        rows.append((*[None] * 4, tree, n, block["idx"][0] >> height, left[0], tiers[-1][0], remain == 1))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOLDED_ARROW, strict=True)], schema=FOLDED_ARROW)

    return run


def build(rows: DataFrame, first: int, last: int | None, tag: str) -> tuple[DataFrame, DataFrame]:
    """(node rows, roots of the trees) of leaves (tree, n, idx, left, hash).

    Each round folds blocks of 2 ** BLOCK neighbours, so a tree of any size takes
    a few rounds and no task holds more than a block.
    """
    level, nodes, roots = 0, [], []
    while True:
        found = stored(rows.withColumn("block", F.shiftright("idx", BLOCK)).groupBy("tree", "block").applyInArrow(folder(level, first, last), FOLDED), f"{tag}-{level}")
        nodes.append(found.where("node is not null").select("node", "parent", "siblings", "sides"))
        rest = found.where("node is null").select("tree", "n", "idx", "left", "hash", "done")
        roots.append(rest.where("done").drop("done"))
        rows = rest.where("not done").drop("done")
        if rows.isEmpty():
            break
        level += BLOCK
    merge = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(merge(frames[1:]))
    return merge(nodes), merge(roots)


def climbed(starts: DataFrame, nodes: str, end: int, shared: bool) -> DataFrame:
    """(place, node, folded, path) of the way from ``starts`` (place, node, folded) up to the first node numbered ``end`` or higher.

    path: the siblings met, from the bottom up, one digest after the other.
    """
    spark, name = starts.sparkSession, f"starts_{uuid.uuid4().hex}"
    starts.createOrReplaceTempView(name)
    hint = "/*+ BROADCAST(n) */" if shared else ""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # else the climb of a large table is refused
    try:
        steps = spark.sql(f"""
            WITH RECURSIVE climb(place, node, folded, path) AS (
              SELECT place, node, folded, CAST('' AS BINARY) FROM {name}
              UNION ALL
              SELECT {hint} c.place, n.parent, aggregate(sequence(1, length(n.sides)), named_struct('hash', c.folded, 'at', 1), (a, i) ->
                  named_struct('hash', unhex(sha2(CASE substr(n.sides, i, 1)
                    WHEN 'L' THEN lower(concat(hex(a.hash), hex(substr(n.siblings, a.at, 32))))
                    WHEN 'R' THEN lower(concat(hex(substr(n.siblings, a.at, 32)), hex(a.hash)))
                    ELSE lower(hex(a.hash)) END, 256)),
                  'at', a.at + IF(substr(n.sides, i, 1) = '-', 0, 32))).hash, concat(c.path, n.siblings)
              FROM climb c JOIN {nodes} n ON c.node = n.node WHERE c.node < {end})
            SELECT place, node, folded, path FROM climb WHERE node >= {end}""")
        return stored(steps, "paths")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
        spark.catalog.dropTempView(name)


def bucketed(nodes: DataFrame, name: str) -> None:
    """Stores node rows as a table in buckets by node, so that no step of a climb shuffles them again."""
    spark = nodes.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{TABLE_FOLDER}/{name}"
    nodes.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(name)


def shared_from(nodes: DataFrame, bound: int) -> int:
    """The level from which on node rows number ``bound`` at most."""
    level = F.col("node").bitwiseAND(F.lit(-SPAN)) / F.lit(SPAN)
    sizes = {int(r["level"]): r["n"] for r in nodes.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # a few rows a tree
    total, least = 0, 2 * TOP
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > bound:
            break
        least = k
    return least


def manifest(docs: DataFrame, every: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(leaves, node rows, trees, end): the stored manifest.

    leaves: doc_id, lang, leaf, changed, place, tree, n, node. trees: tree,
    subroot, root. end: the root's node number.
    """
    leaves = placed(stored(leaves_of(docs, every), "leaves"))
    start = F.when(F.col("n") == 1, F.lit(TOP * SPAN)).otherwise(F.lit(0)) + F.col("place")
    leaves = stored(leaves.withColumn("node", start), "placed")
    rows = leaves.select("tree", "n", (F.col("place") - F.col("tree")).alias("idx"), F.col("place").alias("left"), F.col("leaf").alias("hash"))
    low, subroots = build(rows, 0, TOP, "trees")
    count = subroots.count()
    order = F.row_number().over(Window.orderBy("left")).cast("long") - 1  # one row a language
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), order.alias("idx"), "left", "hash")
    high, roots = build(upper, TOP, None, "top")
    root = roots.select("hash").first()
    trees = subroots.select("tree", F.col("hash").alias("subroot"), F.lit(bytes(root["hash"]) if root else None).cast("binary").alias("root"))
    end = (TOP + max(count - 1, 0).bit_length()) * SPAN
    return leaves, low.unionByName(high), trees, end


def checked(docs: DataFrame, every: int = 7, shared_nodes: int = SHARED_NODES) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings."""
    leaves, nodes, trees, end = manifest(docs, every)
    spark = docs.sparkSession
    middle = min(shared_from(nodes, shared_nodes) * SPAN, end)
    name = f"llm_nodes_{uuid.uuid4().hex}"
    nodes.where(F.col("node") >= middle).createOrReplaceTempView(f"{name}_high")
    bucketed(nodes.where(F.col("node") < middle), name)
    try:
        paths = climbed(leaves.select("place", "node", F.coalesce("changed", "leaf").alias("folded")), name, middle, shared=False)
        upper = climbed(paths.select("place", "node", "folded"), f"{name}_high", end, shared=True)
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder, as those of other steps
        spark.catalog.dropTempView(f"{name}_high")
    path = F.concat("first", "path")
    # the siblings are hashed as soon as both parts meet; only digests travel on
    paths = paths.select("place", F.col("path").alias("first")).join(upper, "place").select(
        "place", "folded", F.sha2(F.lower(F.hex(path)), 256).alias("proof"), (F.octet_length(path) / 32).cast("long").alias("n_siblings"))
    out = leaves.join(paths, "place").join(trees, "tree")
    return out.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.col("proof").alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
        "n_siblings",
    )
