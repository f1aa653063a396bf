"""SimHash near-dedup over a Gray-order hierarchical index (operator 5).

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased,
shingles of ``shingle`` words joined by a space (a shorter text is one shingle),
XXH64 with seed 42 of each, repeats included; a bit is 1 if it is set in over
half of the hashes. A text without words, or a null one, has fingerprint zero
and is linked like any other.

Links: distinct fingerprints are dealt to cells in which a masked part of the
bits is equal. By the pigeonhole principle two fingerprints at ``distance`` or
fewer bits agree in one of ``distance + 1`` blocks, and again in one of
``distance + 1`` parts of the remaining bits, so every link meets in a cell.
Cells above ``cell_limit`` rows are dealt again by parts of their free bits,
until they are small or no free bits are left to deal by: no cap, no lost link.
Inside a cell the fingerprints are sorted by Gray rank and grouped into a tree
whose upper nodes hold the bit pattern their members share under a mask; a
search adds up the differences to each newly factored pattern on its way down
and prunes a whole group as soon as they exceed ``distance``. A cell emits one
row per linked fingerprint (a spanning star), never all pairs.

Components are found by star contraction over fingerprints, then joined back to
the documents. A null doc_id is linked but never names a component. Rows are
independent: repeated rows and extra columns are harmless, an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import components, documents_of, stored

SHINGLE = 3
DISTANCE = 2
CELL_LIMIT = 20_000
FANOUT = 8
ALL = (1 << 64) - 1
#: Shingles hashed at a time, to bound the memory of a very long text.
BLOCK = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, BLOCK):
        part = words[start : start + BLOCK + shingle - 1]
        if len(words) < shingle:
            hashes = [digest(b" ".join(words), seed=42)]
        else:
            hashes = [digest(b" ".join(x), seed=42) for x in zip(*(part[k:] for k in range(shingle)), strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start in range(0, batch.num_rows, 1000):
                found = [fingerprint(t, shingle) for t in texts.slice(start, 1000).to_pylist()]
                signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(start, 1000), signed], names=["doc_id", "fp"])

    return documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def _parts(mask: int, parts: int) -> list[int]:
    """``mask`` widened by each of ``parts`` runs of its free bits."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _dealt(rows: DataFrame, masks: set[int], parts: int) -> tuple[DataFrame, set[int]]:
    """Each (mask, fp) once for every widened mask."""
    wider = {m: _parts(m, parts) for m in masks}
    children = F.lit(None).cast("array<long>")
    for m, found in wider.items():
        children = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)).cast("long") for x in found])).otherwise(children)
    dealt = rows.select("fp", children.alias("children")).select("fp", F.explode("children").alias("mask"))
    return dealt, {x for found in wider.values() for x in found}


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over fingerprints in Gray order; each node has the pattern its members share."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        pattern, mask = self.values, np.full(len(values), ALL, dtype=np.uint64)
        levels = [(pattern, mask)]
        while len(pattern) > FANOUT:
            heads = np.arange(0, len(pattern), FANOUT)
            ones = np.bitwise_and.reduceat(pattern & mask, heads)
            zeros = np.bitwise_and.reduceat(~pattern & mask, heads)
            pattern, mask = ones, ones | zeros
            levels.append((pattern, mask))
        self.levels = levels

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of positions in Gray order at ``distance`` bits or fewer."""
        top_pattern, top_mask = self.levels[-1]
        step = 512
        for start in range(0, len(self.values), step):
            stop = min(len(self.values), start + step)
            query = np.repeat(np.arange(start, stop), len(top_pattern))
            node = np.tile(np.arange(len(top_pattern)), stop - start)
            spent = np.bitwise_count((self.values[query] ^ top_pattern[node]) & top_mask[node])
            for depth in range(len(self.levels) - 2, -1, -1):
                left = spent <= distance
                query, node, spent = query[left], node[left], spent[left]
                pattern, mask = self.levels[depth]
                above = self.levels[depth + 1][1][node]
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, above, spent = np.repeat(query, FANOUT), np.repeat(above, FANOUT), np.repeat(spent, FANOUT)
                real = child < len(pattern)
                query, node, above, spent = query[real], child[real], above[real], spent[real]
                spent = spent + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node] & ~above)
            found = (spent <= distance) & (query < node)
            yield query[found], node[found]


def star_of(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) for every fingerprint linked to another one in the cell."""
    index = GrayIndex(values)
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in index.links(distance):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    roots = np.array([find(x) for x in range(len(values))])
    moved = roots != np.arange(len(values))
    return index.values[moved], index.values[roots[moved]]


def _cells(distance: int):
    """Rows sorted by (mask, cell) -> star edges; a cell may span batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def edges(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            mask, cell = rows["mask"].to_numpy(), rows["cell"].to_numpy()
            fps = rows["fp"].to_numpy().view(np.uint64)
            heads = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])])
            ends = np.r_[heads[1:], len(rows)]
            out = [star_of(fps[a:b], distance) for a, b in zip(heads, ends, strict=True) if b - a > 1]
            if out:
                a, b = (np.concatenate([x[k] for x in out]).view(np.int64) for k in (0, 1))
                yield pd.DataFrame({"a": a, "b": b})

        for frame in frames:
            if not len(frame):
                continue
            same = (frame["mask"].to_numpy() == frame["mask"].iloc[-1]) & (frame["cell"].to_numpy() == frame["cell"].iloc[-1])
            tail = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:  # the frame ends a cell: all before its last one is whole
                yield from edges(pd.concat([*held, frame.iloc[:tail]]))
                held = [frame.iloc[tail:]]
            elif held and (held[0]["mask"].iloc[0] != frame["mask"].iloc[0] or held[0]["cell"].iloc[0] != frame["cell"].iloc[0]):
                yield from edges(pd.concat(held))
                held = [frame]
            else:
                held.append(frame)
        if held:
            yield from edges(pd.concat(held))

    return run


def links(fps: DataFrame, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Star edges (a, b) that connect distinct fingerprints ``fp`` at ``distance`` bits or fewer."""
    parts = distance + 1
    masks = {0}
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for _ in range(2):
        rows, masks = _dealt(rows, masks, parts)
    edges = None
    while True:
        cell = F.col("fp").bitwiseAND(F.col("mask"))
        rows = rows.withColumn("cell", cell)
        sizes = stored(rows.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
        deep = {m for m in masks if 64 - m.bit_count() < parts}
        split = (F.col("n") > cell_limit) & ~F.col("mask").isin([_signed(m) for m in deep] or [0])
        shared = rows.join(sizes.where(~split), ["mask", "cell"]).select("mask", "cell", "fp")
        found = shared.repartition("mask", "cell").sortWithinPartitions("mask", "cell").mapInPandas(_cells(distance), "a long, b long")
        found = stored(found, "links")
        edges = found if edges is None else edges.unionByName(found)
        large = sizes.where(split)
        hot = {r["mask"] & ALL for r in large.select("mask").distinct().collect()}  # masks are a handful
        if not hot:
            return edges
        rows = rows.join(large, ["mask", "cell"], "left_semi").select("fp", "mask")
        rows, masks = _dealt(rows, hot, parts)
        rows = stored(rows, "dealt")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, shingle), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    found = components(links(nodes, distance, cell_limit))
    rooted = stored(
        nodes.join(found, nodes.fp == found.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    names = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with all its columns, without rows whose doc_id is not the smallest of its component.

    Rows with a null doc_id stay: they have no place in the order.
    """
    dropped = near_duplicates(docs, shingle, distance).where("doc_id != component_id").select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped.distinct(), docs["doc_id"].cast("long") == F.col("__dropped"), "left_anti")
