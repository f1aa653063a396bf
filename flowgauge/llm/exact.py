"""Exact dedup by composable polynomial fingerprints (operator 6).

A text is cut into chunks of ``CHUNK`` bytes. All chunks of a text are hashed at
once (one product of the byte matrix with a table of base powers), and chunk
hashes are composed by length-shifted arithmetic, H(xy) = H(x) * B^|y| + H(y)
modulo p, under four primes. Groups of equal fingerprints and lengths then go
through a chunkwise comparison: member chunks are joined with the chunks of the
row that stays, so no task holds a group or two whole texts. Rows that differ
(a collision) are regrouped among themselves until every class is proven equal.

Texts are equal when identical after lower-casing A-Z only; a null text counts
as empty. Of equal texts the row with the largest doc_id stays (a null doc_id
ranks lowest; among repeated rows with one doc_id a single row stays). Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of, stored, with_row_id

#: Bytes to a chunk: 255 * p * CHUNK stays below 2^53, so the products are exact in doubles.
CHUNK = 16384
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1220703125, 1566083941, 1812433253)

PRINT_SCHEMA = "uid long, doc_id long, fp_a long, fp_b long, n_bytes long, text_sha256 string"
BODY_SCHEMA = "uid long, doc_id long, fp_a long, fp_b long, n_bytes long, body binary"


class Polynomial:
    """Fingerprints under the given primes; smaller primes make collisions likely (for tests)."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES):
        self.primes, self.bases = primes, tuple(b % p for b, p in zip(bases, primes, strict=True))
        powers = np.empty((CHUNK, len(primes)))
        for column, (p, b) in enumerate(zip(self.primes, self.bases, strict=True)):
            power = 1
            for row in range(CHUNK - 1, -1, -1):
                powers[row, column] = power
                power = power * b % p
        self.powers = powers
        self.shift = [pow(b, CHUNK, p) for b, p in zip(self.bases, self.primes, strict=True)]

    def chunk_hashes(self, data: bytes) -> list[tuple[list[int], int]]:
        """(hash under each prime, length) of every chunk, in order."""
        raw = np.frombuffer(data, dtype=np.uint8)
        whole = len(raw) // CHUNK
        found = []
        for start in range(0, whole, 256):  # 256 chunks at a time bound the memory of a huge text
            block = raw[start * CHUNK : min(whole, start + 256) * CHUNK].reshape(-1, CHUNK).astype(np.float64)
            found += [([int(v) % p for v, p in zip(row, self.primes, strict=True)], CHUNK) for row in block @ self.powers]
        rest = raw[whole * CHUNK :]
        if len(rest):
            row = rest.astype(np.float64) @ self.powers[CHUNK - len(rest) :]
            found.append(([int(v) % p for v, p in zip(row, self.primes, strict=True)], len(rest)))
        return found

    def compose(self, left: list[int], right: list[int], right_length: int) -> list[int]:
        """Fingerprint of the text whose parts have these fingerprints."""
        if right_length == CHUNK:
            shift = self.shift
        else:
            shift = [pow(b, right_length, p) for b, p in zip(self.bases, self.primes, strict=True)]
        return [(x * s + y) % p for x, s, y, p in zip(left, shift, right, self.primes, strict=True)]

    def __call__(self, data: bytes) -> tuple[int, int]:
        total = [0] * len(self.primes)
        for hashes, length in self.chunk_hashes(data):
            total = self.compose(total, hashes, length)
        total += [0] * (4 - len(total))
        return total[0] << 31 | total[1], total[2] << 31 | total[3]


_MADE: dict[tuple, Polynomial] = {}


def polynomial(primes: tuple[int, ...]) -> Polynomial:
    """One power table per worker process."""
    if primes not in _MADE:
        _MADE[primes] = Polynomial(primes, BASES[: len(primes)])
    return _MADE[primes]


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _mapper(primes: tuple[int, ...], bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = polynomial(primes)
        for batch in batches:
            uids, ids, texts = batch.column("uid"), batch.column("doc_id"), batch.column("text")
            for start in range(0, batch.num_rows, 1000):
                data = [_normal(t) for t in texts.slice(start, 1000).to_pylist()]
                prints = [poly(x) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [
                        uids.slice(start, 1000), ids.slice(start, 1000),
                        pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()),
                        pa.array([len(x) for x in data], pa.int64()),
                        pa.array(data, pa.binary()) if bodies else pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                    ],
                    names=["uid", "doc_id", "fp_a", "fp_b", "n_bytes", "body" if bodies else "text_sha256"],
                )

    return run


KEY = ["fp_a", "fp_b", "n_bytes"]


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk; an empty body has one empty chunk."""
    last = F.floor((F.greatest(F.col("n_bytes"), F.lit(1)) - 1) / CHUNK)
    at = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no")
    piece = F.substring("body", (F.col("chunk_no") * CHUNK + 1).cast("int"), F.lit(CHUNK))
    return rows.select("uid", "keep_uid", "body", at).select("uid", "keep_uid", "chunk_no", piece.alias("chunk"))


def _compared(members: DataFrame) -> DataFrame:
    """(uid, equal): chunkwise comparison of each member with the row that stays."""
    kept = _chunks(members.where("uid = keep_uid")).select("keep_uid", "chunk_no", F.col("chunk").alias("kept_chunk"))
    other = _chunks(members.where("uid != keep_uid"))
    return other.join(kept, ["keep_uid", "chunk_no"]).groupBy("uid").agg(F.bool_and(F.col("chunk") == F.col("kept_chunk")).alias("equal"))


def exact_duplicates(docs: DataFrame, primes: tuple[int, ...] = PRIMES, row_id: str | None = None) -> DataFrame:
    """Classes of equal texts, one row per row of ``docs``.

    Returns uid (number of the row, or the column ``row_id`` of the input),
    doc_id, keep_uid, keep_id, group_size, kept, text_sha256.
    """
    source = with_row_id(documents_of(docs)) if row_id is None else docs.select(
        F.col(row_id).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    prints = stored(source.mapInArrow(_mapper(primes, False), PRINT_SCHEMA), "prints")
    top = F.max(F.struct("doc_id", "uid")).alias("top")
    groups = stored(prints.groupBy(*KEY).agg(top, F.count("*").alias("n")).where("n > 1").select(*KEY, F.col("top.uid").alias("keep_uid")), "groups")
    bodies = source.mapInArrow(_mapper(primes, True), BODY_SCHEMA)
    # sorted and merged at every size: both sides are split where a key is hot
    members = stored(bodies.join(groups.hint("merge"), KEY), "members")
    classes = members.where("uid = keep_uid").select("uid", "keep_uid")
    while True:
        verdict = stored(_compared(members), "verdict")
        same = members.select("uid", "keep_uid").join(verdict.where("equal").select("uid"), "uid", "left_semi")
        classes = classes.unionByName(same)
        odd = verdict.where("not equal").select("uid")
        if odd.isEmpty():
            break
        rest = stored(members.drop("keep_uid").join(odd, "uid", "left_semi"), "rest")
        again = stored(rest.groupBy(*KEY).agg(top).select(*KEY, F.col("top.uid").alias("keep_uid")), "groups")
        members = stored(rest.join(again, KEY), "members")
        classes = classes.unionByName(members.where("uid = keep_uid").select("uid", "keep_uid"))
    classes = stored(classes, "classes")
    ids = prints.select(F.col("uid").alias("keep_uid"), F.col("doc_id").alias("keep_id"))
    sizes = stored(classes.groupBy("keep_uid").agg(F.count("*").alias("group_size")).join(ids, "keep_uid"), "sizes")
    joined = prints.join(classes, "uid", "left").join(sizes, "keep_uid", "left")
    alone = F.col("keep_uid").isNull()
    return joined.select(
        "uid", "doc_id",
        F.when(alone, F.col("uid")).otherwise(F.col("keep_uid")).alias("keep_uid"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each class of equal texts."""
    name = "__row_of_input"
    numbered = with_row_id(docs, name)
    dropped = exact_duplicates(numbered, row_id=name).where("not kept").select(F.col("uid").alias(name))
    return numbered.join(dropped, name, "left_anti").drop(name)
