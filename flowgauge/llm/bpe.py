"""BPE encoding and decoding with content-defined chunk reuse (operator 9).

A rolling hash over the last ``WINDOW`` bytes cuts every text where the hash has
``CUT_BITS`` zero bits, so equal passages fall into equal chunks wherever they
stand. A worker encodes each distinct chunk once and reuses its ids for
all documents it meets; inside a new chunk, words met before are reused as well
(the store forgets what was not used lately when it has grown to
``STORE_BYTES``, which changes no result). A cut may fall inside a word, so
each chunk keeps the bytes before its first and after its last ASCII white space
aside; at a chunk join those ends are put together and re-encoded as one piece,
reaching over as many chunks as it takes to meet white space on either side.
From there on both encodings agree, because the tokenizer never merges,
normalises or matches special tokens across white space.

Decoding gives what the library's ``decode(ids, skip_special_tokens=False)``
gives for this tokenizer, which has no decoder: token strings joined by a space.
A null text counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of

WINDOW = 8
CUT_BITS = 8
#: Bound of the store of a worker process (chunks and words, two generations each).
STORE_BYTES = 128 << 20
BATCH_CHARS = 2 << 20
CALL_WORDS = 20_000
RESULT = "n_tokens long, ids string, decoded string, ids_sha256 string, decoded_sha256 string"

_SPACE = re.compile(rb"[\t\n\r ]")
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, from the bytes of the window alone."""
    mixed = _GEAR[data]
    rolled = mixed.copy()
    for back in range(1, WINDOW):
        rolled[back:] += mixed[:-back] * np.uint32(pow(0x9E3779B1, back, 1 << 32))
    ends = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1
    return ends[(ends < len(data)) & (ends >= WINDOW)]


class Store(dict):
    """Encoded bytes by text; keeps what was used lately in two generations of bounded size."""

    def __init__(self, limit: int):
        self.limit, self.held, self.older = limit, 0, {}

    def lacks(self, keys) -> list[bytes]:
        """Keys that neither generation has; those of the older one come forward."""
        older, missing = self.older, []
        for k in keys:
            if k not in self:
                if k in older:
                    self[k] = older.pop(k)
                else:
                    missing.append(k)
        return missing

    def put(self, key: bytes, value, size: int) -> None:
        self[key] = value
        self.held += size

    def age(self) -> None:
        """Called between groups of texts, when nothing is half done."""
        if self.held > self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0


class ChunkEncoder:
    """Encodes texts by chunks; one per worker process and tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.numbers = [str(k) for k in range(size)]
        self.chunks, self.words = Store(STORE_BYTES // 4), Store(STORE_BYTES // 4)

    def _learn_words(self, words: set[bytes]) -> None:
        """Encode words that the store lacks, many to a call of the library."""
        missing = self.words.lacks(words)
        for start in range(0, len(missing), CALL_WORDS):
            part = missing[start : start + CALL_WORDS]
            found = self.tokenizer.encode([w.decode("utf-8", "surrogatepass") for w in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.kind).tobytes()
            ends = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part)), side="right") * self.kind.itemsize
            at = 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.words.put(word, ids[at:end], 200 + len(word))
                at = end

    @staticmethod
    def _ends(chunk: bytes) -> tuple[int, int]:
        """Ends of the head before the first and the start of the tail after the last white space, or (-1, -1)."""
        first = _SPACE.search(chunk)
        if first is None:
            return -1, -1
        return first.start(), max(chunk.rfind(c) for c in (b" ", b"\n", b"\t", b"\r")) + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut_texts = []
        fresh: dict[bytes, None] = {}
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            bounds = [0, *cuts(np.frombuffer(data, dtype=np.uint8)).tolist(), len(data)] if data else [0]
            chunks = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            cut_texts.append(chunks)
            fresh.update(dict.fromkeys(chunks))
        # Words inside fresh chunks, then the ends that meet at joins.
        words: set[bytes] = set()
        split = []
        for c in self.chunks.lacks(fresh):
            head, tail = self._ends(c)
            inner = None if head < 0 else c[head:tail].split()
            split.append((c, head, inner, tail))
            words.update(inner or ())
        self._learn_words(words)
        word = self.words.__getitem__
        for c, head, inner, tail in split:
            # no white space: the whole chunk is an open end
            found = (c, None, b"") if inner is None else (c[:head], b"".join(map(word, inner)), c[tail:])
            self.chunks.put(c, found, 350 + 2 * len(c))
        plans: list[list[tuple[bool, bytes]]] = []
        joins: set[bytes] = set()
        for chunks in cut_texts:
            plan: list[tuple[bool, bytes]] = []
            open_end = b""
            for c in chunks:
                head, ids, tail = self.chunks[c]
                open_end += head
                if ids is None:  # the join reaches into the next chunk
                    continue
                if open_end:
                    plan.append((True, open_end))
                    joins.add(open_end)
                plan.append((False, ids))
                open_end = tail
            if open_end:
                plan.append((True, open_end))
                joins.add(open_end)
            plans.append(plan)
        # A join holds no space, tab, CR or LF, so it is one word to the store.
        self._learn_words(joins)
        found = [np.frombuffer(b"".join([self.words[x] if is_join else x for is_join, x in plan]), dtype=self.kind) for plan in plans]
        self.chunks.age()
        self.words.age()
        return found

    def strings(self, ids: np.ndarray) -> tuple[str, str]:
        """Decimal ids and token strings, each joined by a space."""
        plain = ids.tolist()
        return " ".join([self.numbers[k] for k in plain]), " ".join([self.names[k] for k in plain])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``BATCH_CHARS``, to bound memory whatever the Arrow batch holds."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256), one row per row of ``docs``.

    ``ids`` are decimal, joined by one space; without ``with_ids`` or
    ``with_decoded`` those strings stay null. Other columns of ``docs`` are
    ignored. Results leave the worker by groups of texts, not by Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            start = 0
            for texts in _groups(t.as_py() or "" for t in batch.column("text")):
                rows = []
                for found in work.encode(texts):
                    ids, decoded = (x.encode() for x in work.strings(found))
                    rows.append((len(found), ids if with_ids else None, decoded if with_decoded else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()), strict=True)]
                columns[1:3] = [c.cast(pa.string()) for c in columns[1:3]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *columns], names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])
                start += len(rows)

    return documents_of(docs).mapInArrow(run, "doc_id long, " + RESULT)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) with the library's own decode; null ids count as empty."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        tokenizer = encoder(path).tokenizer
        ids = [[int(x) for x in s.split()] if isinstance(s, str) else [] for s in column]
        return pd.Series([tokenizer.decode(x, skip_special_tokens=False) for x in ids], dtype=object)

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("ids").cast("string")).alias("text"))
