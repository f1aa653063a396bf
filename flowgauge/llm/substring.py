"""Substring dedup by recompression (operator 2).

A passage is ``window`` consecutive words that also start in a document with a
smaller doc_id. Recompression gives equal passages equal symbols inside: rounds
name maximal runs of one symbol, and pairs whose left symbol falls in one half
of the names and whose right symbol in the other. A name is a hash of what it
stands for, so the names of a round agree over all documents without a
dictionary. Next to each symbol stands the stretch of words that its naming
looked at; a symbol is certain for a window that holds this whole stretch, and
equal windows have the same certain symbols at the same places.

Each window is represented by one certain symbol of the highest round that has
any: a long one if there is one, of these the one with the least hash. Windows
in a row with the same representative form a span. Spark then joins in steps:
1. symbols: only spans whose symbol represents windows in two documents go on;
2. stretches: spans of one symbol that agree in all their words (128 bits of the
   first and the last window and their distance, which cover the stretch) repeat
   the one in the smallest doc_id as a whole;
3. windows: what is left of symbols that still have spans in two documents is
   compared window by window, by 128 bits of the words;
4. words covered by a repeat of a smaller doc_id are removed.
A span that repeats an earlier one adds nothing as a source, so step 3 is whole
without it. Every window has a representative (a word alone at worst), so no
repeat is lost.

Keys of groups are combined before the shuffle, and each join back meets one row
a key, so adaptive skew splitting takes care of a passage in a third of all
documents. A null text has no words; a null doc_id is neither smaller nor larger
than another, so its row keeps all words; rows with the same doc_id do not take
words from each other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of, stored, with_row_id

WINDOW = 50
ROUNDS = ("run", "pair", "pair", "pair", "pair", "pair", "pair")
#: Symbols of so many words are chosen before shorter ones.
LONG = 6
#: Bytes of text worked on at a time (whole documents; a longer document alone).
BYTES = 1 << 20

_ALL = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15
_MIX = np.uint64(_GOLDEN)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # splits at \x20 and \x09-\x0D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd factor and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self, factor: int):
        self.factors = (factor, pow(factor, -1, 1 << 64))
        self.tables = [np.ones(1, dtype=np.uint64) for _ in self.factors]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << (n - 1).bit_length()
            for k, factor in enumerate(self.factors):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                self.tables[k] = np.cumprod(steps, dtype=np.uint64)
        return self.tables[0][:n], self.tables[1][:n]


_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_WORD_POWERS = (Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5))


def _sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values * inverse^k and the powers: the sum over [i, j) times power[i] is the
    polynomial of that stretch, wherever it stands."""
    up, down = powers.upto(len(values) + 1)
    return np.r_[np.uint64(0), np.cumsum(values * down[:-1], dtype=np.uint64)], up


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of texts laid end to end, two columns of 64 bits of a cryptographic hash of
    the word, and the number of words up to each offset."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    names = np.empty((len(starts), 2), dtype=np.uint64)
    at = 0
    while at < len(starts):  # about BYTES bytes at a time, whole words
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + BYTES)))
        low, high = starts[at], stops[end - 1]
        text = data[low:high].tobytes()
        words = [text[i:j] for i, j in zip((starts[at:end] - low).tolist(), (stops[at:end] - low).tolist(), strict=True)]
        named = {w: hashlib.blake2b(w, digest_size=16).digest() for w in set(words)}
        names[at:end] = np.frombuffer(b"".join(map(named.__getitem__, words)), dtype=np.uint64).reshape(-1, 2)
        at = end
    return names, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first column of ``word_digests``, and the number of words up to each offset."""
    names, bounds = word_digests(data, offsets)
    return names[:, 0].copy(), bounds


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and the offset of each text; a null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about BYTES bytes of text (a longer text alone)."""
    if not batch.num_rows:
        return
    _, offsets = _column_bytes(batch.column("text"))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Windows:
    """128-bit names of windows of the words, each half from its own half of the words' names, wherever asked for."""

    def __init__(self, names: np.ndarray, window: int):
        self.window = window
        self.sides = [_sums(v, p) for v, p in zip(names.T, _WORD_POWERS, strict=True)]

    def at(self, place: np.ndarray) -> list[np.ndarray]:
        return [_mix((sums[place + self.window] - sums[place]) * up[place]) for sums, up in self.sides]


class Level:
    """Symbols of a round: name, document, words it stands for, and the stretch [low, high) its naming looked at."""

    __slots__ = ("name", "doc", "size", "low", "high")

    def __init__(self, name: np.ndarray, doc: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.doc, self.size, self.low, self.high = name, doc, size, low, high

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Lows of the left and highs of the right neighbours; a document's end looks one word outside."""
        same = self.doc[1:] == self.doc[:-1]
        left, right = self.low - 1, self.high + 1
        left[1:] = np.where(same, self.low[:-1], left[1:])
        right[:-1] = np.where(same, self.high[1:], right[:-1])
        return left, right

    def runs(self) -> Level:
        if not len(self.name):
            return self
        left, right = self._edges()
        head = np.flatnonzero(np.r_[True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])])
        last = np.r_[head[1:], len(self.name)] - 1
        count = last - head + 1
        name = np.where(count > 1, _mix(self.name[head] * _MIX + count.astype(np.uint64)), self.name[head])
        return Level(name, self.doc[head], self.size[head] * count, left[head], right[last])

    def pairs(self, salt: int) -> Level:
        if not len(self.name):
            return self
        starts = _mix(self.name + np.uint64(salt * _GOLDEN & _ALL)) >> np.uint64(63) == 0
        joined = np.zeros(len(self.name), dtype=bool)  # with the next symbol
        joined[:-1] = starts[:-1] & ~starts[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.r_[False, joined[:-1]]
        left, right = self._edges()
        low = np.where(starts, self.low, left)
        high = np.where(starts, right, self.high)
        at = np.flatnonzero(joined)
        low[at], high[at] = self.low[at], self.high[at + 1]
        name, size = self.name.copy(), self.size.copy()
        name[at] = _mix(_mix(self.name[at] + _MIX) + self.name[at + 1] * np.uint64(3))
        size[at] += self.size[at + 1]
        stay = ~second
        return Level(name[stay], self.doc[stay], size[stay], low[stay], high[stay])

    def ranks(self) -> np.ndarray:
        """Order in which symbols are chosen: long ones first (three classes), then by a hash of the name."""
        classes = (self.size < LONG).astype(np.uint64) + (self.size < LONG // 2)
        return classes << np.uint64(62) | _mix(self.name ^ _MIX) >> np.uint64(2)


def recompressed(names: np.ndarray, doc: np.ndarray) -> list[Level]:
    """The levels of all rounds, words first."""
    place = np.arange(len(names), dtype=np.int64)
    levels = [Level(names, doc, np.ones(len(names), dtype=np.int64), place, place + 1)]
    for k, kind in enumerate(ROUNDS):
        levels.append(levels[-1].runs() if kind == "run" else levels[-1].pairs(k))
    return levels


def _first_least(rank: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position of the first least rank in every range [start, stop), none of them empty."""
    size = stop - start
    out = np.empty(len(start), dtype=np.int64)
    best, width = np.arange(len(rank)), 1  # best[i]: of [i, i + width)
    while True:
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(now):
            a, b = best[start[now]], best[stop[now] - width]
            out[now] = np.where(rank[a] <= rank[b], a, b)
        if not (size >= 2 * width).any():
            return out
        a, b = best[: len(best) - width], best[width:]
        best, width = np.where(rank[a] <= rank[b], a, b), width * 2


def representatives(names: np.ndarray, doc: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(symbol, first window, number of windows) for all windows of the documents.

    ``ends`` holds for every word the end of its document.
    """
    at = np.flatnonzero(np.arange(len(names)) + window <= ends)
    symbol = np.empty(len(at), dtype=np.uint64)
    chosen_at = np.empty(len(at), dtype=np.int64)  # tells one choice from the next
    rest = np.arange(len(at))
    levels = recompressed(names, doc)
    for depth in range(len(levels) - 1, -1, -1):
        if not len(rest):
            break
        level = levels[depth]
        start = np.searchsorted(level.low, at[rest], side="left")
        stop = np.searchsorted(level.high, at[rest] + window, side="right")
        some = stop > start
        now = rest[some]
        if len(now):
            index = _first_least(level.ranks(), start[some], stop[some])
            symbol[now] = _mix(level.name[index] + np.uint64(depth * _GOLDEN & _ALL))
            chosen_at[now] = index * len(levels) + depth
        rest = rest[~some]
    if not len(at):
        return symbol, at, at
    head = np.flatnonzero(np.r_[True, (chosen_at[1:] != chosen_at[:-1]) | (at[1:] != at[:-1] + 1)])
    return symbol[head], at[head], np.diff(np.r_[head, len(at)])


def _symbols(window: int):
    """Rows of documents -> rows (symbol, uid, doc_id, first, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch.filter(batch.column("doc_id").is_valid())):
                names, bounds = word_names(*_column_bytes(part.column("text")))
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                symbol, first, n = representatives(names, doc, bounds[doc + 1], window)
                owner = doc[first]
                uid, ids = (part.column(c).to_numpy()[owner] for c in ("uid", "doc_id"))
                columns = [symbol.view(np.int64), uid, ids, (first - bounds[owner]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["symbol", "uid", "doc_id", "first", "n"])

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _split_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without a candidate are done; the others keep text and candidate windows."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            spans, texts = part.column("spans"), part.column("text").to_pylist()
            words = [words_of(t) for t in texts]
            open_ = [s.is_valid for s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("uid"), part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([None if o else _digest(w) for w, o in zip(words, open_, strict=True)], pa.string()),
                    pa.array([t if o else None for t, o in zip(texts, open_, strict=True)], pa.string()), spans,
                ],
                names=["uid", "doc_id", "n_words", "done", "text", "spans"],
            )


_FIRST, _LAST = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def _opened_spans(part: pa.RecordBatch, column: str, window: int) -> tuple[Windows, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Windows of the rows' words; row, first window (in the words laid end to end) and fields of each span."""
    names, bounds = word_digests(*_column_bytes(part.column("text")))
    spans = part.column(column)
    row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    fields = {flat.type.field(k).name: flat.field(k).to_numpy().astype(np.int64) for k in range(flat.type.num_fields)}
    return Windows(names, window), row, fields["first"] + bounds[row], fields


def _stretches(window: int):
    """Spans of documents -> rows (a, b, symbol, uid, doc_id, first, n), named by all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                windows, row, first, fields = _opened_spans(part, "spans", window)
                n = fields["n"]
                ends = zip(windows.at(first), windows.at(first + n - 1), strict=True)
                sides = [_mix(a * _FIRST + b * _LAST + n.astype(np.uint64)).view(np.int64) for a, b in ends]
                uid, ids = (part.column(c).to_numpy()[row] for c in ("uid", "doc_id"))
                columns = [*sides, fields["symbol"], uid, ids, fields["first"].astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "symbol", "uid", "doc_id", "first", "n"])

    return run


def _windows(window: int):
    """Windows of the spans of documents -> rows (a, b, uid, doc_id, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                windows, row, first, fields = _opened_spans(part, "rest", window)
                n = fields["n"]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # 0, 1, ... inside each span
                row = np.repeat(row, n)
                sides = [x.view(np.int64) for x in windows.at(np.repeat(first, n) + step)]
                uid, ids = (part.column(c).to_numpy()[row] for c in ("uid", "doc_id"))
                columns = [*sides, uid, ids, (np.repeat(fields["first"], n) + step).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "uid", "doc_id", "first"])

    return run


def _removed(window: int):
    """Texts with repeated spans -> kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, done, text, repeats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "done", "text", "repeats")), strict=True):
                if done is not None:
                    out.append((doc_id, n, 0, done, None))
                    continue
                words = words_of(text)
                edge = np.zeros(n + 1, dtype=np.int64)
                for r in repeats or ():
                    edge[r["first"]] += 1
                    edge[r["first"] + r["n"] + window - 1] -= 1
                gone = np.cumsum(edge[:n]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc_id, n, int(gone.sum()), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _in_two_documents(rows: DataFrame, *key: str) -> DataFrame:
    """(key, low) of keys with two doc_ids, low the smallest."""
    ends = rows.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return ends.where("low < high").drop("high")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of ``docs``.

    ``kept`` holds the kept words joined by one space where words were in doubt; it
    is null for a row that surely keeps all its words.
    """
    source = with_row_id(documents_of(docs))
    symbols = stored(source.mapInArrow(_symbols(window), "symbol long, uid long, doc_id long, first int, n int"), "symbols")
    shared = stored(_in_two_documents(symbols, "symbol").select("symbol"), "shared")
    span = F.struct("symbol", "first", "n")
    spans = symbols.join(shared.hint("merge"), "symbol").groupBy("uid").agg(F.collect_list(span).alias("spans"))  # one document's own spans
    opened = source.join(spans.hint("merge"), "uid", "left")
    opened = stored(opened.mapInArrow(_split_off, "uid long, doc_id long, n_words long, done string, text string, spans array<struct<symbol:bigint,first:int,n:int>>"), "opened")
    open_ = opened.where("done is null").select("uid", "doc_id", "text", "spans")

    stretches = stored(open_.mapInArrow(_stretches(window), "a long, b long, symbol long, uid long, doc_id long, first int, n int"), "stretches")
    known = stored(_in_two_documents(stretches, "a", "b"), "known")
    marked = stretches.join(known.hint("merge"), ["a", "b"], "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)))
    marked = stored(marked.select("symbol", "uid", "doc_id", "first", "n", "whole"), "marked")
    single = marked.where("not whole")
    left = stored(_in_two_documents(single, "symbol").select("symbol"), "left")
    rest = single.join(left.hint("merge"), "symbol").groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("rest"))

    windows = stored(open_.drop("spans").join(rest.hint("merge"), "uid").mapInArrow(_windows(window), "a long, b long, uid long, doc_id long, first int"), "windows")
    low = stored(_in_two_documents(windows, "a", "b"), "low")
    late = windows.join(low.hint("merge"), ["a", "b"]).where("doc_id > low").select("uid", "first", F.lit(1).alias("n"))
    repeats = marked.where("whole").select("uid", "first", "n").unionByName(late).groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("repeats"))
    joined = opened.drop("spans").join(repeats.hint("merge"), "uid", "left")
    return joined.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
