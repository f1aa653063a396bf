"""Toxicity by maximum-scoring segments (operator 3).

Tokens (lower-cased, runs of letters and digits) are counted in toxic and other
learning documents, hashed to ``SLOTS`` slots. Their log-odds use an informative
Dirichlet prior, the counts of both sides together, which pulls rare tokens to
zero; a constant ``DRIFT`` is taken off, so ordinary text has a negative
expectation. One linear scan per text (Ruzzo and Tompa) finds every maximal
scoring segment. Segment scores follow an extreme-value law in clean text;
its two parameters are fitted to the best segments of clean learning documents,
and give each segment a chance value and each text the score of the union. The
text's probability is a logistic fit to these.

Counts, prior and extreme-value law cover every learning row; only the logistic
fit reads a sample of at most about ``LABELS`` rows (a documented bound). A null text
counts as empty; a text without a segment has the probability of that case.
Without labels of both kinds every row gets the share of ones (0.5 if there are
none). Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of, sampling_order, stored

LABELS = 20_000
SLOTS = 1 << 18
PRIOR = 20.0
CERTAIN = 4.5
DRIFT = 0.25
SIGNIFICANT = 0.01
STORE_WORDS = 200_000
_PLAIN = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Chinese characters.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M")
_ALONE = re.compile(f"[{_SINGLE}]")
_WORDS = re.compile(rf"(?:[^\W_{_SINGLE}]+[{_MARKS}]*)+|(?=[^\W_])[{_SINGLE}][{_MARKS}]*")


@lru_cache(1 << 16)
def _is_letter(c: str) -> bool:
    """ASCII, or a letter or digit that only goes with its neighbours."""
    return c.isascii() or (c.isalnum() and not _ALONE.match(c))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower-cased; single characters of scripts without spaces. Marks stay with their letter."""
    text = (text or "").lower()
    if text.isascii() or all(map(_is_letter, set(text))):  # other bytes belong to words
        return text.encode("utf-8").translate(_PLAIN).split()
    return [w.encode("utf-8", "surrogatepass") for w in _WORDS.findall(text)]


def slot(token: bytes) -> int:
    return xxhash.xxh32_intdigest(token, seed=9) % SLOTS


def token_counts(rows: DataFrame) -> DataFrame:
    """(half, slot, toxic, other): in how many rows of (text, label, half) a slot occurs; slot -1
    counts the rows. Each task sends at most 2 * SLOTS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, SLOTS + 1), dtype=np.int64)
        for batch in batches:
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half")), strict=True):
                words = tokens(text)
                total[half, label, SLOTS] += 1
                if words:
                    total[half, label, np.unique(np.fromiter(map(slot, words), np.int64, len(words)))] += 1
        for half in (0, 1):
            at = np.flatnonzero(total[half].sum(axis=0))
            slots = np.where(at == SLOTS, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(at), half), slots, total[half, 1, at], total[half, 0, at])], names=["half", "slot", "toxic", "other"])

    parts = rows.select("text", "label", "half").mapInArrow(run, "half long, slot long, toxic long, other long")
    return parts.groupBy("half", "slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(toxic: np.ndarray, other: np.ndarray, toxic_texts: int, other_texts: int) -> np.ndarray:
    """Log-odds of each slot under an informative Dirichlet prior of weight PRIOR.

    A slot whose likelihood ratio is within chance (CERTAIN deviations, which
    allows for the many slots tried) keeps the prior odds: zero.
    """
    both = toxic + other
    prior = PRIOR * both / max(1.0, float(toxic_texts + other_texts))
    share = toxic_texts / max(1, toxic_texts + other_texts)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.log((toxic + share * prior) / (toxic_texts + share * PRIOR)) - np.log((other + (1 - share) * prior) / (other_texts + (1 - share) * PRIOR))
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(other > 0, other * np.log(other / (both * (1 - share))), 0))
    return np.where((both > 0) & (ratio > CERTAIN**2), found, 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint, in linear time.

    Candidates carry the sums before and after them and a link to the nearest
    earlier candidate with a smaller sum before, so none is looked at in vain.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []
    for k in np.flatnonzero(scores > 0).tolist():
        start, before, after = k, total[k], total[k + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, k + 1, before, after, j))
                break
            start, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, float(after - before)) for a, b, before, after, _ in found]


@dataclass
class Model:
    odds: np.ndarray
    rate: float  # lambda of the extreme-value law
    size: float  # log K
    weights: np.ndarray  # logistic: constant, best segment, all significant segments
    constant: float | None = None

    def chance(self, score: float, length: int) -> float:
        return chance(score, length, self.rate, self.size)


def chance(score: float, length: int, rate: float, size: float) -> float:
    """Chance of a segment of this score or more in clean text of ``length`` tokens."""
    return -math.expm1(-math.exp(min(50.0, size + math.log(max(1, length)) - rate * score)))


class Scorer:
    """Token scores with a bounded store of tokens seen."""

    def __init__(self, odds: np.ndarray):
        self.odds, self.known = odds, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > STORE_WORDS:
            known.clear()
        out = np.empty(len(words))
        for k, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = float(self.odds[slot(w)]) - DRIFT
            out[k] = s
        return out


def passages(text: str | None, model: Model, scorer: Scorer) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of tokens and every segment as (first token, end, score, chance)."""
    words = tokens(text)
    found = segments(scorer(words))
    return len(words), [(a, b, s, model.chance(s, len(words))) for a, b, s in found]


def _evidence(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """-log chance of the best segment and of the union of the significant ones, both bounded."""
    best = min((p for *_, p in found), default=1.0)
    union = sum(-math.log(max(p, 1e-12)) for *_, p in found if p < SIGNIFICANT)
    return min(30.0, -math.log(max(best, 1e-12))), math.log1p(union)


def extreme_value(n: int, best: float, square: float, log_length: float) -> tuple[float, float]:
    """(lambda, log K) by moments of the length-corrected best scores of ``n`` clean texts:
    means of the scores, of their squares and of the logarithms of the lengths."""
    deviation = math.sqrt(max(0.0, square - best * best))
    if n < 10 or deviation <= 1e-9:
        return 1.0, 0.0
    rate = math.pi / math.sqrt(6) / deviation
    rate = min(max(rate, 0.2), 5.0)
    # E[max] = (log(K n) + gamma) / lambda
    return rate, rate * best - log_length - 0.5772156649


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic fit with a small ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the texts of ``docs`` that have a label (doc_id, label), however many."""
    # texts meet their labels in one shuffle, at every size; the steps below read the labelled ones twice
    rows = documents_of(docs).join(labels.hint("merge"), "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).cast("int")
    rows = stored(rows.select("text", "label", half.alias("half"), sampling_order(F.col("doc_id"), 3).alias("order")), "labelled")
    flat = Model(np.zeros(SLOTS), 1.0, 0.0, np.zeros(3), 0.5)
    counted = stored(token_counts(rows), "counts")  # 2 * SLOTS rows at most
    texts = np.zeros((2, 2))  # by half and label
    total = np.zeros((2, 2, SLOTS))
    for r in counted.where("slot < 0").collect():
        texts[r["half"]] = r["other"], r["toxic"]
    n, ones = int(texts.sum()), int(texts[:, 1].sum())
    if not n or ones in (0, n):
        flat.constant = ones / n if n else 0.5
        return flat
    found = counted.where("slot >= 0").toPandas()
    total[found["half"], 0, found["slot"]], total[found["half"], 1, found["slot"]] = found["other"], found["toxic"]

    def odds_of(halves: list[int]) -> np.ndarray:
        other, toxic = total[halves].sum(axis=0)
        return log_odds(toxic, other, *texts[halves].sum(axis=0)[::-1])

    # Each half of the rows is judged by the counts of the other half, as new texts will be.
    spread = rows.sparkSession.sparkContext.broadcast([odds_of([1]), odds_of([0])])
    kept = min(1.0, LABELS / n)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Label, length and best score of every text; of those in the sample also the segments."""
        scorers = [Scorer(x) for x in spread.value]
        for batch in batches:
            out = []
            for text, label, k, order in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half", "order")), strict=True):
                words = tokens(text)
                scores = [s for *_, s in segments(scorers[k](words))]
                out.append((label, len(words), max(scores, default=0.0), scores if order < kept else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["label", "n", "best", "scores"])

    first = stored(rows.mapInArrow(judged, "label long, n long, best double, scores array<double>"), "segments")
    clean = first.where("label = 0 and n > 0")
    top = clean.agg(F.percentile_approx("best", 0.98, 10_000)).first()[0]  # mislabelled texts are no clean background
    bulk = clean.where(F.col("best") <= F.lit(top or 0.0))
    moments = bulk.agg(F.count("*"), F.avg("best"), F.avg(F.col("best") * F.col("best")), F.avg(F.log("n"))).first()
    law = extreme_value(moments[0], *(x or 0.0 for x in moments[1:]))
    model = Model(odds_of([0, 1]), *law, np.zeros(3))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("label", "n", "scores"))
            out = [(float(y), *_evidence([(0, 0, s, chance(s, n, *law)) for s in scores])) for y, n, scores in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.float64()) for c in range(3)], names=["label", "one", "all"])

    sample = first.where("scores is not null").mapInArrow(evidence, "label double, one double, all double").toPandas()  # about LABELS rows
    x = np.column_stack([np.ones(len(sample)), sample["one"], sample["all"]])
    model.weights = logistic(x, sample["label"].to_numpy())
    return model


def judge(text: Column, model: Model, df: DataFrame) -> Column:
    """Struct column (score, n_passages, passages) of a text column.

    ``passages`` are the significant segments as ``first-end`` token numbers, comma-joined.
    """
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_passages long, passages string")
    def run(column: pd.Series) -> pd.DataFrame:
        m: Model = spread.value
        scorer = Scorer(m.odds)
        out = []
        for text in column:
            _, found = passages(text if isinstance(text, str) else "", m, scorer)
            sure = [x for x in found if x[3] < SIGNIFICANT]
            p = m.constant if m.constant is not None else 1 / (1 + math.exp(-float(np.clip(m.weights @ (1.0, *_evidence(found)), -30, 30))))
            out.append((p, len(sure), ",".join(f"{a}-{b}" for a, b, *_ in sure)))
        return pd.DataFrame(out, columns=["score", "n_passages", "passages"])

    return run(text)
