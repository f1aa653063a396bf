"""Language identification (operator 7).

Sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3
characters with word ends, hashed to ``DIMENSIONS`` columns), trained with
FTRL-proximal (follow the regularised leader) and elastic-net penalties, then
calibrated with one temperature. Document frequencies are counted over all
learning rows; the model itself is fitted on a bounded sample of them
(``SAMPLE`` rows, split evenly over the languages; a documented parameter).

A text that is null or has no letter gets ``und`` with score 0. Without any
learning row every text gets ``und``. Extra columns are ignored; rows are
judged one by one, so repeated rows and ties change nothing (equal
probabilities go to the alphabetically first language).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 14
SAMPLE = 4000
UNKNOWN = "und"
ROW = 4096
_LETTER = regex.compile(r"\p{L}")
#: Characters processed at a time of a long text.
BLOCK = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the lower-cased text."""
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for start in range(0, len(text), BLOCK):  # neighbouring blocks share two characters
        part = text[max(0, start - 2) : start + BLOCK].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77) + np.uint32(17)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(29)
        skip = min(start, 2)
        for grams in (code[skip:] * np.uint32(0x165667B1), two[max(0, skip - 1) :], three):
            mixed = grams ^ (grams >> np.uint32(15))
            slot = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
            total += np.bincount(slot, minlength=DIMENSIONS)
    return total


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF vector with logarithmic term frequencies."""
    vector = np.log1p(counts) * idf
    norm = math.sqrt(float(vector @ vector))
    return vector / norm if norm else vector


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows of ``texts`` each column occurs, and the number of rows.

    Each task adds up its own rows, so a task sends DIMENSIONS counts whatever it read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += gram_counts(text) > 0
                rows += 1
        if rows:
            slots = np.r_[np.flatnonzero(total), -1]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.r_[total[slots[:-1]], rows], pa.int64())], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # DIMENSIONS + 1 rows
    counts = np.zeros(DIMENSIONS)
    slots, n = found["slot"].to_numpy(), found["n"].to_numpy()
    counts[slots[slots >= 0]] = n[slots >= 0]
    return counts, int(n[slots < 0].sum())


def sampled_vectors(rows: DataFrame, idf: np.ndarray, bound: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, columns, values) of at most about ``bound`` rows of (pick, text, lang), as many of each language."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = bound / max(1, len(counts))
    shares = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        shares = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(shares)
    place = F.pmod(F.xxhash64("pick", F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    spread = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                vectors = [_weighted(gram_counts(t), spread.value) for t in part.column("text").to_pylist()]
                at = [np.flatnonzero(v) for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [part.column("pick"), part.column("lang"), pa.array([x.astype(np.int32).tobytes() for x in at], pa.binary()), pa.array([v[x].astype(np.float32).tobytes() for v, x in zip(vectors, at, strict=True)], pa.binary())],
                    names=["pick", "lang", "at", "value"],
                )

    sample = rows.where(place < shares).select("pick", "text", "lang").mapInArrow(run, "pick long, lang string, at binary, value binary")
    found = sample.toPandas().sort_values(["pick", "lang"], kind="stable")
    return [(lang, np.frombuffer(at, np.int32), np.frombuffer(value, np.float32).astype(np.float64)) for lang, at, value in zip(found["lang"], found["at"], found["value"], strict=True)]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights (DIMENSIONS, classes) after per-coordinate FTRL-proximal steps on softmax loss."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, at, value = rows[k]
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(DIMENSIONS))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss, by golden section on its logarithm.

    Targets keep one pseudo-row of doubt, so rows without an error give a finite answer.
    """
    target = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        scaled = logits / math.exp(t)
        top = scaled.max(axis=1, keepdims=True)
        return float(np.mean((target * (top + np.log(np.exp(scaled - top).sum(axis=1, keepdims=True)) - scaled)).sum(axis=1)))

    low, high, ratio = math.log(0.02), math.log(50), (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(learn: DataFrame, bound: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang); rows with a null lang or a text without letters teach nothing."""
    rows = learn.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("pick"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts, total = document_frequencies(rows)
    idf = np.where(counts > 0, np.log((1 + total) / (1 + counts)) + 1, 0.0)
    sample = sampled_vectors(rows, idf, bound) if total else []
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), 1.0)
    coded = [(languages.index(lang), at, value) for lang, at, value in sample]
    fit = [x for k, x in enumerate(coded) if k % 5]
    weights = ftrl(fit or coded, len(languages))
    check = [x for k, x in enumerate(coded) if k % 5 == 0]
    logits = np.array([value @ weights[at] for _, at, value in check])
    heat = temperature(logits, np.array([x[0] for x in check])) if len(check) >= 20 else 1.0
    return Model(languages, idf, weights, heat)


def predict(text: Column, model: Model, df: DataFrame) -> Column:
    """Struct column (lang_pred, score) of a text column of ``df``."""
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(column: pd.Series) -> pd.DataFrame:
        m: Model = spread.value
        found = []
        for start in range(0, len(column), 128):
            texts = column.iloc[start : start + 128]
            if not m.languages:
                found += [(UNKNOWN, 0.0)] * len(texts)
                continue
            clear = [isinstance(t, str) and has_letter(t) for t in texts]
            vectors = np.zeros((len(texts), DIMENSIONS))
            for k, (t, ok) in enumerate(zip(texts, clear, strict=True)):
                if ok:
                    vectors[k] = _weighted(gram_counts(t), m.idf)
            logits = vectors @ m.weights / m.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            found += [(m.languages[b], float(q[b])) if ok else (UNKNOWN, 0.0) for b, q, ok in zip(best, p, clear, strict=True)]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return judge(text)
