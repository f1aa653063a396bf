"""Quality classifier (operator 10).

Document statistics (lengths, character classes, repetition, shape of words and
lines) are standardised and mapped to random Fourier features, which approximate
a Gaussian kernel. Partitions add up the normal equations of ridge regression,
one set for each of ``FOLDS`` folds; the sums are solved without each fold in
turn, so every learning row gets a score from a model that has not seen it, and
those scores, summed in bins, fit an isotonic calibration.

Labels come from at most about ``LABELS`` rows (a documented bound); means and
deviations of the statistics are taken over all rows. A null text counts as
empty and is scored like any other. Without labels of both kinds every row gets
the share of ones (0.5 if there are none). Extra columns are ignored; repeated
rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import documents_of

LABELS = 20_000
FEATURES = 256
FOLDS = 4
BINS = 400
RIDGE = 3.0
WIDTH = 4.0
#: Tasks that add up normal equations; each sends FEATURES rows for each fold.
SUMMING_TASKS = 12
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "line", "symbol", "bar", "stop", "comma", "high",
    "distinct_words", "top_word", "top_pair", "distinct_lines", "long_words", "symbol_words", "upper_words", "short_words", "repeat_next", "stop_words",
)

_CLASS = np.full(256, 11, dtype=np.int64)  # classes 0..10 below, 11 the rest
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"#$%&*!@^~+=<>{}[]\\/", b"|", b".?", b",;:", b"abcdefghijklmnopqrstuvwxyz", b"'\"()-_")):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 10


def statistics(text: str | None) -> list[float]:
    """Numbers of NAMES for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=12) / n
    words = data.split()
    count = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    number = dict(zip(seen, range(len(seen)), strict=True))
    coded = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = np.sort(coded[:-1] * len(seen) + coded[1:])
    runs = np.diff(np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1], True])) if len(pairs) else np.zeros(1)
    shorts = float((lengths <= 2).sum()) / count
    uppers = sum(w.isupper() for w in words) / count
    symbols = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / count
    repeats = int((coded[1:] == coded[:-1]).sum()) / count
    common = sum(c for w, c in seen.items() if len(w) <= 4 and w.isalpha() and c > 1) / count
    return [
        math.log1p(len(data)), math.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0,
        kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[10],
        len(seen) / count, max(seen.values(), default=0) / count, int(runs.max()) / count,
        len(set(lines)) / max(1, len(lines)), float((lengths > 15).sum()) / count, symbols, uppers, shorts, repeats, common,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start in range(0, batch.num_rows, 1000):
                rows = [statistics(t) for t in texts.slice(start, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(start, 1000), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return documents_of(docs).mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # scores at which the calibration is known
    values: np.ndarray  # probabilities there

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turn + self.phase) * math.sqrt(2 / self.turn.shape[1])
        return np.hstack([waves, z / 6, np.ones((len(z), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.steps, self.values)


def isotonic(score: np.ndarray, label_sum: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to label_sum / weight in order of score."""
    blocks: list[list[float]] = []
    for k in np.argsort(score, kind="stable"):
        blocks.append([label_sum[k], weight[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + c]
    fitted = np.concatenate([np.full(int(c), s / w) for s, w, c in blocks])
    out = np.empty(len(score))
    out[np.argsort(score, kind="stable")] = fitted
    return out


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per fold Z'Z and Z'y, summed inside partitions, then row by row over partitions."""
    spread = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                z = spread.value.features(np.array(part["stats"].tolist(), dtype=np.float64))
                both = np.hstack([z, part["label"].to_numpy(dtype=np.float64)[:, None]])
                sums[fold] = sums.get(fold, 0) + z.T @ both
        for fold, total in sums.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(len(total)), "sums": [x for x in total]})

    parts = rows.repartition(SUMMING_TASKS).mapInPandas(run, "fold int, row int, sums array<double>")
    flat = parts.select("fold", "row", F.posexplode("sums").alias("col", "value")).groupBy("fold", "row", "col").agg(F.sum("value").alias("value"))
    found = flat.toPandas()  # FOLDS * FEATURES^2 numbers, whatever the input
    size = FEATURES + len(NAMES) + 1
    total = np.zeros((FOLDS, size, size + 1))
    total[found["fold"], found["row"], found["col"]] = found["value"]
    return total[:, :, :size], total[:, :, size]


def _solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)), target)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on (doc_id, stats) of all rows and bounded (doc_id, label)."""
    size = len(NAMES)
    cells = [F.col("stats")[k].cast("double") for k in range(size)]
    first = stats.agg(*[F.avg(c).alias(f"a{k}") for k, c in enumerate(cells)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(cells)]).first()
    mean = np.array([first[f"a{k}"] or 0.0 for k in range(size)])
    scale = np.array([first[f"s{k}"] or 1.0 for k in range(size)])
    draw = np.random.default_rng(5)
    model = Model(mean, scale, draw.normal(0, 1 / WIDTH, (size, FEATURES)), draw.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + size + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    rows = stats.join(F.broadcast(labels), "doc_id")  # bounded by LABELS
    rows = rows.select("stats", "label", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS))).cast("int").alias("fold"))
    gram, target = _normal_equations(rows, model)
    count, ones = gram[:, -1, -1].sum(), target[:, -1].sum()
    if not count or ones in (0, count):
        model.values = np.full(2, ones / count if count else 0.5)
        return model
    held = np.array([_solve(gram.sum(0) - gram[f], target.sum(0) - target[f]) for f in range(FOLDS)])
    spread = rows.sparkSession.sparkContext.broadcast((model, held))

    @F.pandas_udf("double")
    def out_of_fold(stat: pd.Series, fold: pd.Series) -> pd.Series:
        m, w = spread.value
        return pd.Series((m.features(np.array(stat.tolist(), dtype=np.float64)) * w[fold.to_numpy()]).sum(axis=1))

    bins = F.round(F.least(F.greatest(out_of_fold("stats", "fold"), F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin")
    binned = rows.select(bins, "label").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).toPandas()  # 2 * BINS + 1 rows
    binned = binned.sort_values("bin")
    model.weights = _solve(gram.sum(0), target.sum(0))
    model.steps = binned["bin"].to_numpy(dtype=np.float64) / BINS
    model.values = isotonic(model.steps, binned["ones"].to_numpy(dtype=np.float64), binned["n"].to_numpy(dtype=np.float64))
    return model


def score(stats: Column, model: Model, df: DataFrame) -> Column:
    """Calibrated probability of label 1 for a column of statistics."""
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(column: pd.Series) -> pd.Series:
        m: Model = spread.value
        if not len(column):
            return pd.Series([], dtype="float64")
        return pd.Series(m.calibrated(m.features(np.array(column.tolist(), dtype=np.float64)) @ m.weights))

    return judge(stats)
