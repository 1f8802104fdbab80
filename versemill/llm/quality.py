"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics. Random Fourier features approximate a Gaussian kernel over the standardised
vectors; the normal equations of ridge regression are sums over the labelled training rows, taken partition by partition and
added up; isotonic regression on a part of the training rows that the ridge has not seen maps its scores to probabilities, from
counts in fixed bins. What reaches the driver has the same size whatever the input. Scores learn from every labelled training row, filters from
at most SAMPLE of them, chosen by a hash of their ids.

Defined results: null is the empty text, whose statistics are all zero; rows without a label or with one other than 0 or 1 are
not learned from; with no label of either kind every score is 0.5; repeated rows and repeated labels count each; ids that are
null have no label; texts are read whole whatever their length; all columns of filtered documents stay, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import fold_of, raw_texts, training_labels
from versemill.session import materialize, ship

FOLDS = 5  # fold 0 is held out
CALIBRATION_FOLD = 4  # training rows that only the calibration sees
SAMPLE = 50_000  # labelled rows that a filter learns from, at most
COMPONENTS = 128
RIDGE = 1.0
BINS = 400
THRESHOLD = 0.3

UPPER, LOWER, DIGIT, SPACE, BANG, SYMBOL, BAR, STOP, OTHER, WIDE = range(10)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, WIDE
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[[ord(c) for c in "!?"]] = BANG
CLASS[[ord(c) for c in "#$%&*+=<>@^~\\_"]] = SYMBOL
CLASS[[ord(c) for c in "|{}[]"]] = BAR
CLASS[[ord(c) for c in ".,;:"]] = STOP
N_STATS = 26


def statistics(raw: bytes) -> np.ndarray:
    """Statistics of a whole text: shares of character classes overall and in the worst line, words, repetition, line shapes."""
    out = np.zeros(N_STATS)
    n = len(raw)
    x = np.frombuffer(raw, dtype=np.uint8)
    cls = CLASS[x]
    inside = cls != SPACE
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    m = len(starts)
    if not m:
        return out
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True])))
    share = np.bincount(cls, minlength=10) / n
    out[:10] = share
    low = raw.lower().split()
    types = len(set(low))
    out[10] = np.log1p(n) / 10
    out[11] = types / m
    out[12] = types / np.sqrt(m) / 10
    out[13] = sum(map(eq, low, low[1:])) / m
    out[14] = n / m / 10
    breaks = np.flatnonzero(x == 10)
    line_starts = np.concatenate(([0], breaks + 1))
    line_starts = line_starts[line_starts < n]
    sizes = np.diff(np.concatenate((line_starts, [n])))
    lines = [s for s in raw.split(b"\n") if s.strip()]
    out[15] = 1 - len(set(lines)) / max(1, len(lines))
    out[16] = np.log1p(n / max(1, len(lines))) / 10
    upper, lower = cls == UPPER, cls == LOWER
    uppers, lowers = (np.add.reduceat(a, starts, dtype=np.int32) for a in (upper, lower))
    last = cls[ends]
    out[17] = ((last == BANG) | (last == SYMBOL) | (last == BAR)).mean()
    out[18] = ((uppers > 0) & (lowers == 0)).mean()
    out[19] = (upper[starts] & (uppers == 1)).mean()
    out[20] = (last == STOP).mean()
    p = share[share > 0]
    out[21] = -(p * np.log(p)).sum()
    long = sizes >= 30
    if not long.any():
        long = sizes == sizes.max()
    for k, c in enumerate((UPPER, BANG, SYMBOL, BAR)):
        out[22 + k] = (np.add.reduceat(cls == c, line_starts, dtype=np.int64) / sizes)[long].max()
    return out


def _stat_batches(batches):
    for b in batches:
        rows = np.array([statistics(t) for t in raw_texts(b.column(1))], dtype=np.float32).reshape(-1, N_STATS)
        cells = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_STATS).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), cells], ["doc_id", "stats"])


class Fourier:
    """Random Fourier features of standardised statistics; the first feature is the constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, components: int = COMPONENTS, seed: int = 17):
        rng = np.random.RandomState(seed)
        self.mean, self.std = mean, std
        self.w = rng.normal(size=(len(mean), components)) / np.sqrt(len(mean)) * 1.5
        self.b = rng.uniform(0, 2 * np.pi, components)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate((np.ones((len(f), 1)), f), axis=1)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, N_STATS)


def _moments(batches):
    """Count, sums and squared sums of a partition's statistics."""
    total = np.zeros(1 + 2 * N_STATS)
    for b in batches:
        x = _matrix(b.column(0))
        total += np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["i", "row"])


def _normal(fourier: Fourier):
    """A partition's share of the normal equations, one row for each feature: products with all features, then with the label."""

    def run(batches):
        d = len(fourier.b) + 1
        total = np.zeros((d, d + 1))
        for b in batches:
            f = fourier(_matrix(b.column(0)))
            y = np.array(b.column(1).to_pylist(), dtype=np.float64)
            total += f.T @ np.concatenate((f, y[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _summed(df: DataFrame, rows: int, cols: int) -> np.ndarray:
    """Elementwise sum of the rows of equal i; rows x cols numbers reach the driver."""
    cells = df.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((rows, cols))
    for r in cells.collect():
        out[r.i, r.j] = r.v
    return out


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Nondecreasing rates by bin: pool adjacent violators of the shares of positives; empty bins lie between their neighbours."""
    used = np.flatnonzero(weight)
    pools: list[list[float]] = []
    for k in used:
        pools.append([positive[k], weight[k], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + p, pools[-1][1] + w, pools[-1][2] + n]
    rates = np.concatenate([np.full(int(n), p / w) for p, w, n in pools])
    return np.interp(np.arange(len(weight)), used, rates)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


class Model:
    def __init__(self, fourier: Fourier, weights: np.ndarray, rates: np.ndarray | None):
        self.fourier, self.weights, self.rates = fourier, weights, rates

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, with a small share of the raw score so that ties of a pool keep their order."""
        if self.rates is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(0.98 * self.rates[_bin(raw)] + 0.02 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def fit(labelled: DataFrame) -> Model:
    """Model from rows (stats, y, fold), all of them training rows."""
    m = _summed(labelled.select("stats").mapInArrow(_moments, "i int, row array<double>"), 1, 1 + 2 * N_STATS)[0]
    n = m[0]
    if not n:
        return Model(Fourier(np.zeros(N_STATS), np.ones(N_STATS)), np.zeros(COMPONENTS + 1), None)
    mean = m[1 : 1 + N_STATS] / n
    std = np.sqrt(np.maximum(m[1 + N_STATS :] / n - mean**2, 0)) + 1e-3
    fourier = Fourier(mean, std)
    d = COMPONENTS + 1
    fitted = labelled.filter(F.col("fold") != CALIBRATION_FOLD).select("stats", F.col("y").cast("double"))
    sums = _summed(fitted.mapInArrow(_normal(fourier), "i int, row array<double>"), d, d + 1)
    reg = np.eye(d) * RIDGE
    reg[0, 0] = 1e-6
    weights = np.linalg.solve(sums[:, :d] + reg, sums[:, d])
    model = Model(fourier, weights, None)

    def bins(batches):
        total = np.zeros((2, BINS))
        for b in batches:
            k, y = _bin(model.raw(_matrix(b.column(0)))), np.array(b.column(1).to_pylist(), dtype=float)
            total += np.array([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    held = labelled.filter(F.col("fold") == CALIBRATION_FOLD).select("stats", F.col("y").cast("double"))
    weight, positive = _summed(held.mapInArrow(bins, "i int, row array<double>"), 2, BINS)
    if weight.sum() > 0 and 0 < sums[0, d] < sums[0, 0]:
        model.rates = isotonic(weight, positive)
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_stat_batches, "doc_id long, stats array<float>")


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from all labelled rows outside fold 0."""
    stats = materialize(document_statistics(docs), "quality-stats")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("y")).filter(F.col("y").isin(0, 1))
    y = y.withColumn("fold", fold_of("doc_id", folds)).filter(F.col("fold") != 0)
    model = fit(materialize(stats.join(y, "doc_id").select("stats", "y", "fold"), "quality-train"))

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    held = (fold_of("doc_id", folds) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, bound: int = SAMPLE) -> DataFrame:
    """The documents that the model accepts, with all their columns: each row is judged where it is, so nothing is shuffled.

    Learns from at most `bound` labelled rows, whose ids are broadcast, so that only their texts are read for that.
    """
    ids = training_labels(labels, label_col, fold_of("doc_id", folds) != 0, bound, "quality-ids")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    stats = document_statistics(chosen).join(F.broadcast(ids), "doc_id").withColumn("fold", fold_of("doc_id", folds))
    model = fit(materialize(stats.select("stats", "y", "fold"), "quality-train"))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in raw_texts(b.column(at))], dtype=np.float32).reshape(-1, N_STATS)
            yield b.filter(pa.array(model.score(x.astype(np.float64)) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
