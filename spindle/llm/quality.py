"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated.

Training reads labelled documents alone (at most about `sample` of them, by a hash of their ids); scoring reads every text once.
Each partition sums its normal equations; the sums, not the rows, are added up in rounds of a bounded fan-in. Calibration
counts labelled rows in bins of the raw score, so the driver sees a bounded table at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused

_UPPER, _LOWERC, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_BLANK = [9, 10, 11, 12, 13, 32]
_PLAIN = [ord(c) for c in ".,;:?'\"()-"]
STATISTICS = 26
#: Bins of the raw score for calibration.
BINS = 2048
#: Labelled documents that training reads, about: all where there are no more, else those with the smallest hashes of their ids.
SAMPLE = 400_000
#: Arrays that one task adds up in a round.
FAN_IN = 16


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for a text that is null, empty or blank."""
    got = (text or "").split()
    if not got:
        return [0.0] * STATISTICS
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(got)
    upper, lower, digit, blank = int(count[_UPPER].sum()), int(count[_LOWERC].sum()), int(count[_DIGIT].sum()), int(count[_BLANK].sum())
    plain = int(count[_PLAIN].sum())
    wide = int(count[128:].sum())
    marks = n - upper - lower - digit - blank - plain - wide
    sizes = np.fromiter(map(len, got), np.int64, m)
    lines = [x for x in text.split("\n") if x.strip()]
    of_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    distinct = len(set(got))
    triples = max(1, m - 2)
    repeated = 1 - len(set(zip(got, got[1:], got[2:]))) / triples if m > 2 else 0.0
    first = sum(w[:1].isupper() for w in got)
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), upper / n, digit / n, blank / n, plain / n, wide / n, marks / n, np.log1p(1000 * marks / n),
        int(count[33]) / m, int(count[124]) / m, sizes.mean() / 10, sizes.std() / 10, min(int(sizes.max()), 200) / 50, (sizes > 15).mean(), distinct / m, np.log1p(distinct) / np.log1p(m), repeated,
        1 - len(set(lines)) / len(lines), np.log1p(of_lines.mean()), of_lines.std() / (1 + of_lines.mean()), first / m, sum(w.isupper() for w in got) / m, sum(not w.isalpha() for w in got) / m, int(count[46]) / m,
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of keep and features (array of statistics) of every document; other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", *keep, "features"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    shape = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    return read.mapInArrow(each, ", ".join(f"{c} {shape[c]}" for c in ("doc_id", *keep)) + ", features array<double>")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Fourier:
    """cos(x W + b) of standardised statistics, with the statistics themselves and a constant beside them."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, dimensions: int, width: float, seed: int) -> "Fourier":
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / width, (len(mean), dimensions)), rng.uniform(0, 2 * np.pi, dimensions))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.weights + self.shift) * np.sqrt(2 / len(self.shift)), x, np.ones((len(x), 1))])


@dataclass
class Model:
    fourier: Fourier
    coefficients: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.coefficients

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(x) else np.zeros(0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to weighted means y at increasing x: pooled blocks at their mean x."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


def _summed(frame: DataFrame, per_batch, size: int) -> np.ndarray:
    """The sum over all rows of arrays of `size` numbers that per_batch makes of each batch of rows.

    A partition gives one array; rounds of tasks add up FAN_IN of them each until the driver adds the last few.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += per_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    left = frame.rdd.getNumPartitions()
    parts = frame.mapInArrow(part, "total binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(added, "total binary")
    return np.sum([np.zeros(size), *(np.frombuffer(r["total"]) for r in parts.collect())], axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def marked(labels: DataFrame, folds: int, held: int, sample: int) -> DataFrame:
    """id_ and label (averaged) of labelled ids outside the held-out fold: all, or about `sample` where there are more."""
    marks = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.avg("label").cast("double").alias("label"))
    marks = checkpointed(marks.where(fold(F.col("id_"), folds) != held))
    there = marks.count()
    return marks if there <= sample else marks.where(F.pmod(F.xxhash64("id_"), F.lit(1 << 30)) < int(sample / there * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, dimensions: int = 192, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, sample: int = SAMPLE) -> Model:
    """The model of labelled documents (doc_id, text joined to doc_id, label) outside the held-out fold.

    Rows of fold 2 of 4 are never read; folds 0 and 1 fit the scores, fold 3 the calibration. Null labels are left out,
    repeated labels of a document averaged; of several documents with a labelled id each counts. Without any labelled rows
    every score is 0.5.
    """
    marks = marked(labels, 4, 2, sample)  # about `sample` pairs of numbers at most, so they may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("id_"))
    known = checkpointed(with_statistics(rows, "label").select("features", "label", fold(F.col("doc_id"), 4).alias("fold")))
    fitted = known.where(F.col("fold") != 3).select("features", "label")
    d = STATISTICS

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = _summed(fitted, moments, 2 * d + 1)
    if not sums[0]:
        nothing = Fourier.drawn(np.zeros(d), np.ones(d), 1, 1.0, seed)
        return Model(nothing, np.zeros(d + 2), np.array([0.0]), np.array([0.5]))
    mean = sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean**2, 1e-12))
    fourier = Fourier.drawn(mean, np.maximum(scale, 1e-4), dimensions, width, seed)
    k = dimensions + d + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        if not batch.num_rows:
            return np.zeros(k * k + k)
        z = fourier(_matrix(batch.column(0)))
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch.column(1).to_numpy()])

    sums2 = _summed(fitted, normal, k * k + k)
    gram = sums2[: k * k].reshape(k, k) / sums[0] + ridge * np.diag([*[1.0] * (k - 1), 1e-6])
    model = Model(fourier, np.linalg.solve(gram, sums2[k * k :] / sums[0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(_matrix(batch.column(0))), -1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(((raw + 1) / 3 * BINS).astype(np.int32)), pa.array(raw), batch.column(1)], ["bin", "raw", "label"])

    counted = known.where(F.col("fold") == 3).select("features", "label").mapInArrow(binned, "bin int, raw double, label double")
    rows = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"), F.sum("label").alias("label")).orderBy("bin").collect()
    if rows:
        n, raw, label = (np.array([r[c] for r in rows], float) for c in ("n", "raw", "label"))
        model.knots, model.values = isotonic(raw / n, label / n, n)
    return model


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, as a pandas UDF."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)))

    return F.pandas_udf(score, "double")(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for better texts) and predicted of every document.

    Nothing but the text enters a score. Null, empty and blank texts have statistics of zero and are scored like others; null
    doc_ids have no label; repeated rows are scored alike; an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(fit(docs, labels, sample=sample), F.col("text")).alias("score"))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that score at least the threshold.

    Null, empty and blank texts are scored like others (statistics of zero), repeated rows alike; columns may have any names.
    """
    score = unused(docs, "score_")
    return docs.withColumn(score, score_column(fit(docs, labels, sample=sample), F.col("text"))).where(F.col(score) >= threshold).drop(score)
