"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, hashed into a fixed table; a text is the mean of
its words, each weighted by the root of how often it occurs, so that a line repeated over and over doesn't drown the rest. A misspelling that was never seen shares most n-grams, and so most of its vector, with the word it hides.
As text and word are means, the difference of the two class scores of a text is the mean of one number per distinct word:
scoring keeps a table of the words met so far and needs one look-up per distinct word.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused
from .quality import fold

BUCKETS = 1 << 17
SIZE = 4
#: Share of the running words from which on a word counts for less: by COMMON / (COMMON + share).
COMMON = 1e-3
#: Factor of the mean of the words before the softmax.
SCALE = 100.0
#: Most labelled documents that training reads, chosen by a hash of their ids; fewer if there are fewer.
SAMPLE = 6_000
WORD = re.compile(r"[^\W_]+(?:['@$!*][^\W_]+)*")
#: Runs of more letters than this are read as pieces of this length, each OVERLAP letters into the one before: nothing is left out.
LONG, OVERLAP = 40, 12
#: Most bytes of text that training takes to its task; of the sample those documents, in its order, that still have room.
SAMPLE_BYTES = 64 << 20
_SCORES: dict[str, "_Words"] = {}


def words(text: str | None) -> list[str]:
    """The lower-cased words of a whole text; signs that stand for letters stay inside them.

    A run of more than LONG letters (words glued together, scripts without blanks) is read as overlapping pieces, so that what
    toxic stem it holds is not lost in the mean of its n-grams.
    """
    found = WORD.findall(text.lower()) if text else []
    if found and max(map(len, found)) > LONG:
        return [p for w in found for p in ([w] if len(w) <= LONG else (w[i : i + LONG] for i in range(0, len(w) - OVERLAP, LONG - OVERLAP)))]
    return found


def grams(word: str) -> list[int]:
    """Buckets of a word: itself and its character n-grams of 3 to 5 with marks at both ends."""
    w = f"<{word}>"
    crc = zlib.crc32
    return [crc(w.encode()) % BUCKETS, *(crc(w[i : i + n].encode(), n) % BUCKETS for n in (3, 4, 5) for i in range(len(w) - n + 1))]


@dataclass
class Model:
    """Per bucket, the difference of the class scores it adds; their offset; the calibration of the difference."""

    weight: np.ndarray
    common: dict[str, float]
    bias: float
    knots: np.ndarray
    values: np.ndarray
    name: str

    def margins(self, texts: list[str | None]) -> np.ndarray:
        table = _SCORES.get(self.name)
        if table is None:
            _SCORES.clear()
            table = _SCORES[self.name] = _Words(self.weight, self.common)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            bag = Counter(words(text))
            parts = [n**0.5 for n in bag.values()]
            out[i] = self.bias + (sum(map(mul, map(table.__getitem__, bag), parts)) / sum(parts) if bag else 0.0)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.interp(self.margins(texts), self.knots, self.values) if len(texts) else np.zeros(0)


class _Words(dict):
    """The number of each word met so far; forgets all at a bound."""

    def __init__(self, weight: np.ndarray, common: dict[str, float], entries: int = 600_000):
        self._weight, self._common, self._entries = weight, common, entries

    def __missing__(self, word: str) -> float:
        if len(self) >= self._entries:
            self.clear()
        got = self._weight[grams(word)]
        value = float(got.sum() / len(got)) * COMMON / (COMMON + self._common.get(word, 0.0))
        self[word] = value
        return value


def train(texts: list[str], toxic: np.ndarray, steps: int = 2000, batch: int = 64, rate: float = 40.0, sparse: float = 2e-4, kept: float = 0.06, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """Vectors of the buckets, class vectors, class offsets and the shares of common words, fitted by gradient descent on the log loss of the softmax.

    Both classes weigh the same. A step is in proportion to the gradient, not normed per number as in adaptive methods, so
    what many texts of a class share outweighs the words that single texts happen to have. One word in fifty decides a
    text, so the mean is scaled up before the softmax. Each step draws the length of every bucket's vector nearer to zero
    by `sparse` (a group lasso): buckets that tell nothing end near zero. After 5/8 of the passes over the texts (about
    `steps` steps in all, 8 to 100 passes) the buckets with a vector shorter than `kept` of the longest go to zero and stay there, and the rest
    are trained on, faster and without the pull. Buckets that no text has are zero.
    """
    index: dict[str, int] = {}
    docs = [np.unique(np.array([index.setdefault(w, len(index)) for w in words(t)] or [-1], np.int32), return_counts=True) for t in texts]
    docs = [(ids, np.sqrt(n)) for ids, n in docs]
    passes = min(100, max(8, -(-steps * batch // max(1, len(docs)))))
    epochs, again = 5 * passes // 8, passes - 5 * passes // 8
    often = np.zeros(len(index) + 1)
    for ids, n in docs:
        often[ids] += n / n.sum() / len(docs)
    common = {w: float(often[i]) for w, i in index.items() if often[i] > COMMON / 20}
    listed, ends = array("i"), array("q", [0])
    for w in index:
        listed.extend(grams(w))
        ends.append(len(listed))
    starts, flat = np.array(ends), np.array(listed)
    lengths = np.diff(starts)
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]  # 4 bytes an n-gram, none of them sorted
    calm = (COMMON / (COMMON + often[:-1])).astype(np.float32)
    del listed, ends, index
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (len(used), SIZE)).astype(np.float32)
    classes, offsets = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    classes[:, 1] = rng.normal(0, 1, SIZE)
    classes[:, 0] = -classes[:, 1]
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    held = None
    for epoch in range(epochs + again):
        if epoch == epochs:
            size = np.sqrt((vectors * vectors).sum(axis=1))
            held = size > kept * size.max(initial=0)
            vectors[~held] = 0
            sparse, rate = 0.0, 5 * rate
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at : at + batch] if docs[i][0][0] >= 0]
            if not chosen:
                continue
            ids = np.concatenate([docs[i][0] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(docs[i][0]) for i in chosen])
            part = np.concatenate([docs[i][1] / docs[i][1].sum() for i in chosen]).astype(np.float32) * SCALE * calm[ids]
            sizes = lengths[ids]
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            buckets = flat[np.repeat(starts[ids] - begin, sizes) + np.arange(sizes.sum())]
            word = np.add.reduceat(vectors[buckets], begin, axis=0) / sizes[:, None]
            doc = np.add.reduceat(word * part[:, None], np.r_[0, np.flatnonzero(np.diff(rows)) + 1], axis=0)
            logits = doc @ classes + offsets
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), toxic[chosen].astype(int)] -= 1
            p *= share[chosen][:, None] / len(chosen)
            d_doc = p @ classes.T
            spread = np.repeat(part / sizes, sizes)
            now = rate * min(1.0, 2 * (1 - (epoch * len(order) + at) / ((epochs + again) * len(order))))
            for j in range(SIZE):
                vectors[:, j] -= now * np.bincount(buckets, spread * np.repeat(d_doc[rows, j], sizes), len(used))
            if held is not None:
                vectors[~held] = 0
            vectors *= np.maximum(0, 1 - now * sparse / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9))
            classes -= 0.02 * (doc.T @ p)
            offsets -= 0.5 * p.sum(axis=0)
    whole = np.zeros((BUCKETS, SIZE), np.float32)
    whole[used] = vectors * SCALE
    return whole, classes, offsets, common


def calibrated(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A logistic curve (Platt) over weighted rows, as knots for interpolation; of the margin's inverse hyperbolic sine, so that
    the outlying margins of short texts don't flatten it."""
    a, b = 1.0, 0.0
    target = np.where(toxic == 1, ((toxic == 1).sum() + 1) / ((toxic == 1).sum() + 2), 1 / ((toxic == 0).sum() + 2))
    scale = float(np.median(np.abs(margin))) or 1.0
    x = np.arcsinh(margin / scale)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9) * weight
        off = (p - target) * weight
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(off * x).sum() + 1e-3 * a, off.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    knots = np.linspace(min(-12.0, float(x.min())), max(12.0, float(x.max())), 4001)
    return np.sinh(knots) * scale, 1 / (1 + np.exp(-np.clip(a * knots + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of at most `sample` labelled documents, of `sample_bytes` in all, outside the held-out fold.

    Rows of fold 1 of 3 are never read. The sample is the documents with the smallest hashes of their ids, half of it from
    each class where there are so many. A fifth of it is left to calibration, whose rows count as their classes do among all
    labelled rows. Of several documents with a labelled id the smallest text counts. Without rows of both classes every score
    is the share of toxic rows (0 without any row).
    """
    marks = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id_")).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    marks = checkpointed(marks.where(fold(F.col("id_"), 3) != 1))
    there = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id_")
    halves = [marks.where(F.col("label") == k).orderBy(order).limit(sample // 2) for k in (0, 1)]
    chosen = halves[0].union(halves[1])  # at most `sample` pairs of numbers
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id_"))
    known = checkpointed(known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
    sizes = known.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id")).collect()
    room, fitting = sample_bytes, []
    for r in sizes:
        if r["size"] <= room:
            room -= r["size"]
            fitting.append((r["doc_id"],))
    taken = docs.sparkSession.createDataFrame(fitting, "id_ long")
    rows = known.join(F.broadcast(taken), F.col("doc_id") == F.col("id_"), "left_semi").select("doc_id", "text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            marks += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(texts, np.array(marks, float), there))], pa.binary())], ["model"])

    # Training takes some nine times the memory of its texts: one task does it, and the driver gets the finished model alone.
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id")).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fitted([], np.zeros(0), there)


def fitted(texts: list[str], toxic: np.ndarray, there: dict[int, int]) -> Model:
    """The calibrated model of a sample's texts; there: how many labelled rows each class has."""
    if not len(set(toxic)) == 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(BUCKETS), {}, 0.0, np.array([0.0]), np.array([share]), f"none {share}")
    own = np.arange(len(texts)) % 5 == 4 if min(toxic.sum(), len(toxic) - toxic.sum()) >= 20 else np.zeros(len(texts), bool)
    vectors, classes, offsets, common = train([t for t, o in zip(texts, own) if not o], toxic[~own])
    weight = (vectors @ (classes[:, 1] - classes[:, 0])).astype(np.float64)
    model = Model(weight, common, float(offsets[1] - offsets[0]), np.array([0.0]), np.array([0.5]), f"{zlib.crc32(weight.tobytes())} {len(texts)}")
    held = own if own.any() else ~own
    weight = np.where(toxic[held] == 1, there[1] / toxic.sum(), there[0] / (len(toxic) - toxic.sum()))
    model.knots, model.values = calibrated(model.margins([t for t, o in zip(texts, held) if o]), toxic[held], weight / weight.mean())
    return model


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, as a pandas UDF."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return F.pandas_udf(score, "double")(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for more toxic texts) and predicted of every document.

    Nothing but the text enters a score. A text without words (null, empty, blank) has the margin of the offsets alone.
    Null doc_ids have no label; repeated rows are scored alike; an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(fit(docs, labels, sample), F.col("text")).alias("score"))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that score below the threshold.

    Texts without words (null, empty, blank) are scored by the offsets, repeated rows alike; columns may have any names.
    """
    score = unused(docs, "score_")
    return docs.withColumn(score, score_column(fit(docs, labels, sample), F.col("text"))).where(F.col(score) < threshold).drop(score)
