"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

A document's features are its words and pairs of neighbouring words (runs of
punctuation are words), hashed to 2**20 weights; all pairs of a word with
itself are one feature: a text that stutters is poor whatever the word, and each
word alone would be too rare to learn it from.  Feature values are counts
over the square root of the number of n-grams, so a score is one gather and
one segmented sum over the document's n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K

BITS = 20
#: Labelled documents to train on (those of the least hashes of their ids), passes over them, and FTRL's parameters.
SAMPLE, EPOCHS, ALPHA, BETA, L1, L2 = 8000, 3, 2.0, 1.0, 0.05, 0.01
THRESHOLD = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of each document, and the documents' offsets among them."""
    words, docs = K.word_hashes(texts, punctuation=True)
    count = np.diff(docs)
    pairs = np.maximum(count - 1, 0)
    out = np.concatenate([[0], np.cumsum(count + pairs)])
    buckets = np.empty(out[-1], np.int64)
    shift = np.uint64(64 - BITS)
    place = np.arange(len(words)) - np.repeat(docs[:-1], count) + np.repeat(out[:-1], count)
    buckets[place] = words >> shift
    last = np.zeros(len(words), bool)
    last[docs[1:][count > 0] - 1] = True
    if len(words) > 1:
        two = K.mix64(np.where(words[:-1] == words[1:], np.uint64(0), words[:-1] * K.GRAM[0] + words[1:] * K.GRAM[1])) >> shift
        first = ~last[:-1]
        buckets[(place + np.repeat(count, count))[:-1][first]] = two[first]
    return buckets, out


def train(docs: Iterator[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader over (buckets, label) pairs, in their order."""
    seen = []
    for buckets, label in docs:
        if len(buckets):
            idx, count = np.unique(buckets, return_counts=True)
            seen.append((idx.astype(np.uint32), (count / np.sqrt(len(buckets))).astype(np.float32), label))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for idx, x, label in seen:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            bias = -zb / ((BETA + nb**0.5) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x) + bias, -35, 35)))
            g = (p - label) * x
            z[idx] += g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[idx] += g * g
            gb = p - label
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += gb * gb
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w.astype(np.float32), float(bias))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities; 0 for a text without words."""
    buckets, docs = features(texts)
    n = np.diff(docs)
    total = np.zeros(len(n))
    if len(buckets):
        some = n > 0
        total[some] = np.add.reduceat(model.weights[buckets].astype(np.float64), docs[:-1][some])
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(n, 1)) + model.bias, -35, 35))), 0.0)


@K.tidy
def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def examples() -> Iterator[tuple[np.ndarray, float]]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in K.text_chunks(batch.column(0)):
                buckets, docs = features(batch.column(0).slice(a, b - a))
                for i in range(b - a):
                    yield buckets[docs[i] : docs[i + 1]], float(label[a + i])

    model = train(examples())
    at = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([model.weights[at].tobytes()], pa.binary()), pa.array([model.bias])], ["at", "weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", reject_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Trains in one task on at most ``sample`` labelled documents, a bound that doesn't grow with the corpus.

    A document is good if its label is 1 and ``reject_col``, where labels have that column, isn't 1: toxic ones aren't to be
    trained on, however well they are written.  Null labels, ids and texts are ignored; an id with several labels takes the least, an id with several texts gives an example for each.  Without labelled documents all weights are 0,
    so that every text with a word scores 0.5 and is kept.
    """
    ship(docs.sparkSession)
    good = F.col(label_col) > 0
    if reject_col in labels.columns:
        good = good & (F.coalesce(F.col(reject_col).cast("double"), F.lit(0.0)) <= 0)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.when(good, 1.0).otherwise(0.0)).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "__id")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id", F.xxhash64("text")).select("text", "__label")
    got = rows.mapInArrow(_trainer, "at binary, weights binary, bias double").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for r in got:
        weights[np.frombuffer(r.at, np.uint32)] = np.frombuffer(r.weights, np.float32)
        bias = r.bias
    return Model(weights, bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) for every row, map-side.  A null text, or one without words, scores 0 and isn't kept; null ids stay null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([score(shared.value, batch.column(1).slice(a, b - a)) for a, b in K.text_chunks(batch.column(1))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, 6)), pa.array(p >= threshold)], ["doc_id", "score", "keep"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least ``threshold``, with all their columns, whatever their names; no shuffle.

    Null texts and texts without words score 0 and go; null ids and repeated rows are judged by their texts, equal texts alike; a
    score of just the threshold is kept; an empty table stays empty.
    """
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: Callable = batch.column(at).slice
            p = np.concatenate([score(shared.value, texts(a, b - a)) for a, b in K.text_chunks(batch.column(at))] or [np.zeros(0)])
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
