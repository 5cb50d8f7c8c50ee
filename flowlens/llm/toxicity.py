"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams inside words, with marks for a word's start and end; a feature's
value counts it over the document's different words. A document's score is therefore a sum over
its different words, so whole texts are scored from a table of word scores that each task fills
as it meets new words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, fsum, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that a fit takes of each class at most: the first in the order of a hash of their ids.
SAMPLE_PER_CLASS = 2_000
BITS = 18
NGRAMS = (3, 4, 5)
#: Features kept: found this often in the sample, with a log-count ratio this far from 0.
LEAST_COUNT, LEAST_RATIO = 3, 1.0
#: Documents whose features a round of the fit takes at once.
CHUNK = 256
#: Words whose scores a task keeps; the table is emptied when it is full.
WORDS_KEPT = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def word_features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the feature at every position of the marked words, which positions count, the words' starts."""
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts, left = ends - lengths, np.repeat(ends, lengths) - np.arange(len(codes))
    hashed = codes * np.uint32(0x85EBCA6B)
    for n in range(2, max(NGRAMS) + 1):
        hashed = hashed * np.uint32(0x01000193)
        hashed[: max(0, len(codes) - n + 1)] += codes[n - 1:] * np.uint32(0x85EBCA6B)
        if n in NGRAMS:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - BITS)).astype(np.int32), left >= n, starts


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their counts over its different words."""
    words = sorted(words_of(text))
    if not words:
        return np.array([], np.int32), np.array([], np.int32)
    found = np.concatenate([index[counts] for index, counts, _ in word_features(words)])
    index, count = np.unique(found, return_counts=True)
    return index.astype(np.int32), count.astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``bias`` plus the weights of the features of all different words is the log odds of label 1."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> list[float]:
        total = np.zeros(len(words))
        for index, counts, starts in word_features(words):
            total += np.add.reduceat(np.where(counts, self.weights[index], 0.0), starts)
        return total.tolist()

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """Probability of label 1 for each text. ``known`` keeps scores of words between calls."""
        found = []
        for text in texts:
            words = words_of(text)
            if len(known) > WORDS_KEPT:
                known.clear()
            new = [w for w in words if w not in known]
            if new:
                known.update(zip(new, self.word_scores(new)))
            # fsum doesn't depend on the order of the words
            odds = self.bias + fsum(map(known.__getitem__, words))
            found.append(1.0 / (1.0 + exp(-max(-700.0, min(700.0, odds)))))
        return found


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float,
        rounds: int = 100, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Logistic regression on features scaled by their naive Bayes log-count ratio.

    ``prior`` is the share of label 1 among all labelled rows: classes weigh the same in the fit and the
    bias is set back to it. Adaptive gradient steps from zero over all rows, so a fit repeats exactly.
    ``documents`` is emptied on the way, so that its features don't stay beside the ones that are kept.
    """
    dimensions = 1 << BITS
    weights, prior = np.zeros(dimensions), min(max(prior, 1e-4), 1 - 1e-4)
    if len(labels) == 0 or labels.min() == labels.max():  # nothing to tell apart
        return Model(weights.astype(np.float32), log(prior / (1 - prior)))
    counts = np.zeros((2, dimensions))
    for (index, count), label in zip(documents, labels):
        counts[label, index] += count
    smooth = counts + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[(counts.sum(axis=0) < LEAST_COUNT) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    # Only features with a ratio go on, as small numbers, and rounds take them some documents at a time.
    chunks = []
    for at in range(0, len(documents), CHUNK):
        some = documents[at:at + CHUNK]
        kept = [ratio[index] != 0 for index, _ in some]
        columns = np.concatenate([index[k] for (index, _), k in zip(some, kept)]).astype(np.int32)
        values = (np.concatenate([count[k] for (_, count), k in zip(some, kept)]) * ratio[columns]).astype(np.float32)
        chunks.append((at, np.array([int(k.sum()) for k in kept]), columns, values))
    documents.clear()  # the features without a ratio, most of them
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    bias, seen, seen_bias = 0.0, np.full(dimensions, 1e-8), 1e-8
    for _ in range(rounds):
        gradient, total = penalty * weights, 0.0
        for at, sizes, columns, values in chunks:
            rows = np.repeat(np.arange(len(sizes)), sizes)
            margin = np.bincount(rows, weights[columns] * values, len(sizes)) + bias
            mine = slice(at, at + len(sizes))
            error = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[mine]) * balance[mine]
            gradient += np.bincount(columns, error[rows] * values, dimensions)
            total += error.sum()
        seen += gradient * gradient
        seen_bias += total ** 2
        weights -= rate * gradient / np.sqrt(seen)
        bias -= rate * total / np.sqrt(seen_bias)
    return Model((weights * ratio).astype(np.float32), float(bias + log(prior / (1 - prior))))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [document_features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i for i, _ in found], pa.list_(pa.int32())),
             pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["label", "index", "count"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on labelled documents that are not held out, ``per_class`` of each class at most.

    A ``doc_id`` with several label rows is toxic if any says so; null ids and null labels are no labels.
    """
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("label")))
    share = known.agg(F.avg("label")).first()[0]
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = known.where("label = 1").orderBy(*order).limit(per_class).union(
        known.where("label = 0").orderBy(*order).limit(per_class))
    # Twice per_class rows at most. Repeated rows of a document count once.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
            .groupBy("__id", "label").agg(F.max("text").alias("text")).select("label", "text")
            .mapInArrow(_sample_features, "label int, index array<int>, count array<int>")).toArrow()
    label = rows["label"].to_numpy()
    documents = [(i.values.to_numpy(), c.values.to_numpy()) for i, c in zip(rows["index"], rows["count"])]
    del rows
    order = sorted(range(len(documents)), key=lambda n: (len(documents[n][0]), xxhash.xxh3_128_digest(documents[n][0].tobytes())))
    documents = [documents[n] for n in order]
    model = fit(documents, label[order], share or 0.0)
    pa.default_memory_pool().release_unused()
    return model


def score(text: Column, model: Model) -> Column:
    """Probability of toxicity of a text; null is scored as an empty text."""
    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for part in parts:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in part], known), dtype="float64")
    return scores(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, by a model trained on ``labels``.

    Null and empty texts have the score of no word at all. Repeated rows have equal scores. Without
    labels of both classes all scores are the share of label 1. Other columns are left out.
    """
    model = train(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't call toxic; all columns."""
    return docs.where(score(F.col("text"), train(docs, labels)) < 0.5)
