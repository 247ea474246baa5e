"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the hashed byte n-grams (``ORDERS``) of the lower-cased text, present or not (Wang and Manning, "Baselines and Bigrams", 2012).  The log-count
ratio of a feature is the log of how much more often it occurs in toxic than in other training texts, smoothed; the ``MAX_FEATURES`` features whose ratio is the most
standard errors from zero are kept, and a logistic regression is fitted on them, each scaled by its ratio.

Training: counts are taken by tasks over the training texts, which are distinct texts of at most about ``max_train`` labelled documents, picked by hash of their id
(a documented bound, the same at every size of the corpus).  The fit sees the selected features of those texts alone.
Scoring reads every whole text once.  Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null or empty texts get the score of a text without known features; very long texts are read whole; labels with
a null doc_id or label are ignored, and a document with several labels is toxic if one says so; without
training rows, or with one class only, all scores are the smoothed share of toxic rows; repeated rows are scored each;
an empty table gives no rows.  Only doc_id and text are read, and doc_id and toxic of the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import map_arrow, materialize, text_of

ORDERS = (3, 4, 5)
BITS = 18
MAX_TRAIN = 20_000
MAX_FEATURES = 4096
SMOOTHING = 1.0
LEAST_Z = 4.0
PIECE = 1 << 20  # bytes of a text whose n-grams are hashed at a time
BLOCK = 1 << 12


def ngram_buckets(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text, repeats included, as an array of integers below 2**BITS."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    out = []
    for at in range(0, len(data), PIECE):
        b = data[at:at + PIECE + max(ORDERS) - 1].astype(np.uint32)  # n-grams that start in this piece
        h = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(b) < n:
                break
            h = h[:len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1:] + np.uint32(1)
            if n in ORDERS:
                own = h[:PIECE] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                own = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                out.append(own >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """``weights`` by bucket (zero where a feature is left out) and the intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        used = self.weights != 0
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            b = ngram_buckets(t)
            z[i] = self.weights[np.unique(b[used[b]])].sum(dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Rows (toxic 0 or 1, text): distinct texts of the labelled documents outside the held-out fold, at most about ``max_train``."""
    own = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = own.count()
    if n > max_train:
        own = own.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # the label rows are at most about max_train pairs of numbers, a proven bound
    joined = docs.select("doc_id", text_of().alias("t")).join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))
    return materialize(joined.select("toxic", "t", F.xxhash64("t").alias("h")).groupBy("h", "toxic").agg(F.first("t").alias("t")).select("toxic", "t"), "train")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """(texts with each feature by class, as an array (2, buckets); number of texts of each class)."""

    def count(batches):
        seen, texts = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y, np.unique(ngram_buckets(t))] += 1
                texts[y] += 1
        blocks = [(-1, texts)] + [(b, seen[:, b * BLOCK:(b + 1) * BLOCK].ravel()) for b in range((1 << BITS) // BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.list_(pa.int64()))], names=["block", "counts"])

    def total(part: pa.Table) -> pa.Table:
        sums = np.sum([np.asarray(v.values) for v in part.column("counts")], axis=0)
        return pa.table({"block": part.column("block")[:1], "counts": pa.array([sums], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(count, "block int, counts array<bigint>")
    got = {r["block"]: np.array(r["counts"]) for r in parts.groupBy("block").applyInArrow(total, "block int, counts array<bigint>").collect()}  # 2**BITS counts
    if not got:
        return np.zeros((2, 1 << BITS)), 0, 0
    texts = got.pop(-1)
    return np.concatenate([got[b].reshape(2, -1) for b in sorted(got)], axis=1), int(texts[0]), int(texts[1])


def log_count_ratios(seen: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
    """The smoothed ratio of each feature, zero where it is within LEAST_Z standard errors of zero or not among the MAX_FEATURES
    features that are farthest from it in standard errors."""
    other, toxic = seen + SMOOTHING
    ratio = np.log(toxic / (n_toxic + 2 * SMOOTHING)) - np.log(other / (n_other + 2 * SMOOTHING))
    z = np.abs(ratio) / np.sqrt(1 / other + 1 / toxic)
    return np.where(z >= max(LEAST_Z, np.sort(z)[-MAX_FEATURES]), ratio, 0.0)


def fit_logistic(features: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, l2: float = 1e-4, rounds: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by full-batch Adam."""
    used = np.flatnonzero(ratios)
    place = np.zeros(len(ratios), dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    index = place[np.concatenate([*features, np.zeros(0, np.int32)])]
    row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    x = ratios[used][index].astype(np.float32)
    w, bias = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=x * w[index], minlength=len(features)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        grad = np.append(np.bincount(index, weights=x * error[row], minlength=len(used)) + l2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(len(ratios))
    weights[used] = w * ratios[used]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit a model on the labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, max_train)
    seen, n_other, n_toxic = class_counts(rows)
    if not n_other or not n_toxic:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((n_toxic + 1) / (n_other + 1))))
    ratios = log_count_ratios(seen, n_other, n_toxic)
    used = ratios != 0

    def select(batch: pa.RecordBatch):
        lists = [np.unique((b := ngram_buckets(t))[used[b]]).astype(np.int32) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "features"])

    picked = map_arrow(rows, "toxic int, features array<int>", select).toArrow()  # at most about max_train rows of selected features
    features = [np.asarray(f.values) for f in picked.column("features")]
    weights, bias = fit_logistic(features, picked.column("toxic").to_numpy().astype(float), ratios)
    return Model(weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for every row of ``docs``."""

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of()), "doc_id long, score double", run)
