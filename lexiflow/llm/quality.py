"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the corpus is unlabelled, good and bad
together. Given the share of good documents (the class prior), the risk of a classifier on
bad documents is its risk on unlabelled ones, less the prior times its risk on positives as if
they were bad. The prior is estimated from unlabelled text: of the texts with the highest scores, where
almost only good ones are left, the share among unlabelled ones over that among positives. That difference cannot be negative; where the sample makes it so, the step goes the
other way, which keeps the fit from memorising positives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.features import DENSE, SURFACE, dense
from lexiflow.llm.store import slices

#: At most so many positives, and so many unlabelled documents, are fitted on: those with the smallest hash of their id.
SAMPLE = 8000
THRESHOLD = 0.3
PAIR_WEIGHT = 0.2
FOLDS = 5


@dataclass(frozen=True)
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = standard(x, self.mean, self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Deviations from the mean, cut off at 8; those of byte pairs, which are many and noisy, at 2 and weighed less."""
    z = np.clip((x - mean) / scale, -8, 8)
    z[:, len(SURFACE) :] = np.clip(z[:, len(SURFACE) :], -2, 2) * PAIR_WEIGHT
    return z


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> LinearModel:
    """Minimise the non-negative unbiased risk with logistic loss, by full-batch Adam from zero weights."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (standard(x, mean, scale).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # Gradients with respect to the margins: of bad documents' risk, and of positives'.
        gp, gu = -prior * sp / len(p), su / len(u)
        if bad < 0:
            gp, gu = -gp, -gu
        else:
            gp = gp + prior * (sp - 1) / len(p)
        grad = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return LinearModel(mean, scale, w, float(b), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, splits: int = 5, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, by the best bin of a classifier's scores on rows kept back from its fit.

    With q(c) the share of rows that score c or more, the prior is at most q_unlabelled(c) / q_positive(c),
    for every c; taken is the c whose upper confidence bound is least, and of its quotient the value a
    standard error below. Of several splits the least counts: with a prior that is too large the risk
    of bad text turns negative everywhere.
    """
    found = []
    for seed in range(splits):
        rng = np.random.default_rng(seed)
        p, u = rng.random(len(positive)) < 0.7, rng.random(len(unlabelled)) < 0.7
        if not p.any() or p.all() or not u.any() or u.all():
            continue
        model = fit_pu(positive[p], unlabelled[u], 0.5, steps=300)
        good, mixed = np.sort(model.scores(positive[~p])), np.sort(model.scores(unlabelled[~u]))
        share = lambda s: 1 - np.searchsorted(s, good, "left") / len(s)
        q_good, q_mixed = share(good), share(mixed)
        margin = sum(math.sqrt(math.log(4 / delta) / (2 * len(s))) for s in (good, mixed))
        best = np.argmin((q_mixed + 1.01 * margin) / q_good)
        error = lambda q, s: math.sqrt(q * (1 - q) / len(s))
        found.append((q_mixed[best] - error(q_mixed[best], mixed)) / (q_good[best] + error(q_good[best], good)))
    return float(min(0.99, max(0.01, min(found, default=0.5))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        x = dense([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "positive", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features of positives and of unlabelled documents, at most ``sample`` of either, in order of id.

    Rows of the held-out fold (CRC-32 of the id as text, mod 5, is 0) are never among them. Positives
    have label 1 (an id with several labels is good if any is 1); unlabelled are documents without a
    label. An id with several texts counts with its least.
    """
    spark = docs.sparkSession
    key = labels[id_col].cast("long")
    marked = labels.filter(key.isNotNull()).groupBy(key.alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("good"))
    inside = F.crc32(F.col("id").cast("string")) % FOLDS != 0
    first = lambda df: [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    positives = first(marked.filter(inside & (F.col("good") == 1)).select("id"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull() & inside).distinct()
    others = first(ids.join(marked.select("id"), "id", "left_anti"))
    if not positives or not others:
        return np.zeros((0, DENSE), np.float32), np.zeros((0, DENSE), np.float32)
    chosen = F.broadcast(spark.createDataFrame([(i, True) for i in positives] + [(i, False) for i in others], "id long, positive boolean"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    rows = sorted(texts.mapInArrow(_features, "id long, positive boolean, x binary").collect(), key=lambda r: r.id)
    good, rest = ([np.frombuffer(r.x, np.float32) for r in rows if r.positive is flag] for flag in (True, False))
    return np.array(good).reshape(len(good), DENSE), np.array(rest).reshape(len(rest), DENSE)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LinearModel:
    """Fit on the rows of :func:`training_rows`, with the prior that :func:`class_prior` finds in them.

    Without positives or unlabelled documents the model gives every text one half.
    """
    positive, unlabelled = training_rows(docs, labels, id_col, text_col, label_col, sample)
    if not len(positive) or not len(unlabelled):
        return LinearModel(np.zeros(DENSE, np.float32), np.ones(DENSE, np.float32), np.zeros(DENSE), 0.0, 0.5)
    return fit_pu(positive, unlabelled, class_prior(positive, unlabelled))


def quality_scores(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted (or, with ``keep``, the input's columns for rows predicted 1).

    Only the text is scored, the whole of it. A null or empty text gets the score of an empty
    text. A null id is not held out. Repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 19):
            score = model.scores(dense([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text_col).to_pylist()])).astype(np.float64)
            if keep:
                yield batch.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(score)], [id_col, "score"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    out = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` long, score double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
