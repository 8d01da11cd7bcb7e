"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

Indicators of hashed byte n-grams are scaled by their log-count ratios between the classes; a linear hinge-loss model is fitted on
the scaled rows by dual coordinate descent, and a logistic curve over its margins gives scores from 0 to 1.

The model is fitted on a bounded sample: at most `SAMPLE_PER_CLASS` labelled texts of a class, those with the smallest
hashes of doc_id. Scoring reads whole texts.

Defined cases: a null or empty text has no indicator and gets the score of the bias alone; labels that are null, or of
documents that do not exist, are not learned from; several labels of one document all count; of several texts of one doc_id
the smallest is learned from; with one class only, every score is that class; without labels every score is 0.5; empty tables give no rows; repeated rows are scored alike;
other columns pass through, unless they clash with the new names, in which case the new ones replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm import ngrams
from loomwork.llm.common import documents, table, text_batches

SAMPLE_PER_CLASS = 1_500
SIZES, BITS = (1, 2, 3, 4), 16


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # what each present n-gram adds, before the row's norm
    squares: np.ndarray  # what it adds to the square of the row's norm
    bias: float
    slope: float
    shift: float

    def score(self, text: bytes) -> float:
        f = ngrams.present(text, SIZES, BITS)
        norm = np.sqrt(self.squares[f].sum()) or 1.0
        margin = float(self.weights[f].sum() / norm) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    size = 1 << BITS
    p, q = (sum((np.bincount(rows[i], minlength=size) for i in np.flatnonzero(y == s)), np.zeros(size)) + alpha for s in (1, -1))
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 3
) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM; the bias is a feature of value 1. Visits the rows in a new random order each epoch."""
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over margins, by Newton steps on a slightly smoothed target."""
    a, c = 1.0, 0.0
    t = np.where(y > 0, 0.99, 0.01)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([(weight * (p - t) * margin).sum() + 1e-3 * (a - 1), (weight * (p - t)).sum()])
        s = weight * np.maximum(p * (1 - p), 1e-4)
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        a, c = np.array([a, c]) - np.linalg.solve(h, g)
        a = max(a, 0.1)
    return float(a), float(c)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    zero = np.zeros(1 << BITS)
    if len(set(labels)) < 2:
        return Model(zero, zero, 0.0, 1.0, 5.0 * (labels[0] * 2 - 1) if labels else 0.0)
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    rows = [ngrams.present(t, SIZES, BITS) for t in texts]
    r = log_count_ratios(rows, y)
    values = [r[f] / (np.linalg.norm(r[f]) or 1.0) for f in rows]
    weight = len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    folds = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):  # margins of rows that the model has not seen, for the curve
        own = np.flatnonzero(folds != k)
        w, b = dual_coordinate_descent([rows[i] for i in own], [values[i] for i in own], y[own], 4 * weight[own], epochs=6)
        for i in np.flatnonzero(folds == k):
            margin[i] = w[rows[i]] @ values[i] + b
    slope, shift = logistic_curve(margin, y, weight)
    w, b = dual_coordinate_descent(rows, values, y, 4 * weight)
    return Model((w * r).astype(np.float32), (r * r).astype(np.float32), b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label 0 or 1): the per_class labels of each class with the smallest hashes.

    The sample is chosen from the labels alone, so only its rows' texts are fetched, by a broadcast of at most
    per_class rows for each class.
    """
    rows = labels.where(F.col("label").isin(0, 1)).select("label", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    buckets = Window.partitionBy("label", F.pmod("h", F.lit(64))).orderBy("h")
    picked = rows.withColumn("r", F.row_number().over(buckets)).where(F.col("r") <= per_class)
    limits = picked.groupBy("label").agg(F.expr(f"array_max(slice(array_sort(collect_list(h)), 1, {per_class}))").alias("most"))
    sample = rows.join(F.broadcast(limits), "label").where("h <= most").select("label", "doc_id")
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = sorted(tuple(r) for r in texts.collect())  # one row for each of the sample
    return fit([t.encode("utf-8", "replace") for *_, t in found], [int(x) for _, x, _ in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted; reads nothing but the text."""
    text_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = share.value
        for part in parts:
            yield pd.Series([model.score((t or "").encode("utf-8", "replace")) for t in part], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels.where(~held_out()))).drop("text")
