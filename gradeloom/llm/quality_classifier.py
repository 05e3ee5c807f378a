"""Quality classifier: naive Bayes support vectors.

A document's features are indicators of its n-grams of word shapes and of its words and word pairs, hashed. Each indicator is
scaled by the class log-count ratio of its feature, and a linear hinge-loss model is fitted by dual coordinate descent on a
bounded sample of labelled documents; a logistic curve on held-back rows of that sample turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as X
from ._shared import Scratch, small_batches
from .toxicity import fit_logistic, labelled_sample

SHAPE_BITS, WORD_BITS = 15, 17
_KIND = np.zeros(256, np.int64)  # of a byte: 0 lower or non-ASCII letter, 1 upper, 2 digit, 3 symbol, 4 stop, 5 quote or bracket
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[list(b"#*$%&|<>=~^_@+\\/{}")] = 3
_KIND[list(b".,;:!?")] = 4
_KIND[list(b"\"'`()[]-")] = 5


def _shapes(data, hashes, rows, starts, ends) -> np.ndarray:
    """A small number for the shape of each word: counts of byte kinds, last byte, length, and whether it repeats the word before."""
    sums = [np.concatenate([[0], np.cumsum(_KIND[data] == k, dtype=np.int64)]) for k in range(6)]
    kinds = [s[ends] - s[starts] for s in sums]
    size = ends - starts
    upper = np.where(kinds[1] == 0, 0, np.where(kinds[0] > 0, 1, np.where(kinds[1] == 1, 2, 3)))
    out = upper
    out = out * 2 + (kinds[2] > 0)
    out = out * 4 + np.minimum(kinds[3], 3)
    out = out * 4 + np.minimum(kinds[4], 3)
    out = out * 2 + (kinds[5] > 0)
    out = out * 8 + np.where(_KIND[data[ends - 1]] == 4, 1 + np.searchsorted(np.array(sorted(b".,;:!?")), data[ends - 1]), 0)
    out = out * 4 + np.digitize(size, [2, 9, 20])
    again = np.zeros(len(rows), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    return out * 2 + again


def features(column, lexical: bool = True):
    """For a string column: sorted distinct (row, feature) pairs as two arrays, for blocks of rows (first row, count)."""
    for a, b in X.row_blocks(column):
        data, offsets = X.utf8(column.slice(a, b - a))
        h, rows, starts, ends = X.words(data, offsets)
        if not len(h):
            yield a, b - a, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        shape = X.mix(_shapes(data, h, rows, starts, ends).astype(X.U))
        found_rows, found = [], []
        for n in (1, 2, 3):
            g, first = X.ngrams(shape, rows, n)
            found_rows.append(rows[first])
            found.append((g >> X.U(64 - SHAPE_BITS)).astype(np.int64))
        for n in (1, 2) if lexical else ():
            g, first = X.ngrams(h, rows, n)
            found_rows.append(rows[first])
            found.append((1 << SHAPE_BITS) + (g >> X.U(64 - WORD_BITS)).astype(np.int64))
        key = np.unique(np.concatenate(found_rows) << 20 | np.concatenate(found))
        yield a, b - a, key >> 20, key & ((1 << 20) - 1)


SIZE = (1 << SHAPE_BITS) + (1 << WORD_BITS)


@dataclass(frozen=True)
class QualityModel:
    """weights: of each feature's indicator (log-count ratio times the fitted weight); curve: constant and slope on the margin."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float]
    lexical: bool = True

    def margins(self, column) -> np.ndarray:
        out = np.zeros(len(column))
        for a, n, rows, found in features(column, self.lexical):
            count = np.bincount(rows, minlength=n)
            out[a : a + n] = np.bincount(rows, self.weights[found], minlength=n) / np.sqrt(np.maximum(count, 1)) + self.bias
        return out

    def scores(self, column) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.margins(column), -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i w.x_i), x_i = scale on the features rows[i]."""
    x = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1.0 for v in x])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            slope = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            change = (new - alpha[i]) * y[i]
            if change:
                w[rows[i]] += change * x[i]
                bias += change
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, least_docs: int) -> np.ndarray:
    """Of each feature: log of its smoothed share of the features of class 1 over that of class 0, less the median; 0 below `least_docs` documents."""
    counts = np.zeros((2, size))
    for v, k in zip(rows, y.astype(int), strict=True):
        counts[k, v] += 1
    used = counts.sum(0) >= least_docs
    ratio = np.where(used, np.log((counts[1] + 1) / (counts[1].sum() + size)) - np.log((counts[0] + 1) / (counts[0].sum() + size)), 0.0)
    if used.any():
        ratio[used] -= np.median(ratio[used])
    return ratio


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 5000, max_features: int = 20_000_000, least_docs: int = 5, cost: float = 1.0, lexical: bool = True) -> QualityModel:
    """Fit on at most `max_rows` labelled documents outside the held-out fold; only their feature numbers reach the driver, at most
    `max_features` over all documents (4 bytes each) or those of one: further documents, in the order of a hash, are left out.

    Log-count ratios and weights come from four fifths of these documents, the score's curve from the rest. Features in fewer than `least_docs` of them are ignored. A class that does not occur leaves a constant score: the share of
    label 1, or 0.5 without labels.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, label, id_col, text_col, max_rows, Scratch(spark, "quality"), "sample")

    def work(batches):
        for batch in batches:
            text = batch.column(0).cast(pa.string())
            for a, n, rows, found in features(text, lexical):
                at = X.bounds(rows, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n), pa.ListArray.from_arrays(pa.array(at), pa.array(found.astype(np.int32)))], names=["y", "x"])

    found = Scratch(spark, "quality").keep(sample.mapInArrow(work, "y int, x array<int>").withColumn("h", F.xxhash64("x", "y")), "features")
    so_far = F.sum(F.size("x")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))  # max_rows rows at most
    table = found.select("y", "x", F.coalesce(so_far, F.lit(0)).alias("before"), F.size("x").alias("n")).where(f"before = 0 or before + n <= {max_features}").select("y", "x").toArrow()
    y = table["y"].to_numpy().astype(float)
    x = [np.asarray(v, np.int64) for v in table["x"].to_numpy()] if len(y) else []
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros(SIZE), 0.0, (float(np.log(share / (1 - share))), 0.0), lexical)
    aside = np.arange(len(y)) % 5 == 4
    if not 0 < y[~aside].sum() < (~aside).sum():
        aside[:] = False
    fit = np.flatnonzero(~aside)
    ratio = log_count_ratios([x[i] for i in fit], y[fit], SIZE, least_docs)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * cost
    w, bias = dual_coordinate_descent([x[i] for i in fit], ratio, 2 * y[fit] - 1, weight[fit])
    model = QualityModel(ratio * w, bias, (0.0, 1.0), lexical)
    aside = aside if aside.any() else ~aside  # too few documents to set some aside
    margin = np.array([model.weights[x[i]].sum() / np.sqrt(max(len(x[i]), 1)) + bias for i in np.flatnonzero(aside)])
    curve = fit_logistic(np.stack([np.ones(len(margin)), margin], 1), y[aside], ridge=0.1)
    return QualityModel(model.weights, bias, (float(curve[0]), float(max(curve[1], 0.1))), lexical)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then quality_score (0 to 1, higher: label 1 likelier).

    A null or empty text has no features and the score of the bias alone. Repeated rows are scored each; texts of any length are
    read whole, in blocks of a few MB; an empty table gives an empty one; a column quality_score is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("quality_score")
    columns = base.columns
    at = columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # SIZE weights

    def work(batches):
        for batch in batches:
            score = shared.value.scores(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*columns, "quality_score"])

    return base.mapInArrow(work, StructType(list(base.schema.fields) + list(StructType.fromDDL("quality_score double").fields)))
