"""Quality by ordinal cumulative-link regression on graded ratings.

One set of hashed weights is shared by all grades: P(grade >= j) = logistic(s(text) - t_j) with thresholds t_1 < t_2 < ...  The
score s is the mean over a text's words of a weight for the word and one for its shape (kinds of bytes, length, repetition of the
word before), plus a weight for the text's length class.  Expected grade and tail probability follow from the thresholds.

Training uses at most ``MAX_TRAIN`` labelled documents (those with the lowest hash of doc_id) and at most as many bytes of their
features as ``training.MAX_BYTES`` tells; scoring covers all texts whole.

Defined results: null and empty texts, and texts without words, get the lowest grade and tail probability 0; if the labels hold
one grade only, every text with words gets that grade; null labels are left out and repeated ones of an id count once, with the
highest; very long texts are scored whole; repeated rows get equal scores; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import slices, words
from .training import gathered, labelled_sample

MAX_TRAIN, MIN_DOCS, SELECT_AT = 8_000, 4, 0.5
WORD_BITS, SHAPES, LENGTHS = 17, 8192, 40
_SIZE = (1 << WORD_BITS) + SHAPES + LENGTHS

#: a bit for each kind of byte
_KIND = np.full(256, 64, np.uint8)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[[ord(c) for c in ".,;:'-"]] = 8
_KIND[[ord(c) for c in "!?"]] = 16
_KIND[[ord(c) for c in "|<>/\\"]] = 32
_KIND[[ord(c) for c in "()[]{}\""]] = 128


@dataclass
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray


def _features(data: np.ndarray, off: np.ndarray):
    w = words(data, off)
    idx = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    if not len(idx):
        return w, idx, idx
    kinds = np.bitwise_or.reduceat(_KIND[data[w.index]], w.begin).astype(np.int32)
    again = np.zeros(len(idx), np.int32)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    return w, idx, (1 << WORD_BITS) + (kinds << 5 | np.minimum(w.length, 15).astype(np.int32) << 1 | again)


def _length_class(count: np.ndarray) -> np.ndarray:
    return _SIZE - LENGTHS + np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), LENGTHS - 1)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(1)
        for lo, hi, data, off in slices(batch.column(2)):
            w, idx, shape = _features(data, off)
            out = []
            for r in range(hi - lo):
                own = slice(w.first[r], w.first[r] + w.count[r])
                f, n = np.unique(np.concatenate([idx[own], shape[own]]), return_counts=True)
                out.append((f.astype(np.int32).tobytes(), (n / max(1, w.count[r])).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), labels.slice(lo, hi - lo), pa.array(w.count), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                ["doc_id", "label", "n", "idx", "share"],
            )


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: DataFrame, epochs: int = 20, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, seed: int = 5) -> QualityModel:
    """Trains on (doc_id, label, text) rows, gathered on the driver: their number must be bounded, and their bytes are."""
    features = rows.select("doc_id", "label", "text").mapInArrow(_training_rows, "doc_id long, label int, n long, idx binary, share binary").where("n > 0")
    table = gathered(features, ["idx", "share"])
    label = table["label"].to_numpy()
    grades = np.unique(label)
    weights, acc = np.zeros(_SIZE, np.float32), np.full(_SIZE, 1e-3, np.float32)
    if len(grades) < 2:
        return QualityModel(weights, np.zeros(0), grades.astype(np.float64) if len(grades) else np.zeros(1))
    y = np.searchsorted(grades, label)
    steps = len(grades) - 1
    length = _length_class(table["n"].to_numpy())
    docs = [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.float32)) for a, b in zip(table["idx"], table["share"], strict=True)]
    seen = np.zeros(_SIZE, np.int32)
    for f, _ in docs:
        seen[f] += 1
    seen[length] = MIN_DOCS
    live = seen >= MIN_DOCS
    share = np.array([(y > j).mean() for j in range(steps)])
    t = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(steps))
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    raw_acc = np.full(steps, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            idx, val = np.concatenate([docs[i][0] for i in own]), np.concatenate([docs[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), [len(docs[i][0]) for i in own])
            s = np.bincount(row, weights[idx] * val, len(own)) + weights[length[own]]
            t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            c = _logistic(s[:, None] - t)  # P(grade > j)
            upper = np.concatenate([np.ones((len(own), 1)), c], 1)
            lower = np.concatenate([c, np.zeros((len(own), 1))], 1)
            k = y[own]
            r = np.arange(len(own))
            p = np.maximum(upper[r, k] - lower[r, k], 1e-9)
            du, dl = upper[r, k] * (1 - upper[r, k]), lower[r, k] * (1 - lower[r, k])
            gs = -(du - dl) / p
            gt = np.zeros((len(own), steps + 1))
            np.add.at(gt, (r[k > 0], k[k > 0] - 1), (du / p)[k > 0])
            np.add.at(gt, (r[k < steps], k[k < steps]), (-dl / p)[k < steps])
            gt = gt[:, :steps].mean(0)
            g_raw = np.concatenate([[gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(raw[1:])])
            grad = (np.bincount(idx, gs[row] * val, _SIZE) + np.bincount(length[own], gs, _SIZE)).astype(np.float32) / len(own)
            grad[~live] = 0
            grad += decay * weights
            acc += grad * grad
            weights -= rate * grad / np.sqrt(acc)
            raw_acc += g_raw * g_raw
            raw -= 0.1 * g_raw / np.sqrt(raw_acc)
    weights[~live] = 0
    t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
    return QualityModel(weights, t, grades.astype(np.float64))


def _scored(model: QualityModel, column, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= at_least) of each text."""
    n = len(column)
    expected, tail = np.full(n, model.grades[0]), np.zeros(n)
    step = int(np.searchsorted(model.grades, at_least)) - 1
    for lo, hi, data, off in slices(column):
        w, idx, shape = _features(data, off)
        some = w.count > 0
        s = np.bincount(w.row, model.weights[idx] + model.weights[shape], hi - lo) / np.maximum(w.count, 1) + model.weights[_length_class(w.count)]
        c = _logistic(s[:, None] - model.thresholds[None, :]) if len(model.thresholds) else np.zeros((hi - lo, 0))
        expected[lo:hi] = np.where(some, model.grades[0] + c @ np.diff(model.grades), model.grades[0])
        tail[lo:hi] = np.where(some, 1.0 if step < 0 else c[:, step] if step < c.shape[1] else 0.0, 0.0)
    return expected, tail


def tail_probability(model: QualityModel, at_least: float = 1):
    """A column function: P(grade >= at_least) of a text column."""

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array(_scored(model, text, at_least)[1])

    return run


def scores(docs: DataFrame, model: QualityModel, at_least: float = 1, text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = _scored(model, batch.column(1), at_least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    fields = [docs.schema["doc_id"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]
    return docs.select("doc_id", text_col).mapInArrow(run, T.StructType(fields))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = MAX_TRAIN) -> QualityModel:
    return fit(labelled_sample(docs, labels, "quality", max_rows, where))
