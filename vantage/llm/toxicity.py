"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels only.

A sentence's score is a logistic function of hashed weights of its words and of their first bytes; a document is toxic unless no
sentence is, P = 1 - prod(1 - p_s).  The likelihood of the document labels trains the sentence scorer, which then also locates the
offending sentences.  Weights are kept for features of ``MIN_DOCS`` training documents or more, so that words of a single document
cannot mark it.

Training uses at most ``MAX_TRAIN`` labelled documents (those with the lowest hash of doc_id) and at most as many bytes of their
words as ``training.MAX_BYTES`` tells; scoring covers all texts whole.

Defined results: null and empty texts, and texts without words, score 0 and have no offending sentence; very long texts are scored
whole; without any labels of both kinds, or without documents that have them, every score is 0; repeated labels of an id count once;
repeated rows get equal scores; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import ALNUM, fold_case, prefix_hash, sentences, slices, words
from .training import gathered, labelled_sample

MAX_TRAIN, MIN_DOCS, THRESHOLD = 20_000, 4, 0.7
WORD_BITS, PREFIX_BITS, PREFIX_BYTES = 18, 16, 5
_SIZE = (1 << WORD_BITS) + (1 << PREFIX_BITS)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float


@dataclass
class _Words:
    """Words of a slice without those that repeat the word before: place, row, two feature indices, words before each row, and the first word of each sentence."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    idx: np.ndarray
    pre: np.ndarray
    begin: np.ndarray
    first: np.ndarray


def _features(data: np.ndarray, off: np.ndarray) -> _Words:
    """A word said a thousand times on end is one hint, not a thousand: it counts once."""
    data = fold_case(data)
    w = words(data, off, ALNUM)
    keep = np.ones(len(w.hash), bool)
    keep[1:] = (w.hash[1:] != w.hash[:-1]) | (w.row[1:] != w.row[:-1])
    idx = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)[keep]
    pre = (prefix_hash(data, w, PREFIX_BYTES) >> np.uint64(64 - PREFIX_BITS)).astype(np.int32)[keep] + (1 << WORD_BITS)
    number = sentences(data, w)[keep]
    first = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, np.int64)
    row = w.row[keep]
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))])
    return _Words(w.start[keep], (w.start + w.length)[keep], row, idx, pre, begin, first)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(1)
        for lo, hi, data, off in slices(batch.column(2)):
            w = _features(data, off)
            heads = np.zeros(len(w.idx), np.int8)
            heads[w.first] = 1
            cut = list(zip(w.begin[:-1], w.begin[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), labels.slice(lo, hi - lo)] + [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (w.idx, w.pre, heads)],
                ["doc_id", "label", "idx", "pre", "heads"],
            )


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(rows: DataFrame, epochs: int = 30, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, toxic_weight: float = 10.0, seed: int = 7) -> ToxicityModel:
    """Trains on (doc_id, label, text) rows, gathered on the driver: their number must be bounded, and their bytes are.  Toxic documents, the rarer, weigh more."""
    features = rows.select("doc_id", "label", "text").mapInArrow(_training_rows, "doc_id long, label int, idx binary, pre binary, heads binary")
    table = gathered(features, ["idx", "pre", "heads"])
    label = table["label"].to_numpy()
    weights, acc = np.zeros(_SIZE, np.float32), np.full(_SIZE, 1e-2, np.float32)
    if not len(label) or label.min() == label.max():
        return ToxicityModel(weights, -50.0)
    docs = []
    seen = np.zeros(_SIZE, np.int32)
    for i in range(len(label)):
        idx, pre = (np.frombuffer(table[c][i].as_py(), np.int32) for c in ("idx", "pre"))
        heads = np.frombuffer(table["heads"][i].as_py(), np.int8)
        docs.append((idx, pre, heads))
        seen[np.unique(idx)] += 1
        seen[np.unique(pre)] += 1
    live = seen >= MIN_DOCS
    bias, bias_acc = -6.0, 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = [docs[i] for i in order[at : at + batch]]
            y = label[order[at : at + batch]]
            idx, pre = np.concatenate([d[0] for d in chosen]), np.concatenate([d[1] for d in chosen])
            first = np.flatnonzero(np.concatenate([d[2] for d in chosen]))
            if not len(first):
                continue
            size = np.diff(np.append(first, len(idx)))
            count = np.array([int(d[2].sum()) for d in chosen])
            doc = np.repeat(np.arange(len(chosen)), count)
            z = np.clip(np.add.reduceat(weights[idx] + weights[pre], first) + bias, -30, 30)
            total = np.bincount(doc, _softplus(z), len(chosen))
            slope = np.where(y == 1, -toxic_weight / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
            g = np.clip(slope[doc] / (1 + np.exp(-z)), -4, 4)
            g_word = np.repeat(g, size)
            grad = (np.bincount(idx, g_word, _SIZE) + np.bincount(pre, g_word, _SIZE)).astype(np.float32) / len(chosen)
            grad[~live] = 0
            grad += decay * weights
            acc += grad * grad
            weights -= rate * grad / np.sqrt(acc)
            gb = float(g.sum()) / len(chosen)
            bias_acc += gb * gb
            bias -= rate * gb / bias_acc**0.5
    weights[~live] = 0
    return ToxicityModel(weights, bias)


def _sentence_costs(model: ToxicityModel, data: np.ndarray, off: np.ndarray) -> tuple[_Words, np.ndarray, np.ndarray]:
    """The words of a slice; of each sentence -log(1 - p) and the row."""
    w = _features(data, off)
    if not len(w.first):
        return w, np.zeros(0), np.zeros(0, np.int64)
    z = np.add.reduceat((model.weights[w.idx] + model.weights[w.pre]).astype(np.float64), w.first) + model.bias
    return w, _softplus(z), w.row[w.first]


def _score_column(model: ToxicityModel, column) -> np.ndarray:
    out = np.zeros(len(column))
    for lo, hi, data, off in slices(column):
        _, cost, row = _sentence_costs(model, data, off)
        out[lo:hi] = -np.expm1(-np.bincount(row, cost, hi - lo))
    return out


def score(model: ToxicityModel):
    """A column function: P(toxic) of a text column."""

    @F.arrow_udf(T.DoubleType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array(_score_column(model, text))

    return run


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """doc_id, the score of each row's whole text, and the byte offsets of sentences that score ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                w, cost, row = _sentence_costs(model, data, off)
                hit = np.flatnonzero(cost >= -np.log1p(-threshold))
                last = np.append(w.first[1:], len(w.start))[hit] - 1
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=hi - lo))]).astype(np.int32))
                start, end = (pa.ListArray.from_arrays(cuts, pa.array(x - off[row[hit]])) for x in (w.start[w.first[hit]], w.end[last]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(-np.expm1(-np.bincount(row, cost, hi - lo))), start, end], ["doc_id", "score", "offending_start", "offending_end"])

    fields = [docs.schema["doc_id"], T.StructField("score", T.DoubleType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("offending_start", "offending_end"))]
    return docs.select("doc_id", text_col).mapInArrow(run, T.StructType(fields))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """(doc_id, start_byte, end_byte, sentence, score) of every sentence that scores ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, off in slices(batch.column(1)):
                w, cost, row = _sentence_costs(model, data, off)
                p = -np.expm1(-cost)
                last = np.append(w.first[1:], len(w.start)) - 1
                hit = np.flatnonzero(p >= threshold)
                start, end = w.start[w.first[hit]], w.end[last[hit]]
                texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + row[hit])), pa.array(start - off[row[hit]]), pa.array(end - off[row[hit]]), pa.array(texts, pa.string()), pa.array(p[hit])],
                    ["doc_id", "start_byte", "end_byte", "sentence", "score"],
                )

    return docs.select("doc_id", text_col).mapInArrow(run, "doc_id long, start_byte long, end_byte long, sentence string, score double")


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = MAX_TRAIN) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", max_rows, where))
