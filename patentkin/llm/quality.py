"""Quality scores by a factorisation machine (operator 8).

A document is a sparse vector: its hashed words, each with the same share of a unit length, figures
of its structure (shares of kinds of bytes, word and line lengths, repetition) as numbers and as
steps, and its length. The model has a weight for each feature and for each pair of features the
product of two short vectors. The pairs are summed in time linear in the features, as half the
difference of the squared sum and the sum of squares. It is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.llm.labelled import SAMPLE_CHARS, labelled_sample
from patentkin.llm.language import fold
from patentkin.llm.text import ALPHANUMERIC, slices, words

WORDS = 2**14
STEPS = 16
FACTORS = 8
SAMPLE_EACH = 3_000
EPOCHS = 8
THRESHOLD = 0.3
_KINDS = {
    "upper": [(65, 90)], "lower": [(97, 122)], "digit": [(48, 57)], "blank": [(9, 13), (32, 32)], "high": [(128, 255)],
    "mark": [(33, 47), (58, 64), (91, 96), (123, 126)],
}
_SHARES = len(_KINDS)
FIGURES = _SHARES + 6
WIDTH = WORDS + FIGURES + FIGURES * (STEPS + 1)


class Sparse(NamedTuple):
    """Rows of (feature, value); row r owns first[r] to first[r + 1]. No row is empty."""

    first: np.ndarray
    feature: np.ndarray
    value: np.ndarray


class Machine(NamedTuple):
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(texts: pa.Array) -> Sparse:
    """Feature vectors of whole texts; an empty text has its structure figures only."""
    found = words(texts, ALPHANUMERIC)
    n, offsets, counts = len(texts), found.offsets, found.counts
    size = np.maximum(np.diff(offsets), 1)
    kinds = np.zeros(256, dtype=np.int8)
    for k, ranges in enumerate(_KINDS.values()):
        for low, high in ranges:
            kinds[low : high + 1] = k + 1
    kind = kinds[found.data]
    figures = np.zeros((n, FIGURES))
    for k in range(_SHARES):
        figures[:, k] = _per_doc(kind == k + 1, offsets) / size
    doc = found.doc()
    _, at = np.unique(doc.astype(np.uint64) << np.uint64(44) | found.hash >> np.uint64(20), return_index=True)
    distinct = np.bincount(doc[at], minlength=n)
    lines = _per_doc(found.data == 10, offsets) + 1
    letters = _per_doc((kind == 1) | (kind == 2) | (kind == 3) | (kind == 5), offsets)
    figures[:, _SHARES] = np.minimum(letters / np.maximum(counts, 1) / 20, 1)
    figures[:, _SHARES + 1] = distinct / np.maximum(counts, 1)
    figures[:, _SHARES + 2] = np.minimum(np.log1p(counts / lines) / 8, 1)
    figures[:, _SHARES + 3] = np.minimum(np.log1p(np.diff(offsets)) / 20, 1)
    figures[:, _SHARES + 4] = np.minimum(figures[:, 5] * size / np.maximum(counts, 1) / 4, 1)
    figures[:, _SHARES + 5] = np.minimum(figures[:, 0] * size / np.maximum(counts, 1) / 4, 1)
    pairs = np.unique(doc * WORDS + (found.hash & np.uint64(WORDS - 1)).astype(np.int64))
    owner, word = pairs // WORDS, pairs % WORDS
    share = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    rows = np.arange(n)
    step = WORDS + FIGURES + np.arange(FIGURES) * (STEPS + 1) + np.floor(figures * STEPS).astype(np.int64)
    owners = np.concatenate([owner, np.repeat(rows, FIGURES), np.repeat(rows, FIGURES)])
    feature = np.concatenate([word, np.tile(WORDS + np.arange(FIGURES), n), step.ravel()])
    value = np.concatenate([share[owner], figures.ravel(), np.full(n * FIGURES, 0.5)])
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(n + 1))
    return Sparse(first, feature[order], value[order])


def raw_scores(x: Sparse, m: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, sums of the factors) by the sum-of-squares identity."""
    at = x.first[:-1]
    inner = m.factor[x.feature] * x.value[:, None]
    sums = np.add.reduceat(inner, at, axis=0)
    squares = np.add.reduceat((inner * inner).sum(axis=1), at)
    linear = np.add.reduceat(m.weight[x.feature] * x.value, at)
    return m.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _part(x: Sparse, rows: np.ndarray) -> Sparse:
    n = np.diff(x.first)[rows]
    at = np.repeat(x.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Sparse(np.concatenate([[0], np.cumsum(n)]), x.feature[at], x.value[at])


def fit(x: Sparse, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Minimise the logistic loss by Adam over small batches in a fixed order."""
    chance = np.random.default_rng(7)
    state = [np.zeros(1), np.zeros(WIDTH), chance.normal(0, 0.02, (WIDTH, FACTORS))]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    step = 0
    for _ in range(epochs if len(y) else 0):
        order = chance.permutation(len(y))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            p = _part(x, rows)
            z, sums = raw_scores(p, Machine(float(state[0][0]), state[1], state[2]))
            error = np.repeat((logistic(z) - y[rows]) / len(rows), np.diff(p.first))
            by_value = error * p.value
            owner = np.repeat(np.arange(len(rows)), np.diff(p.first))
            slope = by_value[:, None] * (sums[owner] - state[2][p.feature] * p.value[:, None])
            grads = [np.array([error[p.first[:-1]].sum()]), np.bincount(p.feature, by_value, WIDTH)]
            grads.append(np.stack([np.bincount(p.feature, slope[:, f], WIDTH) for f in range(FACTORS)], axis=1))
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * state[k] * (k > 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(state[0][0]), state[1], state[2])


def learn(sample: DataFrame) -> Machine:
    """A machine from rows (text, label) whose number is bounded; their vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                cut = lambda v: pa.LargeListArray.from_arrays(pa.array(x.first, pa.int64()), pa.array(v)).cast(pa.list_(v.type))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), cut(pa.array(x.feature, pa.int32())), cut(pa.array(x.value, pa.float32()))],
                    ["doc_id", "label", "feature", "value"],
                )

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(run, f"doc_id {kind}, label int, feature array<int>, value array<float>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    sizes = rows.column("feature").combine_chunks()
    n = np.array([len(v) for v in sizes], dtype=np.int64)
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if not len(n):
        return Machine(0.0, np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)))
    x = Sparse(np.concatenate([[0], np.cumsum(n)]), flat("feature").astype(np.int64), flat("value").astype(np.float64))
    return fit(x, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of docs."""
    small = Machine(machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                z, _ = raw_scores(Sparse(x.first, x.feature, x.value.astype(np.float32)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(logistic(z.astype(np.float64)))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learned from at most `each` labelled ids and `chars` characters of either class outside the
    held-out fold (see `labelled_sample`); whole texts are scored. Null and
    empty texts are scored by their structure figures. Without labels every score is 0.5. A row
    without doc_id is scored and not held out. Other columns are not read.
    """
    machine = learn(labelled_sample(docs, labels, "quality", fold(5) != 0, each, chars))
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    scored = score(docs, machine)
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
