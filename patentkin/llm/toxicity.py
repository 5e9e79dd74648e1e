"""Toxic spans and document scores by a linear-chain conditional random field (operator 9).

Labels mark documents, not words, so tokens are labelled first: a token counts as toxic where it
stands in a toxic document and its word, or the beginning of its word, is far more frequent in toxic
documents than in others, counted once for each group of copies. How rare it may be follows from a test
of significance, with FALSE_SHARE as the expected share of false ones among all that pass. A two-state chain with weights for
hashed words, their beginnings and their neighbours is fitted to these labels by gradient ascent. The marginals of the toxic state, from the forward and
backward messages over the whole text, give the offending spans; their largest value and their sum
give the document's score through a logistic fit. All fitting uses a bounded sample.

Messages run through blocks of BLOCK tokens: the product of the steps of every block first, then
from block to block, then inside the blocks, which is exact and handles texts of any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.llm.labelled import labelled_sample
from patentkin.llm.language import fold
from patentkin.llm.quality import THRESHOLD, logistic
from patentkin.llm.text import ALPHANUMERIC, Words, constants, mix, slices, words

BUCKETS = 2**16
BLOCK = 64
BEGINNINGS = (4, 5, 6, 7)
SAMPLE_EACH = 1_000
#: Of each class; the fit holds several arrays with a place for each word.
SAMPLE_CHARS = 4 * 2**20
ROUNDS = 30
MIN_DOCUMENTS = 4
MIN_ODDS = 8.0
FALSE_SHARE = 0.05
SPAN = 0.5

_PLACES = constants(max(BEGINNINGS), 8)


class Chain(NamedTuple):
    """Weights of the toxic state: a table for each of the word, its beginnings and its neighbours; bias; log weights
    of the moves (from, to); the fit of the score."""

    tables: list[np.ndarray]
    bias: float
    moves: np.ndarray
    fit: np.ndarray


def traits(found: Words) -> np.ndarray:
    """Hashes (trait, token) of the words and of their first BEGINNINGS bytes; 0 where a word is shorter."""
    out = np.zeros((1 + len(BEGINNINGS), len(found.hash)), dtype=np.uint64)
    out[0] = found.hash
    size = found.end - found.start
    total = np.zeros(len(found.hash), dtype=np.uint64)
    for k in range(max(BEGINNINGS)):
        byte = ALPHANUMERIC.values[found.data[np.minimum(found.start + k, len(found.data) - 1)]] if len(total) else total
        total = total + byte * _PLACES[k]
        if k + 1 in BEGINNINGS:
            at = BEGINNINGS.index(k + 1)
            out[1 + at] = np.where(size > k, mix(total + np.uint64(at)) | np.uint64(1), 0)
    return out


def _buckets(traits: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Buckets of the traits, of the word before and of the word after; BUCKETS where there is none."""
    own = (traits >> np.uint64(48)).astype(np.int64)
    own[traits == 0] = BUCKETS
    before, after = np.full(own.shape[1], BUCKETS), np.full(own.shape[1], BUCKETS)
    before[1:], after[:-1] = own[0, :-1], own[0, 1:]
    full = np.diff(first) > 0
    before[first[:-1][full]] = BUCKETS
    after[first[1:][full] - 1] = BUCKETS
    return [*own, before, after]


def _emissions(buckets: list[np.ndarray], chain: Chain) -> np.ndarray:
    total = np.full(len(buckets[0]), chain.bias)
    for table, bucket in zip(chain.tables, buckets, strict=True):
        total += table[bucket]
    return np.clip(total, -25, 25)


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability of the toxic state of each token; with `pairs`, also the expected moves (from, to)."""
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    head = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(emission)) - first[doc]
    row, column = head[doc] + place // BLOCK, place % BLOCK
    weight = np.ones((total, BLOCK, 2))
    weight[row, column, 1] = np.exp(emission)
    used = np.zeros((total, BLOCK), dtype=bool)
    used[row, column] = True
    step = np.exp(moves)

    def scaled(v: np.ndarray, axes) -> np.ndarray:
        return v / v.sum(axis=axes, keepdims=True)

    product = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
    for t in range(BLOCK):
        rows = used[:, t]
        product[rows] = scaled((product[rows] @ step) * weight[rows, t][:, None, :], (1, 2))
    ahead, behind = np.zeros((total, 2)), np.full((total, 2), 0.5)
    ahead[head[blocks > 0], 0] = 1
    for k in range(1, int(blocks.max())):
        at = head[blocks > k] + k
        ahead[at] = scaled((ahead[at - 1][:, None, :] @ product[at - 1])[:, 0], 1)
    for k in range(2, int(blocks.max()) + 1):
        at = (head + blocks)[blocks >= k] - k
        behind[at] = scaled((product[at + 1] @ behind[at + 1][:, :, None])[:, :, 0], 1)
    forward = np.empty((total, BLOCK, 2))
    for t in range(BLOCK):
        ahead = np.where(used[:, t : t + 1], scaled((ahead @ step) * weight[:, t], 1), ahead)
        forward[:, t] = ahead
    out = np.empty((total, BLOCK))
    moved = np.zeros((2, 2))
    for t in range(BLOCK - 1, -1, -1):
        both = forward[:, t] * behind
        out[:, t] = both[:, 1] / both.sum(axis=1)
        carried = weight[:, t] * behind
        if pairs and t:
            joint = forward[:, t - 1][:, :, None] * step[None] * carried[:, None, :]
            moved += (scaled(joint, (1, 2)) * used[:, t, None, None]).sum(axis=0)
        behind = np.where(used[:, t : t + 1], scaled(carried @ step.T, 1), behind)
    chances = out[row, column]
    return (chances, moved) if pairs else chances


def _chance(c: int, total: int, share: float) -> float:
    """Probability of c or more of `total` documents being toxic if each is so with a chance of `share`."""
    k = np.arange(c, total + 1)
    steps = np.log((total - k[:-1]) / (k[:-1] + 1) * share / (1 - share))
    start = math.lgamma(total + 1) - math.lgamma(c + 1) - math.lgamma(total - c + 1) + c * math.log(share) + (total - c) * math.log1p(-share)
    return float(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])).sum())


def toxic_traits(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Traits far more frequent in toxic documents; documents with an equal least word pair count once.

    A trait stands in MIN_DOCUMENTS toxic documents or more, has odds of MIN_ODDS, and is significant
    by the step-up rule of Benjamini and Hochberg over all traits of MIN_DOCUMENTS documents.
    """
    seen: dict[bool, set] = {True: set(), False: set()}
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for own, bad in zip(documents, toxic.astype(bool), strict=True):
        word = own[0]
        least = int((word[1:] * np.uint64(3) + word[:-1]).min()) if len(word) > 1 else int(word.sum(dtype=np.uint64))
        if least not in seen[bad]:
            seen[bad].add(least)
            counts[bad].update(np.unique(own).tolist())
    n, m = len(seen[True]), len(seen[False])
    if not n or not m:
        return np.zeros(0, dtype=np.uint64)
    share = lambda k: (counts[False][k] + 0.5) / (m + 1)
    tested = sum(c + counts[False][k] >= MIN_DOCUMENTS for k, c in counts[True].items() if k)
    tested += sum(c >= MIN_DOCUMENTS for k, c in counts[False].items() if k and k not in counts[True])
    known: dict[tuple[int, int], float] = {}
    found = []
    for k, c in counts[True].items():
        if k and c >= MIN_DOCUMENTS and (c + 0.5) / (n + 1) >= MIN_ODDS * share(k):
            pair = (c, c + counts[False][k])
            if pair not in known:
                known[pair] = _chance(*pair, n / (n + m))
            found.append((known[pair], k))
    found.sort()
    last = max((at for at, (p, _) in enumerate(found, 1) if p * tested <= FALSE_SHARE * at), default=0)
    return np.array(sorted(k for _, k in found[:last]), dtype=np.uint64)


def fit_chain(buckets: list[np.ndarray], first: np.ndarray, tag: np.ndarray) -> Chain:
    """Weights that maximise the penalised likelihood of the tags, by Adam over the whole sample.

    The sequences to learn from are blocks of the documents.
    """
    starts = [np.arange(a, a + c, BLOCK) for a, c in zip(first, np.diff(first), strict=False)]
    cuts = np.unique(np.concatenate([first, *starts]).astype(np.int64))
    inside = np.ones(len(tag), dtype=bool)
    inside[cuts[:-1]] = False
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (tag[:-1][inside[1:]].astype(int), tag[1:][inside[1:]].astype(int)), 1)
    seen = [np.bincount(p, tag, BUCKETS + 1) for p in buckets]
    n = len(buckets)
    state = [np.zeros(BUCKETS + 1) for _ in range(n)] + [np.array([-3.0]), np.zeros((2, 2))]
    one, two = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    scale = 1 / max(1.0, float(tag.sum()))
    for step in range(1, ROUNDS + 1):
        chain = Chain(state[:n], float(state[n][0]), state[n + 1], np.zeros(3))
        chance, moved = marginals(_emissions(buckets, chain), cuts, chain.moves, pairs=True)
        grads = [s - np.bincount(p, chance, BUCKETS + 1) for s, p in zip(seen, buckets, strict=True)]
        grads += [np.array([float(tag.sum() - chance.sum())]), seen_moves - moved]
        for k, g in enumerate(grads):
            neighbour = k in (n - 2, n - 1)
            g = g * scale - 1e-3 * state[k] * (10 if neighbour else 1)
            one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.99 * two[k] + 0.01 * g * g
            rate = 0.03 if neighbour else 0.3
            state[k] = state[k] + rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
    return Chain([t.astype(np.float32) for t in state[:n]], float(state[n][0]), state[n + 1], np.zeros(3))


def _figures(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: one, the largest marginal, the logarithm of one plus the sum of the clear ones."""
    counts = np.diff(first)
    out = np.zeros((len(counts), 3))
    out[:, 0] = 1
    full = counts > 0
    if full.any():
        out[full, 1] = np.maximum.reduceat(chance, first[:-1][full])
        out[full, 2] = np.log1p(np.add.reduceat(np.where(chance >= SPAN, chance, 0), first[:-1][full]))
    return out


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(300):
        w += 0.5 * (x.T @ (y - logistic(x @ w)) / max(1, len(y)) - 1e-3 * w * [0, 1, 1])
    return w


def learn(sample: DataFrame) -> Chain | None:
    """A chain from rows (doc_id, text, label) whose number is bounded; the traits of their words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALPHANUMERIC)
                all_ = traits(found)
                own = [all_[:, a:b].tobytes() for a, b in zip(found.first, found.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "traits"]
                )

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(run, f"doc_id {kind}, label int, traits binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("traits", "ascending")])
    documents = [np.frombuffer(v, dtype=np.uint64).reshape(1 + len(BEGINNINGS), -1) for v in rows.column("traits").to_pylist()]
    label = rows.column("label").to_numpy().astype(float)
    if not sum(d.size for d in documents):
        return None
    bad = toxic_traits(documents, label)
    flat = np.concatenate(documents, axis=1)
    first = np.concatenate([[0], np.cumsum([d.shape[1] for d in documents])])
    tag = np.isin(flat, bad).any(axis=0) & (np.repeat(label, np.diff(first)) == 1)
    buckets = _buckets(flat, first)
    chain = fit_chain(buckets, first, tag.astype(float))
    figures = _figures(marginals(_emissions(buckets, chain), first, chain.moves), first)
    return chain._replace(fit=_fit_score(figures, label))


def _spans(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[str]:
    """start:end in code points of the given byte spans, by document, joined by commas."""
    out: list[list[str]] = [[] for _ in range(n)]
    if len(start):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for d, a, b in zip(doc, points[start] - points[offsets[doc]], points[end] - points[offsets[doc]], strict=True):
            out[d].append(f"{a}:{b}")
    return [",".join(x) for x in out]


def tag(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, score and spans (code points, end exclusive) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                score, spans = np.zeros(n), [""] * n
                if chain is not None:
                    found = words(part.column("text"), ALPHANUMERIC)
                    buckets = _buckets(traits(found), found.first)
                    chance = marginals(_emissions(buckets, chain), found.first, chain.moves)
                    score = logistic(_figures(chance, found.first) @ chain.fit)
                    clear = np.flatnonzero(chance >= SPAN)
                    doc = np.searchsorted(found.first, clear, side="right") - 1
                    spans = _spans(found.data, found.offsets, doc, found.start[clear], found.end[clear], n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array(spans, pa.string())], ["doc_id", "score", "spans"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans string")


def toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, spans.

    Learned from at most `each` labelled ids and `chars` characters of either class outside the
    held-out fold (see `labelled_sample`); whole texts are scored. Null and
    empty texts have no spans and the score of a text without toxic words. Without labels every
    score is 0. A row without doc_id is scored and not held out. Other columns are not read.
    """
    chain = learn(labelled_sample(docs, labels, "toxic", fold(4) != 2, each, chars))
    held_out = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return tag(docs, chain).select(
        "doc_id", held_out, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans"
    )
