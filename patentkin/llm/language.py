"""Languages of documents as mixtures (operator 5).

A model holds the frequencies of hashed byte trigrams per language, counted over all documents to
learn from. A document is a series of units of a few words; each unit comes from one language.
Expectation-maximisation estimates the shares of the languages in the document from the units'
likelihoods. Then languages are left out one after another, the smallest share first, as long as
the likelihood penalised by half the logarithm of the number of units for each language does not
fall. The language with the largest share is the prediction, its share the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patentkin.llm.columns import nested, restored
from patentkin.llm.text import ALPHANUMERIC, PIECE_BYTES, slices, text_bytes

BUCKETS = 2**14
UNIT_BYTES = 64
ROUNDS = 8
NO_LANGUAGE = "und"
_FOLD = np.where(ALPHANUMERIC.word, np.arange(256), 0x20).astype(np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 0x20


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte; BUCKETS where it has no letter or passes the end."""
    out = np.full(len(data), BUCKETS, dtype=np.int32)
    for low in range(0, len(data), PIECE_BYTES):
        b = _FOLD[data[low : low + PIECE_BYTES + 2]]
        if len(b) < 3:
            continue
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
        bucket[code == 0x202020] = BUCKETS
        out[low : low + len(bucket)] = bucket
    return out


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by bucket and language) from all rows of docs with text and lang.

    Counts are added up per task and then by Spark; languages x BUCKETS numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                bucket = grams(data)
                for d, lang in enumerate(part.column("lang").to_pylist()):
                    own = bucket[offsets[d] : max(offsets[d], offsets[d + 1] - 2)]
                    counts = np.bincount(own, minlength=BUCKETS + 1)[:BUCKETS]
                    total[lang] = total[lang] + counts if lang in total else counts
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    counted = docs.where("text is not null and lang is not null").select("text", "lang")
    counted = counted.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS + 1, len(langs)), 0.5)
    counts[rows["bucket"].to_numpy(dtype=int), np.searchsorted(langs, rows["lang"])] += rows["n"].to_numpy(dtype=float)
    table = np.log(counts / counts.sum(axis=0, keepdims=True)) if langs else counts
    table[BUCKETS] = 0
    return langs, table.astype(np.float32)


def _likelihood(unit: np.ndarray, first: np.ndarray, share: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each document under its shares, and the shares after one round."""
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(divide="ignore"):
        joint = unit + np.log(share)[doc]
    top = joint.max(axis=1, keepdims=True)
    top[~np.isfinite(top)] = 0
    weight = np.exp(joint - top)
    total = weight.sum(axis=1, keepdims=True)
    full = np.flatnonzero(n)
    fit, new = np.zeros(len(n)), share.copy()
    if len(full):
        fit[full] = np.add.reduceat((np.log(total) + top)[:, 0], first[full])
        new[full] = np.add.reduceat(weight / total, first[full], axis=0) / n[full, None]
    return fit, new


def mixtures(unit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of the languages in each document; unit: a row of log-likelihoods per unit, n[d] of document d."""
    langs = unit.shape[1]
    first = np.cumsum(n) - n
    share = np.full((len(n), langs), 1 / max(1, langs))
    for _ in range(ROUNDS):
        _, share = _likelihood(unit, first, share, n)
    fit, _ = _likelihood(unit, first, share, n)
    price = 0.5 * np.log(np.maximum(n, 2))
    rows = np.arange(len(n))
    settled = np.zeros(len(n), dtype=bool)
    for _ in range(langs - 1):
        least = np.where(share > 0, share, np.inf).argmin(axis=1)
        fewer = share.copy()
        fewer[rows, least] = 0
        total = fewer.sum(axis=1, keepdims=True)
        fewer = np.divide(fewer, total, out=share.copy(), where=total > 0)
        for _ in range(2):
            _, fewer = _likelihood(unit, first, fewer, n)
        new, _ = _likelihood(unit, first, fewer, n)
        take = ~settled & (total[:, 0] > 0) & (new - fit >= -price)
        share[take], fit[take] = fewer[take], new[take]
        settled |= ~take
    return share


def _units(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood rows, number per document) of runs of UNIT_BYTES trigrams of each document."""
    bucket = grams(data)
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    n = -(-sizes // UNIT_BYTES)
    inside = np.ones(len(data), dtype=bool)
    for back in (1, 2):
        ends = offsets[1:] - back
        inside[ends[ends >= offsets[:-1]]] = False
    bucket[~inside] = BUCKETS
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(offsets[:-1], n) + k * UNIT_BYTES
    if not len(start):
        return np.zeros((0, table.shape[1]), dtype=np.float32), n
    rows = np.empty((len(start), table.shape[1]))
    for lang in range(table.shape[1]):
        rows[:, lang] = np.add.reduceat(table[:, lang][bucket], start)
    return rows, n


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *kept: Column, prefix: str = "") -> DataFrame:
    """The columns `kept` of docs with lang_pred, score and langs (all languages of the mixture, largest first).

    `prefix` stands before the names of these three.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing was
    learned. Whole texts are read; a text below three bytes has no trigram, and its shares are
    equal. Ties go to the language first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.select(*kept).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            for part in slices(batch, "_whole_text"):
                data, offsets = text_bytes(part.column("_whole_text"))
                lettered = [any(map(str.isalpha, t.as_py() or "")) for t in part.column("_whole_text")]
                pred, score, found = [], [], []
                share = mixtures(*_units(data, offsets, table)) if langs else np.zeros((part.num_rows, 0))
                for own, known in zip(share, lettered, strict=True):
                    order = np.argsort(-own, kind="stable") if known and langs else []
                    pred.append(langs[order[0]] if len(order) else NO_LANGUAGE)
                    score.append(float(min(1.0, own[order[0]])) if len(order) else 0.0)
                    found.append([langs[i] for i in order if own[i] > 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))],
                    [*names, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}langs"],
                )

    given = docs.select(*kept, F.col("text").alias("_whole_text"))
    added = StructType.fromDDL(f"{prefix}lang_pred string, {prefix}score double, {prefix}langs array<string>")
    return given.mapInArrow(run, StructType([*docs.select(*kept).schema, *added]))


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def language_mixture(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs per row; learned from the rows that are not held out.

    A row without doc_id is neither learned from nor held out.
    """
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return identify(docs, learn(docs.where(fold(5) != 0)), F.col("doc_id"), held_out)


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose language can't be told: null texts and texts without a letter.

    All columns, of any name and type, are passed on as they are.
    Where no language is known to learn from, all other rows stay too, as if of a single language.
    """
    langs, table = learn(docs.where(fold(5) != 0))
    if not langs:
        langs, table = ["any"], np.zeros((BUCKETS + 1, 1), dtype=np.float32)
    slim = nested(docs, "doc_id", "text")
    marked = identify(slim, (langs, table), *[F.col(c) for c in slim.columns])
    return restored(marked.where(F.col("lang_pred") != NO_LANGUAGE), docs, "doc_id", "text")
