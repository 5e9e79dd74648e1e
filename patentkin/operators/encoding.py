"""Text embeddings for families, pooling, and the insert-if-absent rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from patentkin.functions.text import combined_text

BATCH_SIZE = 32
MAX_LENGTH = 512
HASH_DIMENSION = 16


def masked_mean(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (batch, token, dimension) where the mask is set; zero where it never is."""
    weight = mask[:, :, None].astype(np.float64)
    return (vectors * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def token_count(text: str) -> int:
    return len(re.findall("[a-z0-9]+", text.lower()))


def text_windows(text: str, max_length: int) -> list[tuple[str, int]]:
    """Consecutive parts of a text with their token counts, at most `max_length` tokens each.

    Parts are cut between words. A single word of more tokens is a part of its own; a text without
    tokens is one part.
    """
    parts, low, at, tokens = [], 0, 0, 0
    for word in re.finditer(r"\S+", text):
        more = token_count(word[0])
        if tokens and tokens + more > max_length:
            parts.append((text[low:at], tokens))
            low, tokens = word.start(), 0
        tokens += more
        at = word.end()
    return [*parts, (text[low:], tokens)]


def over_whole_texts(make_predict_fn: Callable, max_length: int, batch_size: int) -> Callable:
    """A model of a bounded length over whole texts: the mean of its vectors of all windows, by token count."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        predict = make_predict_fn()

        def run(texts: np.ndarray) -> np.ndarray:
            cut = [text_windows(str(t), max_length) for t in texts.ravel()]
            parts = np.array([p for parts in cut for p, _ in parts], dtype=object)
            vectors = np.concatenate([predict(parts[i : i + batch_size]) for i in range(0, len(parts), batch_size)])
            weight = np.array([n for parts in cut for _, n in parts], dtype=np.float64)
            first = np.cumsum([0, *[len(parts) for parts in cut[:-1]]])
            total = np.add.reduceat(weight, first)
            weight = np.where(np.repeat(total, [len(p) for p in cut]) > 0, weight, 1)
            sums = np.add.reduceat(vectors.astype(np.float64) * weight[:, None], first, axis=0)
            return (sums / np.add.reduceat(weight, first)[:, None]).astype(np.float32)

        return run

    return make


def token_hash_model() -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A stand-in for a language model: every token's vector is the bytes of its md5."""

    def make_predict_fn() -> Callable[[np.ndarray], np.ndarray]:
        known: dict[str, np.ndarray] = {}

        def vector(token: str) -> np.ndarray:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                known[token] = np.frombuffer(hashlib.md5(token.encode()).digest(), np.uint8) / 127.5 - 1.0
            return known[token]

        def predict(texts: np.ndarray) -> np.ndarray:
            tokens = [re.findall("[a-z0-9]+", str(t).lower()) for t in texts.ravel()]
            width = max(1, max(map(len, tokens)))
            vectors = np.zeros((len(tokens), width, HASH_DIMENSION))
            mask = np.zeros((len(tokens), width))
            for i, row in enumerate(tokens):
                if row:
                    vectors[i, : len(row)] = [vector(t) for t in row]
                    mask[i, : len(row)] = 1
            return masked_mean(vectors, mask).astype(np.float32)

        return predict

    return make_predict_fn


def embed(
    pending: DataFrame,
    make_predict_fn: Callable | None = None,
    batch_size: int = BATCH_SIZE,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """(id, embedding) of families (family_id, title, abstract).

    `make_predict_fn` loads the model once per Python worker; the texts reach it in Arrow batches.
    A text longer than `max_length` tokens is read in consecutive windows, whose vectors are
    averaged by their token counts.
    """
    whole = over_whole_texts(make_predict_fn or token_hash_model(), max_length, batch_size)
    model = predict_batch_udf(whole, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return pending.select(
        F.col("family_id").cast("bigint").alias("id"),
        model(combined_text(F.col("title"), F.col("abstract"))).alias("embedding"),
    )


def new_embeddings(encoded: DataFrame, existing: DataFrame) -> DataFrame:
    """Encoded rows whose id is not stored yet, one per id."""
    stored = existing.select(F.col("id").cast("bigint").alias("id"))
    return encoded.join(stored, "id", "left_anti").dropDuplicates(["id"])


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(doc, embedding) from a token table (doc, pos, mask, vec).

    The table form of `masked_mean`: vectors stay whole and are summed up in the tasks first, so one
    row per task and document is shuffled. A masked token weighs next to nothing, and a document
    without any other has the zero vector.
    """
    mask = F.col("mask").cast("double")
    mean = vector_to_array(Summarizer.mean(array_to_vector("vec"), F.greatest(mask, F.lit(1e-300))))
    pooled = tokens.groupBy("doc").agg(mean.alias("mean"), F.sum(mask).alias("weight"))
    share = F.col("weight") / F.greatest("weight", F.lit(1e-9))
    return pooled.select("doc", F.transform("mean", lambda v: (v * share).cast("float")).alias("embedding"))
