"""Blocks of queries against blocks of vectors, inside a task, and the vectors that a search sees.

The scores of two blocks are one matrix product, done on Arrow batches. A task gives out no more
than the best k per query; a window over these candidates picks the final ones. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patentkin.functions.vectors import parse_vector
from patentkin.operators.skew import broadcast_if_small, store_columns as cut_lineage

CELL_BYTES = 16 * 2**20  # of the vectors on one side of a cell, in double precision
CELL_ROWS = 65_536
CHUNK_ROWS = 1_024
CHUNK_SCORES = 2**20  # scores held at a time
TIE_DIGITS = 12  # equal vectors tie, whatever the last bits of their products are

_FOUND = pa.schema([("query_id", pa.int64()), ("k", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if rows and len(flat) % rows:
        raise ValueError("vectors of different length in one table")
    return flat.reshape(rows, -1).astype(np.float64) if rows else np.empty((0, 0))


def _usable(ids: np.ndarray, vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors that have a length, scaled to one for cosine, and which rows they were."""
    norms = np.linalg.norm(vectors, axis=1)
    if metric == "euclidean":
        keep = np.isfinite(norms)
        return ids[keep], vectors[keep], keep
    keep = (norms > 0) & np.isfinite(norms)
    return ids[keep], vectors[keep] / norms[keep, None], keep


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: cosine similarity, or minus the squared distance."""
    out = queries @ corpus.T
    if metric == "euclidean":
        out = 2 * out - (queries**2).sum(1)[:, None] - (corpus**2).sum(1)[None, :]
        out = np.minimum(out, 0.0)
    return out


def _keep_best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: np.ndarray):
    """Of flat (row, id, score) triples the best k of each row."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k[rows]
    return rows[keep], ids[keep], scores[keep]


def _search(
    query_ids: np.ndarray, queries: np.ndarray, k: np.ndarray, floor: np.ndarray,
    corpus: Iterable[tuple[np.ndarray, np.ndarray]], metric: str, digits: int, skip_self: bool,
) -> Iterator[pa.RecordBatch]:
    """Best k of the corpus for every query, over any number of corpus batches.

    A score below the query's `floor` does not count.
    """
    query_ids, queries, usable = _usable(query_ids, queries, metric)
    k, floor = k[usable], floor[usable].astype(np.float64)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # not yet merged into the best
    if not len(query_ids) or k.max() < 1:
        return
    by_id = np.argsort(query_ids)
    last_id = np.full(len(query_ids), np.iinfo(np.int64).max)  # at the floor only smaller ids count
    margin = 10.0**-digits
    step = min(max(CHUNK_SCORES // len(query_ids), 64), CHUNK_ROWS)
    most = max(CHUNK_SCORES // step, 1)  # queries per chunk

    def merge() -> None:
        nonlocal best
        best = _keep_best(*(np.concatenate(parts) for parts in zip(best, *found)), k)
        found.clear()
        # A row that has its k needs nothing behind its worst one.
        size = np.bincount(best[0], minlength=len(query_ids))
        full = (size >= k) & (size > 0)
        worst = np.cumsum(size)[full] - 1
        floor[full], last_id[full] = best[2][worst], best[1][worst]

    for ids, vectors in corpus:
        ids, vectors, _ = _usable(ids, vectors, metric)
        for start in range(0, len(ids), step):
            part = ids[start : start + step]
            own = (np.empty(0, np.int64), np.empty(0, np.int64))  # where a query meets itself
            if skip_self:
                left = np.searchsorted(query_ids, part, side="left", sorter=by_id)
                right = np.searchsorted(query_ids, part, side="right", sorter=by_id)
                met = np.nonzero(right > left)[0]
                if len(met):
                    own = (np.concatenate([by_id[left[c] : right[c]] for c in met]), np.repeat(met, (right - left)[met]))
            for low in range(0, len(query_ids), most):
                high = min(low + most, len(query_ids))
                scores = _scores(queries[low:high], vectors[start : start + step], metric)
                inside = (own[0] >= low) & (own[0] < high)
                scores[own[0][inside] - low, own[1][inside]] = -np.inf
                depth = min(int(k.max()), len(part))
                least = floor[low:high]
                if depth < len(part) and np.isinf(least).any():
                    cut = np.partition(scores, len(part) - depth, axis=1)[:, len(part) - depth]
                    least = np.maximum(least, cut)
                # Only what may count is rounded; rounding can lift a score by less than the margin.
                rows, columns = np.nonzero(scores >= (least - margin)[:, None])
                rounded = np.round(scores[rows, columns], digits)
                rows += low
                level = floor[rows]
                counts = (rounded > level) | ((rounded == level) & (part[columns] < last_id[rows]))
                counts &= rounded > -np.inf
                found.append((rows[counts], part[columns[counts]], rounded[counts]))
            if sum(len(f[0]) for f in found) >= len(best[0]):
                merge()
    if found:
        merge()
    rows, ids, scores = best
    if len(rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[rows]), pa.array(k[rows].astype(np.int32)), pa.array(ids), pa.array(scores)],
            schema=_FOUND,
        )


QUERY = ("query_id", "embedding", "k", "floor")


def _columns(queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, k, floor = (queries[c].to_numpy() for c in ("query_id", "k", "floor"))
    return ids, list_matrix(queries["embedding"]), k, floor


def _slices(corpus: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors a few at a time, so that a cell is never held twice in double precision."""
    for start in range(0, corpus.num_rows, 4 * CHUNK_ROWS):
        part = corpus.slice(start, 4 * CHUNK_ROWS)
        yield part["id"].to_numpy(), list_matrix(part["embedding"])


def search_broadcast(queries: DataFrame, corpus: DataFrame, metric: str, digits: int, skip_self: bool) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(_columns(queries.select(*QUERY).toArrow()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((b["id"].to_numpy(zero_copy_only=False), list_matrix(b["embedding"])) for b in batches if b.num_rows)
        yield from _search(*shared.value, read, metric, digits, skip_self)

    return corpus.select("id", "embedding").mapInArrow(scan, "query_id long, k int, id long, score double")


def search_cells(
    left: DataFrame, right: DataFrame, cell: list[str], metric: str, digits: int, skip_self: bool
) -> DataFrame:
    """Search inside every cell; both sides carry the cell's key columns."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(*cell).schema)

    def search(key: tuple, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and corpus.num_rows:
            found = list(
                _search(*_columns(queries), _slices(corpus), metric, digits, skip_self)
            )
        table = pa.Table.from_batches(found, _FOUND)
        for i, name in enumerate(cell):
            table = table.add_column(i, name, pa.array([key[i].as_py()] * table.num_rows, key[i].type))
        return table

    # Fresh names keep the two sides apart when both come from one table.
    right = right.select(*[F.col(c).alias(c) for c in (*cell, "id", "embedding")])
    return (
        left.groupBy(*cell)
        .cogroup(right.groupBy(*cell))
        .applyInArrow(search, f"{schema}, query_id long, k int, id long, score double")
    )


def ranked_by_score(found: DataFrame, keys: list[str], k_max: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= k_max) & (F.col("rank") <= F.col("k")))


class Vectors(NamedTuple):
    """Vectors (id, embedding) brought into shape once: one per id, all of the length that most have."""

    rows: DataFrame
    dimension: int
    count: int


def _present(emb: DataFrame) -> DataFrame:
    """(id, embedding) that are not missing or empty; text vectors are parsed."""
    vector = F.col("embedding")
    if emb.schema["embedding"].dataType.simpleString() == "string":
        vector = parse_vector(vector)
    out = emb.select(F.col("id").cast("bigint").alias("id"), vector.alias("embedding"))
    return out.where(F.col("id").isNotNull() & (F.size("embedding") > 0))


def usable_vectors(emb: DataFrame) -> DataFrame:
    """(id, embedding) without missing and empty vectors, one for each id; text vectors are parsed.

    Of an id's vectors the greatest stays. Only ids that are stored twice are found first, by a
    count of the ids alone, so the other vectors are not shuffled for this; where there are none,
    the table is read as it is.
    """
    out = _present(emb)
    again = cut_lineage(out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return out
    again = broadcast_if_small(again)
    one_each = out.join(again, "id", "left_semi").groupBy("id").agg(F.max("embedding").alias("embedding"))
    return out.join(again, "id", "left_anti").unionAll(one_each)


def as_vectors(emb: DataFrame | Vectors) -> Vectors:
    """`emb` in shape: two passes over the table, however many searches follow. The smaller length of two that tie counts."""
    if isinstance(emb, Vectors):
        return emb
    rows = usable_vectors(emb)
    sizes = _present(emb).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "d").first()
    dimension, count = (usual["d"], usual["n"]) if usual else (0, 0)
    return Vectors(rows.where(F.size("embedding") == dimension), dimension, count)
