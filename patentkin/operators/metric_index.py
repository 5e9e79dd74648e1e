"""Exact nearest neighbours over vectors stored by the centroid they are nearest to.

Unit vectors at a small angle are near by their straight distance too, and for that the triangle
inequality holds: a vector of a cell is no nearer to a query than the cell's centre less the
cell's radius. A query first looks into its nearest cells, until they hold as many vectors as it
wants. The worst score found there is a bound; of all other cells only those are searched whose best possible
score reaches it, and queries travel only to cells they have to see. Small cells that lie side by side go to one
task there, so that a query travels at most once for every such group, however many of its cells it has to see.

The centres are a sample in the order of a hash. They, the radii and the counts are the only
parts on the driver, CENTRE_BYTES at most; a cell with more rows than fit is cut into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.operators.block_search import (
    CELL_BYTES, CELL_ROWS, CHUNK_SCORES, TIE_DIGITS, Vectors, as_vectors, list_matrix, ranked_by_score, search_cells,
)
from patentkin.operators.skew import store_columns as cut_lineage

CENTRE_BYTES = 64 * 2**20
SLACK = 1e-9  # of distances, for the last bits of products


class MetricIndex(NamedTuple):
    """`vectors` is (cell, block, id, embedding); the arrays have one entry per cell."""

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which rows have one."""
    length = np.linalg.norm(vectors, axis=1)
    usable = (length > 0) & np.isfinite(length)
    return vectors[usable] / length[usable, None], usable


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (unit @ centres.T), 0.0))


def cell_side(dimension: int) -> int:
    """How many vectors one side of a search in a task may have."""
    return min(CELL_ROWS, max(1, CELL_BYTES // (8 * max(dimension, 1))))


def build_index(emb: DataFrame | Vectors, cell_rows: int | None = None) -> MetricIndex:
    """Index of the usable vectors (id, embedding) of the length that most have, in cells of about `cell_rows`."""
    own, dimension, n = as_vectors(emb)
    side = cell_side(dimension)
    wanted = max(1, math.ceil(n / (cell_rows or side)))
    number = min(wanted, max(1, CENTRE_BYTES // (8 * max(dimension, 1))))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(number).select("embedding").toArrow()
    centres, _ = _unit(list_matrix(sample["embedding"]))
    if not len(centres):
        centres = np.zeros((1, max(dimension, 1)))
    shared = own.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK_SCORES // len(shared.value))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                unit, usable = _unit(list_matrix(batch.column("embedding")))
                kept = batch.filter(pa.array(usable))
                far = _distances(unit, shared.value)
                cell = far.argmin(axis=1) if len(far) else np.zeros(0, dtype=np.int64)
                reach = far[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), kept.column("id"), pa.array(reach), kept.column("embedding")],
                    ["cell", "id", "reach", "embedding"],
                )

    kind = own.schema["embedding"].dataType.simpleString()
    placed = cut_lineage(
        own.select("id", "embedding").mapInArrow(assign, f"cell int, id long, reach double, embedding {kind}")
    )
    radius, rows = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect():
        radius[row["cell"]], rows[row["cell"]] = row["radius"], row["n"]
    blocks = np.maximum(1, -(-rows // side))
    per_cell = F.get(F.lit(blocks.tolist()).cast("array<int>"), F.col("cell"))
    block = F.pmod(F.xxhash64("id"), per_cell).cast("int")
    return MetricIndex(placed.select("cell", block.alias("block"), "id", "embedding"), centres, radius, rows, blocks)


def cell_groups(index: MetricIndex) -> tuple[MetricIndex, np.ndarray]:
    """The index with cells put together as far as their rows fit one side of a search, and the group of every cell.

    Cells follow each other by the nearest of as many centres as there will be groups, so a group is mostly of neighbours. `centres`
    and `radius` are of no use in the result.
    """
    side = cell_side(index.centres.shape[1])
    pivots = index.centres[: max(1, math.ceil(index.rows.sum() / side))]
    step = max(1, CHUNK_SCORES // len(pivots))
    far = [_distances(index.centres[low : low + step], pivots) for low in range(0, len(index.centres), step)]
    near, reach = (np.concatenate([how(f) for f in far]) for how in (lambda f: f.argmin(axis=1), lambda f: f.min(axis=1)))
    of_cell, rows = np.zeros(len(index.rows), dtype=np.int64), [0]
    for cell in np.lexsort((reach, near)):
        if rows[-1] and rows[-1] + index.rows[cell] > side:
            rows.append(0)
        rows[-1] += int(index.rows[cell])
        of_cell[cell] = len(rows) - 1
    blocks = np.maximum(1, -(-np.array(rows) // side))
    group = F.get(F.lit(of_cell.tolist()).cast("array<int>"), F.col("cell"))
    block = F.pmod(F.xxhash64("id"), F.get(F.lit(blocks.tolist()).cast("array<int>"), F.col("cell"))).cast("int")
    vectors = index.vectors.select(group.alias("cell"), "id", "embedding").select("cell", block.alias("block"), "id", "embedding")
    return MetricIndex(vectors, index.centres, index.radius, np.array(rows), blocks), of_cell


def visits(index: MetricIndex, queries: DataFrame, digits: int, first: bool, of_cell: np.ndarray | None = None) -> DataFrame:
    """Queries (query_id, k, floor, embedding), a row for each cell they have to look into, or for each group of such cells.

    first: the nearest cells that hold k vectors and one more, for the query itself. Otherwise the
    cells besides these that may hold a score of `floor` or more. A score is rounded, so it may be
    lower than the floor by a unit of the last digit.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.rows, of_cell))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, rows, of_cell = shared.value
        step = max(1, min(1_024, CHUNK_SCORES // len(centres)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                unit, usable = _unit(list_matrix(part.column("embedding")))
                part = part.filter(pa.array(usable))
                far = _distances(unit, centres)
                order = np.argsort(far, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                k = part.column("k").to_numpy(zero_copy_only=False)
                near = np.zeros(far.shape, dtype=bool)
                np.put_along_axis(near, order, before < k[:, None] + 1, axis=1)
                near &= rows > 0
                if first:
                    chosen = near
                else:
                    best = np.maximum(far - radius - SLACK, 0.0)
                    floor = part.column("floor").to_numpy(zero_copy_only=False)
                    chosen = ~near & (rows > 0) & (1.0 - best**2 / 2 >= (floor - 10.0**-digits)[:, None])
                row, cell = np.nonzero(chosen)
                if of_cell is not None:
                    row, cell = np.unique(np.stack([row, of_cell[cell]]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("query_id", "k", "floor", "embedding"))],
                    ["cell", "query_id", "k", "floor", "embedding"],
                )

    kind = queries.schema["embedding"].dataType.simpleString()
    schema = f"cell int, query_id long, k int, floor double, embedding {kind}"
    given = queries.select("query_id", F.col("k").cast("int").alias("k"), F.col("floor").cast("double").alias("floor"), "embedding")
    return given.mapInArrow(choose, schema)


def _look(index: MetricIndex, asked: DataFrame, digits: int, skip_self: bool) -> DataFrame:
    """Best k of every query in every cell it looks into; queries of one cell are dealt to tasks of bounded size."""
    side = cell_side(index.centres.shape[1])
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    turns = [max(1, math.ceil(counts.get(c, 0) / side)) for c in range(len(index.rows))]

    def per_cell(values: list[int]):
        return F.get(F.lit(values).cast("array<int>"), F.col("cell"))

    blocks, turn = per_cell(index.blocks.tolist()), per_cell(turns)
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
        "turn", F.pmod(F.xxhash64("query_id"), turn).cast("int")
    )
    seen = index.vectors.where(F.get(F.lit([c in counts for c in range(len(index.rows))]), F.col("cell")))
    right = seen.withColumn("turn", F.explode(F.sequence(F.lit(0), turn - 1)))
    return search_cells(left, right, ["cell", "block", "turn"], "cosine", digits, skip_self)


def search_index(
    index: MetricIndex, queries: DataFrame, k_max: int, digits: int = TIE_DIGITS, skip_self: bool = False
) -> DataFrame:
    """(query_id, id, score, rank) of the k best by cosine for queries (query_id, k, embedding); ties go to the smaller id."""
    queries = queries.where(F.size("embedding") == index.centres.shape[1])
    open_ = queries.withColumn("floor", F.lit(-math.inf))
    near = cut_lineage(_look(index, visits(index, open_, digits, True), digits, skip_self).select("query_id", "k", "id", "score"))
    worst = ranked_by_score(near, ["query_id"], k_max).where(F.col("rank") == F.col("k"))
    bound = worst.select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bound, "query_id", "left").withColumn("floor", F.coalesce("bound", F.lit(-math.inf))).drop("bound")
    groups, of_cell = cell_groups(index)
    asked = cut_lineage(visits(index, bounded, digits, False, of_cell))
    rest = _look(groups, asked, digits, skip_self).select("query_id", "k", "id", "score")
    # A group may have cells that were seen before; what was found there counts once, as it was found first.
    both = near.withColumn("first", F.lit(1)).unionByName(rest.withColumn("first", F.lit(0))).repartition("query_id")
    once = both.groupBy("query_id", "k", "id").agg(F.max_by("score", "first").alias("score"))
    return ranked_by_score(once, ["query_id"], k_max).select("query_id", "id", "score", "rank")
