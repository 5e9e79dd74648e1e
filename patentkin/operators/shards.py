"""Ordered rows cut into shards below a size in bytes.

Shards are filled one after the other, as by a single pass over all rows in key order, but ranges of
keys are worked through side by side. What a range does depends on one number only: the bytes in
the shard that is open where the range begins. So every range first says, for each such number,
how many shards it closes and what it leaves open. That is a step function with at most one step for each
row of a first shard. Neighbouring functions are composed level by level, FAN at a time; then the
numbers at the beginnings come back down, and every range fills its shards from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.functions.text import ROW_OVERHEAD_BYTES, row_size
from patentkin.operators.skew import cut_lineage

TARGET_BYTES = 100 * 2**20
ROWS_PER_RANGE = 200_000
FAN = 16
STEPS = "node long, at binary, closed binary, left binary, adds binary"


class Steps(NamedTuple):
    """What a range does with `c` bytes open before it, for c from at[k] up to at[k + 1].

    It opens closed[k] new shards and leaves left[k] bytes in the last one; where adds[k], it opens
    none and leaves c + left[k]. The first step is for 0 alone, an empty shard, which takes any row.
    """

    at: np.ndarray
    closed: np.ndarray
    left: np.ndarray
    adds: np.ndarray

    def __call__(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.at, c, side="right") - 1
        return self.closed[k], self.left[k] + np.where(self.adds[k], c, 0)


def _packed(steps: Steps) -> dict[str, bytes]:
    return {name: np.asarray(value, dtype=np.int64).tobytes() for name, value in steps._asdict().items()}


def _unpacked(row) -> Steps:
    return Steps(*(np.frombuffer(row[name], dtype=np.int64) for name in Steps._fields))


def range_steps(sizes: np.ndarray, target: int) -> Steps:
    """The steps of one range of rows, each of one byte or more."""
    upto = np.cumsum(sizes, dtype=np.int64)
    m, total = len(upto), int(upto[-1]) if len(sizes) else 0
    before = upto - sizes
    # the row that opens the next shard after one that opens at each row
    following = np.maximum(np.searchsorted(upto, before + target), np.arange(m) + 1).tolist()
    opened, left = [1] * m, (total - before).tolist()
    for k in range(m - 1, -1, -1):
        if following[k] < m:
            opened[k] = 1 + opened[following[k]]
            left[k] = left[following[k]]
    first = int(np.searchsorted(upto, target))  # of an empty shard, the row that doesn't fit
    if first == 0 and m:
        rows = [(0, opened[0] - 1, left[0], 0)]
    else:
        rows = [(0, 0, total, 0) if first == m else (0, opened[first], left[first], 0)]
    if total < target - 1:
        rows.append((1, 0, total, 1))
    last = int(np.searchsorted(upto, target - 1))
    rows += [(max(1, target - int(upto[p])), opened[p], left[p], 0) for p in range(min(last, m - 1), -1, -1)]
    # for 1 several rows may stand here; the last one is the first that doesn't fit
    unique = {row[0]: row for row in rows}
    return Steps(*(np.array(x, dtype=np.int64) for x in zip(*(unique[a] for a in sorted(unique)), strict=True)))


def composed(one: Steps, two: Steps) -> Steps:
    """The steps of two neighbouring ranges together."""
    closed, left = two(one.left)
    parts = [(one.at, one.closed + closed, left, np.zeros_like(left))]
    for k in np.flatnonzero(one.adds):
        low, most = one.at[k], one.at[k + 1] - 1 if k + 1 < len(one.at) else np.iinfo(np.int64).max - one.left[k]
        inside = two.at[(two.at > low + one.left[k]) & (two.at <= most + one.left[k])]
        starts = np.concatenate([[low + one.left[k]], inside])
        j = np.searchsorted(two.at, starts, side="right") - 1
        moved = np.where(two.adds[j], two.left[j] + one.left[k], two.left[j])
        parts.append((starts - one.left[k], one.closed[k] + two.closed[j], moved, two.adds[j]))
    keep = one.adds == 0
    parts[0] = tuple(x[keep] for x in parts[0])
    at, closed, left, adds = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")
    return Steps(at[order], closed[order], left[order], adds[order])


def _range_steps(key: str, target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, node = [], 0
        for batch in batches:
            if batch.num_rows:
                node = batch.column("_range")[0].as_py()
                sizes.append(batch.column("_bytes").to_numpy())
        if sizes:
            row = _packed(range_steps(np.concatenate(sizes), target))
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.int64()), *(pa.array([row[name]], pa.binary()) for name in Steps._fields)], ["node", *Steps._fields]
            )

    return run


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for row in rows.sort_values("node").to_dict("records"):
        total = _unpacked(row) if total is None else composed(total, _unpacked(row))
    return pd.DataFrame([{"node": rows["node"].iloc[0] // FAN, **_packed(total)}])


def _openings(rows: pd.DataFrame) -> pd.DataFrame:
    """What is open, and how many shards are behind, at the beginning of each child of one node."""
    rows = rows.sort_values("node")
    shard, filled, out = int(rows["shard"].iloc[0]), int(rows["filled"].iloc[0]), []
    for row in rows.to_dict("records"):
        out.append((row["node"], shard, filled))
        closed, left = _unpacked(row)(np.array([filled]))
        shard, filled = shard + int(closed[0]), int(left[0])
    return pd.DataFrame(out, columns=["node", "shard", "filled"])


def range_openings(ranged: DataFrame, key: str, target: int, ranges: int) -> dict[int, tuple[int, int]]:
    """(shard, bytes in it) at the beginning of every range: two numbers for `ROWS_PER_RANGE` rows."""
    levels = [cut_lineage(ranged.mapInArrow(_range_steps(key, target), STEPS))]
    size = ranges
    while size > 1:
        below = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("parent"))
        levels.append(cut_lineage(below.applyInPandas(_compose, STEPS)))
        size = math.ceil(size / FAN)
    schema = "node long, shard long, filled long"
    opened = ranged.sparkSession.createDataFrame([(0, 0, 0)], schema)
    for level in reversed(levels[:-1]):
        parent = opened.withColumnRenamed("node", "parent")
        placed = level.withColumn("parent", F.floor(F.col("node") / FAN)).join(parent, "parent")
        opened = cut_lineage(placed.groupBy("parent").applyInPandas(_openings, schema))
    return {r["node"]: (r["shard"], r["filled"]) for r in opened.collect()}


def _fill(key: str, target_bytes: int, openings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the shards of one sorted range, holding a batch and two numbers at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard, filled = openings.value[batch.column("_range")[0].as_py()]
            upto = np.cumsum(batch.column("_bytes").to_numpy())
            numbers = np.empty(len(upto), dtype=np.int64)
            low, before = 0, 0
            while low < len(upto):
                high = max(low, int(np.searchsorted(upto, before + target_bytes - filled)))
                if high == low and not filled:
                    high = low + 1  # a row that is too large by itself
                numbers[low:high] = shard
                if high > low:
                    filled += int(upto[high - 1]) - before
                    before, low = int(upto[high - 1]), high
                if low < len(upto):
                    shard, filled = shard + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(numbers)], ["_at", "shard"])

    return run


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        yield batch.append_column("_range", pa.array(np.full(batch.num_rows, part), pa.int64()))


def assign_shards(
    df: DataFrame, target_bytes: int = TARGET_BYTES, key: str = "family_id", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows (key, title, abstract) with `shard`: key order is kept and every shard is below the target.

    A shard is closed before a row would bring it to the target; a row at or above the target has a
    shard of its own. The numbers are those of one pass over all keys in order, whatever the
    number of ranges. Rows of one key share a shard.

    Only keys and sizes are sorted. They are written to the checkpoint folder, so a retried task
    sees the same ranges; the texts meet their shard in one join.
    """
    size = F.coalesce(row_size(F.col("title"), F.col("abstract")).cast("long"), F.lit(ROW_OVERHEAD_BYTES).cast("long"))
    sized = cut_lineage(df.select(key, size.alias("_bytes")).groupBy(key).agg(F.sum("_bytes").alias("_bytes")))
    ranges = max(1, math.ceil(sized.count() / rows_per_range))
    kind = dict(df.dtypes)[key]
    ranged = sized.repartitionByRange(ranges, key).sortWithinPartitions(key)
    ranged = cut_lineage(ranged.mapInArrow(_ranged, f"{key} {kind}, _bytes long, _range long"))
    ranges = max(ranges, ranged.rdd.getNumPartitions())
    openings = df.sparkSession.sparkContext.broadcast(range_openings(ranged, key, target_bytes, ranges))
    placed = ranged.mapInArrow(_fill(key, target_bytes, openings), f"_at {kind}, shard long")
    return df.join(placed, F.col(key).eqNullSafe(F.col("_at"))).drop("_at")


def write_shards(df: DataFrame, path: str, key: str = "family_id") -> None:
    """One snappy Parquet file per shard under `path`/shard=N."""
    (
        df.repartition("shard")
        .sortWithinPartitions("shard", key)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy("shard")
        .parquet(path)
    )
