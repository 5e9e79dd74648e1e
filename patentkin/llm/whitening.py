"""Whitened embeddings from a covariance weighted by multiplicity (operator 13).

Equal vectors are grouped first, inside the tasks and then by one shuffle, so a vector that a third
of all rows hold is one row with a count. The groups are the only input of the fit: their weighted
sums give the mean, a weighted product of the centred vectors in every task gives its share of the
covariance, and the shares are added row of the matrix by row. Every distinct vector is whitened
once and joined back to its rows by a key of 128 bits; keys with many rows are salted.

What reaches the driver are d sums, a d x d matrix and the keys with more than a thousandth of all
rows, at most a thousand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.llm.near_dedup import shared_folder

SCALE = 1_024
SHIFT = 100_000
COMPONENTS = 8
CHUNK_ROWS = 4_096
HOT_PART = 1_000
#: Entries from here on cannot be scaled to whole numbers in double precision.
LARGEST = 2.0**42
#: An eigenvalue below this share of the trace is zero but for rounding.
RANK_SHARE = 1e-13
SAFE = 2**62


class Fit(NamedTuple):
    """Mean and covariance of the fit list, its size and exact sums, and the axes with their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or empty and holds finite numbers below LARGEST only."""
    entry = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & entry)


def whole_numbers(vector: str) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _key(x: str) -> list[Column]:
    return [F.xxhash64(x).alias("key_a"), F.xxhash64(F.lit(SHIFT), x).alias("key_b")]


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch], kind: type, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, weights) of at most CHUNK_ROWS rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(low, CHUNK_ROWS)
            weight = part.column("copies").to_numpy(zero_copy_only=False)
            yield _matrix(part.column("x"), kind), weight if weighted else np.ones_like(weight)


def weighted_sums(groups: DataFrame, weighted: bool) -> tuple[int, list[int]]:
    """(sum of the weights, exact weighted sums per dimension) of whole-number vectors `x`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, 0
        for x, weight in _chunks(batches, np.int64, weighted):
            total += int(weight.sum())
            if int(np.abs(x).max()) * int(weight.sum()) >= SAFE:
                x, weight = x.astype(object), weight.astype(object)
            sums = sums + (weight @ x).astype(object)
        if total:
            values = [total, *sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(sums)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
                ["dim", "share"],
            )

    shares = groups.mapInArrow(run, "dim int, share decimal(38,0)")
    found = {r["dim"]: int(r["total"]) for r in shares.groupBy("dim").agg(F.sum("share").alias("total")).collect()}
    return found.pop(-1, 0), [found[k] for k in range(len(found))]


def weighted_scatter(groups: DataFrame, centre: np.ndarray, weighted: bool) -> np.ndarray:
    """Sum of weight * (x - centre)(x - centre)' over the vectors `x`.

    A task gives out one matrix, row by row; the rows with one number are added in a stream.
    """
    d = len(centre)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, weight in _chunks(batches, np.float64, weighted):
            x = x - centre
            share = (x * weight[:, None]).T @ x
            total = share if total is None else total + share
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["dim", "share"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, share in zip(batch.column("dim").to_pylist(), _matrix(batch.column("share"), np.float64), strict=True):
                sums[dim] = sums[dim] + share if dim in sums else share.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["dim", "share"]
            )

    schema = "dim int, share array<double>"
    tasks = groups.mapInArrow(product, schema)
    rows = tasks.repartition("dim").mapInArrow(add, schema).collect()
    out = np.zeros((d, d))
    for row in rows:
        out[row["dim"]] = row["share"]
    return out


def fit(groups: DataFrame, components: int, weighted: bool) -> Fit:
    """Axes of the covariance of the fit list by falling eigenvalue."""
    n, sums = weighted_sums(groups, weighted)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    centre = np.array([s / n for s in sums])
    covariance = weighted_scatter(groups, centre, weighted) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    take = np.argsort(-values, kind="stable")[:components]
    return Fit(n, sums, vectors[:, take], values[take], float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Exact sums over the dimensions of (n * x - sums)^2; null where one has more than 38 digits."""
    largest = max(int(np.abs(x).max()) * n, max(abs(s) for s in sums))
    if largest < SAFE:
        z = n * x - np.array(sums, dtype=np.int64)
        most = int(np.abs(z).max())
        if most * most * x.shape[1] < 2**63:
            return [Decimal(v) for v in (z * z).sum(axis=1).tolist()]
        z = z.astype(object)
    else:
        z = n * x.astype(object) - np.array(sums, dtype=object)
    return [Decimal(int(v)) if v < 10**38 else None for v in (z * z).sum(axis=1)]


def whiten_groups(groups: DataFrame, found: Fit) -> DataFrame:
    """Every distinct vector once: key_a, key_b, copies, deviation, x (its coordinates on the axes, of unit variance)."""
    n, sums, axes, values, trace = found
    centre = np.array([s / n for s in sums])
    real = values > RANK_SHARE * max(trace, 0.0)
    scaled = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(low, CHUNK_ROWS)
                x = _matrix(part.column("x"), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("key_a", "key_b", "copies")]
                    + [
                        pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                        pa.array(list((x - centre) @ scaled), pa.list_(pa.float64())),
                    ],
                    ["key_a", "key_b", "copies", "deviation", "x"],
                )

    schema = "key_a long, key_b long, copies long, deviation decimal(38,0), x array<double>"
    return groups.select("key_a", "key_b", "copies", "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, found: Fit, weighted: bool) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, over axes of some variance."""
    real = found.eigenvalues > RANK_SHARE * max(found.trace, 0.0)
    if not real.any():
        return 0.0
    first = weighted_scatter_mean(whitened, len(found.eigenvalues), weighted) / found.n
    covariance = weighted_scatter(whitened, first, weighted) / found.n
    return float(np.abs(covariance - np.eye(len(real)))[np.ix_(real, real)].max())


def weighted_scatter_mean(groups: DataFrame, d: int, weighted: bool) -> np.ndarray:
    """Weighted sums per dimension of vectors `x` of any numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(d)
        for x, weight in _chunks(batches, np.float64, weighted):
            sums = sums + weight @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(sums)], ["dim", "share"])

    shares = groups.mapInArrow(run, "dim int, share double").groupBy("dim").agg(F.sum("share").alias("total"))
    out = np.zeros(d)
    for row in shares.collect():
        out[row["dim"]] = row["total"]
    return out


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """`df` as a table in the shared folder, where equal numbers take little room."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _joined(rows: DataFrame, whitened: DataFrame, total: int) -> DataFrame:
    """Rows with what their vector has; a key with more than 1 / HOT_PART of the rows is dealt to several tasks."""
    limit = max(1, total // HOT_PART)
    parts = F.ceil(F.col("copies") / limit).cast("int")
    # fewer than HOT_PART keys by the limit
    hot = F.broadcast(whitened.where(F.col("copies") > limit).select("key_a", "key_b", parts.alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_key"), F.col("parts"))).cast("int")
    dealt = rows.join(hot, ["key_a", "key_b"], "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.when(F.col("copies") > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))
    return dealt.join(whitened.withColumn("part", copies), ["key_a", "key_b", "part"]).drop("part")


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "counts"
) -> DataFrame:
    """One row per usable row of `df` and component: `key`, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers x = floor(1024 * c) + 100000. The fit list is all usable vectors
    (`weights="counts"`) or every distinct one once (`weights="ones"`); n is its length, and every
    covariance over it is centred and divided by n. Components are the eigenvectors by falling
    eigenvalue, min(`components`, dimensions) of them. deviation is the exact sum of (n * x - S)^2
    with S the sums of the list (null beyond 38 digits), explained the eigenvalue's share of the trace, and identity_error
    one value: how far the covariance of the whitened list is from the identity.

    Rows go when their vector is null or empty or holds a null or non-finite entry, or one from
    2^42 on, or when it is of another length than most (ties: the longer). Equal vectors have equal
    results; rows with one or a null key stay rows of their own. A component without variance
    has a null whitened and counts in no identity_error; with no variance at all explained is 0.
    Other columns are not read. An empty table gives no rows.
    """
    if weights not in ("counts", "ones"):
        raise ValueError("weights are counts or ones")
    spark, weighted = df.sparkSession, weights == "counts"
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    x = usable(df, vector).select(F.col(key).alias("row_key"), whole_numbers(vector).alias("x"))
    groups = _stored(x.groupBy("x").agg(F.count("*").alias("copies")).select(*_key("x"), "copies", "x"), f"{folder}/groups")
    lengths = groups.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    d, total = (usual["d"], usual["rows"]) if usual else (0, 0)
    groups = groups.where(F.size("x") == d)
    found = fit(groups, components, weighted)
    axes = len(found.eigenvalues)
    if found.n:
        whitened = _stored(whiten_groups(groups, found), f"{folder}/whitened")
        error = identity_error(whitened, found, weighted)
    else:
        whitened = groups.select(
            "key_a", "key_b", "copies", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.col("x").cast("array<double>")
        )
        error = 0.0
    real = [bool(v > RANK_SHARE * max(found.trace, 0.0)) for v in found.eigenvalues]
    share = [float(v / found.trace) if r else 0.0 for v, r in zip(found.eigenvalues, real, strict=True)]
    table = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                (F.get("x", F.lit(k)) if real[k] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(share[k]).alias("explained"),
            )
            for k in range(axes)
        ]
    ) if axes else F.expr("array_remove(array(named_struct('component', 0, 'whitened', 0D, 'explained', 0D)), null)")
    rows = _joined(x.where(F.size("x") == d).select("row_key", *_key("x")), whitened, total)
    return rows.select("row_key", "deviation", F.explode(table).alias("c")).select(
        F.col("row_key").alias(key), "c.component", F.lit(found.n).cast("long").alias("n"), "deviation",
        "c.whitened", "c.explained", F.lit(error).alias("identity_error"),
    )
