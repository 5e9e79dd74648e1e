"""Buckets of consecutive ids, so that work along an order needs no single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_PARTITION = 4


def bucket_number(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket(value: Column, tops: list[int]) -> Column:
    """Number of `tops` (ascending) below the value, by binary search; 0 for null."""
    if not tops:
        return F.lit(0)
    known = F.lit(tops).cast("array<bigint>")
    steps = F.array(*[F.lit(2**k) for k in reversed(range(len(tops).bit_length()))])
    step = lambda at, by: F.when(F.get(known, at + by - 1) < value, at + by).otherwise(at)
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), step))


def tops(df: DataFrame, column: str) -> list[int]:
    """Largest ids of about equally full buckets of consecutive ids, ascending, all of them in the table.

    As many numbers come to the driver as there are buckets, a multiple of the shuffle partitions.
    """
    n = bucket_number(df)
    shares = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    near = df.agg(F.percentile_approx(column, shares, F.lit(max(10_000, 10 * n))).alias("p")).first()["p"]
    part = bucket(F.col(column), sorted(set(near or [])))
    exact = df.where(F.col(column).isNotNull()).groupBy(part.alias("b")).agg(F.max(column).alias("top"))
    return sorted(row["top"] for row in exact.collect())
