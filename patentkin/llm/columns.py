"""Columns that a stage passes on without looking at them, whatever their names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST = "rest"


def nested(docs: DataFrame, *own: str) -> DataFrame:
    """The columns in `own` that `docs` has, and all others in one struct by their places.

    Inside a stage no other name can then clash with one of its own, and names with dots need no care.
    """
    kept = [F.col(c) for c in own if c in docs.columns]
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in own]
    return docs.select(*kept, F.struct(*rest, F.lit(0).alias("none")).alias(REST))


def restored(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """`df`, made from `nested(docs, *own)`, with the columns of `docs` under their names and in their order."""
    return df.select(*[F.col(c) if c in own else F.col(f"{REST}.c{k}").alias(c) for k, c in enumerate(docs.columns)])
